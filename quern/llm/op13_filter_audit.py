"""What each filter removes, alone and in every order.

Filters judge whole texts, so their order changes only which of them is said to
remove a document.  A document is a mask of the filters it fails; documents of
one part with equal masks and labels are one weighted cell, at most 4 * 2^n a
part.  Each cell folds over the constant array of all n! orders: an ``aggregate``
inside a ``transform`` walks an order and leaves a struct per step; the cells'
arrays (600 structs for five filters) are merged by elementwise sums.

Texts are read once: flags are counted with array arithmetic, in parts if a text
is long, and only a digest of the text goes on.  Copies are told from the first
of their text by a join on (digest, smallest id), so a text that a third of all
rows share is no key of its own anywhere but in sums that start on the map side.

A null text is empty, a null part the empty string.  Rows that repeat id, text
and part are counted as often as they come; none of them is an earlier copy of
another.  A row without id counts as later than all ids and fails the copy filter
if a row with an id has its text; two rows without id are no copies of each other.
Labels that repeat an id count if any of them is 1.  An empty table has no parts
and gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.words import BLANKS, Tally, counted, parts, raw
from quern.session import stash

FILTERS = "ABCDE"
#: Bits of a mask, by filter: short, repetitive, capitals, signs, copy.
SHORT, REPEATED, CAPITALS, SIGNS, COPY = (1 << k for k in range(len(FILTERS)))
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
MARKED = np.zeros(256, bool)
MARKED[[ord(c) for c in "#$%&*|"]] = True


def text_masks(texts: pa.Array, least_words: int, distinct_percent: int, capital_percent: int) -> np.ndarray:
    """Mask of the filters that look at the text alone, per row."""
    n, tally = len(texts), Tally(len(texts))
    capitals, points, marks = (np.zeros(n, np.int64) for _ in range(3))
    for first, some in parts(texts, BLANKS):
        data, at = raw(some)
        for out, flags in ((capitals, UPPER[data]), (points, (data & 0xC0) != 0x80), (marks, MARKED[data])):
            upto = counted(flags)
            out[first : first + len(some)] += np.diff(np.where(at > 0, upto[at - 1] if len(upto) else 0, 0))
        tally.add(first, some, BLANKS)
    words, distinct = tally.words, tally.distinct
    return SHORT * (words < least_words) + REPEATED * (100 * distinct < distinct_percent * words) + CAPITALS * (100 * capitals > capital_percent * points) + SIGNS * (marks > 0)


def filter_masks(docs: DataFrame, least_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask, n: a row per distinct id, text and part, n times in docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = text_masks(batch.column("text"), least_words, distinct_percent, capital_percent)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "digest")] + [pa.array(mask.astype(np.int32))], ["doc_id", "part", "digest", "mask"])

    flagged = rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")
    flagged = stash(flagged.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "masks")
    # the first of each text, and a second entry that only rows without id can meet
    firsts = flagged.groupBy("digest").agg(F.min("doc_id").alias("first")).filter("first is not null")
    firsts = firsts.select(F.col("digest").alias("same"), F.explode(F.array("first", F.lit(None).cast("long"))).alias("first"), F.lit(True).alias("met"))
    out = flagged.join(firsts, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("same")), "left")
    copy = F.when(F.col("doc_id").isNull(), F.col("met").isNotNull()).otherwise(F.col("met").isNull())
    return out.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, COPY).otherwise(0)).alias("mask"), "n")


def folded(cell: Column, orders: Column) -> Column:
    """A cell's share in every step of every order, as one array of structs."""

    def step(state: Column, f: Column) -> Column:
        fails, before = cell.mask.bitwiseAND(f) != 0, cell.mask.bitwiseAND(state.seen) != 0
        lost = fails & ~before
        share = lambda test, of: F.when(test, cell[of]).otherwise(F.lit(0).cast("long"))
        told = [(~fails & ~before, "n"), (lost, "n"), (fails & before, "n"), (cell.mask == f, "n"), (lost, "good"), (lost, "bad")]
        entry = F.struct(*(share(*t).alias(c) for t, c in zip(told, COUNTS, strict=True)))
        return F.struct(state.seen.bitwiseOR(f).alias("seen"), F.concat(state.steps, F.array(entry)).alias("steps"))

    start = F.struct(F.lit(0).alias("seen"), F.array().cast(f"array<{ENTRY}>").alias("steps"))
    return F.flatten(F.transform(orders, lambda o: F.aggregate(o, start, step, lambda s: s.steps)))


ENTRY = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def audited(masks: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """masks (doc_id, part, mask, n), labels (doc_id, quality, toxic) -> a row per
    part, order of the filters and step, with counts and the sum of what the step's
    filter removes over all orders."""
    told = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("bad"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c)
    cells = masks.join(told, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("bad"))
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))

    names = list(permutations(filters))
    bit = {f: 1 << k for k, f in enumerate(filters)}
    orders = F.expr(f"array({', '.join(f'array({', '.join(str(bit[f]) for f in o)})' for o in names)})")
    told_orders = F.split(F.lit(",".join(map("".join, names))), ",")
    zero = F.array_repeat(F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS)), len(names) * len(filters))
    summed = lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS))
    merged = by_part.select("part", F.aggregate("cells", zero, lambda all_, cell: F.zip_with(all_, folded(cell, orders), summed)).alias("merged"))
    rows = merged.select("part", F.posexplode("merged").alias("at", "c"))
    rows = rows.select("part", F.get(told_orders, F.expr(f"at div {len(filters)}").cast("int")).alias("filter_order"), (F.col("at") % len(filters) + 1).alias("step"), "c.*")
    rows = rows.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    shares = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "filter"]).select("part", "filter_order", "step", "filter", *COUNTS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The audit of the five filters over docs; settings as for filter_masks."""
    return audited(filter_masks(docs, **settings), labels)


def _orders_sql() -> str:
    letters = [f"(select unnest(list_value({', '.join(repr(f) for f in FILTERS)})) as f{k})" for k in range(len(FILTERS))]
    distinct = " and ".join(f"f{a} <> f{b}" for b in range(len(FILTERS)) for a in range(b))
    return f"select {' || '.join(f'f{k}' for k in range(len(FILTERS)))} as filter_order from {', '.join(letters)} where {distinct}"


ORACLE_SQL = f"""
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
words as (select doc_id, part, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from texts),
firsts as (select t, min(doc_id) as first from texts group by t),
told as (select doc_id, coalesce(max(case when quality = 1 then 1 end), 0) as good, coalesce(max(case when toxic = 1 then 1 end), 0) as bad from labels group by doc_id),
masks as (
  select part, good, bad,
    (case when len(w) < 50 then 'A' else '' end)
    || (case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end)
    || (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' else '' end)
    || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end)
    || (case when doc_id > first then 'E' else '' end) as mask
  from words join firsts using (t) left join told using (doc_id)),
cells as (select part, mask, coalesce(good, 0) as good, coalesce(bad, 0) as bad, count(*) as n from masks group by all),
orders as ({_orders_sql()}),
steps as (select filter_order, s.step, substr(filter_order, s.step, 1) as filter, substr(filter_order, 1, s.step - 1) as before from orders, (select unnest([1, 2, 3, 4, 5]) as step) s),
met as (
  select c.*, filter_order, step, filter, contains(mask, filter) as fails,
    len(list_filter(string_split(before, ''), lambda f: f <> '' and contains(mask, f))) > 0 as gone
  from cells c, steps),
counts as (
  select part, filter_order, step, filter,
    sum(case when not fails and not gone then n else 0 end)::bigint as kept,
    sum(case when fails and not gone then n else 0 end)::bigint as removed,
    sum(case when fails and gone then n else 0 end)::bigint as redundant,
    sum(case when mask = filter then n else 0 end)::bigint as unique_fails,
    sum(case when fails and not gone and good = 1 then n else 0 end)::bigint as good_lost,
    sum(case when fails and not gone and bad = 1 then n else 0 end)::bigint as toxic_lost
  from met group by all)
select part, filter_order, step::int as step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, filter))::bigint as shapley
from counts
"""
