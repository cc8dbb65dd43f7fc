"""Importance resampling towards a target distribution.

Features are all runs of ``smallest`` to ``largest`` consecutive words, hashed to
buckets by CRC-32.  A bucket's gain is the smoothed log ratio of its share in the
targets and in the documents, a document's weight the floored mean of its features'
gains; adding a Gumbel variable made of a hash of the id and taking the highest
scores draws documents without replacement in proportion to their importance.

Words come from Arrow kernels (ascii_lower, split_pattern_regex, list_flatten,
dictionary_encode).  Runs of several words are formed by shifting the dictionary
indices; only distinct runs are joined to text and hashed, and gains go back to all
occurrences with take and a segmented sum.  Texts are read twice: once to sum the
buckets (at most ``buckets`` rows a task are shuffled), once to weigh.  The table of
gains, ``buckets`` numbers, is all that tasks share.  Long texts are taken in parts.

Scores are whole numbers of a bounded range, so their histogram gives the lowest
score drawn; only rows from there on are ranked, by a range partitioning on all that
orders them and the parts' sizes.

A null text has no words and weight 0.  A null id is hashed as an empty one and comes
last among equal scores.  Rows that repeat an id are drawn each on its own; those that
are alike in everything else too take consecutive ranks.  Empty tables of documents or
targets work as counts of zero.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.words import NOT_ALNUM, parts
from quern.session import stash

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's row and number, and the distinct words by number."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(full).dictionary_encode()
    return rows.filter(full).to_numpy(), coded.indices.to_numpy().astype(np.int64), coded.dictionary


class Features:
    """Buckets of the features of texts that come in parts."""

    def __init__(self, smallest: int, largest: int, buckets: int):
        if not 1 <= smallest <= largest:
            raise ValueError("runs have at least one word")
        self.orders, self.buckets = range(smallest, largest + 1), buckets
        self.row, self.tail = -1, pa.array([], pa.large_string())

    def of(self, first: int, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each feature's row and bucket, and the rows' numbers of words.

        A text of the same row as the one before goes on where that ended: its
        last words are set before the text, and runs of them alone left out.
        """
        rows, codes, names = words_of(texts)
        n_words, old = np.bincount(rows, minlength=len(texts)), 0
        goes_on = first == self.row
        if goes_on and len(self.tail):
            old = len(self.tail)
            coded = pa.concat_arrays([self.tail, names.take(pa.array(codes))]).dictionary_encode()
            codes, names, rows = coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.zeros(old + len(rows), np.int64)
        out_rows, out = [], []
        run, texts_of_run = codes, names
        for m in range(1, self.orders[-1] + 1):
            if m > 1:
                # a run is the run before and the word after it, if both are of one row
                inside = rows[m - 1 :] == rows[: max(len(rows) - m + 1, 0)]
                pair = np.where(inside, run[: len(inside)] * len(names) + codes[m - 1 :], -1)
                distinct, number = np.unique(pair, return_inverse=True)
                skip = int(len(distinct) and distinct[0] < 0)
                texts_of_run = pc.binary_join_element_wise(texts_of_run.take(pa.array(distinct[skip:] // len(names))), names.take(pa.array(distinct[skip:] % len(names))), pa.scalar(" ", names.type))
                run = number - skip
            if m in self.orders:
                hashed = np.fromiter((zlib.crc32(t.encode()) % self.buckets for t in texts_of_run.to_pylist()), np.int64, len(texts_of_run))
                at = np.flatnonzero(run >= 0)
                at = at[at + m > old]
                out_rows.append(rows[at])
                out.append(hashed[run[at]])
        self.row = first + len(texts) - 1
        last = rows == len(texts) - 1 if not old else np.ones(len(rows), bool)
        keep = np.flatnonzero(last)[-(self.orders[-1] - 1) :] if self.orders[-1] > 1 else np.zeros(0, np.int64)
        kept = names.take(pa.array(codes[keep]))
        self.tail = kept if len(keep) or not goes_on else self.tail
        order = np.argsort(np.concatenate(out_rows), kind="stable") if len(out) > 1 else slice(None)
        return np.concatenate(out_rows)[order] + first, np.concatenate(out)[order], n_words


def bucket_counts(texts: DataFrame, text: Column, smallest: int, largest: int, buckets: int) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            features = Features(smallest, largest, buckets)
            for first, some in parts(batch.column("text"), NOT_ALNUM):
                total += np.bincount(features.of(first, some)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return texts.select(text.cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket in thousandths, from the two tables of bucket_counts."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, found in ((s, source), (t, target)):
        for r in found.collect():
            counts[r.bucket] = r.n
    whole_s, whole_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((float(b + 1) * whole_s) / (float(a + 1) * whole_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, smallest: int, largest: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n_words, n_features, weight: a row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            features = Features(smallest, largest, buckets)
            for first, some in parts(batch.column("text"), NOT_ALNUM):
                rows, found, n_words = features.of(first, some)
                words[first : first + len(some)] += n_words
                if len(rows):
                    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                    n[rows[begins]] += np.diff(np.append(begins, len(rows)))
                    total[rows[begins]] += np.add.reduceat(shared.value.take(found), begins)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *map(pa.array, (words, n, weight))], ["doc_id", "text_key", "n_words", "n_features", "weight"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel variable in thousandths, fixed by seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_sampled(docs: DataFrame, targets: DataFrame, percent: int, smallest: int = 1, largest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every row of docs as doc_id, text_key, n_words, n_features, weight, score and
    rank; rank is null unless the row is among the floor(percent * N / 100) drawn of
    the N rows with least_words words or more.  text_key: xxhash64 of the text."""
    source = bucket_counts(docs, F.col(text_col), smallest, largest, buckets)
    gains = gains_of(source, bucket_counts(targets, F.col(target_col), smallest, largest, buckets), buckets)
    scored = stash(weighed(docs, gains, smallest, largest, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")

    takes_part = F.col("n_words") >= least_words
    # whole numbers between twice the least and the greatest logarithm in thousandths
    histogram = sorted((r.score, r.n) for r in scored.filter(takes_part).groupBy("score").agg(F.count("*").alias("n")).collect())
    wanted, lowest = percent * sum(n for _, n in histogram) // 100, None
    reached = 0
    while reached < wanted:
        lowest, n = histogram.pop()
        reached += n
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    drawn = takes_part & (F.col("score") >= lowest)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "text_key", "n_words", "n_features", "weight"]
    # rows that are alike in all of these are one row while they are ordered
    alike = scored.filter(drawn).groupBy(*scored.columns).agg(F.count("*").alias("times"))
    ordered = alike.repartitionByRange(docs.sparkSession.sparkContext.defaultParallelism, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    placed = stash(ordered.withColumns({"part": F.shiftright(number, 33), "place": number}), "placed")
    sizes = sorted(placed.groupBy("part").agg(F.sum("times").alias("n")).collect())
    before = np.append(0, np.cumsum([r.n for r in sizes])).tolist()
    begins = placed.sparkSession.createDataFrame([(r.part, b) for r, b in zip(sizes, before, strict=False)], "part long, before long")
    running = F.sum("times").over(Window.partitionBy("part").orderBy("place")) - F.col("times")
    ranked = placed.withColumn("running", running).join(F.broadcast(begins), "part")
    first = F.col("before") + F.col("running") + 1
    ranked = ranked.withColumn("rank", F.explode(F.sequence(first, first + F.col("times") - 1)))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scored.columns, "rank")
    return ranked.unionByName(scored.filter(~F.coalesce(drawn, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, sampled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that importance_sampled drew, in all their columns."""
    drawn = sampled.filter("rank is not null").select(F.col("doc_id").alias("quern_id"), F.col("text_key").alias("quern_key")).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("quern_id")) & F.xxhash64(F.col(text_col).cast("string")).eqNullSafe(F.col("quern_key"))
    return docs.join(drawn, same, "left_semi")


ORACLE_SQL = r"""
with crc_table as (select list(list_reduce(list_prepend(b::bigint, range(8)), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by b) as t from range(256) r(b)),
texts as (select 's' as side, doc_id as id, text from documents union all select 't', item_id, text from benchmark),
words as (
  select side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w
  from texts),
bytes as (select w, hex(encode(w)) as h from (select distinct w from words)),
hashed as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: (('0x' || substr(h, 2 * i + 1, 2))::int)::bigint)),
      lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 10000 as bucket
  from bytes, crc_table),
counts as (select bucket, count(*) filter (side = 's') as s, count(*) filter (side = 't') as t from words join hashed using (w) group by bucket),
whole as (select coalesce(sum(s), 0) as s, coalesce(sum(t), 0) as t from counts),
gains as (select bucket, floor(1000 * ln(((c.t + 1)::double * (w.s + 10000)::double) / ((c.s + 1)::double * (w.t + 10000)::double)))::bigint as gain from counts c, whole w),
weights as (select id as doc_id, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from words join hashed using (w) join gains using (bucket) where side = 's' group by id),
scored as (
  select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln(((('0x' || substr(sha256('2024:' || doc_id::varchar), 1, 8))::bigint) + 0.5)::double / 4294967296)))::bigint as score
  from documents left join weights using (doc_id)),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, (case when r <= 10 * n // 100 then r end)::bigint as rank
from scored left join drawn using (doc_id)
"""
