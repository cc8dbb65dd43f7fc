"""Benchmark decontamination; DataFrame and SQL functions only.

Texts are compared by shingles of ``size`` words (lower case), by their
multiplicities: common shingles over all shingles of an item and of a window of
a document that has the item's length in words.

Windows are laid where they can be like an item.  A window that reaches the threshold holds at least one of an item's few rarest
shingles (its *seeds*: at 0.8 a fifth of them), since it can't lack them all.
Around each seed in a document the stretch is cut out that holds all windows
with that seed.  The best window of a stretch may be taken to end at a shingle
of the item (moved to the left until it does, it loses nothing), or to begin the
document.  Of those, the ones are left out that share too few shingles for the
threshold, or for the best of the stretch.

The others, and the items, get 64-bit SimHash fingerprints of their shingles.
Both are cut into radius + 1 blocks: of two fingerprints at most radius bits
apart one block at least is equal, so a join on length and block brings to every
window all items within the radius, whichever item's seed it was laid for.  Those
are verified exactly.  At a similarity of 0.8 fingerprints differ
by 10 bits on average with a deviation of 3; the radius of 23 leaves out less
than one pair in a million.

Seeds are broadcast in blocks of at most ``block_rows``; a larger benchmark
takes several passes over the documents.  Stretches with equal shingles are
looked at once, however many documents hold them.

Items of fewer than ``size`` words are one shingle of that many words; items
and documents without words take no part.  A document shorter than an item is
one window.  Null text counts as empty.  Rows with a null id or a repeated id
are searched like others and reported under that id; items with a null id are
looked for like others and reported as null.  Items are verified by their
contents.  Empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import few, stash, unstash

_SLOW = "aggregate(sequence(0, 63), 0L, (bits, b) -> bits | shiftleft(if(aggregate(shingles, 0, (t, x) -> t + cast(shiftright(x, b) & 1L as int) * 2 - 1) > 0, 1L, 0L), b))"
# four bits of each shingle are counted at once, in lanes of 16 bits
_LANES = "array(" + ", ".join(f"aggregate(shingles, 0L, (t, x) -> t + (shiftrightunsigned(x, {j}) & 281479271743489L))" for j in range(16)) + ")"
_FAST = f"aggregate(transform({_LANES}, (n, j) -> aggregate(sequence(0, 3), 0L, (bits, k) -> bits | shiftleft(if(2 * (shiftrightunsigned(n, 16 * k) & 65535L) > size(shingles), 1L, 0L), 16 * k + j))), 0L, (bits, x) -> bits | x)"
FINGERPRINT = f"if(size(shingles) > 65535, {_SLOW}, {_FAST})"
COMMON = "aggregate(array_distinct(array_intersect(w, i)), 0, (t, s) -> t + least(size(filter(w, x -> x = s)), size(filter(i, x -> x = s))))"
FOUND = "doc_id long, text_key long, item_id long, start int, n_words int, similarity double"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[ \x09-\x0D]+"), "")


def shingled(df: DataFrame, size: int) -> DataFrame:
    """words -> n (words), shingles (hashes of size successive words)."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("h"))
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - size), lambda k: F.xxhash64(*(F.get("h", k + j) for j in range(size))))
    return df.withColumn("shingles", F.when(F.col("n") >= size, grams).otherwise(F.array().cast("array<bigint>"))).drop("words", "h")


def blocks(fingerprint: Column, radius: int) -> Column:
    """The radius + 1 blocks of 64 bits, each with its number."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*(F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).bitwiseOR(F.lit(k << 56)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))))  # noqa: B905


def named_by_contents(column: str) -> Column:
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.reverse(column)).alias("b"))


def leaked_windows(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, radius: int = 23, block_rows: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), item_id, start (word, from 0),
    n_words, similarity: of each document and item, the most similar window
    (ties: the first) that reaches the threshold."""
    parts = items.select(F.col(item_col).cast("long").alias("item_id"), words_of(F.col(item_text_col)).alias("words")).filter(F.size("words") > 0)
    lengths = [r.k for r in parts.select(F.least(F.size("words"), F.lit(size)).alias("k")).distinct().collect()]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    found = [_leaked(texts, parts.filter(F.least(F.size("words"), F.lit(size)) == k), k, threshold, radius, block_rows) for k in sorted(lengths)]
    if not found:
        return docs.sparkSession.createDataFrame([], FOUND)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n_words")).alias("b")
    return out.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", (-F.col("b.before")).alias("start"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))


def seeds_of(items: DataFrame, threshold: float) -> DataFrame:
    """s, item, m: of each item the rarest shingles, as many as a similar window can't lack."""
    each = items.select("item", "m", F.posexplode("i").alias("q", "s"))
    rare = each.join(each.groupBy("s").agg(F.count("*").alias("n")), "s")
    order = "row_number() over (partition by item order by n, s, q)"
    return rare.withColumn("rank", F.expr(order)).filter(F.col("rank") <= F.col("m") - F.ceil(F.lit(threshold) * F.col("m") - 1e-9) + 1).select("s", "item", "m").distinct()


def _leaked(texts: DataFrame, parts: DataFrame, size: int, threshold: float, radius: int, block_rows: int) -> DataFrame:
    wanted = shingled(parts, size).withColumn("item", named_by_contents("shingles"))
    named = stash(wanted.select("item", "item_id", F.col("n").alias("n_words")).distinct(), "named")
    items = wanted.dropDuplicates(["item"]).withColumn("own", F.expr(FINGERPRINT)).select("item", F.col("shingles").alias("i"), F.size("shingles").alias("m"), "own", blocks(F.col("own"), radius).alias("own_blocks"))
    items = stash(items, "items")
    seeds = stash(seeds_of(items, threshold), "seeds")
    passes = math.ceil(seeds.count() / block_rows)
    # the outer forms of explode, since for the inner ones the optimiser adds a filter on the
    # array's size below the projections, which computes the array again
    searched = shingled(texts, size).select("doc_id", "text_key", "shingles", F.posexplode_outer("shingles").alias("p", "s"))
    laid = None
    for k in range(max(passes, 1)):
        hit = searched.join(F.broadcast(seeds.filter(F.pmod(F.xxhash64("s"), F.lit(max(passes, 1))) == k)), "s")
        block = F.expr("p - p % m")
        low = F.greatest(F.lit(0), block - F.col("m") + 1)
        cut = hit.select("doc_id", "text_key", "item", low.alias("low"), F.slice("shingles", low + 1, block + 2 * F.col("m") - 1 - low).alias("stretch"))
        laid = cut if laid is None else laid.union(cut)
    laid = laid.dropDuplicates(["doc_id", "text_key", "item", "low"]).withColumns({"x": named_by_contents("stretch"), "head": F.col("low") == 0})
    laid = stash(laid, "stretches")
    held = ["item", "x", "head"]
    alike = stash(_alike(laid.dropDuplicates(held).select(*held, "stretch"), items, threshold, radius), "alike")
    unstash(seeds, items)
    return laid.select("doc_id", "text_key", *held, "low").join(few(alike, 200_000), held).drop("item").join(few(named.withColumnRenamed("item", "like")), "like").select("doc_id", "text_key", "item_id", (F.col("low") + F.col("start")).alias("start"), "n_words", "similarity")


def _alike(stretches: DataFrame, items: DataFrame, threshold: float, radius: int) -> DataFrame:
    """item (the one whose seed the stretch was cut for), x, head, like (the item found),
    start, similarity: the best window of each stretch that is like an item.
    items are of document size, so no more than a few thousand are broadcast."""
    m, hits = F.col("m"), F.col("hits")
    least = F.lit(threshold) * (m + F.col("all")) / F.lit(1 + threshold) - 1e-9  # common shingles that reach the threshold
    looked = (
        stretches.join(few(items, 5_000), "item")
        .withColumn("hits", F.filter(F.transform("stretch", lambda s, j: F.when(F.array_contains("i", s), j).otherwise(-1)), lambda j: j >= 0))
        .withColumn("all", F.least(m, F.size("stretch")))
        .withColumn("need", F.ceil(least).cast("int"))
        .withColumn("ends", F.filter(F.transform("hits", lambda e, r: F.when((e >= m - 1) & (r >= F.col("need") - 1) & (F.get("hits", r - F.col("need") + 1) > e - m), e).otherwise(-1)), lambda e: e >= 0))
        .withColumn("starts", F.array_distinct(F.concat(F.when(F.col("head"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.transform("ends", lambda e: e - m + 1))))
        .withColumn("windows", F.filter(F.transform("starts", lambda a: F.struct(F.size(F.filter(hits, lambda h: (h >= a) & (h < a + m))).alias("shared"), (-a).alias("before"))), lambda w: w.shared >= F.col("need")))
        .withColumn("top", F.array_max("windows"))
        # what the window with most shared places has in common for certain
        .withColumn("w", F.expr("slice(stretch, 1 - top.before, m)"))
        .withColumn("sure", F.expr(COMMON))
        .select("item", "x", "head", "stretch", "m", F.explode_outer(F.filter("windows", lambda w: (w.shared > F.col("sure")) | (w.shared == F.col("sure")) & (w.before >= F.col("top.before")))).alias("window"))
        .filter("window is not null")
        .select("item", "x", "head", "m", (-F.col("window.before")).alias("start"), F.expr("slice(stretch, 1 - window.before, m)").alias("w"))
        .withColumn("shingles", F.col("w"))
        .withColumn("fingerprint", F.expr(FINGERPRINT))
        .drop("shingles")
    )
    # the block index: windows and items of a length meet where a block is equal, each pair at its first one
    asked = looked.select("*", F.explode(blocks(F.col("fingerprint"), radius)).alias("block"))
    held = items.select(F.col("item").alias("like"), "i", "own", F.col("m").alias("own_m"), F.explode("own_blocks").alias("own_block"))
    met = asked.join(few(held, 5_000 * (radius + 1)), (F.col("m") == F.col("own_m")) & (F.col("block") == F.col("own_block")))
    first = F.get(F.array_intersect(blocks(F.col("fingerprint"), radius), blocks(F.col("own"), radius)), F.lit(0))
    near = met.filter((F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("own"))) <= radius) & (F.col("block") == first))
    common = near.select("item", "x", "head", "like", "start", F.expr(COMMON).alias("c"), (F.size("w") + F.size("i")).alias("both"))
    reached = common.withColumn("similarity", F.col("c") / (F.col("both") - F.col("c"))).filter(F.col("similarity") >= threshold)
    best = reached.groupBy("item", "x", "head", "like").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("b"))
    return best.select("item", "x", "head", "like", (-F.col("b.before")).alias("start"), F.col("b.similarity").alias("similarity"))


#: The same for a size of 5 and a threshold of 0.8, over all windows that hold a shingle of an item.
ORACLE_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[^ \x09-\x0D]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \x09-\x0D]+') AS words FROM benchmark),
i AS (SELECT item_id, len(words) AS n, least(5, len(words)) AS k, len(words) - least(5, len(words)) + 1 AS m, words FROM b WHERE len(words) > 0),
iplaces AS (SELECT item_id, n, k, m, words, unnest(range(m)) AS q FROM i),
igrams AS (SELECT item_id, n, k, m, array_to_string(words[q + 1 : q + k], ' ') AS s, count(*) AS c FROM iplaces GROUP BY ALL),
dplaces AS (SELECT doc_id, text, k, words, unnest(range(len(words) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(words) >= k),
dgrams AS (SELECT doc_id, text, k, len(words) - k + 1 AS whole, p, array_to_string(words[p + 1 : p + k], ' ') AS s FROM dplaces),
hits AS (SELECT doc_id, text, whole, p, item_id, n, m, s, c FROM dgrams JOIN igrams USING (k, s)),
windows AS (SELECT DISTINCT doc_id, text, whole, item_id, n, m, greatest(0, p - m + 1) AS start FROM hits),
shared AS (SELECT doc_id, text, w.whole, item_id, w.n, w.m, w.start, h.s, least(count(*), max(h.c)) AS c FROM windows w JOIN hits h USING (doc_id, text, item_id) WHERE h.p >= w.start AND h.p < w.start + w.m GROUP BY ALL),
told AS (SELECT doc_id, text, item_id, n, start, sum(c)::DOUBLE / (m + least(m, whole) - sum(c)) AS similarity FROM shared GROUP BY doc_id, text, whole, item_id, n, m, start)
SELECT doc_id, item_id, (array_agg(start ORDER BY similarity DESC, start))[1]::INTEGER AS start, n::INTEGER AS n_words, max(similarity) AS similarity
FROM told WHERE similarity >= 0.8 GROUP BY doc_id, text, item_id, n
"""


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no window like an item; all columns stay."""
    leaks = stash(leaked_windows(docs, items).select(F.col("doc_id").alias("quern_id"), F.col("text_key").alias("quern_key")).distinct(), "leaks")
    return docs.join(few(leaks), F.col("doc_id").eqNullSafe(F.col("quern_id")) & (F.xxhash64("text") == F.col("quern_key")), "left_anti")
