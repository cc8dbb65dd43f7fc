"""Near-duplicates by circulant MinHash, confirmed on full shingle sets.

A document is the set of its distinct word shingles.  Documents with equal
sets form a class; from there on one representative stands for a class, so
exact copies are never compared.  A signature needs two permutations of 32-bit
numbers only: sigma, applied to the shingles once, and pi, of which coordinate
k takes the arguments shifted by k around the circle.  Signatures are cut into
bands; representatives that agree on a band share a bucket.

Buckets are never expanded into all pairs.  Each names a centre, its members
are compared with it, and confirmed links are merged to components.  Only
buckets that still hold several components go on: two more rounds compare the
members outside a bucket's largest component with other centres of it, and
then all documents of the components that still meet in a bucket are joined
exactly.  For that, shingles are ordered from rare to common; two similar sets have to share a shingle within
their first parts (a fifth of each at 0.8), early enough for the rest to reach
the threshold.  So a passage that many unlike documents share yields no pairs.
A pair within one component needs no check, as it can't change the result.
All comparisons are exact, over joined sets; a hot centre's pairs are ordinary
join rows, which skew joins can divide.

With 48 bands of 6 a pair at the threshold of 0.8 shares no bucket with
probability 5e-7.

Null text, or text without words, has no shingles and is linked with nothing.
Rows with a null id are linked with nothing, too, and kept.  Rows that repeat
an id are one document: they share a component.  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.words import BLANKS, coded, slices, split_words
from quern.session import few, stash, unstash

BANDS, ROWS = 48, 6
STAR_ROUNDS = 3
SET_SLICE = 3_000_000
#: Numbers that are worked on at once in one signature.
BLOCK = 32_768


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit hashes."""
    words, offsets = split_words(texts, BLANKS)
    codes, distinct = coded(words)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    h = hashes[codes] if len(distinct) else np.zeros(0, np.uint64)
    prime = np.uint64(0x9E3779B97F4A7C15)
    whole = h[: max(len(h) - size + 1, 0)].copy()
    for k in range(1, size):
        whole = whole * prime + h[k : k + len(whole)]
    whole = mix(whole)
    out = []
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if last - first >= size:
            out.append(np.unique(whole[first : last - size + 1]))
        elif last > first:
            one = np.uint64(last - first) * prime
            for w in h[first:last]:
                one = one * prime + w
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """k coordinates: the least pi(sigma(s) + shift), shift from 0 to k - 1."""
    sigma = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    # pi(y) = (z ^ z >> 15) * c2 with z = y * c1, all modulo 2**32: a permutation
    c1, c2 = np.uint32(0x2C1B3C6D), np.uint32(0x297A2D39)
    turned = (np.arange(k, dtype=np.uint32) * c1)[:, None]
    base = (sigma * c1)[None, :]
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(sigma), BLOCK):
        part = base[:, a : a + BLOCK]
        step = max(1, BLOCK // part.shape[1])
        for b in range(0, k, step):
            z = part + turned[b : b + step]
            z ^= z >> np.uint32(15)
            z *= c2
            np.minimum(out[b : b + step], z.min(axis=1), out=out[b : b + step])
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def described(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in slices(batches, "text", SET_SLICE):
                sets = shingle_sets(part.column("text"), size)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                f1 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                f2 = np.array([mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                keys = band_keys(np.array([signature(s, BANDS * ROWS) for s in sets]))
                bands = pa.ListArray.from_arrays(pa.array((np.arange(len(sets) + 1) * BANDS).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(f1), pa.array(f2), bands], ["doc_id", "n", "f1", "f2", "bands"])

    return run


def full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in slices(batches, "text", SET_SLICE):
                sets = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])

    return run


def confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                place = np.searchsorted(y, x)
                common = int((y[np.minimum(place, len(y) - 1)] == x).sum()) if len(x) else 0
                good.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, own, component, shingles) -> a row (rep, own, component, n, s) per shingle."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) // 8 for x in batch.column("shingles")], np.int64)
        flat = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.int64)
        rep, own, component = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("rep", "own", "component"))
        for k in range(0, len(flat), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in (rep, own, component, np.repeat(sizes, sizes), flat)], ["rep", "own", "component", "n", "s"])


def crossing_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of different components of sets (rep, component,
    shingles) that can reach the similarity, and few others.

    A shingle is *early* in a set if, with it as the first common one, a set of
    the same size could still be reached.  Of two sets that reach the similarity
    at least the smaller one has their first common shingle early, so sets which
    have a shingle late are never joined with each other: pages over one template
    whose own parts are too large give no pairs, however many there are."""
    each = sets.select("rep", F.xxhash64("shingles").alias("own"), "component", "shingles").mapInArrow(unpacked, "rep long, own long, component long, n long, s long")
    common = each.groupBy("s").agg(F.count("*").alias("df"))
    order = Window.partitionBy("rep", "own").orderBy("df", "s")
    ranked = each.join(common, "s").withColumn("place", F.row_number().over(order))
    left = 1 + F.col("n") - F.col("place")
    first = ranked.filter(100 * left >= percent * F.col("n")).select("s", "rep", "component", "n", "place", ((100 + percent) * left >= 2 * percent * F.col("n")).alias("early"))
    first = stash(first, "first")
    mixed = first.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("s")
    met = first.join(mixed, "s", "left_semi")
    x = met.filter("early").drop("early")
    y = met.select("s", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("place").alias("pb"), "early")
    reach = 1 + F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("pb"))
    # intersection * 100 >= percent * (n + nb - intersection)
    apart = (F.col("component") < F.col("cb")) | ~F.col("early") & (F.col("component") > F.col("cb"))
    return x.join(y, "s").filter(apart & ((100 + percent) * reach >= percent * (F.col("n") + F.col("nb")))).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(vertex, component) of every vertex of the links (a, b): the component is
    its smallest vertex.  Alternates large and small stars; each step takes a
    minimum per vertex and joins it back, so no vertex gathers its neighbours."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(low, "a")
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def told(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = stash(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = told(edges)
    while before[0]:
        new = stash(star(star(edges, True), False), name)
        unstash(edges)
        edges, now = new, told(new)
        if now == before:
            break
        before = now
    out = edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    out._quern_path = edges._quern_path
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    size: words of a shingle.  Documents are linked if 100 * intersection is
    at least percent * union, percent being 80 or more for the bands used here.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stash(texts.mapInArrow(described(size), "doc_id long, n long, f1 long, f2 long, bands array<long>"), "described")
    linked = rows.filter("n > 0 and doc_id is not null")
    reps = linked.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    classes = linked.join(reps.withColumnRenamed("rep", "doc_id"), ["f1", "f2", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "n", F.explode("bands").alias("key"))
    shared = classes.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"), F.min("n").alias("least"), F.max("n").alias("most")).filter("centre < last").select("key", "centre")
    members = stash(classes.join(shared, "key"), "members")

    wanted = stash(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sets = texts.filter("doc_id is not null").join(few(wanted), "doc_id").mapInArrow(full_sets(size), "rep long, shingles binary")
    repeated = not linked.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").isEmpty()
    sets = stash(sets.distinct() if repeated else sets, "sets")

    def check(pairs: DataFrame, name: str) -> DataFrame:
        left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
        return stash(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(confirmed(percent), "a long, b long").distinct(), name)

    def size_fits(x: str, y: str):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    spread = None
    if repeated:  # an id with several texts joins their classes
        own = linked.join(reps, ["f1", "f2"]).select("doc_id", "rep")
        spread = own.join(own.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b").filter("a <> b").distinct()
    links, label, named, written = spread, None, members, []
    for k in range(STAR_ROUNDS + 1):
        if k == 0:
            # the first centre of a bucket is its smallest member
            centres = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c")).select("key", F.col("c.rep").alias("a"), F.col("c.n").alias("na"))
            apart = F.col("rep") != F.col("a")
        else:
            # of a bucket that holds several components only the members outside its
            # largest one go on; a member of that, another one each round, is the centre
            shares = named.groupBy("key", "component").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("o"), "rep", "n")).alias("centre"))
            mixed = shares.groupBy("key").agg(F.max(F.struct("c", "component", "centre")).alias("x"), F.count("*").alias("parts")).filter("parts > 1")
            centres = mixed.select("key", F.col("x.centre.rep").alias("a"), F.col("x.centre.n").alias("na"), F.col("x.component").alias("ca"))
            apart = F.col("component") != F.col("ca")
        if k < STAR_ROUNDS:
            pairs = named.join(centres, "key").filter(apart & size_fits("n", "na"))
            pairs = pairs.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
        else:
            # exactly: all documents of the components that still meet in a bucket
            met = few(stash(shares.join(mixed.select("key"), "key", "left_semi").select("component").distinct(), "met"))
            held = wanted.join(label, F.col("doc_id") == F.col("vertex"), "left").select(F.col("doc_id").alias("rep"), F.coalesce("component", "doc_id").alias("component"))
            pairs = crossing_pairs(held.join(met, "component", "left_semi").join(sets, "rep"), percent)
        for old in written[::2]:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = stash(pairs, "pairs")
        found = check(pairs, "links")
        written += [pairs, found]
        links = found if links is None else links.union(found)
        if k and k < STAR_ROUNDS and found.isEmpty():
            continue
        unstash(label)
        label = components(links, "labels")
        if k < STAR_ROUNDS:
            named = members.join(label, F.col("rep") == F.col("vertex"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))

    # written first, so that both sides of the last join are plain shuffles and a class of
    # very many copies can be divided
    labels = stash(reps.join(label, F.col("rep") == F.col("vertex"), "left").select("f1", "f2", F.coalesce("component", "rep").alias("component")), "classes")
    unstash(members, wanted, sets, label, *written)
    out = (
        rows.join(labels, (rows.f1 == labels.f1) & (rows.f2 == labels.f2) & (rows.n > 0) & rows.doc_id.isNotNull(), "left")
        .select(rows.doc_id, rows.n.alias("n_shingles"), F.coalesce("component", rows.doc_id).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
    out.quern_reads = (rows, labels)
    return out


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those that near_duplicates doesn't keep.  Rows that
    share an id are documents of their own if their texts differ; of equal ones one
    stays.  All columns stay."""
    named = docs.filter("doc_id is not null")
    ids = named.groupBy("doc_id").agg(F.count("*").alias("c"))
    if ids.filter("c > 1").isEmpty():
        found = near_duplicates(docs, size, percent)
        gone = stash(found.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
        unstash(*found.quern_reads)
        return docs.join(few(gone), "doc_id", "left_anti")
    # numbers in the order of the ids stand for (id, text)
    text = F.xxhash64(F.col("text"), F.length("text"))
    marked = named.select(F.col("doc_id").alias("quern_id"), F.col("text").alias("quern_text"), text.alias("quern_hash"))
    numbers = stash(marked.select("quern_id", "quern_hash").distinct().orderBy("quern_id", "quern_hash").withColumn("quern_no", F.monotonically_increasing_id()), "numbers")
    texts = stash(marked.dropDuplicates(["quern_id", "quern_hash"]).join(numbers, ["quern_id", "quern_hash"]), "texts")
    found = near_duplicates(texts, size, percent, "quern_no", "quern_text")
    kept = found.filter("kept").select(F.col("doc_id").alias("quern_no"))
    stays = stash(numbers.join(kept, "quern_no").select(F.col("quern_id").alias("doc_id"), "quern_hash"), "stays")
    unstash(numbers, texts, *found.quern_reads)
    once = named.withColumn("quern_hash", text).dropDuplicates(["doc_id", "quern_hash"])
    left = once.join(stays, ["doc_id", "quern_hash"], "left_semi").select(docs.columns)
    return left.unionByName(docs.filter("doc_id is null"))
