"""Exact most similar items, without comparing blocks that can't hold one.

Vectors of length one are dealt to their nearest pivot and cut, in the order of their
angle to it, into blocks; a block is one row with its vectors packed, the cone around
them (mean direction and widest angle), and how many of them are of other projects
than any one project.  By the triangle inequality of angles no vector of a block is
nearer to one of another block than the angle of the two directions less both widths.

1. Every query block meets its nearest blocks, up to those that surely hold k eligible
   items (of other projects, beyond the threshold's angle); that gives each query a
   cosine which its k-th example can't fall below.
2. It then meets those blocks only that may hold a better one, and there only the
   queries that may find it are compared.

So results are those of all pairs, and what is saved depends on how clustered vectors
are: isotropic ones of many dimensions have no bounds worth the name.  Queries and
items are tables of blocks; compared blocks come together in cells of a group of blocks
by another, so a block is shuffled once per group it meets, as it came (floats stay
floats), and no task holds more than a cell.  There are GROUPS groups of each table, so
what is shuffled grows with the table, up to groups of CELL_NUMBERS numbers; only larger
tables have more groups.  Bounds are worked out for pairs of blocks, a millionth of the
pairs of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import reread, stash, unstash, width

#: Vectors and numbers a block has at most; blocks a group has about, until there are
#: GROUPS groups (more where more cores wait for cells); cones of a page.
BLOCK, BLOCK_NUMBERS, GROUP, PAGE = 1024, 131_072, 16, 256
#: From there on groups get larger, up to so many numbers on average.
GROUPS, CELL_NUMBERS = 12, 1 << 23
#: Pivots at most, and how many sampled vectors are looked at for each.
PIVOTS, LOOKED_AT = 1024, 8
#: Cosines that agree to so many digits are equal; angles may be off by SLACK.
DIGITS, SLACK = 12, 1e-6


def unit(vectors: pa.Array) -> np.ndarray:
    return scaled(np.array(vectors.to_pylist(), float))


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors_of(row: dict) -> np.ndarray:
    """A block's vectors, scaled to length one, from the numbers as they came."""
    dims = len(row["center"]) // 8
    kind = np.float64 if len(row["matrix"]) == 8 * dims * len(row["ids"]) else np.float32
    return scaled(np.frombuffer(row["matrix"], kind).reshape(-1, dims).astype(float))


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def pivots_of(items: DataFrame, n: int) -> np.ndarray:
    """Directions that lie apart: far points of a bounded sample, moved to their nearest vectors' mean."""
    wanted = int(np.clip(np.sqrt(n), 1, PIVOTS))
    most = LOOKED_AT * wanted
    rows = items.filter(F.rand(7) < 2.0 * most / max(n, 1)).limit(most).select("v").toArrow()
    if not rows.num_rows:
        rows = items.limit(most).select("v").toArrow()
    x = unit(rows.column("v").combine_chunks())
    chosen, far = [0], angles(x, x[:1])[:, 0]
    while len(chosen) < min(wanted, len(x)) and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, angles(x, x[chosen[-1:]])[:, 0])
    pivots = x[chosen]
    for _ in range(3):
        own = (x @ pivots.T).argmax(axis=1)
        for c in np.unique(own):
            mean = x[own == c].sum(axis=0)
            if np.linalg.norm(mean) > SLACK:
                pivots[c] = mean / np.linalg.norm(mean)
    return pivots


def dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, project, v) -> a row per block: block, center, radius, n, sure, ids, projects, matrix."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    of = rows.schema["id"].dataType.simpleString()
    id_type = rows.select("id").limit(0).toArrow().schema.field("id").type
    kind = np.dtype(np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                some = batch.slice(first, 4096)
                given = np.array(some.column("v").to_pylist(), kind)
                x = scaled(given.astype(float))
                cos = x @ shared.value.T
                own = cos.argmax(axis=1)
                theta = np.arccos(np.clip(cos[np.arange(len(x)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("project"), pa.array(own.astype(np.int32)), pa.array(theta), pa.array([r.tobytes() for r in given], pa.binary())], ["id", "project", "cluster", "theta", "x"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, []
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            cuts = np.flatnonzero(cluster[1:] != cluster[:-1]) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(cluster)], strict=True):
                while begin < end:
                    if held and held[0].column("cluster")[0].as_py() != cluster[begin]:
                        yield block(number, held)
                        number, held = number + 1, []
                    size = max(1, min(BLOCK, BLOCK_NUMBERS * kind.itemsize // max(len(batch.column("x")[begin].as_py()), 1)))
                    room = size - sum(h.num_rows for h in held)
                    held.append(batch.slice(begin, min(room, end - begin)))
                    begin += room
                    if room <= held[-1].num_rows:
                        yield block(number, held)
                        number, held = number + 1, []
        if held:
            yield block(number, held)

    def block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        some = pa.Table.from_batches(held).combine_chunks()
        matrix = b"".join(some.column("x").to_pylist())
        x = scaled(np.frombuffer(matrix, kind).reshape(some.num_rows, -1).astype(float))
        center = x.sum(axis=0)
        size = np.linalg.norm(center)
        center = center / size if size > SLACK else x[0]
        projects = some.column("project").to_pylist()
        sure = len(projects) - max(pd.Series(projects).value_counts(dropna=False))
        columns = [[number], [center.tobytes()], [float(angles(x, center[None]).max())], [len(x)], [int(sure)]]
        types = [pa.int64(), pa.binary(), pa.float64(), pa.int32(), pa.int32()]
        lists = [pa.array([some.column("id").to_pylist()], pa.list_(id_type)), pa.array([projects], pa.list_(pa.string())), pa.array([matrix], pa.binary())]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *lists], ["block", "center", "radius", "n", "sure", "ids", "projects", "matrix"])

    order = ["cluster", "theta", "id"]
    near = rows.mapInArrow(placed, f"id {of}, project string, cluster int, theta double, x binary")
    near = near.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    return stash(near.mapInArrow(packed, f"block long, center binary, radius double, n int, sure int, ids array<{of}>, projects array<string>, matrix binary"), "blocks")


def grouped(blocks: DataFrame, name: str) -> Column:
    """The group of the block that column name holds: blocks in the order of their numbers,
    dealt to groups of as many blocks each.  Only how many blocks and numbers each part has
    comes to the driver."""
    sizes = blocks.groupBy(F.shiftright("block", 33).cast("int").alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("n") * F.length("center") / 8).alias("numbers")).collect()
    n = sum(r.n for r in sizes)
    most = max(GROUPS, int(np.ceil(np.sqrt(4 * blocks.sparkSession.sparkContext.defaultParallelism))))
    groups = max(min(-(-n // GROUP), most), int(-(-sum(r.numbers for r in sizes) // CELL_NUMBERS)))
    before = np.zeros(max((r.part for r in sizes), default=0) + 2, int)
    for r in sizes:
        before[r.part + 1] = r.n
    place = F.element_at(F.lit(before.cumsum().tolist()), (F.shiftright(name, 33) + 1).cast("int")) + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return F.floor(place * min(groups, n) / n).cast("int")


def block_bounds(queries: DataFrame, items: DataFrame) -> DataFrame:
    """query, block, least (angle between any of their vectors), n, sure: all pairs of blocks."""
    cone = lambda df, name: df.select(F.col("block").alias(name), "center", "radius", "n", "sure")
    pages = [max(1, -(-df.count() // PAGE)) for df in (queries, items)]
    page = lambda k, c: F.pmod(F.xxhash64(c), F.lit(pages[k])).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(pages[k] - 1)))
    left = cone(queries, "query").withColumn("p", page(0, "query")).withColumn("q", every(1))
    right = cone(items, "block").withColumn("q", page(1, "block")).withColumn("p", every(0))

    def bounds(_, a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({c: pa.array([], t) for c, t in (("query", pa.int64()), ("block", pa.int64()), ("least", pa.float64()), ("n", pa.int64()), ("sure", pa.int32()))})
        x, y = (np.frombuffer(b"".join(t.column("center").to_pylist())).reshape(t.num_rows, -1) for t in (a, b))
        least = angles(x, y) - a.column("radius").to_numpy()[:, None] - b.column("radius").to_numpy()[None]
        rows, columns = (r.ravel() for r in np.indices(least.shape))
        n = a.column("n").to_numpy().astype(np.int64)[rows] * b.column("n").to_numpy()[columns]
        return pa.table({"query": a.column("query").to_numpy()[rows], "block": b.column("block").to_numpy()[columns], "least": np.maximum(least, 0).ravel(), "n": n, "sure": b.column("sure").to_numpy()[columns]})

    met = left.groupBy("p", "q").cogroup(right.groupBy("p", "q"))
    return met.applyInArrow(bounds, "query long, block long, least double, n long, sure int")


@dataclass
class Wanted:
    k: int
    threshold: float
    below: bool

    def among(self, cos: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Cosines, those that don't count as minus infinity."""
        cos = np.round(cos, DIGITS)
        return np.where(other & ((cos < self.threshold) if self.below else (cos >= self.threshold)), cos, -np.inf)


def compared(pairs: DataFrame, queries: DataFrame, items: DataFrame, wanted: Wanted, reached: DataFrame | None = None) -> DataFrame:
    """pairs (query, block, query_group, block_group) of blocks -> query, row, id, example_id, cos: the best k of
    every query among what its cell holds.  reached (query, rows, least): cosines that
    each query's k-th example has already."""
    group = lambda df, of: df.select("block", "matrix", "projects", "ids", "center", "radius", *of)
    cells = pairs.select("query", "block", "query_group", "block_group")
    keys = ["query_group", "block_group"]
    own_keys = [f"own_{c}" for c in keys]
    asked = cells.groupBy("query", *keys).agg(F.collect_set("block").alias("met")).join(queries.withColumnRenamed("block", "query"), "query").withColumnRenamed("query", "block")
    if reached is not None:
        asked = asked.join(reached.withColumnRenamed("query", "block"), "block", "left")
    else:
        asked = asked.withColumns({"rows": F.lit(None).cast("array<int>"), "least": F.lit(None).cast("array<double>")})
    held = cells.select(F.col("block").alias("own"), *(F.col(c).alias(f"own_{c}") for c in keys)).distinct().join(items, F.col("own") == F.col("block")).drop("own")
    types = [df.schema["ids"].dataType.elementType.simpleString() for df in (queries, items)]
    arrow = [df.select("ids").limit(0).toArrow().schema.field("ids").type.value_type for df in (queries, items)]
    names, kinds = ["query", "row", "id", "example_id", "cos"], [pa.int64(), pa.int32(), *arrow, pa.float64()]
    k = wanted.k

    def cell(_, a: pa.Table, b: pa.Table) -> pa.Table:
        blocks, codes = {}, {}
        coded = lambda projects: np.array([codes.setdefault(p, len(codes)) for p in projects])
        for r in b.to_pylist():
            x = vectors_of(r)
            # smaller ids first, so that equal cosines are kept in that order
            order = np.array(sorted(range(len(x)), key=r["ids"].__getitem__), int)
            blocks[r["block"]] = (x[order], coded(r["projects"])[order], [r["ids"][j] for j in order], np.frombuffer(r["center"]), r["radius"])
        out = []
        for r in a.to_pylist():
            q, own = vectors_of(r), coded(r["projects"])
            kth = np.full(len(q), -np.inf)
            if r["rows"]:
                kth[r["rows"]] = r["least"]
            best_row, best_cos, best_id = np.zeros(0, int), np.zeros(0), []
            for n in r["met"]:
                x, projects, ids, center, radius = blocks[n]
                may = np.flatnonzero(angles(q, center[None])[:, 0] - radius <= np.arccos(np.clip(kth, -1, 1)) + SLACK)
                if not len(may):
                    continue
                cos = q[may] @ x.T
                new = np.flatnonzero(kth[may] == -np.inf)
                if len(new) and len(ids) >= k:
                    fits = wanted.among(cos[new], own[may[new], None] != projects[None])
                    kth[may[new]] = np.partition(fits, -k, axis=1)[:, -k]
                # few are left, so the rest is looked at for them alone
                rows, columns = np.nonzero(cos >= kth[may, None] - 10.0**-DIGITS)
                near = wanted.among(cos[rows, columns], own[may[rows]] != projects[columns])
                keep = (near >= kth[may[rows]]) & (near > -np.inf)
                rows, columns, near = rows[keep], columns[keep], near[keep]
                # of a row's equal cosines more than k are of no use
                best_row = np.append(best_row, may[rows])
                best_cos = np.append(best_cos, near)
                best_id += [ids[c] for c in columns]
                rank = np.argsort(np.array(sorted(range(len(best_id)), key=best_id.__getitem__), int)) if best_id else np.zeros(0, int)
                order = np.lexsort((rank, -best_cos, best_row))
                place = np.arange(len(order)) - np.searchsorted(best_row[order], best_row[order])
                keep = order[place < k]
                best_row, best_cos, best_id = best_row[keep], best_cos[keep], [best_id[j] for j in keep]
                last = np.flatnonzero(np.arange(len(keep)) - np.searchsorted(best_row, best_row) == k - 1)
                kth[best_row[last]] = np.maximum(kth[best_row[last]], best_cos[last])
            out.append([np.full(len(best_row), r["block"]), best_row, [r["ids"][j] for j in best_row], best_id, best_cos])
        columns = [sum((list(o[c]) for o in out), []) for c in range(5)]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, columns, kinds, strict=True)})

    met = group(asked, [*keys, "met", "rows", "least"]).groupBy(*keys).cogroup(group(held, own_keys).groupBy(*own_keys))
    return met.applyInArrow(cell, f"query long, row int, id {types[0]}, example_id {types[1]}, cos double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "row").orderBy(F.desc("cos"), "example_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similar_items(queries: DataFrame, items: DataFrame, k: int, threshold: float = 0.9, below: bool = True, report: dict | None = None) -> DataFrame:
    """(id, project, embedding) each -> id, example_id, cos (4 digits), rank: of
    every query the k items of other projects with the greatest cosine, below the
    threshold (near-copies are no examples) or at and above it.

    Cosines that agree to 12 digits are equal, and ties go to the smaller id.  Rows
    without id or vector, zero vectors and those that hold nulls, NaN or infinity have
    no part in it; a null project is a project of its own; repeated rows are asked and
    found row by row.  Ids may be of any type.  report takes the pairs of rows that
    were compared at most (``compared``) out of all (``pairs``).
    """
    narrow = lambda df: df.schema["embedding"].dataType.simpleString() == "array<float>"
    v = lambda df: F.col("embedding") if narrow(df) else F.col("embedding").cast("array<double>")
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    told = lambda df: df.select("id", F.col("project").cast("string").alias("project"), v(df).alias("v")).filter(F.col("id").isNotNull() & F.forall("v", whole) & F.exists("v", lambda x: x != 0))
    asked, held = told(queries), told(items)
    n, wanted = held.count(), Wanted(k, threshold, below)
    if not n:
        return asked.select("id", F.lit(None).cast(held.schema["id"].dataType).alias("example_id"), F.lit(0.0).alias("cos"), F.lit(0).alias("rank")).limit(0)
    pivots = pivots_of(held, n)
    x = dealt(held, pivots)
    q = reread(x) if queries is items else dealt(asked, pivots)
    bounds = stash(block_bounds(q, x), "bounds")
    near = -1.0 if threshold > 1 else float(np.arccos(max(threshold, -1.0)))
    # what is surely below the threshold counts; at and above it nothing far away does
    counts = F.when(F.col("least") > near + SLACK, F.col("sure")).otherwise(0) if below else F.col("sure")
    nearest = Window.partitionBy("query").orderBy("least", "block")
    before = F.sum(counts).over(nearest.rowsBetween(Window.unboundedPreceding, -1))
    fits = F.lit(True) if below else F.col("least") <= near + SLACK
    pairs = stash(bounds.withColumns({"first": fits & (F.coalesce(before, F.lit(0)) < k), "fits": fits, "query_group": grouped(q, "query"), "block_group": grouped(x, "block")}), "pairs")
    unstash(bounds)
    met = stash(best_of(compared(pairs.filter("first"), q, x, wanted), k), "met")
    reached = met.filter(F.col("rank") == k).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("row", "cos"))).alias("r"))
    reached = reached.select("query", F.col("r.row").alias("rows"), F.col("r.cos").alias("least")).join(q.select(F.col("block").alias("query"), F.col("n").alias("size")), "query")
    # an angle beyond which no vector of the block has a better example
    bound = reached.select("query", F.when(F.size("rows") == F.col("size"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.array_min("least"))))).alias("widest"))
    later = pairs.filter(F.col("fits") & ~F.col("first")).join(bound, "query", "left").filter(F.col("widest").isNull() | (F.col("least") <= F.col("widest") + SLACK))
    later = stash(later.select("query", "block", "query_group", "block_group", "n"), "later")
    if report is not None:
        count = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        report |= {"pairs": count(pairs), "compared": count(pairs.filter("first")) + count(later)}
    rest = compared(later, q, x, wanted, reached.drop("size"))
    found = best_of(met.drop("rank").unionByName(rest), k)
    return found.select("id", "example_id", F.round("cos", 4).alias("cos"), "rank")
