"""Approximate nearest neighbours: NN-descent builds the graph, greedy search
answers queries.  Nearness is Euclidean distance.

Every distinct vector is a node, named by the smallest id that has it; equal
rows come back at the end, each node by its k + 1 smallest ids, so ties go to the
smaller id in groups of any size.  The first edges come from blocks of rows on the same
side of random planes, compared within bounded blocks.  Each round of
NN-descent then gathers, for every node, its neighbours and (the nearest of)
its reverse neighbours, compares these neighbours of neighbours among
themselves where at least one edge is new, and keeps every node's K nearest.
The gathering is a join on ids, the keeping a top-k per node that starts on
the map side; no node collects an unbounded number of rows, however many rows
point to it.

The queries' nodes walk the graph together, from the entry points and from
themselves: in each round every query takes the nearest nodes of its pool that
it has not opened yet, a join on ids brings the neighbours of these, another one
the codes of those that it has not seen yet, and the pool keeps the ``pool``
nearest.  It ends when no pool has a node to open.  The nearest of the pools are
ranked by exact distances of the original vectors, in double precision.

Within graph and walk, vectors are 16-bit codes with a scale of their own, fine
enough to rank near-copies.  The entry points are a bounded sample by a hash of
the id (one row in 16, ``entries`` at most), which is broadcast; all rows are
indexed, and every table is searched in this way, small ones too.

Rows with a null id, and vectors that are null, zero, hold null or non-finite
components or have another length than most rows (ties: the shorter), take no
part.  Rows that repeat an id count once, with the smallest vector.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import few, stash, unstash

NEIGHBOURS, REVERSE, OFFERED = 24, 16, 8
#: First edges: that many sets of planes, rows of a block, nearest of a block.
TABLES, BLOCK, FIRST = 10, 256, 12
ROUNDS, SETTLED = 5, 0.04
ENTRIES, POOL, OPENED = 512, 480, 192
HEADER = 4
#: Pairs of query and node to open that are sent to all tasks.
FRONT = 1_000_000


def packed(df: DataFrame, rows: int, width: int) -> DataFrame:
    """df in partitions of about 64 MB, two per core at least: rounds over small
    tables don't pay for partitions that hold nothing."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, rows * width >> 26))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id long, v array<double>: the rows that take part, once each."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("v") == (sizes.d if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def lists(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def width(dims: int) -> int:
    """Bytes of a code."""
    return HEADER + 2 * dims


def encode(x: np.ndarray) -> np.ndarray:
    """Rows of bytes: a scale as float32, then 16 bits a component."""
    top = np.abs(x).max(axis=1, keepdims=True)
    scale = np.clip(top / 32767.0, 1e-37, 3e38).astype("<f4")
    q = np.rint(np.clip(x / scale, -32767, 32767)).astype("<i2")
    return np.hstack([np.ascontiguousarray(scale).view(np.uint8), np.ascontiguousarray(q).view(np.uint8)])


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms squared and vectors of rows of bytes, in double precision, so that
    differences of near-copies survive."""
    scale = np.ascontiguousarray(codes[:, :HEADER]).view("<f4").astype(float)
    x = np.ascontiguousarray(codes[:, HEADER:]).view("<i2") * scale
    return np.einsum("ij,ij->i", x, x), x


def blobs(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    offsets = (np.arange(len(rows) + 1) * (rows.shape[1] if rows.ndim > 1 else 0)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def unblob(column: pa.Array, width: int) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, width)


def nearest(edges: DataFrame, k: int, key: str = "u", other: str = "w") -> DataFrame:
    order = Window.partitionBy(key).orderBy("d", other)
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def first_edges(coded: DataFrame, n: int, dims: int, k: int, seed: int = 7) -> DataFrame:
    """(u, w, d) from blocks of codes on the same side of random planes."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / (BLOCK / 2)))))
    planes = np.random.default_rng(seed).standard_normal((TABLES, bits, dims)).astype(np.float32)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = decode(unblob(batch.column("code"), width(dims)))
            for t in range(TABLES):
                side = (x @ planes[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("code"), pa.array(np.full(len(x), t, np.int32)), pa.array(side.astype(np.int64))], ["id", "code", "t", "side"])

    def within(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        norm, x = decode(unblob(table.column("code").combine_chunks() if isinstance(table.column("code"), pa.ChunkedArray) else table.column("code"), width(dims)))
        us, ws, ds = [], [], []
        for a in range(0, len(ids), 512):
            d = np.sqrt(np.maximum(norm[a : a + 512, None] + norm[None] - 2 * x[a : a + 512] @ x.T, 0))
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            m = min(k, len(ids) - 1)
            near = np.argpartition(d, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(d), 0), int)
            us.append(np.repeat(ids[a : a + 512], m))
            ws.append(ids[near].ravel())
            ds.append(np.take_along_axis(d, near, 1).ravel())
        return pa.table({"u": np.concatenate(us), "w": np.concatenate(ws), "d": np.concatenate(ds).astype(np.float32)})

    placed = coded.mapInArrow(keys, "id long, code binary, t int, side long")
    # only the sides that need more than one block are named here
    crowded = placed.groupBy("t", "side").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK).withColumn("parts", F.ceil(F.col("c") / BLOCK)).drop("c")
    blocks = placed.join(crowded, ["t", "side"], "left").withColumn("part", F.pmod(F.xxhash64("id", "t"), F.coalesce("parts", F.lit(1))))
    return blocks.select("id", "code", "t", "side", "part").groupBy("t", "side", "part").applyInArrow(within, "u long, w long, d float")


def compared(dims: int, offered: int, kept: int):
    """From gathered nodes (m: list of u, radius, fresh, code) the pairs (u, w, d)
    that are no farther than u's radius, the nearest few of each u and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("m")
            sizes = m.value_lengths().to_numpy(zero_copy_only=False)
            flat = m.flatten()
            ids, radius, fresh = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("u", "radius", "fresh"))
            codes = unblob(flat.field("code"), width(dims))
            ends = np.cumsum(sizes)
            widest = int(sizes.max()) if len(sizes) else 0
            for a in range(0, len(sizes), 256):
                part = sizes[a : a + 256]
                col = np.arange(widest)[None]
                real = col < part[:, None]
                place = np.where(real, (ends[a : a + 256] - part)[:, None] + col, ends[a] - part[0])
                least = int(place.min())
                norm, x = decode(codes[least : int(place.max()) + 1])
                px, pn, pid = x[place - least], norm[place - least], ids[place]
                d = np.sqrt(np.maximum(pn[:, :, None] + pn[:, None, :] - 2 * np.matmul(px, px.transpose(0, 2, 1)), 0))
                pf = fresh[place]
                good = real[:, :, None] & real[:, None, :] & (pf[:, :, None] | pf[:, None, :]) & (pid[:, :, None] != pid[:, None, :]) & (d <= radius[place][:, :, None])
                d = np.where(good, d, np.inf)
                few = min(offered, widest)
                near = np.argpartition(d, few - 1, axis=2)[:, :, :few]
                found = np.take_along_axis(d, near, 2)
                b, u, c = np.nonzero(np.isfinite(found))
                u, w, d = pid[b, u], pid[b, near[b, u, c]], found[b, u, c].astype(np.float32)
                # each pair once, and the nearest of each u, so that a node that many others
                # point to sends on a bounded number of rows from here
                order = np.lexsort((w, d, u))
                u, w, d = u[order], w[order], d[order]
                first = np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])) if len(u) else np.zeros(0, bool)
                u, w, d = u[first], w[first], d[first]
                begins = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
                keep = np.arange(len(u)) - np.repeat(begins, np.diff(np.append(begins, len(u)))) < kept
                yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(w[keep]), pa.array(d[keep])], ["u", "w", "d"])

    return run


def neighbour_graph(coded: DataFrame, n: int, dims: int, neighbours: int, rounds: int) -> DataFrame:
    """(u, w, d, fresh): each node's nearest others, as far as found."""
    def stored(candidates: DataFrame) -> DataFrame:
        # one shuffle by u serves the removal of repeated pairs and the ranking
        once = candidates.repartition("u").groupBy("u", "w").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
        held = Window.partitionBy("u")
        far = F.when(F.count("*").over(held) >= neighbours, F.max("d").over(held)).otherwise(float("inf")).cast("float")
        out = nearest(once, neighbours).withColumns({"radius": far, "lead": F.col("w") == F.min("w").over(held)})
        return stash(packed(out, n * neighbours, 32), "edges")

    edges = stored(first_edges(coded, n, dims, min(FIRST, neighbours)).withColumn("fresh", F.lit(True)))
    for _ in range(rounds):
        back = nearest(edges.select(F.col("w").alias("v"), F.col("u").alias("w"), "d", "fresh"), REVERSE, "v").select("v", F.col("w").alias("u"), "fresh")
        around = edges.select(F.col("u").alias("v"), F.col("w").alias("u"), "fresh").union(back)
        known = coded.select(F.col("id").alias("u"), "code").join(edges.filter("lead").select("u", "radius"), "u", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf")).cast("float")))
        gathered = around.join(known, "u").groupBy("v").agg(F.collect_list(F.struct("u", "radius", "fresh", "code")).alias("m"))
        offers = packed(gathered.select("m"), n * (neighbours + REVERSE), 2 * dims + 32).mapInArrow(compared(dims, OFFERED, neighbours), "u long, w long, d float").withColumn("fresh", F.lit(True))
        new = stored(edges.select("u", "w", "d", F.lit(False).alias("fresh")).union(offers))
        unstash(edges)
        edges = new
        told = edges.agg(F.count("*").alias("all"), F.count_if("fresh").alias("new")).first()
        if told.new <= SETTLED * told.all:
            break
    return edges


def adjacency(edges: DataFrame) -> DataFrame:
    """node, others: its neighbours and nearest reverse neighbours."""
    back = nearest(edges.select(F.col("w").alias("u"), F.col("u").alias("w"), "d"), REVERSE)
    return edges.select("u", "w").union(back.select("u", "w")).groupBy(F.col("u").alias("node")).agg(F.collect_set("w").alias("others"))


STATE = "q long, x array<double>, ids array<long>, ds array<float>, done array<boolean>, todo array<long>, worst float, seen array<long>"
ARROW_STATE = pa.schema([("q", pa.int64()), ("x", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("ds", pa.list_(pa.float32())), ("done", pa.list_(pa.bool_())), ("todo", pa.list_(pa.int64())), ("worst", pa.float32()), ("seen", pa.list_(pa.int64()))])


def state_row(q: int, x: np.ndarray, ids: np.ndarray, ds: np.ndarray, done: np.ndarray, seen: np.ndarray, pool: int, step: int) -> dict:
    """The pool kept to its nearest, with the nodes to open next."""
    order = np.lexsort((ids, ds))[:pool]
    ids, ds, done = ids[order], ds[order], done[order].copy()
    todo = np.flatnonzero(~done)[:step]
    done[todo] = True
    return {"q": [q], "x": [x], "ids": [ids], "ds": [ds], "done": [done], "todo": [ids[todo]], "worst": [float(ds[-1]) if len(ds) >= pool else float("inf")], "seen": [seen]}


def merged(dims: int, pool: int, step: int):
    """A query's state and the codes of the nodes it meets for the first time."""

    def run(key: tuple, state: pa.Table, found: pa.Table) -> pa.Table:
        if not state.num_rows:
            return ARROW_STATE.empty_table()
        state = state.slice(0, 1).combine_chunks()
        of = lambda c: state.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids, ds, done, seen, x, worst = of("ids"), of("ds"), of("done"), of("seen"), of("x"), state.column("worst")[0].as_py()
        new, d = np.zeros(0, np.int64), np.zeros(0, np.float32)
        if found.num_rows:
            new = found.column("node").to_numpy()
            norm, y = decode(unblob(found.column("code").combine_chunks(), width(dims)))
            d = np.sqrt(np.maximum(x @ x + norm - 2 * y @ x, 0)).astype(np.float32)
            seen = np.append(seen, new)
            near = d <= worst
            new, d = new[near], d[near]
        out = state_row(state.column("q")[0].as_py(), x, np.append(ids, new), np.append(ds, d), np.append(done, np.zeros(len(new), bool)), seen, pool, step)
        return pa.table(out, schema=ARROW_STATE)

    return run


def walked(state: DataFrame, graph: DataFrame, coded: DataFrame, dims: int, asking: int, pool: int, step: int) -> DataFrame:
    """The states at the end: every node of every pool has been opened."""
    while True:
        front = state.select(F.col("q").alias("asker"), F.explode("todo").alias("node"))
        steps = front.count()
        if not steps:
            return state
        opened = (F.broadcast(front) if steps <= FRONT else front).join(graph, "node").groupBy("asker").agg(F.flatten(F.collect_list("others")).alias("others"))
        fresh = state.select(F.col("q").alias("asker"), "seen").join(opened, "asker").select("asker", F.explode(F.array_except("others", "seen")).alias("node"))
        met = fresh.join(coded.withColumnRenamed("id", "node"), "node")
        new = stash(packed(state.groupBy("q").cogroup(met.groupBy("asker")).applyInArrow(merged(dims, pool, step), STATE), asking, 64 * pool), "walk")
        unstash(state)
        state = new


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, entries: int = ENTRIES, pool: int = POOL, step: int = OPENED
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found of each query.

    queries: which of the rows (column id) are queries; a query is no candidate
    of its own.  Ties go to the smaller id.
    """
    base = stash(usable(vectors, id_col, vector_col), "vectors")
    spark = base.sparkSession
    first = base.select(F.size("v").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("v").orderBy("id")
    # no more than the k + 1 smallest ids of a vector leave the map side
    ranked = base.withColumns({"rank": F.row_number().over(order), "node": F.first("id").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    ranked = stash(ranked.filter(F.col("rank") <= k + 1), "distinct")
    nodes, copies = ranked.filter("rank = 1").select("id", "v"), ranked.filter("rank > 1").select("node", F.col("id").alias("copy"))
    shared_by_two = few(ranked.filter("rank = 2").select("node", "v"), 50_000)
    asked = stash(base.filter(queries).join(shared_by_two, "v", "left").select(F.col("id").alias("query_id"), F.coalesce("node", "id").alias("node")), "queries")
    dims, n = first.d, nodes.count()

    def coding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), blobs(encode(lists(batch.column("v"), dims)))], ["id", "code"])

    coded = stash(packed(nodes, n, 8 * dims).mapInArrow(coding, "id long, code binary"), "coded")
    starts = nodes.orderBy(F.xxhash64("id"), "id").limit(max(1, min(entries, n // 16))).toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast((starts.column("id").to_numpy(), lists(starts.column("v").combine_chunks() if isinstance(starts.column("v"), pa.ChunkedArray) else starts.column("v"), dims)))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        norm = np.square(x).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = lists(batch.column("v"), dims)
            rows: dict[str, list] = {}
            for own, v in zip(batch.column("id").to_pylist(), q, strict=True):
                d = np.sqrt(np.maximum(norm + v @ v - 2 * x @ v, 0)).astype(np.float32)
                other = ids != own
                near, d = np.append(ids[other], own), np.append(d[other], np.float32(0))
                for c, value in state_row(own, v, near, d, np.zeros(len(near), bool), near, pool, step).items():
                    rows.setdefault(c, []).extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in ARROW_STATE], schema=ARROW_STATE)

    state = stash(nodes.join(asked.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("id", "v").mapInArrow(begin, STATE), "walk")
    asking = state.count()
    edges = neighbour_graph(coded, n, dims, neighbours, rounds)
    graph = stash(packed(adjacency(edges), n, 8 * (neighbours + REVERSE)), "graph")
    unstash(edges)
    state = walked(state, graph, coded, dims, asking, pool, step)
    unstash(graph, coded)
    best = state.select(F.col("q").alias("q"), F.explode(F.slice("ids", 1, max(6 * k, 64))).alias("node"))
    pairs = best.join(nodes.select(F.col("id").alias("node"), F.col("v").alias("b")), "node").join(nodes.select(F.col("id").alias("q"), F.col("v").alias("a")), "q")
    exact = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    ranks = lambda of, by: F.row_number().over(Window.partitionBy(of).orderBy("score", by))
    # of k + 1 nodes, k hold a row that is not the query
    top = pairs.select("q", "node", exact.alias("score")).withColumn("rank", ranks("q", "node")).filter(F.col("rank") <= k + 1)
    rows = top.select("q", F.col("node").alias("vec_id"), "score").unionByName(top.join(few(copies), "node").select("q", F.col("copy").alias("vec_id"), "score"))
    rows = rows.withColumn("rank", ranks("q", "vec_id")).filter(F.col("rank") <= k + 1)
    lists_of = stash(rows.groupBy("q").agg(F.collect_list(F.struct("score", "vec_id")).alias("m")), "lists")
    unstash(base, ranked, state)
    answers = asked.join(few(lists_of, 200_000), asked.node == lists_of.q).select("query_id", F.posexplode(F.slice(F.array_sort(F.filter("m", lambda r: r.vec_id != F.col("query_id"))), 1, k)).alias("at", "r"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), "r.vec_id", "r.score")
