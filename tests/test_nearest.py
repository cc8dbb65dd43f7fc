"""Exact most similar items against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import nearest, prompts, retrieval
from quern.operators.retrieval import similar_items

SCHEMA = "id long, project string, embedding array<double>"


def brute(items, queries, k, threshold, below):
    usable = [r for r in items if r[0] is not None and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[2]) and any(r[2])]
    x = np.array([r[2] for r in usable], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r[0] for r in usable])
    projects = np.array([r[1] for r in usable], object)
    out = {}
    for key, project, v in queries:
        q = np.array(v, float)
        cos = np.round(x @ (q / np.linalg.norm(q)), 12)
        fits = np.flatnonzero((projects != project) & ((cos < threshold) if below else (cos >= threshold)))
        for rank, j in enumerate(fits[np.lexsort((ids[fits], -cos[fits]))][:k], 1):
            out[key, rank] = (int(ids[j]), round(float(cos[j]), 4))
    return out


def found(df):
    rows = df.collect()
    out = {(r.id, r["rank"]): (r.example_id, r.cos) for r in rows}
    assert len(out) == len(rows)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[key][0] == want[key][0] and got[key][1] == pytest.approx(want[key][1], abs=1e-4) for key in want)


def clustered(n, dims, clusters, seed):
    rnd = np.random.default_rng(seed)
    centers = rnd.standard_normal((clusters, dims))
    return centers[rnd.integers(0, clusters, n)] + 0.15 * rnd.standard_normal((n, dims)), rnd


def test_clustered_items_are_not_all_compared(spark):
    """20,000 rows, a seventh of them equal to each other, over many blocks."""
    x, rnd = clustered(20_000, 16, 60, 1)
    x[rnd.permutation(20_000)[:3000]] = x[0]
    rows = [(k, f"p{p}", v.tolist()) for k, (p, v) in enumerate(zip(rnd.integers(0, 9, 20_000).tolist(), x, strict=True))]
    items = spark.createDataFrame(rows, SCHEMA).repartition(6)
    some = [rows[k] for k in range(0, 20_000, 40)]
    report = {}
    same(found(similar_items(items, items, 5, 0.97, report=report).filter("id % 40 = 0")), brute(rows, some, 5, 0.97, True))
    assert report["pairs"] == 20_000**2 and report["compared"] < 0.25 * report["pairs"]
    same(found(similar_items(spark.createDataFrame(some, SCHEMA), items, 5, 0.99, below=False)), brute(rows, some, 5, 0.99, False))


def test_projects_that_are_clusters(spark):
    """No item of the nearest blocks is eligible."""
    rnd = np.random.default_rng(2)
    centers = rnd.standard_normal((12, 8))
    rows = [(k, f"p{k % 12}", (centers[k % 12] + 0.05 * rnd.standard_normal(8)).tolist()) for k in range(2400)]
    items = spark.createDataFrame(rows, SCHEMA)
    same(found(similar_items(items, items, 4, 0.9)), brute(rows, rows, 4, 0.9, True))


@pytest.mark.parametrize("below", [True, False])
def test_small_blocks_of_isotropic_items(spark, monkeypatch, below):
    for name, value in (("BLOCK", 7), ("GROUP", 2), ("PAGE", 3)):
        monkeypatch.setattr(nearest, name, value)
    rnd = np.random.default_rng(3)
    rows = [(k, f"p{k % 3}" if k % 5 else None, rnd.standard_normal(5).round(1).tolist()) for k in range(300)] + [(7, "p9", [1.0, 0.0, 0.0, 0.0, 0.0])]
    items = spark.createDataFrame(rows, SCHEMA)
    asked = rows[:300]
    queries = items.filter("project is null or project <> 'p9'")
    same(found(similar_items(queries, items, 3, 0.6, below)), brute(rows, [r for r in asked if any(r[2])], 3, 0.6, below))


def test_equal_vectors_in_many_blocks(spark):
    rows = [(k, "a" if k % 2 else "b", [1.0, 2.0, 3.0]) for k in range(6000)]
    items = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = found(similar_items(items, items, 5, 1.5))
    assert len(got) == 30_000 and all(got[k, r][0] == 2 * (r - 1) + (k % 2 == 0) for k, r in got)


def test_odd_vectors_have_no_part(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "b", [0.0, 0.0]), (3, "b", None), (4, "b", [1.0, None]), (5, "b", [float("nan"), 1.0]), (6, "b", [float("inf"), 1.0]), (None, "b", [1.0, 0.1]), (8, "b", [1.0, 1.0]), (9, None, [1.0, 0.5]), (10, None, [1.0, 0.5])]
    items = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("block", "matrix", "cos", "rank", "query")})
    got = found(similar_items(items, items, 9, 2.0))
    assert {(k, e) for (k, _), (e, _) in got.items()} == {(1, 8), (1, 9), (1, 10), (8, 1), (8, 9), (8, 10), (9, 1), (9, 8), (10, 1), (10, 8)}
    for a, b in ((items.limit(0), items), (items, items.limit(0)), (items.filter("id = 2"), items)):
        assert similar_items(a, b, 3).count() == 0


@pytest.mark.parametrize("below,threshold", [(True, 0.9), (False, 0.3)])
def test_blocks_are_shuffled_a_bounded_number_of_times(spark, below, threshold):
    """However many parts shuffles have, a block goes to at most GROUPS groups, as it came."""
    n, dims = 2048, 32
    x = np.random.default_rng(4).standard_normal((n, dims)).astype(np.float32)
    rows = [(k, f"p{k % 3}", v.tolist()) for k, v in enumerate(x)]
    items = spark.createDataFrame(rows, SCHEMA.replace("double", "float"))
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        bus.waitUntilEmpty(30_000)
        return store.executorList(True).apply(0).totalShuffleWrite()

    parts, before = spark.conf.get("spark.sql.shuffle.partitions"), shuffled()
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = found(similar_items(items, items, 3, threshold, below))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    same(got, brute(rows, rows, 3, threshold, below))
    assert shuffled() - before < 40 * n * dims * 4


#: What is made of the examples of text ids, further on in a chain.
CHAINS = {
    "lists": lambda found, items: retrieval.example_lists(found, 3),
    "prompts": lambda found, items: prompts.prompts(coded(items), "", prompts.example_sections(found, coded(items), 3)),
}


def coded(items):
    return items.select("id", F.col("id").alias("code_formatted"), F.col("project").alias("doc_constraint"))


@pytest.mark.parametrize("chain", CHAINS)
def test_chains_over_text_ids_shuffle_no_more(spark, chain):
    n, dims = 2048, 32
    x = np.random.default_rng(5).standard_normal((n, dims)).astype(np.float32)
    items = spark.createDataFrame([(f"v{k}", f"p{k % 3}", v.tolist()) for k, v in enumerate(x)], "id string, project string, embedding array<float>")
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        bus.waitUntilEmpty(30_000)
        return store.executorList(True).apply(0).totalShuffleWrite()

    parts, before = spark.conf.get("spark.sql.shuffle.partitions"), shuffled()
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        assert len({r.id for r in CHAINS[chain](similar_items(items, items, 3, 0.9), items).collect()}) == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert shuffled() - before < 60 * n * dims * 4
