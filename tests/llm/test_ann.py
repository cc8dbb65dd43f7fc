import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm.op01_ann import decode, encode, nearest_neighbours
from quern.llm.queries import op1_ann
from quern.session import table

SF = "/root/testdata/sf0.001"


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(axis=1))
        out[q] = [(float(d[j]), int(ids[j])) for j in sorted(range(len(ids)), key=lambda j: (d[j], ids[j])) if ids[j] != q][:k]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({j for _, j in got[q]} & {j for _, j in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("sf,rows", [("/root/testdata/sf0.001", 500), ("/root/testdata/sf0.1", 2000)])
def test_query_against_brute_force(spark, sf, rows):
    e = sorted((r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect())
    ids, x = [k for k, _ in e], np.array([v for _, v in e], float)
    want, got = brute(ids, x, [i for i in ids if i % 100 == 0], 10), found(op1_ann(spark, sf).collect())
    assert len(ids) == rows and recall(got, want) >= 0.95 and all(len(v) == 10 for v in got.values())
    for q, near in got.items():
        for score, j in near:
            assert score == pytest.approx(np.sqrt(((x[ids.index(q)] - x[ids.index(j)]) ** 2).sum()), abs=1e-12)


def test_recall_on_many_isotropic_vectors(spark):
    n = 20_000
    x = np.random.default_rng(3).standard_normal((n, 64)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))})).repartition(8)
    asked = list(range(0, n, 200))
    got = found(nearest_neighbours(df, F.col("id") % 200 == 0).collect())
    x = x.astype(float)
    d = np.sqrt(np.maximum((x[asked] ** 2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * x[asked] @ x.T, 0))
    want = {q: [(row[j], int(j)) for j in np.argsort(row)[:11] if j != q][:10] for q, row in zip(asked, d, strict=True)}
    assert recall(got, want) >= 0.9


def test_graph_search_with_few_entries(spark):
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((1500, 16))
    x[500:900] = x[500] + 1e-3 * rnd.standard_normal((400, 16))  # one large group of near-copies
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    x = x.astype(np.float32).astype(float)
    got = found(nearest_neighbours(df, F.col("id") % 50 == 0, k=10, entries=24, pool=96, step=32, neighbours=16, rounds=6).collect())
    want = brute(range(1500), x, range(0, 1500, 50), 10)
    assert set(got) == set(want) and recall(got, want) > 0.9


def test_ties_in_a_large_group_of_copies_go_to_the_smallest_ids(spark):
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((900, 16)).astype(np.float32)
    x[300:700] = x[300]
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    got = found(nearest_neighbours(df, F.col("id").isin(5, 300, 305, 690), k=10, entries=24, pool=96, step=32).collect())
    assert [j for _, j in got[300]] == list(range(301, 311)) and [j for _, j in got[690]] == list(range(300, 310))
    assert [j for _, j in got[305]] == [j for j in range(300, 311) if j != 305]
    assert recall(got, brute(range(900), x.astype(float), [5, 300, 305, 690], 10)) > 0.9


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (2, [0.0, 2.0]), (10, [3.0, 3.0]), (100, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "score", "rank")})
    got = found(nearest_neighbours(df, F.col("id") % 100 == 0, k=3).collect())
    assert {q: [j for _, j in near] for q, near in got.items()} == {0: [1, 100, 2], 100: [0, 1, 2]}
    assert [s for s, _ in got[0]] == [0.0, 0.5, pytest.approx(5**0.5)]
    few = found(nearest_neighbours(df.filter("vec_id in (0, 2)"), F.col("id") == 0, k=10).collect())
    assert [j for _, j in few[0]] == [2]
    assert nearest_neighbours(df.filter("vec_id = 0"), F.col("id") == 0).count() == 0
    assert nearest_neighbours(df.limit(0), F.col("id") == 0).count() == 0
    assert nearest_neighbours(df.filter("vec_id = 3"), F.col("id") == 3).count() == 0


def test_codes():
    x = np.random.default_rng(2).standard_normal((50, 64)).astype(np.float32)
    norm, y = decode(encode(x))
    assert np.allclose(norm, (x**2).sum(axis=1), rtol=1e-3) and np.abs(x - y).max() <= np.abs(x).max() / 60_000
