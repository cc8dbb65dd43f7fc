"""Running aggregates, corrections of large families and exact random examples."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import ordering, retrieval, significance


@pytest.mark.parametrize("back,own", [(False, False), (False, True), (True, False), (True, True)])
def test_running_over_parts(spark, back, own):
    rnd = np.random.default_rng(4)
    rows = [(f"g{g}" if g else None, k, int(v)) for g in range(3) for k, v in enumerate(rnd.integers(-50, 50, (5, 900, 40)[g]))]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(6)
    placed = ordering.ordered(df, ["g"], ["k"])
    assert placed.filter("g = 'g1'").select("quern_part").distinct().count() > 1
    got = {(r.g, r.k): (r.s, r.a, r.b) for r in ordering.bare(ordering.running(placed, ["g"], own=own, back=back, s=("sum", "v"), a=("max", "v"), b=("min", "v"))).collect()}
    for g in (None, "g1", "g2"):
        v = [x for h, _, x in rows if h == g]
        for k in range(len(v)):
            seen = v[k + (not own) :] if back else v[: k + own]
            assert got[g, k] == (sum(seen), max(seen, default=None), min(seen, default=None))


def test_numbers(spark):
    rows = ordering.numbered(spark.range(2000).repartition(5), [], [F.desc("id")], "n").collect()
    assert {r.id: r.n for r in rows} == {k: 1999 - k for k in range(2000)}
    assert ordering.numbered(spark.range(0), [], ["id"], "n").count() == 0


def brute_correction(p, method):
    order = sorted((k for k in range(len(p)) if p[k] is not None), key=lambda k: p[k])
    m, out = len(order), [None] * len(p)
    steps = [(m - i) * p[k] if method == "holm" else m / (i + 1) * p[k] for i, k in enumerate(order)]
    for i, k in enumerate(order):
        out[k] = min(1.0, max(steps[: i + 1]) if method == "holm" else min(steps[i:]))
    return out


@pytest.mark.parametrize("method", ["holm", "bh"])
def test_corrections_of_large_families(spark, method):
    rnd = np.random.default_rng(5)
    families = {"large": [float(x) for x in np.round(rnd.random(3000) ** 4, 4)], None: [0.01, None, 0.04, 0.01, 0.03], "same": [0.2] * 50}
    rows = [(f, k, p) for f, ps in families.items() for k, p in enumerate(ps)]
    tests = spark.createDataFrame(rows, "family string, k int, p double").repartition(7)
    out = significance.corrected(tests, "p", "family", method=method)
    assert out.columns == ["family", "k", "p", "p_corr"]
    got = {(r.family, r.k): r.p_corr for r in out.collect()}
    for f, ps in families.items():
        for k, want in enumerate(brute_correction(ps, method)):
            assert got[f, k] == (want if want is None else pytest.approx(want, abs=1e-12))
    assert significance.corrected(tests.limit(0), "p", "family", method=method).count() == 0
    with pytest.raises(ValueError):
        significance.corrected(tests, "p", "family", method="none")


def test_every_item_gets_all_random_examples(spark):
    """990 of 1000 items are of one project: each has ten possible examples."""
    items = spark.range(1000).select("id", F.when(F.col("id") < 990, "large").otherwise("small").alias("project"))
    got = {}
    for r in retrieval.random_items(items, items, 5).collect():
        got.setdefault(r.id, []).append((r["rank"], r.example_id))
    assert len(got) == 1000
    for k, found in got.items():
        assert sorted(r for r, _ in found) == [1, 2, 3, 4, 5] and len({e for _, e in found}) == 5
        assert all((e < 990) != (k < 990) for _, e in found)
    drawn = Counter(e for k, found in got.items() if k < 990 for _, e in found)
    assert set(drawn) == set(range(990, 1000)) and all(400 < n < 590 for n in drawn.values())
    first = Counter(e for k, found in got.items() if k < 990 for r, e in found if r == 1)
    assert all(60 < n < 140 for n in first.values())


def test_random_examples_of_odd_items(spark):
    items = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, None), (4, "b"), (None, "b")], "id long, project string")
    got = {}
    for r in retrieval.random_items(items, items, 9).collect():
        got.setdefault(r.id, set()).add(r.example_id)
    assert got == {1: {3, 4, None}, 2: {3, 4, None}, 3: {1, 2, 4, None}, 4: {1, 2, 3}, None: {1, 2, 3}}
    alone = items.filter("project = 'a'")
    assert retrieval.random_items(alone, alone, 3).count() == 0 and retrieval.random_items(items, items.limit(0), 3).count() == 0
    strangers = spark.createDataFrame([(7, "new")], "id long, project string")
    assert {r.example_id for r in retrieval.random_items(strangers, items, 9).collect()} == {1, 2, 3, 4, None}
    assert sorted(map(str, retrieval.random_items(items.repartition(3), items.repartition(5), 2, seed=1).collect())) == sorted(map(str, retrieval.random_items(items, items, 2, seed=1).collect()))
    assert retrieval.random_items(items, items, 2, seed=1).collect() != retrieval.random_items(items, items, 2, seed=2).collect()
