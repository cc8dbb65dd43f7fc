"""Resampling, quality scores and the audit of filters against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import op11_importance as R
from quern.llm import op12_quality as Q
from quern.llm import op13_filter_audit as A
from quern.llm.words import BLANKS, NOT_ALNUM, Tally, parts
from tests.llm.cases import AWKWARD, SCHEMA, awkward, empty, with_clashes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", " \n", "one", "to be or not to be, that is\tthe question " * 20, "é ü　x " * 30, "x" * 300 + " " + "y" * 10, " a" * 100, "A B C D E F G H I J K L M N O P Q R S T U"]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def grams(text, smallest, largest):
    words = ALNUM.findall(lowered(text))
    return len(words), [" ".join(words[i : i + m]) for m in range(smallest, largest + 1) for i in range(len(words) - m + 1)]


def test_parts_are_whole_and_cut_at_separators():
    texts = pa.array(TEXTS)
    for size in (1, 7, 50, 10_000):
        whole = {}
        for first, some in parts(texts, BLANKS, size):
            for k, t in enumerate(some.to_pylist()):
                whole.setdefault(first + k, []).append(t)
        assert ["".join(whole.get(k, [])) for k in range(len(TEXTS))] == [t or "" for t in TEXTS]
        for k, t in enumerate(TEXTS):
            assert [w for p in whole.get(k, []) for w in WORDS.findall(p)] == WORDS.findall(t or "")
    assert max(len(some) for _, some in parts(texts, BLANKS, 10_000, 2)) == 2


@pytest.mark.parametrize("size", [1, 13, 60, 100_000])
def test_tally_over_parts(size):
    tally = Tally(len(TEXTS))
    for first, some in parts(pa.array(TEXTS), BLANKS, size):
        tally.add(first, some, BLANKS)
    words = [WORDS.findall(t or "") for t in TEXTS]
    assert tally.words.tolist() == [len(w) for w in words]
    assert tally.distinct.tolist() == [len(set(w)) for w in words]
    assert tally.repeated.tolist() == [sum(a == b for a, b in zip(w, w[1:], strict=False)) for w in words]


@pytest.mark.parametrize("orders", [(1, 1), (1, 2), (2, 3), (1, 4)])
@pytest.mark.parametrize("size", [1, 40, 100_000])
def test_features_over_parts(orders, size):
    features, got, n_words = R.Features(*orders, 97), {}, Counter()
    for first, some in parts(pa.array(TEXTS), NOT_ALNUM, size):
        rows, found, n = features.of(first, some)
        for row, bucket in zip(rows.tolist(), found.tolist(), strict=True):
            got.setdefault(row, Counter())[bucket] += 1
        for k, x in enumerate(n.tolist()):
            n_words[first + k] += x
    for k, text in enumerate(TEXTS):
        count, runs = grams(text, *orders)
        assert n_words[k] == count and got.get(k, Counter()) == Counter(zlib.crc32(g.encode()) % 97 for g in runs)
    with pytest.raises(ValueError):
        R.Features(0, 1, 97)


def brute_resampling(rows, targets, percent, orders, buckets, least):
    runs = [grams(r[1], *orders) for r in rows]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, gs in runs for g in gs), Counter(bucket(g) for x in targets for g in grams(x, *orders)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (doc_id, *_), (n_words, gs) in zip(rows, runs, strict=True):
        weight = sum(gain(bucket(g)) for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    n = percent * len(order) // 100
    ranks = {}
    for k, r in enumerate(order[:n]):
        ranks.setdefault(tuple(map(str, r)), []).append(k + 1)
    return sorted(str((*r[:4], ranks[tuple(map(str, r))].pop(0) if ranks.get(tuple(map(str, r))) else None)) for r in out)


@pytest.mark.parametrize("orders,percent,least", [((1, 1), 50, 1), ((1, 2), 100, 0), ((2, 2), 30, 3), ((1, 1), 0, 1)])
def test_resampling_against_brute_force(spark, orders, percent, least):
    targets = ["the quick brown fox", None, "", "word word tricks"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(targets)], "item_id long, text string")
    for docs in (awkward(spark), with_clashes(awkward(spark)).repartition(5)):
        got = R.importance_sampled(docs, bench, percent, *orders, buckets=50, least_words=least)
        assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got.collect()) == brute_resampling(AWKWARD, targets, percent, orders, 50, least)
    assert R.importance_sampled(empty(spark), bench, 10).count() == 0
    none = bench.limit(0)
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in R.importance_sampled(awkward(spark), none, percent, *orders, buckets=50, least_words=least).collect()) == brute_resampling(AWKWARD, [], percent, orders, 50, least)


def test_resampled_rows(spark):
    docs = with_clashes(awkward(spark))
    sampled = R.importance_sampled(docs, docs, 100, least_words=1)
    drawn = R.resampled(docs, sampled)
    assert drawn.columns == docs.columns and drawn.count() == sum(1 for r in AWKWARD if ALNUM.findall(lowered(r[1])))


def test_many_rows_are_ranked_across_parts(spark):
    rows = [(k // 2, f"w{k % 7} " * 25, None, None, 0) for k in range(4000)]
    got = R.importance_sampled(spark.createDataFrame(rows, SCHEMA).repartition(7), spark.createDataFrame([("w1 w2",)], "text string"), 33)
    ranked = [(r["rank"], -r.score, r.doc_id) for r in got.filter("rank is not null").collect()]
    assert [r[0] for r in sorted(ranked)] == list(range(1, 33 * 4000 // 100 + 1))
    assert sorted(ranked) == sorted(ranked, key=lambda r: (r[1], r[2], r[0]))
    assert got.count() == 4000


@pytest.mark.parametrize("size", [1, 30, 200])
def test_quality_features_over_parts(size, monkeypatch):
    whole = Q.text_features(pa.array(TEXTS))
    monkeypatch.setattr(Q, "PART_BYTES", size)
    assert np.allclose(Q.text_features(pa.array(TEXTS)), whole, atol=1e-6) and np.isfinite(whole).all()


def test_strengths_follow_preferences():
    draw = np.random.default_rng(3)
    x, truth = draw.normal(size=(400, 6)), np.array([2.0, -1.0, 0.5, 0, 0, 0])
    a, b = draw.integers(0, 400, (2, 20_000))
    first = draw.random(20_000) < 1 / (1 + np.exp(-(x[a] - x[b]) @ truth))
    w = Q.fit_strengths(x, np.where(first, a, b), np.where(first, b, a), 1e-6, 600)
    assert np.allclose(w, truth, atol=0.1)


def test_quantile_and_slope():
    assert Q.quantile_between(np.array([3.0, 1.0, 2.0, 4.0]), np.ones(4), 0.5) == 2.5
    assert Q.quantile_between(np.array([1.0]), np.ones(1), 0.3) == 1.0
    y = np.array([0] * 50 + [1] * 50)
    assert Q.fit_slope(np.linspace(-1, 1, 100), y, np.ones(100), 0.0) > 10


def labelled(spark):
    good, bad = "a plain and calm text of words that go on %d ", "LOUD!! $$$ %d LOUD!! LOUD!! "
    docs = [(k, (good if k % 3 else bad) % k * (1 + k % 5), "en", "s", 0) for k in range(300)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 300, 2)], "doc_id long, quality int")


def test_quality_of_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = Q.learn_quality(with_clashes(docs), labels, F.col("doc_id") % 5 != 0, per_label=40)
    found = Q.quality_scores(docs, model).collect()
    assert len(found) == 300 and all(r.predicted == int(r.doc_id % 3 > 0) and r.predicted == int(r.score >= 0.3) for r in found)
    odd = Q.quality_scores(with_clashes(awkward(spark)), model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 for r in odd)
    assert Q.quality_scores(empty(spark), model).count() == 0


def test_quality_with_repeated_ids_and_missing_labels(spark):
    docs, labels = labelled(spark)
    same = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id")))
    many = same.unionByName(same.filter("doc_id = 0")).unionByName(same.filter("doc_id = 1"))
    model = Q.learn_quality(many, labels, F.lit(True), per_label=30)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in Q.quality_scores(docs, model).collect())
    one = Q.learn_quality(docs, labels.filter("quality = 1"), F.lit(True))
    assert {r.score for r in Q.quality_scores(docs, one).collect()} == {1.0}
    none = Q.learn_quality(docs, labels.limit(0), F.lit(True))
    assert {(r.score, r.predicted) for r in Q.quality_scores(awkward(spark), none).collect()} == {(0.5, 1)}
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    assert Q.learn_quality(docs, nulls, F.lit(True)).w is None


def test_quality_is_learned_from_all_rows(spark):
    """The weights are those of least loss over all pairs, not over those of the first rows."""
    draw = np.random.default_rng(5)
    words = ["plain", "calm", "LOUD", "$$$", "text", "of", "words", "12"]
    texts = [" ".join(draw.choice(words, 5 + k % 40)) for k in range(400)]
    quality = [int(t.count("LOUD") + draw.integers(0, 3) < t.count("calm") + 2) for t in texts]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int")
    model = Q.learn_quality(docs.unionByName(docs.filter("doc_id < 30")).repartition(3), labels, F.lit(True), per_label=20)
    x, y = Q.text_features(pa.array(texts)).astype(np.float64), np.array(quality)
    good, bad = x[y == 1], x[y == 0]
    pull = 1 / (1 + np.exp((good @ model.w)[:, None] - bad @ model.w)) / len(good) / len(bad)
    gradient = pull.sum(axis=0) @ bad - pull.sum(axis=1) @ good + Q.PENALTY * model.w
    assert gradient @ Q.inverse_curvature(x, y, model.w) @ gradient < 1e-6
    strength = np.sort(x @ model.w)
    assert np.isclose(model.threshold, strength[len(bad) - 1 : len(bad) + 1].mean(), atol=1e-9)
    assert np.isclose(model.slope, Q.fit_slope(x @ model.w - model.threshold, y, np.ones(400), np.log(0.3 / 0.7)))


def brute_audit(rows, labels):
    good, bad = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    firsts = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            firsts[text or ""] = min(firsts.get(text or "", doc_id), doc_id)
    failing, parts_ = [], sorted({r[3] or "" for r in rows})
    for doc_id, text, _, source, _ in rows:
        t = text or ""
        words, first = WORDS.findall(t), firsts.get(t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": first is not None and (doc_id is None or doc_id > first),
        }
        failing.append((source or "", {f for f, x in fails.items() if x}, doc_id in good, doc_id in bad))
    out = []
    for part in parts_:
        cells, removed_by = [], Counter()
        for order in permutations("ABCDE"):
            left = [r for r in failing if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failed = sum(f in r[1] for r in failing if r[0] == part)
                removed_by[f] += len(gone)
                cells.append([part, "".join(order), step, f, len(left), len(gone), failed - len(gone), sum(r[1] == {f} for r in failing if r[0] == part), sum(r[2] for r in gone), sum(r[3] for r in gone)])
        out += [str([*c, removed_by[c[3]]]) for c in cells]
    return sorted(out)


def test_audit_against_brute_force(spark):
    some = [(k, t, "en", f"s{k % 2}", 0) for k, t in enumerate(["LOUD " * 60, "calm words " * 40, "a $ b", " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}" for k in range(80)), "LOUD " * 60, None, ""], 20)]
    rows = AWKWARD + some + [(None, "a $ b", None, "s0", 0), (None, "only here", None, None, 0), (None, "only here", None, None, 0), (23, some[3][1], None, "s1", 0)]
    labels = [(1, 1, 0), (20, 0, 1), (21, 1, 1), (24, 1, None), (25, None, 1), (25, 1, 0), (None, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    for df in (docs, with_clashes(docs).withColumns({"mask": F.lit("x"), "part": F.lit("x"), "digest": F.lit("x")}).repartition(5)):
        got = A.filter_audit(df, told)
        assert sorted(str([r[c] for c in ("part", "filter_order", "step", "filter", *A.COUNTS, "shapley")]) for r in got.collect()) == brute_audit(rows, labels)
    assert A.filter_audit(empty(spark), told).count() == 0
    assert A.filter_audit(docs, told.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_audit_masks_over_parts(monkeypatch):
    whole = A.text_masks(pa.array(TEXTS), 5, 65, 5)
    monkeypatch.setattr(A, "parts", lambda t, s: parts(t, s, 20))
    assert A.text_masks(pa.array(TEXTS), 5, 65, 5).tolist() == whole.tolist()
