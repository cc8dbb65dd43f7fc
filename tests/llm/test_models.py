import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm.op07_language_id import UND, features, fit_languages, fit_svm, language_column, predict_languages, spoken_text
from quern.llm.op10_lm_scoring import END, START, LowOrders, grams, score_documents
from quern.llm.queries import op7_language_id, op10_lm_scoring
from quern.session import table

from .cases import AWKWARD, SCHEMA, awkward, empty, with_clashes

SF = "/root/testdata/sf0.001"


def test_language_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    rows = op7_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_awkward_rows(spark):
    docs = table(spark, SF, "documents").unionByName(awkward(spark).withColumn("doc_id", F.col("doc_id") + 100_000))
    model = fit_languages(docs, F.lit(True))
    rows = predict_languages(with_clashes(awkward(spark)), model).collect()
    assert sorted(r.lang_pred == UND for r in rows) == sorted(not spoken_text(r[1]) for r in AWKWARD)
    assert all((r.score == 0) == (r.lang_pred == UND) for r in rows)
    column = awkward(spark).select("doc_id", language_column(model, F.col("text")).alias("x")).collect()
    assert sorted(str((r.doc_id, r.x.lang_pred, r.x.score)) for r in column) == sorted(str((r.doc_id, r.lang_pred, r.score)) for r in rows)
    none = fit_languages(empty(spark), F.lit(True))
    assert {r.lang_pred for r in predict_languages(awkward(spark), none).collect()} == {UND}
    assert predict_languages(empty(spark), model).count() == 0
    one = fit_languages(docs.filter("lang = 'fr'"), F.lit(True))
    assert {r.lang_pred for r in predict_languages(awkward(spark).filter("doc_id = 1"), one).collect()} == {"fr"}


def test_votes_and_margins_against_single_machines(spark):
    """Each machine fitted alone on all rows, each text judged by itself."""
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    dims, family = 512, {"en": "germanic", "de": "germanic", "fr": "romance", "es": "romance"}
    model = fit_languages(table(spark, SF, "documents"), F.lit(True), dims=dims, per_language=10_000_000)
    train = [docs[k] for k in sorted(docs) if docs[k].lang is not None]
    x = features(pa.array([r.text for r in train]), dims).astype(np.float16).astype(np.float32)
    langs = np.array([r.lang for r in train])

    def machine(plus, minus):
        rows = np.isin(langs, [*plus, *minus])
        return fit_svm(x[rows], np.where(np.isin(langs[rows], plus), 1, -1))

    first = machine(("en", "de"), ("fr", "es"))
    pairs = {"germanic": ("de", "en", machine(("de",), ("en",))), "romance": ("es", "fr", machine(("es",), ("fr",)))}
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(table(spark, SF, "documents"), model).collect()}
    for k, r in docs.items():
        if not spoken_text(r.text):
            assert got[k] == (UND, 0)
            continue
        v = np.append(features(pa.array([r.text]), dims)[0], 1)
        top = v @ first
        a, b, w = pairs["germanic" if top >= 0 else "romance"]
        within = v @ w
        want = (1 / (1 + math.exp(-4 * abs(top)))) / (1 + math.exp(-4 * abs(within)))
        assert got[k] == (a if within > 0 else b, pytest.approx(want, abs=1e-3)) or min(abs(top), abs(within)) < 1e-3
        assert family[got[k][0]] in pairs


def test_languages_whose_rows_share_an_id(spark):
    """All English rows have one id, and a third of all rows are one French row."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    same = docs.withColumn("doc_id", F.when(F.col("lang") == "en", 7).otherwise(F.col("doc_id")))
    one = docs.filter("lang = 'fr' and length(text) > 200").orderBy("doc_id").limit(1)
    same = same.unionByName(one.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("t"))
    model = fit_languages(same, F.lit(True), per_language=100)
    assert all(np.abs(w).max() > 0 for w in [*model.family_w, *(w for ws in model.pair_w for w in ws)])
    said = {r.doc_id: r.lang_pred for r in predict_languages(docs.filter("length(text) > 100"), model).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(said[k] == lang[k] for k in said) > 0.95 * len(said)


def test_letters():
    assert [spoken_text(t) for t in ("²", "½ Ⅷ", "12 _", "", None, "1ª", "é", "12 a", "日")] == [False, False, False, False, False, True, True, True, True]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


ORDER = 4


def ppm(train, text):
    """log10 probability by the recursive definition."""
    order = [defaultdict(Counter) for _ in range(ORDER + 1)]
    for t in train:
        s = [START] * ORDER + [*low(t).encode(), END]
        for k in range(ORDER, len(s)):
            for o in range(ORDER + 1):
                order[o][tuple(s[k - o : k])][s[k]] += 1
    return [coded_length(order, x) for x in text] if isinstance(text, list) else coded_length(order, text)


def coded_length(order, text):
    s, out = [START] * ORDER + [*low(text).encode(), END], 0.0
    possible = set(range(256)) - {START}
    for k in range(ORDER, len(s)):
        excluded, p = set(), 1.0
        for o in range(ORDER, -1, -1):
            counts = {x: n for x, n in order[o][tuple(s[k - o : k])].items() if x not in excluded}
            if not counts:
                continue
            rest = possible - excluded - set(counts)
            whole = sum(counts.values()) + (len(counts) if rest else 0)
            if s[k] in counts:
                out += math.log10(p * counts[s[k]] / whole)
                break
            p *= len(counts) / whole
            excluded |= set(counts)
        else:
            out += math.log10(p / len(possible - excluded))
    return out


def by_last_three(codes, n):
    at = np.lexsort((codes, codes >> 8 & 0xFFFFFF))
    return codes[at], n[at]


def test_code_lengths_against_the_recursive_definition(spark):
    train = ["Abracadabra", "abrakad é", "", "aa", "the cat sat on the mat and the hat"]
    tests = ["abracadabra", "zzz é", "", "bradé ka", "the rat sat on thé mat", "x" * 9]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(train + tests)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_documents(docs, F.col("doc_id") < len(train)).collect()}
    assert [got[k] for k in sorted(got)] == pytest.approx(ppm(train, train + tests), abs=1e-9)


def test_a_context_sums_to_one():
    codes, _ = grams(pa.array(["the cat sat on the mat", "on the hat", "a hot rat"]))
    code, n = np.unique(codes, return_counts=True)
    low_code, of = np.unique(code & 0xFFFFFF, return_inverse=True)
    low_part = LowOrders.of(low_code, np.bincount(of, n))
    for context in (b" the", b"xthe", b"xxhe", b"xxxe", b"xxxx"):
        four = int.from_bytes(context, "big") << 8
        every = np.array([four | s for s in range(256) if s != START])
        seen = dict(zip(code.tolist(), n.tolist(), strict=True))
        others = code[(code >> 8 & 0xFFFFFF == four >> 8 & 0xFFFFFF) & (code >> 8 != four >> 8)]
        c, m = by_last_three(np.append(every, others), np.array([seen.get(x, 0) for x in np.append(every, others).tolist()]))
        p = 10 ** low_part.code_lengths(c, m)
        assert p[c >> 8 == four >> 8].sum() == pytest.approx(1)


def brute_base(docs):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", low(t)) for k, t in docs.items()}
    train = [k for k in docs if zlib.crc32(str(k).encode()) % 5 != 1]
    c = Counter(w for k in train for w in words[k])
    ends, n = len(train), sum(c.values()) + len(train)
    v = len(c) + (ends > 0)
    f = lambda x: math.log10((x + 0.5) / (n + 0.5 * (v + 1)))
    return {k: (len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, sum(f(c[x]) for x in w) + f(ends)) for k, w in words.items()}, train


def test_scoring_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    want, train = brute_base(docs)
    rows = op10_lm_scoring(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == (r.doc_id not in train)
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
    got = {r.doc_id: r.score for r in rows}
    some = sorted(docs, key=lambda d: len(docs[d] or ""))[::4]
    want = ppm([docs[k] for k in train], [docs[d] for d in some])
    assert any(d not in train for d in some) and [got[d] for d in some] == pytest.approx(want, rel=1e-9)


def test_scoring_awkward_rows(spark):
    rows = score_documents(with_clashes(awkward(spark)), F.col("doc_id") < 8).collect()
    assert len(rows) == len(AWKWARD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.doc_id for r in rows if r.trained} == {1, 2, 3, 4, 5, 6, 7}
    assert score_documents(empty(spark), F.lit(True)).count() == 0
    alone = score_documents(spark.createDataFrame([(1, "ab", "en", "a", 2)], SCHEMA), F.lit(False)).first()
    assert alone.score == pytest.approx(3 * math.log10(1 / 255)) and (alone.n_known, alone.train_tokens) == (0, 0)
