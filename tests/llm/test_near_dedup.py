import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm.op05_near_dedup import BANDS, ROWS, components, crossing_pairs, deduplicated, near_duplicates, shingle_sets, signature
from quern.llm.queries import op5_near_dedup
from quern.session import table

from .cases import AWKWARD, SCHEMA, awkward, empty, with_clashes

SF = "/root/testdata/sf0.001"


def brute(docs, size, percent=80):
    """doc_id -> (set size, component) by counting common shingles of all pairs."""
    sets, holders = {}, defaultdict(list)
    for k, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        for x in sets[k]:
            holders[x].append(k)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j != k).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def same(rows, docs, size):
    want = brute(docs, size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(docs)


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    same(op5_near_dedup(spark, SF).collect(), docs, 4)


def test_chains_copies_and_edits(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = rnd.choices(words, k=300)
    docs = {k: " ".join(base) for k in range(40)}  # exact copies
    chain = base[:]
    for k in range(100, 160):  # a chain whose ends are unlike each other
        docs[k] = " ".join(chain)
        for _ in range(4):
            chain[rnd.randrange(len(chain))] = rnd.choice(words)
    for k in range(200, 260):  # near copies of one text
        own = base[:]
        for _ in range(rnd.randrange(9)):
            own[rnd.randrange(len(own))] = f"x{rnd.random()}"
        docs[k] = " ".join(own)
    docs |= {300 + k: " ".join(rnd.choices(words, k=50)) for k in range(40)}
    docs |= {400: "one two", 401: "One  TWO", 402: "", 403: "", 404: "one"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    same(near_duplicates(df, size=5).collect(), docs, 5)


def test_awkward_rows(spark):
    rows = near_duplicates(with_clashes(awkward(spark))).collect()
    assert len(rows) == len(AWKWARD) and near_duplicates(empty(spark)).count() == 0
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[10] == {(1, False)} and by[1] == {(1, True)} and by[None] == {(None, True)} and by[3] == {(3, True)} and by[4] == {(4, True)}


def test_repeated_ids_with_other_texts_share_a_component(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_deduplicated_keeps_columns(spark):
    docs = with_clashes(awkward(spark))
    out = deduplicated(docs)
    assert out.schema == docs.schema
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(k) for k in {r[0] for r in AWKWARD} - {10})
    assert deduplicated(empty(spark)).count() == 0


def test_unlike_texts_of_one_id_stay(spark):
    a, b, c = ("".join(f"{w}{k} " for k in range(40)) for w in "abc")
    docs = spark.createDataFrame([(1, a), (5, a + "more"), (5, b), (5, b), (6, c), (7, b), (7, None), (7, ""), (None, a)], "doc_id long, text string")
    assert sorted(map(str, deduplicated(docs).collect())) == sorted(map(str, spark.createDataFrame([(1, a), (5, b), (6, c), (7, None), (7, ""), (None, a)], docs.schema).collect()))


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.vertex: r.component for r in components(links).collect()}
    assert got == {k: 0 for k in range(1, 31)} | {101: 100, 102: 100}


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(1)
    whole = rnd.integers(0, 2**63, 1500).astype(np.uint64)
    with np.errstate(over="ignore"):
        a, b = signature(np.sort(whole[:1200]), BANDS * ROWS), signature(np.sort(whole[300:]), BANDS * ROWS)
    assert abs((a == b).mean() - 900 / 1500) < 0.12
    sets = shingle_sets(pa.array(["A b c d E", "a  B c\td e", None]), 4)
    assert np.array_equal(sets[0], sets[1]) and len(sets[0]) == 2 and len(sets[2]) == 0


def test_crossing_pairs_against_all_pairs(spark):
    rnd = random.Random(8)
    template = list(range(1000, 1100))
    sets = []
    for k in range(60):
        kept = rnd.sample(template, rnd.randrange(70, 101))
        sets.append(set(kept) | {10_000 * (k + 1) + j for j in range(rnd.randrange(0, 40))})
    sets += [set(range(50 * k, 50 * k + rnd.randrange(1, 12))) for k in range(10)] + [{7}, {7}, set(template), set(template[:80])]
    rows = [(k, k, np.array(sorted(s), np.uint64).tobytes()) for k, s in enumerate(sets)]
    got = {(r.a, r.b) for r in crossing_pairs(spark.createDataFrame(rows, "rep long, component long, shingles binary"), 80).collect()}
    near = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert near <= got and len(near) > 20


def test_a_template_with_large_own_parts_gives_no_pairs(spark):
    rows = [(k, k, np.array(sorted([*range(1000, 1085), *range(10_000 * (k + 1), 10_000 * (k + 1) + 15)]), np.uint64).tobytes()) for k in range(200)]
    assert crossing_pairs(spark.createDataFrame(rows, "rep long, component long, shingles binary"), 80).count() == 0
