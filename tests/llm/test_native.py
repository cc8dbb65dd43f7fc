import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm.op02_decontamination import _FAST, _SLOW, decontaminated, leaked_windows
from quern.llm.op02_decontamination import ORACLE_SQL as LEAKS_SQL
from quern.llm.op04_url_reputation import ORACLE_SQL, domain_of, host_of, judge_urls, suffix_of
from quern.llm.queries import URL_RULES, op2_decontamination, op4_url_reputation
from quern.session import table

from .cases import AWKWARD, awkward, empty, with_clashes

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def grams(w, size):
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute(docs, items, size=5, threshold=0.8):
    """(doc, item) -> (greatest similarity, its first start) over all windows of the item's length."""
    out = {}
    for i, t in items.items():
        if not (w := words(t)):
            continue
        k = min(size, len(w))
        own = grams(w, k)
        for d, text in docs.items():
            v = words(text)
            each = [tuple(v[a : a + k]) for a in range(len(v) - k + 1)]
            m, other, common = len(w) - k + 1, Counter(), 0
            for e, g in enumerate(each):
                common += other[g] < own[g]
                other[g] += 1
                if e >= m:
                    old = each[e - m]
                    other[old] -= 1
                    common -= other[old] < own[old]
                if e < min(m, len(each)) - 1:
                    continue
                alike = common / (sum(own.values()) + min(e + 1, m) - common)
                if common and alike >= threshold and alike > out.get((d, i), (0, 0))[0]:
                    out[d, i] = alike, max(e - m + 1, 0)
    return out


def planted():
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = {k: " ".join(rnd.choices(vocabulary, k=rnd.randrange(15, 60))) for k in range(20)} | {20: "only three words", 21: "", 22: "x"}
    docs = {}
    for k in range(60):
        w = rnd.choices(vocabulary, k=rnd.randrange(0, 80))
        own = words(items[rnd.randrange(20)])
        for _ in range(k % 5):  # edits: replaced, dropped and added words
            at, how = rnd.randrange(len(own)), rnd.randrange(3)
            own[at : at + (how < 2)] = [] if how == 1 else ["edit"]
        at = rnd.randrange(len(w) + 1)
        docs[k] = " ".join(w[:at] + own + w[at:]).title()
    return docs | {100: "", 101: None, 102: items[3], 103: "x only  three\nWORDS y", 104: " ".join(words(items[4])[:-3])}, items


@pytest.mark.parametrize("block_rows", [40, 2_000_000])
def test_windows_against_all_windows(spark, block_rows):
    docs, items = planted()
    rows = leaked_windows(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), block_rows=block_rows).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.start) for r in rows} == brute(docs, items)
    assert {(103, 20), (103, 22), (102, 3)} <= {(r.doc_id, r.item_id) for r in rows}
    assert all(r.n_words == len(words(items[r.item_id])) for r in rows)


def test_windows_between_two_alignments(spark):
    own = [f"w{k}" for k in range(120)]
    moved = ["x"] * 5 + own[5:60] + [f"y{k}" for k in range(8)] + own[60:117] + ["z"] * 3
    often = "a b a b a b a b c d e f g h i j k l m n o p a b a b".split()
    docs = {1: " ".join(["q"] * 30 + moved + ["r"] * 30), 2: " ".join(moved), 3: " ".join(own[:104]), 4: " ".join("a b a b a b a b a b".split() + often), 5: " ".join(own[3:]), 6: " ".join(own[:110] + ["v"] * 10)}
    items = {1: " ".join(own), 2: " ".join(often), 3: " ".join(own[::-1]), 4: " ".join(own[:60])}
    rows = leaked_windows(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start) for r in rows} == want and want[1, 1] == (0.8125, 35)


def test_query_against_all_windows(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in op2_decontamination(spark, SF).collect()}
    assert got == brute(docs, items)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(LEAKS_SQL).fetchall()
    assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in op2_decontamination(spark, sf).collect())


def test_awkward_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "The quick brown fox's 12 tricks,"), (2, None), (3, "")], "item_id long, text string")
    rows = leaked_windows(with_clashes(awkward(spark)), items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (10, 1)}
    assert leaked_windows(empty(spark), items).count() == 0 and leaked_windows(awkward(spark), items.filter("item_id > 1")).count() == 0
    docs = with_clashes(awkward(spark))
    kept = decontaminated(docs, items)
    assert kept.schema == docs.schema and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in AWKWARD if r[0] not in (1, 10))


def test_fingerprint(spark):
    rnd = random.Random(1)
    cases = [[-1, -1, 0], [5], [0], [-1], *([rnd.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (2, 7, 40, 301))]
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in c) > len(c)) for c in cases]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, shingles array<long>").withColumns({"fast": F.expr(_FAST), "slow": F.expr(_SLOW)}).orderBy("k").collect()
    assert [r.fast & (1 << 64) - 1 for r in rows] == [r.slow & (1 << 64) - 1 for r in rows] == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_url_query_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in op4_url_reputation(spark, sf).collect())


def test_hosts_rules_and_reputation(spark):
    urls = ["HTTP://WWW.Example.com/en/x?q", "https://example.com/en/", "https://example.com/EN/", "x://net/es/", "x://a.net/es/1", "http://a.net/es", "https://u@b.org:80", None, "no scheme", "", "a://b://c/d", "http://bad.org/x", "http://bad.org/y", "http://new.bad.org/", "http://fine.org/", "http://ünï.org/en/"]
    pages = with_clashes(spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)] + [(None, "http://bad.org/", "x"), (1, urls[1], None)], "page_id long, url string, html string"))
    bad = spark.createDataFrame([("http://bad.org/1", 1)] * 40 + [("http://fine.org/", 0)] * 60 + [("http://z.co.uk/", None), (None, 1)], "url string, bad int")
    rows = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in judge_urls(pages, bad, URL_RULES).collect()}
    assert len(rows) == len(urls) + 1
    by = {k: v for (k, _), v in rows.items()}
    assert by[0] == ("/en/x", "www.example.com/en/", "allow") and by[1] == ("/en/", "example.com/en/", "block") and by[2] == ("/EN/", "com/", "allow")
    assert by[3][1:] == by[4][1:] == ("net/es/", "block") and by[5] == ("/es", None, "allow") and by[6] == ("", None, "allow")
    assert by[7] == by[8] == by[9] == ("", None, "allow") and rows[10, "b:"][0] == "//c/d"
    assert by[11][2] == by[12][2] == rows[None, "bad.org"][2] == "block" and by[14][2] == "allow"
    none = judge_urls(pages, bad.limit(0), URL_RULES).filter("host = 'bad.org'").collect()
    assert {r.verdict for r in none} == {"allow"}
    assert judge_urls(pages.limit(0), bad, URL_RULES).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("http://u:p@a.b.co.uk:8080/x",), ("https://localhost/",), ("https://x.y.example.com",)], "url string")
    got = df.select(host_of(F.col("url")).alias("h")).select("h", domain_of(F.col("h")), suffix_of(F.col("h"))).collect()
    own = df.select(domain_of(host_of(F.col("url")), ["example.com"]), suffix_of(host_of(F.col("url")), ["example.com"])).collect()
    assert tuple(own[2]) == ("y.example.com", "example.com") and tuple(own[0]) == ("co.uk", "uk")
    assert [tuple(r) for r in got] == [("u:p@a.b.co.uk:8080", "b.co.uk", "co.uk"), ("localhost", "localhost", "localhost"), ("x.y.example.com", "example.com", "com")]


def test_items_without_id_are_found(spark):
    docs = spark.createDataFrame([(1, "so a b c d e f g it is"), (2, "nothing of that kind is here"), (3, "p q r s t u v")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c d e f g"), (None, "p q r s t u v"), (4, "p q r s t u v")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaked_windows(docs, items).collect()} == {(1, None), (3, None), (3, 4)}
    assert [r.doc_id for r in decontaminated(docs, items).collect()] == [2]
