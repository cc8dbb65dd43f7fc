"""Operators on small tables, with values worked out by hand or published."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import columns as C
from quern.jobs import carriers, evaluation
from quern.operators import inference, metrics, prompts, retrieval, scoring, significance, slices
from quern.sources import tables
from quern.streaming.scoring import score_arrivals

SF = "/root/testdata/sf0.001"


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v string").orderBy("k").select(column(F.col("v"))).collect()]


def test_canonical(spark):
    said = {
        "myList.isEmpty()": "(myList.LEN == 0)",
        "!(myList.isEmpty())": "!((myList.LEN == 0))",
        "x > 0 && myVar.isEmpty()": "x > 0 && (myVar.LEN == 0)",
        "myStr.isBlank()": "(myStr.trim().LEN == 0)",
        "a.equals(b)": "(a == b)",
        '!("a".equals(b))': '!(("a" == b))',
        "obj.equals(another.get(index.sub(1)))": "(obj == another.get(index.sub(1)))",
        "CollectionUtils.isEmpty(c)": "(c == null || (c.LEN == 0))",
        "StringUtils.isBlank(s)": "(s == null || (s.trim().LEN == 0))",
        "size() > 0": "this.LEN > 0",
        "x instanceof Foo": "x.TYPE == Foo",
        "(True)": "",
        "none": "",
    }
    assert one(spark, C.canonical, *said) == list(said.values())


def test_equals_at_any_depth(spark):
    said = {
        "a.equals(b.equals(c))": "(a == (b == c))",
        "a.equals(b.equals(c.equals(d)) && e.equals( f ))": "(a == (b == (c == d)) && (e == f))",
        "a.equals(f(g(h(i(j(k))))))": "(a == f(g(h(i(j(k))))))",
        'a.equals(")(") && "x\\")".equals(b)': '(a == ")(") && ("x\\")" == b)',
        "a.b().c.equals(d)": "(a.b().c == d)",
        "get(a).equals(b)": "get(a).equals(b)",
        "a.equals (b": "a.equals (b",
        "(a.equals(b) || c.equals(": "((a == b) || c.equals(",
        "a) && b.equals(c)": "a) && (b == c)",
        "x.equals()": "(x == )",
        # no special case, as nothing tells a class from a value
        "Objects.equals(a, b)": "(Objects == a, b)",
        "f(" * 60 + "a.equals(b)" + ")" * 60: "f(" * 60 + "(a == b)" + ")" * 60,
        "plain": "plain",
    }
    assert one(spark, C.equals_calls, *said) == list(said.values())


def test_candidates_and_rejection(spark):
    text = "So `a > 0` holds.\n\n```java\nb > 0\n```\n\nFinal expression: c > 0\nFinal Expression is: d > 0"
    assert one(spark, C.candidates, text)[0][:3] == ["d > 0", "b > 0", "a > 0"] or one(spark, C.candidates, text)[0][0] == "d > 0"
    said = {"x > 0": False, "isPositive": False, "int d = 3;": True, "throw x": True, "a = b": True, 's.contains("=")': False, "We get this:": True, "It ends. Here": True, "- x > 0": True, "just some words": True, "": True}
    assert one(spark, C.rejected, *said) == list(said.values())


def test_format_errors(spark):
    assert one(spark, C.format_error, "(a)", "(a", "a)", "a &&", "", "((a) || (b))") == [None, "parse_error: unmatched opening parenthesis", "parse_error: mismatched parentheses", "parse_error: trailing dangling operator", None, None]


def test_comments_and_calls(spark):
    assert one(spark, C.without_comments, 'a = "// no"; // yes', "x /* y\n z */ + '\"' // q", 'b("/* no */")') == ['a = "// no"; ', "x  + '\"' ", 'b("/* no */")']
    said = {"assertEquals": True, "AssertThat": True, "requireNonNull": True, "orElseThrow": True, "getName": False, "testnotNull": False, "isTrueish": False}
    assert one(spark, C.asserting_call, *said) == list(said.values())


def test_evaluation_of_odd_rows(spark):
    gold = spark.createDataFrame([("1", "a > 0"), ("2", None), ("3", "x"), ("4", "b")], "id string, doc_constraint string")
    said = spark.createDataFrame([("1", "Final Expression: a > 0"), ("1", "a > 0"), ("2", None), ("3", "It is so."), ("9", "x")], "id string, text string")
    got = {(r.id, r.text): (r.parse_failed, r.code_constraint, r.strict_f1, r.relaxed_f1, r.doc_constraint_subs, r.code_constraint_subs) for r in scoring.evaluated(gold, said).collect()}
    assert got == {("1", "Final Expression: a > 0"): (0, "a > 0", 1.0, 1.0, 1, 1), ("1", "a > 0"): (0, "a > 0", 1.0, 1.0, 1, 1), ("2", None): (0, "", 1.0, 1.0, 0, 0), ("3", "It is so."): (1, "parse_error: no extractable expression", 0.0, 0.0, 1, 0)}
    assert scoring.evaluated(gold, said.limit(0)).count() == 0


def test_holm_and_bh(spark):
    raw = [1.1190919250889892e-39, 1.4639671473841783e-38, 0.0858611316007757, 2.980213202089613e-29]
    df = spark.createDataFrame([("f", p) for p in raw], "f string, p double")
    got = {r.p: r.p_corr for r in significance.corrected(df, "p", "f").collect()}
    assert [got[p] for p in raw] == pytest.approx([4.476367700355957e-39, 4.391901442152535e-38, 0.0858611316007757, 5.960426404179226e-29], rel=1e-12)
    bh = {r.p: r.p_corr for r in significance.corrected(spark.createDataFrame([("f", p) for p in (0.01, 0.04, 0.03, 0.9)], "f string, p double"), "p", "f", method="bh").collect()}
    assert [bh[p] for p in (0.01, 0.04, 0.03, 0.9)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.9])


@pytest.mark.parametrize("x,df,p", [(439.5087, 4, 8.050e-94), (15.1777, 4, 4.346e-3), (501.9404, 16, 1.295e-96), (3.841459, 1, 0.05), (7.814728, 3, 0.05), (0.0, 2, 1.0)])
def test_chi2_tail(x, df, p):
    assert significance.chi2_p(x, df) == pytest.approx(p, rel=1e-3)


def test_normal_tail():
    assert significance.normal_p(1.959964) == pytest.approx(0.05, rel=1e-5) and significance.normal_p(None) is None


def pairs(spark, x, y):
    return spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y, strict=True)], "g string, x double, y double")


def test_wilcoxon_and_delta(spark):
    w = significance.wilcoxon(pairs(spark, [0, 1, -2, 3], [0, 0, 0, 0]), "g").first()
    assert (w.n, w.statistic) == (4, 3.5) and w.z == pytest.approx(-1.5 / math.sqrt(7.5))
    assert significance.wilcoxon(pairs(spark, [0, 0], [0, 0]), "g").first().statistic == 1.5
    assert significance.cliffs_delta(pairs(spark, [1, 2, 3], [2, 2, 2]), "g").first().delta == 0
    assert significance.cliffs_delta(pairs(spark, [3, 3], [1, 2]), "g").first().delta == 1
    assert significance.cliffs_delta(pairs(spark, [], []), "g").count() == 0
    rnd = np.random.default_rng(4)
    x, y = rnd.integers(0, 9, 200), rnd.integers(0, 9, 200)
    assert significance.cliffs_delta(pairs(spark, x, y), "g").first().delta == pytest.approx(np.sign(x[:, None] - y[None]).mean())


def test_many_distinct_values(spark):
    rnd = np.random.default_rng(6)
    x, y = rnd.standard_normal(1500), rnd.standard_normal(1500) + 0.1
    assert significance.cliffs_delta(pairs(spark, x, y), "g").first().delta == pytest.approx(np.sign(x[:, None] - y[None]).mean())
    ranks = np.abs(x - y).argsort().argsort() + 1
    w = significance.wilcoxon(pairs(spark, x, y), "g").first()
    assert w.statistic == min(ranks[x > y].sum(), ranks[x < y].sum())


def test_friedman(spark):
    rows = [(str(i), c, float(v)) for i, r in enumerate([(1, 2, 3), (1, 2, 3), (1, 3, 2), (2, 2, 3)]) for c, v in zip("abc", r, strict=True)] + [("lone", "a", 1.0)]
    f = significance.friedman(spark.createDataFrame(rows, "id string, config string, value double").withColumn("m", F.lit(1)), "m").first()
    sums = np.array([1 + 1 + 1 + 1.5, 2 + 2 + 3 + 1.5, 3 + 3 + 2 + 3])
    plain = 12 / (4 * 3 * 4) * (sums**2).sum() - 3 * 4 * 4
    assert (f.n, f.groups, f.df) == (4, 3, 2) and f.chi2 == pytest.approx(plain / (1 - 6 / (4 * 3 * 8)))


def test_effect_labels(spark):
    df = spark.createDataFrame([(0.1,), (-0.2,), (0.4,), (-0.9,), (None,)], "d double")
    assert [r[0] for r in df.select(C.effect_label(F.col("d"))).collect()] == ["Negligible", "Small", "Medium", "Large", None]


def test_significance_job(spark):
    rows = [(c, str(i), float((i % 7) * k % 5)) for i in range(40) for k, c in enumerate(["p", "q", "r"], 1)]
    scores = spark.createDataFrame(rows, "config string, id string, value double").withColumn("metric", F.lit("strict"))
    out = evaluation.significance(scores, ["metric"]).collect()
    assert {(r.a, r.b) for r in out} == {("p", "q"), ("p", "r"), ("q", "r")} and all(r.p_corr >= r.p_raw and r.groups == 3 for r in out)


def test_scratch_folder(spark):
    from types import SimpleNamespace

    from quern.session import scratch_dir

    assert scratch_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held: dict = {}
    conf = SimpleNamespace(get=lambda k, d=None: held.get(k, d), set=held.__setitem__)
    plain = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(plain("spark://host:7077"))
    assert scratch_dir(plain("local[2]")) == scratch_dir(plain("local[2]")) and held


def test_two_configurations_are_not_corrected(spark):
    rows = [(c, str(i), float((i * k) % 11)) for i in range(30) for k, c in enumerate("pq", 1)]
    scores = spark.createDataFrame(rows, "config string, id string, value double").withColumn("metric", F.lit("strict"))
    (r,) = evaluation.significance(scores, ["metric"]).collect()
    assert r.groups == 2 and r.p_corr == r.p_raw and r.chi2 is None and r.p_global is None
    told = evaluation.sectioned(evaluation.significance(scores.unionByName(scores.withColumn("metric", F.lit("other"))), ["metric"]).withColumn("analysis", F.lit("one")), "analysis").orderBy("row_no").collect()
    assert [(x.analysis, x.metric, x.comparison) for x in told] == [("one", "", ""), ("", "Strict F1", "Wilcoxon signed-rank (global)"), ("", "Strict F1", "p vs q"), ("", "", ""), ("", "other", "Wilcoxon signed-rank (global)"), ("", "other", "p vs q"), ("", "", "")]
    assert (told[0].n, told[0].correction, told[1].chi2) == ("30", "HOLM", "")


def test_failures_are_counted_on_the_way(spark):
    gold = spark.createDataFrame([("1", "a > 0"), ("2", "b")], "id string, doc_constraint string")
    said = spark.createDataFrame([("1", "None", None), ("1", "It is so.", None), ("2", "b", None), ("2", None, "timeout")], "id string, text string, error string")
    rows, seen = metrics.observed_failures(scoring.evaluated(gold, said))
    assert rows.count() == 4 and seen.get == {"rows": 4, "parse_failed": 1, "empty": 2, "errors": 1}


def test_similar_items_in_several_blocks(spark):
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((40, 6))
    x[5] = 0
    items = spark.createDataFrame([(k, int(k % 4), [float(v) for v in r]) for k, r in enumerate(x)], "id long, project int, embedding array<double>")
    rows = retrieval.similar_items(items, items.repartition(5), 3, 0.6).collect()
    got = {(r.id, r.rank): r.example_id for r in rows}
    with np.errstate(invalid="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    for k in range(40):
        near = sorted((j for j in range(40) if k != 5 and j != 5 and j % 4 != k % 4 and cos[k, j] < 0.6), key=lambda j: (-cos[k, j], j))[:3]
        assert [got.get((k, r)) for r in (1, 2, 3)][: len(near)] == near
    assert all(r.cos == round(float(cos[r.id, r.example_id]), 4) for r in rows)
    named = items.withColumn("id", F.concat(F.lit("n"), F.format_string("%02d", "id")))
    assert {(r.id, r.rank): r.example_id for r in retrieval.similar_items(named, named, 3, 0.6).collect()} == {(f"n{k:02d}", r): f"n{j:02d}" for (k, r), j in got.items()}
    assert retrieval.similar_items(items.limit(0), items, 3).count() == 0 and retrieval.similar_items(items, items.limit(0), 3).count() == 0


def test_equal_cosines_go_to_the_smaller_ids(spark):
    items = spark.createDataFrame([(k, k % 2, [1.0, float(k % 3)]) for k in range(60)], "id long, project int, embedding array<double>").repartition(7)
    got = {}
    for r in sorted(retrieval.similar_items(items, items, 4, 1.1).collect(), key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append(r.example_id)
    assert all(near == [j for j in range(60) if j % 2 != k % 2 and j % 3 == k % 3][:4] for k, near in got.items()) and len(got) == 60


def test_examples_are_reversed_and_never_the_item(spark):
    items = spark.createDataFrame([("1", "c1", "g1"), ("2", "c2", None), ("3", "c1", "g3")], "id string, code_formatted string, doc_constraint string")
    found = spark.createDataFrame([("1", "2", 1), ("1", "1", 2), ("1", "3", 3), ("1", "9", 4), ("1", "2", 5)], "id string, example_id string, rank int")
    said = prompts.prompts(items, "T\n", prompts.example_sections(found, items, 5, slices=spark.createDataFrame([("1", "s1")], "id string, slice string"))).filter("id = '1'").first().prompt
    assert said == "T\nFew-Shot Examples:\n\nExample 1:\nTarget Method:\nc1\n\nCode Slice (highlights constraint-relevant statements):\ns1\n\nOutput:\ng3\n\nExample 2:\nTarget Method:\nc2\n\nOutput:\n\n\n" + "-" * 40 + "\n\nNow analyze the Target Method below:\n\nTarget Method:\nc1\n"
    assert {r.example_ids[0] for r in retrieval.example_lists(found.filter("rank < 4"), 3).collect()} == {"3"}


def test_codes_meet_as_digests(spark):
    items = spark.createDataFrame([("3", "c1"), ("1", "c1"), ("2", None), ("4", None), ("5", "")], "id string, code_formatted string")
    out = prompts.with_first_of_same_code(items)
    assert {r.id: r.first_id for r in out.collect()} == {"3": "1", "1": "1", "2": "2", "4": "2", "5": "5"}
    plan = out._jdf.queryExecution().toString()
    assert all("code_formatted" not in line for line in plan.splitlines() if "hashpartitioning" in line or "SortMergeJoin" in line)


def test_slices(spark):
    code = 'private static double f(double v) {\n    if (v < 0.0 || v > 1.0) {\n        throw new X("// v");\n    }\n    this.v = v;\n    return v;\n}'
    other = "void g(String s, int n) {\n    String t = s;\n    int k = 10 / n;\n    t.trim();\n}"
    plain = "int h(int n) {\n    int a = 1;\n    return n;\n}"
    df = spark.createDataFrame([("f", code), ("g", other), ("h", plain), ("e", ""), ("n", None), ("h", plain)], "id string, code string")
    rows = slices.sliced(df, 1).collect()
    got = {r.id: r for r in rows}
    assert len(rows) == 6 and {c: got["n"][c] for c in ("slice", "is_effective", "is_fallback", "stmt_retention", "error")} == {"slice": None, "is_effective": False, "is_fallback": False, "stmt_retention": None, "error": "code is missing"}
    assert got["e"].slice == "" and got["e"].stmt_retention is None
    assert got["f"].slice == code.replace("    this.v = v;\n    return v;", "    // ...") and got["f"].stmt_retention == 0.5 and got["f"].is_effective
    assert got["g"].slice == other  # the declaration that gives t its value stays
    assert not {r.id: r for r in slices.sliced(df, 0).collect()}["g"].slice.count("t.trim")
    assert got["h"].is_fallback and not got["h"].is_effective and got["h"].slice == "int h(int n) {\n    // ...\n    return n;\n}"


def test_parameters(spark):
    said = {
        "f(Map<String, Integer> m, int b) {": ["m", "b"],
        '@A("x(y)")\npublic int f(int b)\n  throws E {': ["b"],
        "<T extends Comparable<? super T>> void f(final @Nonnull T[] xs, String... more) {": ["xs", "more"],
        "void f() { g(a, b); }": [],
        "f(int[] a[], Map<String, Map<String, List<Integer>>> deep);": ["a", "deep"],
        "no method": [],
    }
    df = spark.createDataFrame(list(enumerate(said)), "k int, code string").orderBy("k")
    assert [r[0] for r in df.select(slices.parameters(F.col("code"))).collect()] == list(said.values())


def test_repeated_triggers(spark):
    code = "void f(String s, int n) {\n    s.trim();\n    s.length();\n    s.trim();\n    check(9 / n);\n    if (n < 0) {\n        throw new X();\n    }\n}"
    df = spark.createDataFrame([("f", code)], "id string, code string")
    kept = {d: slices.sliced(df, 0, dedup=d).first().slice for d in slices.DEDUP}
    assert kept["none"] == code and kept["relaxed"] == code.replace("    s.trim();\n    check", "    // ...\n    check")
    assert kept["strict"] == code.replace("    s.length();\n    s.trim();", "    // ...")
    with pytest.raises(ValueError, match="dedup"):
        slices.sliced(df, 0, dedup="some")


def test_asked_retries_and_reports_errors(spark):
    def client():
        calls = {}

        def ask(prompt):
            calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "bad":
                raise KeyError("no")
            if prompt == "slow" and calls[prompt] < 2:
                raise OSError("again")
            return prompt.upper(), 1, 2

        return ask

    df = spark.createDataFrame([("1", "fine"), ("2", "bad"), ("3", "slow")], "id string, prompt string")
    got = {r.id: (r.text, r.error, r.output_tokens) for r in inference.asked(df, client, per_minute=60000, workers=2, tries=3, fatal=(KeyError,)).collect()}
    assert got == {"1": ("FINE", None, 2), "2": (None, "KeyError: 'no'", None), "3": ("SLOW", None, 2)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "doc_constraint": "x"}, {"id": "2"}]')
    assert {r.id: r.doc_constraint for r in tables.read_array(spark, str(tmp_path / "a.json"), tables.PAIRS).collect()} == {"1": "x", "2": None}
    answers = spark.createDataFrame([("1", "t", None, 1, 2, 0.5, "fewshot", "sr", 4, "m")], f"{tables.ANSWERS}, strategy string, variant string, k int, model string")
    tables.write_answers(answers, str(tmp_path / "raw"))
    assert tables.read_answers(spark, str(tmp_path / "raw")).filter("k = 4").collect() == answers.collect()
    with pytest.raises(Exception, match="project_name is empty"):
        tables.required(spark.createDataFrame([(" ",)], "project_name string"), "project_name").collect()
    tables.write_report(answers, str(tmp_path / "r.csv"), ["id"])
    assert (tmp_path / "r.csv").read_text(encoding="utf-8-sig").splitlines()[1] == "1,t,,1,2,0.5,fewshot,sr,4,m"


def test_stream_scores_like_the_batch(spark, tmp_path):
    gold, answers = carriers.methods(spark, SF), carriers.answers(spark, SF).select("strategy", "id", "text")
    answers.repartition(3).write.parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_arrivals(arrivals, gold, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(240)
    columns = ["strategy", "id", "strict_f1", "relaxed_f1"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, scoring.evaluated(gold, answers).select(columns).collect()))


def test_encoder_is_given(spark):
    items = spark.createDataFrame([("a", "xx"), ("b", None)], "id string, code string")
    got = retrieval.embedded(items, lambda texts: np.array([[float(len(t)), 1.0] for t in texts]), F.col("code"))
    assert {r.id: r.embedding for r in got.collect()} == {"a": [2.0, 1.0], "b": [0.0, 1.0]}
