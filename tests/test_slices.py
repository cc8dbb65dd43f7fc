"""Statements of Java code and slices of them, by rules worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quern.operators import slices, statements

CODE = '''@A({1,2}) int g(int[] a, Map<String, List<X>> m) throws E {
    int[] b = {1, 2}; int[][] c = new int[][]{{1},{2}};
    for (int i = 0; i < a.length; i++) if (a[i] > 0) return f(() -> { x(); }); else y();
    if (a == null) {
        q = """
  s.trim(); // {
  """;
    } else if (m.isEmpty()) {
        throw new X("}");
    } else {
        run('{');
    }
    try (R r = o()) { z(); } catch (E e) { w(); } finally { v(); }
    do { k(); } while (a.length > 0);
    Runnable h = () -> { j(); };
    rest'''


def test_pieces(spark):
    df = spark.createDataFrame([(CODE,), ("",), ("}",), (") ; (",), ('"open',), ("else {} else {}",)], "code string").withColumn("t", statements.tokens_of(F.col("code"))).withColumn("p", statements.pieces_of(F.col("t")))
    rows = df.select("code", F.transform("p", lambda p: F.struct(statements.text_of(F.col("t"), p).alias("text"), p.alias("p"))).alias("p")).collect()
    for r in rows:
        assert "".join(x.text for x in r.p) == r.code
    got = [(x.text.strip(), x.p.kind, x.p.parent, x.p.within, x.p.chain) for x in rows[0].p]
    text = [g[0] for g in got]
    assert text[:8] == ["@A({1,2}) int g(int[] a, Map<String, List<X>> m) throws E {", "int[] b = {1, 2};", "int[][] c = new int[][]{{1},{2}};", "for (int i = 0; i < a.length; i++)", "if (a[i] > 0)", "return f(() -> { x(); });", "else", "y();"]
    where = {t: k for k, t in enumerate(text) if text.count(t) == 1}
    within = lambda t: [text[h] for h in got[where[t]][3][1:]]
    assert within("return f(() -> { x(); });") == ["for (int i = 0; i < a.length; i++)", "if (a[i] > 0)"] and within("y();") == ["else"]
    assert within('throw new X("}");') == ["else", "if (m.isEmpty())"] and within("if (a == null)") == []
    assert text[got[where["y();"] - 1][4][0]] == "if (a[i] > 0)" and text[got[where["finally"]][4][0]] == "catch (E e)"
    last_else = [k for k, t in enumerate(text) if t == "else"][-1]
    assert [text[h] for h in got[last_else][4]] == ["if (m.isEmpty())", "else", "if (a == null)"]
    assert within("z();")[0] == "try" and within("k();") == ["do"] and within("j();") == ["Runnable h = () -> {"]
    assert got[-1][:2] == ("rest", "simple")


def cut(spark, code, hops=1, dedup="strict"):
    return slices.sliced(spark.createDataFrame([("f", code)], "id string, code string"), hops, dedup).first()


CASES = {
    "an element of a parameter": ("void f(int[] xs) {\n    for (int x : xs)\n        go(x);\n}", "void f(int[] xs) {\n    for (int x : xs)\n        // ...\n}", 0.5),
    "a throw below another statement": ("void f(int a) {\n    if (a > 0) {\n        log();\n        throw new X();\n    }\n}", "void f(int a) {\n    if (a > 0) {\n        // ...\n        throw new X();\n    }\n}", 0.6667),
    "a sum as divisor": ("int f(int a) {\n    int b = 1;\n    return 10 / (2 + a);\n}", "int f(int a) {\n    // ...\n    return 10 / (2 + a);\n}", 0.5),
    "a call over lines": ('void f(Map m) {\n    g();\n    m\n        .get("x");\n}', 'void f(Map m) {\n    // ...\n    m\n        .get("x");\n}', 0.5),
    "a method in one line": ("void f(String s) { if (s == null) throw new X(); }", "void f(String s) { if (s == null) throw new X(); }", 1.0),
    "a text block": ('void f(String s) {\n    q = """\n        s.trim() // x\n        """;\n    s.strip();\n}', "void f(String s) {\n    // ...\n    s.strip();\n}", 0.5),
    "an unconditional throw": ("void f(int a) {\n    try {\n        throw new X();\n    } finally {\n        g(9 % a);\n    }\n}", "void f(int a) {\n    try {\n        // ...\n    } finally {\n        g(9 % a);\n    }\n}", 0.5),
    "a throw in else": ("void f(int a) {\n    if (a > 0) {\n        g();\n    } else\n        throw new X();\n    h();\n}", "void f(int a) {\n    if (a > 0) {\n        // ...\n    } else\n        throw new X();\n    // ...\n}", 0.5),
    "a loop's condition": ("void f(int n) {\n    for (int i = 0; i < n; i++) {\n        g();\n        throw new X();\n    }\n}", "void f(int n) {\n    for (int i = 0; i < n; i++) {\n        // ...\n        throw new X();\n    }\n}", 0.6667),
    "one line, partly": ("void f(String s) { g(); s.trim(); h(); }", "void f(String s) {\n// ...\n s.trim();\n// ...\n }", 0.3333),
    "values of a name": ("int f(int n, int[] v) {\n    int at = n + 1;\n    at++;\n    if (v == null) {\n        at = 0;\n    }\n    g();\n    return v[at];\n}", "int f(int n, int[] v) {\n    int at = n + 1;\n    at++;\n    // ...\n    return v[at];\n}", 0.5),
    "a result's member": ("void f(String s) {\n    g();\n    trim(s, 1).length();\n}", "void f(String s) {\n    // ...\n    trim(s, 1).length();\n}", 0.5),
    "compound assignment": ("void f(int n) {\n    int x = 9;\n    x /= n;\n    g(n);\n}", "void f(int n) {\n    // ...\n    x /= n;\n    // ...\n}", 0.3333),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    code, want, share = CASES[name]
    got = cut(spark, code)
    assert (got.slice, got.stmt_retention) == (want, share)
    assert got.is_effective == (name != "compound assignment") and got.is_fallback == (name == "compound assignment")


def test_depths_of_derived_names(spark):
    code = "void f(int a) {\n    int b = a;\n    int c = b;\n    x(1 / c);\n}"
    assert cut(spark, code, 0).is_fallback and cut(spark, code, 1).is_fallback
    assert cut(spark, code, 2).slice == "void f(int a) {\n    // ...\n    int c = b;\n    x(1 / c);\n}"


def test_odd_methods(spark):
    df = spark.createDataFrame([("no body", "int f(int a);"), ("open", "void f(int a) {\n    if (a > 0) {\n        a.b("), ("blank", " \n "), ("text", "not java at all"), ("long", "void f(int a) {\n" + "    g(a.x);\n" * 400 + "}"), ("quotes", "void f(String s) {\n    g('\"', s.x, \"'\");\n}")], "id string, code string")
    got = {r.id: r for r in slices.sliced(df, 1).collect()}
    assert len(got) == 6 and all(r.error is None for r in got.values())
    assert got["quotes"].is_effective and got["long"].slice == "void f(int a) {\n    g(a.x);\n    // ...\n}"
    assert got["open"].slice.startswith("void f(int a) {") and not got["no body"].is_effective
