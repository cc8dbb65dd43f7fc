"""Evaluation inputs derived from the given tables: each part is a method with
a gold constraint, each (part, configuration) an answer, each part a result of a
static tool.  Names, operators, numbers and the number of members follow the
part's key and size, so distinct texts grow with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.expressions import ACCEPTS, MIRROR
from quern.session import table

#: Java methods by line: when a slice keeps the line (f: always, as it is no statement;
#: 0, 1, 2: at that depth; F before a depth: as the first use of a parameter; c: it goes
#: on with the statement above; x: it is a comment), the line, and what is left of it
#: without comments where that differs.
JAVA = [
    [
        ("f", "public int m{p}(String name, int size, int[] items) {"),
        ("012", "    if (size < {s}) {"),
        ("012", '        throw new IllegalArgumentException("a // b");'),
        ("f", "    }"),
        ("12", "    int half = size / 2; // derived", "    int half = size / 2; "),
        ("", "    int other = 1;"),
        ("", "    other = other + 1;"),
        ("x", "    /* one"),
        ("x", "    two */"),
        ("012", "    return items[half] + other;"),
        ("f", "}"),
    ],
    [("f", "public static <K, V> void m{p}(Map<K, List<V>> map, K key) {"), ("012", "    if (map == null) {"), ("012", "        throw new NullPointerException();"), ("f", "    }"), ("012", "    List<V> found = map.get(key);"), ("12", "    found.clear();"), ("f", "}")],
    [("f", '@Check(value = "{s}", more = @Deep(1))'), ("f", "public int m{p}(@Nonnull final String text,"), ("f", "        int count) {"), ("012", "    Objects.requireNonNull(text);"), ("012", "    return text.length() / count;"), ("f", "}")],
    [("f", "void m{p}(int mode, String label) {"), ("012", "    if (mode < {s}) {"), ("012", "        throw new IllegalStateException();"), ("012", "    } else if (label.isEmpty()) {"), ("012", '        throw new IllegalArgumentException("mode");'), ("f", "    } else {"), ("", "        run();"), ("f", "    }"), ("f", "}")],
    [("f", "long m{p}(long a, long b) {"), ("", "    long c = {s};"), ("F0F1F2", "    c = c + a;"), ("F0F1F2", "    return c + b;"), ("f", "}")],
    [("f", "void m{p}() {"), ("", "    start({s});"), ("f", "}")],
    [("f", "int m{p}(int... values) {"), ("", "    int total = {s};"), ("012", "    for (int v : values) {"), ("", "        total += v;"), ("f", "    }"), ("", "    return values[0] % total;"), ("f", "}")],
    [("f", "void m{p}(String s, int n) {"), ("012", "    s.trim();"), ("", "    s.trim();"), ("", "    s.length();"), ("012", "    int k = {s} / n;"), ("", "    k = 20 / n;"), ("f", "}")],
    [("f", "void m{p}(String url) {"), ("012", "    String tail = url.substring({s});"), ("", '    log("// no /* comment */ url.x");'), ("12", "    tail.trim();"), ("f", "}")],
    [("f", "public byte m{p}(byte[] data, final int at) throws IOException, Oops {"), ("12", "    int next = at + {s};"), ("012", "    return data[next];"), ("f", "}")],
    [("f", "void m{p}(int a) {"), ("F012", "    int b = a * {s};"), ("2", "    int c = b + 1;"), ("2", "    int d = 100 / c;"), ("12", "    use(100 % b);"), ("f", "}")],
    [("f", "void m{p}(int a) {"), ("012", "    if (a > {s}) {"), ("", "        log();"), ("012", '        throw new IllegalStateException("a");'), ("f", "    }"), ("012", "    use(10 / (2 + a));"), ("f", "}")],
    [("f", "String m{p}(Map<String, String> given) {"), ("", "    int size = {s};"), ("012", "    String v = given"), ("c012", '        .get("x");'), ("", "    return other(size)"), ("c", "        + 1;"), ("f", "}")],
    [("f", "void m{p}(String s) {"), ("", '    String q = """'), ("c", "        s.trim() // {s}; {"), ("c", '        """;'), ("012", "    s.strip();"), ("f", "}")],
    [("f", "void m{p}(int n) {"), ("f", "    try {"), ("012", "        if (n < {s}) {"), ("012", "            throw new Oops();"), ("f", "        }"), ("", "        run();"), ("f", "    } finally {"), ("", "        close();"), ("f", "    }"), ("f", "}")],
]
NAMES = ["name", "size", "items", "user", "path", "total"]
LENGTHS = ["> 0", "!= 0", ">= 1", "< 9", "== 2"]
#: How an answer is put, by configuration.
CONFIGS = [("vanilla", None, None, "Final Expression: {}"), ("fewshot", "sr", 16, "{}"), ("cot", "exim", None, "Checking each branch in turn.\n\nFinal expression is: {}\n\nThis is all."), ("slice", "slonly", None, "```java\n{}\n```"), ("mix", None, None, "The method proceeds if `{}`")]


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows that come straight from a table of a few small files, dealt to all cores;
    tables of more files stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def filled(template: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{p}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))


def gold() -> Column:
    p, s = F.col("p_partkey"), F.col("p_size")
    first = F.concat_ws(" ", pick(NAMES, p), pick(list(ACCEPTS), s), s.cast("string"))
    second = F.concat(pick(NAMES, p + 1), F.lit(".size() "), pick(LENGTHS, p))
    return F.when(p % 17 == 5, "").when(p % 3 == 0, F.concat(first, F.when(p % 2 == 0, " && ").otherwise(" || "), second)).otherwise(first)


def answered(c: Column) -> Column:
    """The expression that configuration number c finds."""
    p, s = F.col("p_partkey"), F.col("p_size")
    name, number, at = pick(NAMES, p + F.when(p % 5 == 0, 1).otherwise(0)), (s + (p + c) % 3).cast("string"), s + (p + c) % 4
    first = F.when(p % 7 == 1, F.concat_ws(" ", number, pick([MIRROR[o] for o in ACCEPTS], at), name)).otherwise(F.concat_ws(" ", name, pick(list(ACCEPTS), at), number))
    second = F.concat(pick(NAMES, p + 1), F.lit(".length() "), pick(LENGTHS, p + c))
    both = F.concat(first, F.when(p % 2 == 0, " && ").otherwise(" || "), second)
    return F.when((p + c) % 19 == 7, "None").when(p % 4 == 0, both).otherwise(first)


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, project_name, code_formatted, doc_constraint."""
    code = filled(pick(["\n".join(line[1] for line in m) for m in JAVA], F.col("p_partkey")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("project_name"), code.alias("code_formatted"), gold().alias("doc_constraint"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy, variant, k, model, id, text, error, input_tokens, output_tokens,
    elapsed_seconds; every 13th part has no readable answer, every 11th none at all."""
    every = F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), F.lit(v).cast("string").alias("variant"), F.lit(k).cast("int").alias("k"), F.lit(n).alias("n"), F.lit(t).alias("t")) for n, (s, v, k, t) in enumerate(CONFIGS))))
    rows = table(spark, sf_dir, "part").filter("p_partkey % 11 <> 0").select("p_partkey", "p_size", "p_brand", every.alias("c"))
    text = F.when(F.col("p_partkey") % 13 == 0, "The parameter must be valid.").otherwise(F.replace("c.t", F.lit("{}"), answered(F.col("c.n"))))
    return rows.select("c.strategy", "c.variant", "c.k", F.col("p_brand").alias("model"), F.col("p_partkey").cast("string").alias("id"), text.alias("text"), F.lit(None).cast("string").alias("error"), F.col("p_size").alias("input_tokens"), (F.col("p_size") % 7).alias("output_tokens"), (F.col("p_size") / 4.0).alias("elapsed_seconds"))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, wit_result, wit_paths, miss_reason of a static tool; every 11th part has none."""
    p = F.col("p_partkey")
    said = F.when(p % 5 == 0, "").when(p % 5 == 1, "true").when(p % 5 == 2, "simplify_error: x").otherwise(F.replace(answered(F.lit(0)), F.lit("None"), F.lit("false")))
    paths = F.transform(F.filter(F.sequence(F.lit(0), F.col("p_size") % 4), lambda k: k > 0), lambda k: F.concat(F.lit("path "), k.cast("string")))
    return table(spark, sf_dir, "part").filter(p % 11 != 0).select(p.cast("string").alias("id"), said.alias("wit_result"), paths.alias("wit_paths"), F.when(p % 3 == 0, "timeout").alias("miss_reason"))
