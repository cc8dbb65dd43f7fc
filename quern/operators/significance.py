"""Paired non-parametric tests as aggregations.

Values are rounded scores, so their distinct values are few however many rows
there are; ranks come from counts per distinct value and never sort a whole
group in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.ordering import bare, ordered, running
from quern.session import few


def pair_grid(configs: DataFrame, by: str, name: str = "config") -> DataFrame:
    """Every two configurations of a group, each once."""
    a, b = configs.select(by, F.col(name).alias("a")), configs.select(by, F.col(name).alias("b"))
    return a.join(b, by).filter("a < b")


def paired(values: DataFrame, pairs: DataFrame, *by: str) -> DataFrame:
    """values (*by, config, id, value), pairs (*by, a, b) -> *by, a, b, id, x, y, joined on the id.

    Pairs are few and go to the values, which are never collected for a broadcast."""
    x = values.select(*by, F.col("config").alias("a"), "id", F.col("value").alias("x"))
    y = values.select(*by, F.col("config").alias("b"), "id", F.col("value").alias("y"))
    return few(pairs).join(x, [*by, "a"]).join(y.hint("merge"), [*by, "b", "id"]).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")


def with_sums_below(counts: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """counts (*by, order, value, ...) with ``below``: the sum of value over the
    family's rows of a smaller order.  No task holds a family, however many distinct
    values it has."""
    return bare(running(ordered(counts, by, [order]), by, below=("sum", value)))


def cliffs_delta(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, x, y) -> *by, delta: (#x>y - #x<y) over all pairs, from counts per value."""
    keys = list(by)
    each = rows.select(*by, F.explode(F.array(F.struct(F.col("x").alias("v"), F.lit(1).alias("nx"), F.lit(0).alias("ny")), F.struct(F.col("y").alias("v"), F.lit(0).alias("nx"), F.lit(1).alias("ny")))).alias("e")).select(*by, "e.*")
    counts = each.groupBy(*by, "v").agg(F.sum("nx").alias("nx"), F.sum("ny").alias("ny"))
    placed = with_sums_below(counts, keys, "v", "ny").groupBy(*by).agg(F.sum(F.col("nx") * (2 * F.col("below") + F.col("ny"))).alias("over"), F.sum("nx").alias("n"), F.sum("ny").alias("m"))
    # of the m values of y, those below less those above: below - (m - below - ny)
    return placed.select(*by, F.try_divide(F.col("over") - F.col("n") * F.col("m"), F.col("n") * F.col("m")).alias("delta"))


def wilcoxon(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, x, y) -> *by, n, statistic, z: signed ranks of x - y, zeros ranked
    and split evenly, normal approximation with tie correction at any n."""
    d = F.col("x") - F.col("y")
    counts = rows.groupBy(*by, F.abs(d).alias("size")).agg(F.count_if(d > 0).alias("plus"), F.count_if(d < 0).alias("minus"), F.count_if(d == 0).alias("zero"))
    counts = with_sums_below(counts.withColumn("t", F.col("plus") + F.col("minus") + F.col("zero")), list(by), "size", "t")
    ranked = counts.select(*by, "plus", "minus", "zero", "t", (F.col("below") + (F.col("t") + 1) / 2.0).alias("rank"))
    whole = ranked.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * (F.col("plus") + F.col("zero") / 2.0)).alias("up"), F.sum(F.col("rank") * (F.col("minus") + F.col("zero") / 2.0)).alias("down"), F.sum(F.pow(F.col("t").cast("double"), 3.0) - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    variance = (n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24
    low = F.least("up", "down")
    return whole.select(*by, "n", low.alias("statistic"), F.when(variance > 0, (low - n * (n + 1) / 4) / F.sqrt(variance)).alias("z"))


def friedman(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, id, config, value) -> *by, n, groups, chi2, df; ids that lack a configuration are left out."""
    same = Window.partitionBy(*by, "id")
    rank = F.rank().over(same.orderBy("value")) + (F.count("*").over(Window.partitionBy(*by, "id", "value")) - 1) / 2.0
    groups = rows.groupBy(*by).agg(F.count_distinct("config").alias("k"))
    # the tie term of an id is the sum of t^3 - t over its values: t^2 - 1 for each of t rows
    tie = F.count("*").over(Window.partitionBy(*by, "id", "value"))
    ranked = rows.join(groups, list(by)).withColumns({"r": rank, "held": F.count("*").over(same), "tie": tie * tie - 1}).filter("held = k")
    sums = ranked.groupBy(*by, "config", "k").agg(F.sum("r").alias("s"), F.count("*").alias("n"), F.sum("tie").alias("t"))
    total = sums.groupBy(*by, "k").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("squares"), F.sum("t").alias("ties"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    correction = 1 - F.col("ties") / (n * k * (k * k - 1))
    return total.select(*by, "n", F.col("k").alias("groups"), F.when(correction > 0, (12 / (n * k * (k + 1)) * F.col("squares") - 3 * n * (k + 1)) / correction).alias("chi2"), (F.col("k") - 1).alias("df"))


def corrected(tests: DataFrame, p: str, *by: str, method: str = "holm") -> DataFrame:
    """tests with p_corr within each family by; method: holm or bh.

    Holm takes the greatest of (m - i + 1) * p up to a row, Benjamini-Hochberg the
    least of m / i * p from a row on, over a family's m tests by ascending p.  A test
    without p is none of the m and stays without.  Numbers and extrema run over range
    parts, so no task holds a family.
    """
    if method not in ("holm", "bh"):
        raise ValueError("method must be holm or bh")
    sizes = few(tests.groupBy(*(F.col(c).alias(f"quern_of_{c}") for c in by)).agg(F.count(p).alias("quern_m")))
    rows = tests.join(sizes, [F.col(c).eqNullSafe(F.col(f"quern_of_{c}")) for c in by]).drop(*(f"quern_of_{c}" for c in by))
    placed = ordered(rows.withColumn("quern_one", F.lit(1).cast("long")), by, [F.asc_nulls_last(p), F.xxhash64(*tests.columns)])
    m, i = F.col("quern_m"), F.col("quern_i") + 1
    step = (m - i + 1) * F.col(p) if method == "holm" else m / i * F.col(p)
    steps = running(placed, by, quern_i=("sum", "quern_one")).withColumn("quern_step", step)
    best = running(steps, by, own=True, back=method == "bh", quern_best=("max" if method == "holm" else "min", "quern_step"))
    return best.select(*tests.columns, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("quern_best"))).alias("p_corr"))


def normal_p(z: float | None) -> float | None:
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def chi2_p(x: float | None, df: int | None) -> float | None:
    """Upper tail: closed form for even df, else by the recurrence from one degree."""
    if x is None or df is None or math.isnan(x) or df < 1:
        return None
    if x <= 0:
        return 1.0
    h = x / 2
    log_term, out = (-h, 0.0) if df % 2 == 0 else (0.5 * math.log(h) - h - math.lgamma(1.5), math.erfc(math.sqrt(h)))
    for i in range(df // 2):
        out += math.exp(log_term)
        log_term += math.log(h) - math.log(i + (1.0 if df % 2 == 0 else 1.5))
    return min(out, 1.0)


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    return z.astype(object).where(z.notna(), None).map(normal_p).astype(float)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_p(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b)) for a, b in zip(x, df, strict=True)], dtype=float)
