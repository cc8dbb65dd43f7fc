"""The evaluation's jobs: score answers, summarise, test for significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.metrics import summarised
from quern.operators.prompts import label
from quern.operators.scoring import evaluated
from quern.operators.significance import chi2_tail, cliffs_delta, corrected, friedman, normal_tail, pair_grid, paired, wilcoxon
from quern.functions.columns import effect_label
from quern.session import stash
from quern.sources.tables import write_report


def metrics(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """Scores of all configurations in one job."""
    return evaluated(gold, answers).withColumn("config", label(F.col("strategy"), F.col("variant"), F.col("k")))


def summary(gold: DataFrame, answers: DataFrame) -> DataFrame:
    return summarised(metrics(gold, answers), "config")


def significance(scores: DataFrame, family: list[str], method: str = "holm") -> DataFrame:
    """scores (*family, config, id, value) -> a row per pair of configurations:
    means, Friedman's test over all, Wilcoxon's test, Cliff's delta, corrected p.

    A family of two configurations has no test over all and nothing to correct;
    its effect is named by the delta as it is, in larger families by the delta to
    4 digits."""
    scores = stash(scores, "scores")
    of_family = F.concat_ws("|", *family)
    pairs = pair_grid(scores.select(*family, "config").distinct().withColumn("family", of_family), "family").join(scores.select(*family).distinct().withColumn("family", of_family), "family").drop("family")
    rows = stash(paired(scores, pairs, *family), "paired")
    keys = [*family, "a", "b"]
    tests = wilcoxon(rows, *keys).withColumn("p_raw", normal_tail("z"))
    means = rows.groupBy(*keys).agg(F.round(F.avg("x"), 4).alias("mean_a"), F.round(F.avg("y"), 4).alias("mean_b"))
    many = F.col("groups") > 2
    whole = friedman(scores, *family).withColumn("p_global", chi2_tail("chi2", "df")).select(*family, "groups", *(F.when(many, F.col(c)).alias(c) for c in ("chi2", "p_global")))
    out = tests.join(means, keys).join(cliffs_delta(rows, *keys), keys).join(whole, family, "left")
    out = corrected(out, "p_raw", *family, method=method).withColumn("p_corr", F.when(many, F.col("p_corr")).otherwise(F.col("p_raw")))
    return out.withColumns({"significant": F.col("p_corr") < 0.05, "effect": effect_label(F.when(many, F.round("delta", 4)).otherwise(F.col("delta")))})


#: Columns of a report and their headings.
EXPORTED = {
    "model": "Model",
    "analysis": "Analysis",
    "n": "N",
    "groups": "Groups",
    "correction": "Correction",
    "metric": "Metric",
    "comparison": "Comparison",
    "mean_a": "Mean F1 (A)",
    "mean_b": "Mean F1 (B)",
    "p_raw": "Raw p-value",
    "p_corr": "Corrected p-value",
    "significant": "Significant",
    "delta": "Cliff's Delta",
    "effect": "Effect Size",
    "chi2": "Global chi2",
}
#: Metrics that a report shows first, and their labels; others follow by name.
METRICS = {"strict": "Strict F1", "relaxed": "Relaxed F1"}


def sectioned(tests: DataFrame, analysis: str, method: str = "holm", model: str = "") -> DataFrame:
    """significance() by analysis and metric as rows of a report: section, row_no and
    text columns.  Each analysis has a header with the model; each metric of it, strict
    before relaxed, a row with the test over all (for two configurations Wilcoxon's own),
    its pairs and an empty row."""
    text = lambda c: F.col(c).cast("string")
    blank = {c: F.lit("") for c in EXPORTED}
    named = F.create_map(*(F.lit(x) for kv in METRICS.items() for x in kv))
    metric = F.coalesce(F.element_at(named, F.col("metric")), F.col("metric"))
    rank = F.coalesce(F.array_position(F.lit(list(METRICS)), F.col("metric")), F.lit(0))
    first = F.format_string("%02d", F.when(rank > 0, rank).otherwise(99))

    def rows(df: DataFrame, place: Column, filled: dict[str, Column]) -> DataFrame:
        return df.select(F.col(analysis).alias("section"), place.alias("place"), *(F.coalesce((blank | filled)[c], F.lit("")).alias(c) for c in EXPORTED))

    each = tests.groupBy(analysis).agg(F.max("n").alias("n"), F.max("groups").alias("groups"))
    # the only pair of two configurations is the test over all
    whole = F.max(F.when(F.col("groups") == 2, F.col("p_raw")))
    by_metric = tests.groupBy(analysis, "metric").agg(F.max("chi2").alias("chi2"), F.coalesce(F.max("p_global"), whole).alias("p_raw"), F.max("groups").alias("groups"))
    place = lambda kind, *more: F.concat_ws("|", first, F.col("metric"), F.lit(kind), *more)
    test = F.when(F.col("groups") > 2, "Friedman (global)").otherwise("Wilcoxon signed-rank (global)")
    parts = [
        rows(each, F.lit(""), {"model": F.lit(model), "analysis": text(analysis), "n": text("n"), "groups": text("groups"), "correction": F.lit(method.upper())}),
        rows(by_metric, place("1"), {"metric": metric, "comparison": test, "p_raw": text("p_raw"), "significant": (F.col("p_raw") < 0.05).cast("string"), "chi2": F.round("chi2", 4).cast("string")}),
        rows(tests, place("2", F.col("a"), F.col("b")), {"metric": metric, "comparison": F.concat_ws(" vs ", "a", "b"), "mean_a": text("mean_a"), "mean_b": text("mean_b"), "p_raw": text("p_raw"), "p_corr": text("p_corr"), "significant": text("significant"), "delta": F.round("delta", 4).cast("string"), "effect": text("effect")}),
        rows(by_metric, place("3"), {}),
    ]
    whole_report = parts[0]
    for part in parts[1:]:
        whole_report = whole_report.unionByName(part)
    order = Window.partitionBy("section").orderBy("place")
    return whole_report.withColumn("row_no", F.row_number().over(order)).drop("place")


def write_sections(report: DataFrame, path: str, sections: list[str] | None = None) -> None:
    """sectioned() as one CSV file with headings; sections: their order, else by name."""
    rank = F.coalesce(F.array_position(F.lit(sections), F.col("section")), F.lit(0)) if sections else F.lit(0)
    rows = report.select(*(F.col(c).alias(title) for c, title in EXPORTED.items()), rank.alias("quern_rank"), "section", "row_no")
    write_report(rows, path, ["quern_rank", "section", "row_no"], shown=list(EXPORTED.values()))
