"""Summaries of scored answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quern.functions.columns import safe_f1
from quern.operators.scoring import SCORES, compared

MEANS = ["strict_precision", "strict_recall", "strict_f1", "relaxed_precision", "relaxed_recall", "relaxed_f1", "doc_constraint_subs", "code_constraint_subs", "input_tokens", "output_tokens", "elapsed_seconds"]


def summarised(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over rows (failed parses count) and shares of failed, empty and exact answers."""
    share = lambda p: F.round(100 * F.count_if(p) / F.count("*"), 2)
    return metrics.groupBy(*by).agg(
        F.count("*").alias("n"),
        *(F.round(F.avg(c), 3).alias(c) for c in MEANS),
        share(F.col("parse_failed") == 1).alias("parse_fail_pct"),
        share((F.col("parse_failed") == 0) & (F.col("code_constraint") == "")).alias("none_pct"),
        share(F.col("strict_f1") == 1.0).alias("exact_match_pct"),
    )


def missing_configurations(wanted: DataFrame, metrics: DataFrame, *by: str) -> DataFrame:
    return wanted.join(metrics.select(*by).distinct(), list(by), "left_anti")


def with_mean_row(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """rows as text for a report, a row of means before them (is_mean)."""
    means = rows.agg(*(F.format_string("%.3f", F.avg(c)).alias(c) for c in values)).select(F.lit(True).alias("is_mean"), F.lit("mean").alias(key), *values)
    each = rows.select(F.lit(False).alias("is_mean"), F.col(key).cast("string").alias(key), *(F.format_string("%.5f", F.col(c)).alias(c) for c in values))
    return means.unionByName(each)


def baseline_scored(results: DataFrame) -> DataFrame:
    """Results of a static tool (wit_result, wit_paths, miss_reason) -> usable
    expression and flags; long path lists are shortened as text."""
    text = F.coalesce("wit_result", F.lit(""))
    usable = (text != "") & ~text.startswith("simplify_error") & ~F.lower(text).isin("true", "false")
    paths = F.to_json("wit_paths")
    return results.withColumns(
        {
            "expression": F.when(usable, text).otherwise(""),
            "wit_path_count": F.coalesce(F.size("wit_paths"), F.lit(0)),
            "none_pct": F.coalesce("miss_reason", F.lit("")).rlike("\\S").cast("int"),
            "wit_paths_text": F.when(F.length(paths) > 30000, F.concat(F.substring(paths, 1, 29997), F.lit("..."))).otherwise(paths),
        }
    )


def baseline_evaluated(gold: DataFrame, results: DataFrame) -> DataFrame:
    """gold (id, doc_constraint) joined with a static tool's results (id, wit_result,
    wit_paths, miss_reason) and scored to 4 digits; unusable results score 0 and
    stay, ids without a result are left out (see missing)."""
    rows = baseline_scored(results).join(gold.select("id", F.coalesce("doc_constraint", F.lit("")).alias("doc_constraint")), "id")
    scores = compared(rows.select(F.col("doc_constraint").alias("gold"), F.col("expression").alias("answer")), 4)
    usable = F.col("expression") != ""
    out = rows.join(scores, (F.col("doc_constraint") == F.col("gold")) & (F.col("expression") == F.col("answer"))).drop("gold", "answer")
    out = out.withColumns({c: F.when(usable, F.col(c)).otherwise(0.0) for c in SCORES})
    out = out.withColumnsRenamed({"gold_parts": "doc_constraint_subs", "answer_parts": "wit_result_subs"})
    out = out.withColumns({f"{m}_f1": safe_f1(F.col(f"{m}_precision"), F.col(f"{m}_recall"), 4) for m in ("strict", "relaxed")})
    return out.withColumn("exact_match", (F.col("strict_f1") == 1.0).cast("int"))


BASELINE_MEANS = ["wit_path_count", "strict_precision", "strict_recall", "strict_f1", "relaxed_precision", "relaxed_recall", "relaxed_f1", "doc_constraint_subs", "wit_result_subs"]


def baseline_summary(scored: DataFrame) -> DataFrame:
    """One row: means to 4 digits, flags as percentages to 2."""
    return scored.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in BASELINE_MEANS), *(F.round(100 * F.avg(c), 2).alias(c) for c in ("none_pct", "exact_match")))


FAILURES = {
    "rows": "true",
    "parse_failed": "parse_failed = 1",
    "empty": "parse_failed = 0 and code_constraint = ''",
    "errors": "error is not null",
}


def failure_counts(metrics: DataFrame, *by: str) -> DataFrame:
    """Rows, failed parses, empty expressions and failed requests."""
    return metrics.groupBy(*by).agg(*(F.count_if(F.expr(test)).alias(name) for name, test in FAILURES.items()))


def observed_failures(metrics: DataFrame, name: str = "failures") -> tuple[DataFrame, Observation]:
    """The same rows, and the counts that the job which uses them takes on the way."""
    seen = Observation(name)
    return metrics.observe(seen, *(F.count_if(F.expr(test)).alias(c) for c, test in FAILURES.items())), seen


def scores_from_report(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A report's text rows -> key, value: without the row of means and without
    cells that are no numbers."""
    number = F.expr(f"try_cast(`{value}` as double)")
    return rows.filter(~F.col("is_mean")).select(key, number.alias(value)).filter(F.col(value).isNotNull() & ~F.isnan(value))
