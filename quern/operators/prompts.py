"""Prompts as DataFrames: templates, examples and slices joined to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "-" * 40
# Strategies and their variants (strategy, variant, number of
# examples, whether every model runs it or only the benchmark model).
EXAMPLES = [1, 2, 4, 8, 16, 32, 64, 128]
VARIANTS = [
    ("vanilla", None, None, True),
    *[("fewshot", v, k, (v, k) == ("sr", 16)) for v in ("rand", "sr") for k in EXAMPLES],
    *[("cot", v, None, v == "exim") for v in ("unst", "woex", "expl", "exim")],
    *[("slice", v, None, v == "slextra") for v in ("slextra", "slonly")],
    ("mix", None, None, True),
]


def target(code: Column) -> Column:
    return F.concat(F.lit("Target Method:\n"), code, F.lit("\n"))


def highlighted(slice_code: Column) -> Column:
    """Section with a slice, empty if there is none."""
    said = F.concat(F.lit("\nCode Slice (highlights constraint-relevant statements):\n"), slice_code, F.lit("\n"))
    return F.when(F.coalesce(slice_code, F.lit("")) == "", "").otherwise(said)


def first_of_same_code(items: DataFrame) -> DataFrame:
    """code_formatted, first_id: of items with equal code the smallest id."""
    return items.groupBy("code_formatted").agg(F.min("id").alias("first_id"))


def with_first_of_same_code(items: DataFrame) -> DataFrame:
    """id, first_id: for each item the smallest id of those with equal code.  Codes meet
    as digests of 256 bits, so no code is shuffled."""
    keyed = items.select("id", F.unhex(F.sha2(F.coalesce("code_formatted", F.lit("")), 256)).alias("digest"), F.col("code_formatted").isNull().alias("none"))
    return keyed.join(keyed.groupBy("digest", "none").agg(F.min("id").alias("first_id")), ["digest", "none"]).select("id", "first_id")


def example_sections(found: DataFrame, items: DataFrame, k: int, slices: DataFrame | None = None, reasoned: bool = False) -> DataFrame:
    """(id, example_id, rank) -> id, examples: numbered sections, the most
    similar last; an item is no example of itself, unknown ids are passed over.
    With slices (id, slice) each example shows the slice of the first item that
    has the same code."""
    shown = found.filter((F.col("rank") <= k) & (F.col("id") != F.col("example_id"))).groupBy("id", "example_id").agg(F.min("rank").alias("rank"))
    texts = items.select(F.col("id").alias("example_id"), "code_formatted", "doc_constraint")
    if slices is not None:
        shown_slices = with_first_of_same_code(items).join(slices.select(F.col("id").alias("first_id"), "slice"), "first_id").select(F.col("id").alias("example_id"), "slice").dropDuplicates(["example_id"])
        texts = texts.join(shown_slices, "example_id", "left")
    else:
        texts = texts.withColumn("slice", F.lit(None).cast("string"))
    said = F.concat(target(F.col("code_formatted")), highlighted(F.col("slice")), F.lit("\nOutput:\n"), F.lit("(Step by step reasoning here)\nFinal expression: " if reasoned else ""), F.coalesce("doc_constraint", F.lit("")), F.lit("\n"))
    listed = F.sort_array(F.collect_list(F.struct("rank", "said")), asc=False)
    joined = F.array_join(F.transform(listed, lambda x, i: F.concat(F.lit("\nExample "), (i + 1).cast("string"), F.lit(":\n"), x.said)), "")
    sections = F.concat(F.lit("Few-Shot Examples:\n"), joined, F.lit(f"\n{RULE}\n\nNow analyze the Target Method below:\n\n"))
    return shown.join(texts, "example_id").select("id", "rank", said.alias("said")).groupBy("id").agg(sections.alias("examples"))


def prompts(items: DataFrame, task: str, examples: DataFrame | None = None, slices: DataFrame | None = None, slice_only: bool = False) -> DataFrame:
    """items (id, code_formatted) -> id, prompt.  task: the instructions of the
    strategy; examples (id, examples) and slices (id, slice) as it needs them."""
    df = items.select("id", "code_formatted")
    df = df.join(examples, "id", "left") if examples is not None else df.withColumn("examples", F.lit(""))
    df = df.join(slices.select("id", "slice"), "id", "left") if slices is not None else df.withColumn("slice", F.lit(""))
    code = F.concat(F.lit("Code Slice:\n"), F.coalesce(F.when(F.col("slice") != "", F.col("slice")), "code_formatted"), F.lit("\n")) if slice_only else F.concat(target(F.col("code_formatted")), highlighted(F.col("slice")))
    return df.select("id", F.concat(F.lit(task), F.coalesce("examples", F.lit("")), code).alias("prompt"))


def label(strategy: Column, variant: Column, k: Column) -> Column:
    """Name of a configuration, as reports show it."""
    return F.when(k.isNotNull(), F.concat(variant, F.lit(" k="), k.cast("string"))).when(variant.isNotNull(), F.concat(strategy, F.lit("-"), variant)).otherwise(strategy)


def variants(spark: SparkSession) -> DataFrame:
    """strategy, variant, k, by_default: all configurations."""
    return spark.createDataFrame(VARIANTS, "strategy string, variant string, k int, by_default boolean")


def config_grid(models: DataFrame, configs: DataFrame) -> DataFrame:
    """(model, is_benchmark), (strategy, variant, k, by_default) -> model, strategy,
    variant, k, label, path: the benchmark model runs all, the others the default ones."""
    path = F.concat_ws("/", "strategy", "variant", F.concat("model", F.coalesce(F.concat(F.lit("_k"), F.col("k").cast("string")), F.lit("")), F.lit(".json")))
    met = models.join(F.broadcast(configs), F.col("is_benchmark") | F.col("by_default"))
    return met.select("model", "strategy", "variant", "k", label(F.col("strategy"), F.col("variant"), F.col("k")).alias("label"), path.alias("path"))


def routed(models: DataFrame, registry: DataFrame) -> DataFrame:
    """(model) with the backend, rate, ... that registry (model, ...) has for it."""
    return models.join(F.broadcast(registry), "model")


def unknown_models(models: DataFrame, registry: DataFrame) -> DataFrame:
    """Models that no backend is registered for."""
    return models.select("model").distinct().join(F.broadcast(registry), "model", "left_anti")


def prompts_by_variant(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """items (id, code_formatted), tasks (variant, task): the few instructions of a
    strategy -> id, variant, prompt."""
    met = items.select("id", "code_formatted").join(F.broadcast(tasks))
    return met.select("id", "variant", F.concat("task", target(F.col("code_formatted"))).alias("prompt"))


def mixed_prompts(items: DataFrame, task: str, found: DataFrame, slices: DataFrame, k: int = 16) -> DataFrame:
    """Examples with slices and reasoning, then the item with its slice -> id, prompt."""
    return prompts(items, task, example_sections(found, items, k, slices, reasoned=True), slices)
