"""Corpus preparation: documents in, packed training sequences out.

Every stage works on all rows that its predecessor kept and gives back the
columns of its input, the last one the pieces of packed sequences.  run()
writes each stage's result and reads it again, so a lost executor costs one
stage at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.op02_decontamination import decontaminated
from quern.llm.op03_packing import pack_documents
from quern.llm.op05_near_dedup import deduplicated
from quern.llm.op07_language_id import UND, fit_languages, language_column, learn_likeness
from quern.llm.op09_secrets import redact_secrets
from quern.llm.queries import vocabulary
from quern.session import stash, table, unstash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Predictions less sure than this are rejected.
LEAST_SURE = 0.1


#: Whole documents in an Arrow batch; the default of 10,000 is meant for narrow rows.
#: Stages set it as their result is worked out later; run() puts it back.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those unlike all languages of the table."""
    model = learn_likeness(fit_languages(docs, F.lit(True)), docs, F.lit(True))
    said = docs.withColumn("quern_language", language_column(model, F.col("text")))
    return said.filter((F.col("quern_language.lang_pred") != UND) & (F.col("quern_language.score") >= LEAST_SURE)).drop("quern_language")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest id, of each group of near-duplicates; unlike texts of one id stay."""
    return deduplicated(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; n_chars follows where a text changed."""
    out = redact_secrets(docs.withColumn("quern_before", F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col("quern_before")), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.drop("quern_before")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of at most 1024 tokens."""
    packed = pack_documents(docs, vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


def in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("language id", language_id), ("near dedup", near_dedup), ("decontamination", decontaminate), ("secrets", secrets), ("packing", packing)]
STAGES = [(name, in_small_batches(stage)) for name, stage in STAGES]

#: Not to be had in SQL (model, tokens); tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; returns the last one's rows."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            kept = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            unstash(docs)
            docs = kept
    finally:
        spark.conf.set(BATCH, before)
    return docs
