"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.op02_decontamination import ORACLE_SQL as LEAKS_SQL
from quern.llm.op04_url_reputation import ORACLE_SQL as URL_SQL
from quern.llm.op11_importance import ORACLE_SQL as RESAMPLING_SQL
from quern.llm.op13_filter_audit import ORACLE_SQL as AUDIT_SQL
from quern.session import table


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op01_ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op02_decontamination import leaked_windows

    return leaked_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels whose doc_id is the page's id: bad if toxic or of low quality."""
    from quern.llm.op04_url_reputation import judge_urls

    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    outcomes = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return judge_urls(pages.select("page_id", "url"), outcomes, URL_RULES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op03_packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op05_near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op06_token_counts import count_tokens

    counted = count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op07_language_id import fit_languages, predict_languages

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))
    model = fit_languages(docs, ~held_out)
    return predict_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op08_licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts, labels = F.col("phrases.start"), lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(F.col("phrases.label")).alias("base_labels"),
        labels(F.col("phrases.label"), F.col("templates.label")).alias("labels"),
        "score",
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op09_secrets import KINDS, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.depth == 0)
    count = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), "unfinished")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op10_lm_scoring import score_documents

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    scored = score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op11_importance import importance_sampled

    sampled = importance_sampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10)
    return sampled.select("doc_id", "n_features", "weight", "score", "rank")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op12_quality import learn_quality, quality_scores

    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))
    model = learn_quality(docs, table(spark, sf_dir, "labels"), ~held_out, cut=0.3)
    return quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op13_filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_url_reputation": op4_url_reputation,
    "op5_near_dedup": op5_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_importance": op11_importance,
    "op12_quality": op12_quality,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {"op2_decontamination": LEAKS_SQL, "op4_url_reputation": URL_SQL, "op11_importance": RESAMPLING_SQL, "op13_filter_audit": AUDIT_SQL}
