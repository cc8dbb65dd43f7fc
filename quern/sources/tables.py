"""Reading and writing the evaluation's tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import scratch_dir
from quern.sources.arrays import read_array

__all__ = ["ANSWERS", "BASELINE", "CONFIG", "PAIRS", "last_by_key", "overlaid", "read_answers", "read_array", "required", "with_code", "write_answers", "write_report"]

# Schemas of the files the stages exchange; always declared, never inferred.
PAIRS = "id string, project_name string, code_formatted string, doc_constraint string"
ANSWERS = "id string, text string, error string, input_tokens int, output_tokens int, elapsed_seconds double"
BASELINE = "id string, wit_result string, wit_paths array<string>, miss_reason string"
CONFIG = ["strategy", "variant", "k", "model"]


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers of all configurations, partitioned by strategy, variant, k and model."""
    return spark.read.schema(f"{ANSWERS}, strategy string, variant string, k int, model string").json(path)


def write_answers(answers: DataFrame, path: str) -> None:
    answers.write.mode("overwrite").partitionBy(*CONFIG).json(path)


def overlaid(preferred: DataFrame, fallback: DataFrame, *keys: str) -> DataFrame:
    """Rows of preferred, and those of fallback whose key it lacks."""
    return preferred.unionByName(fallback.join(preferred.select(*keys).distinct(), list(keys), "left_anti"))


def last_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows that repeat a key the last in order."""
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("quern_n", F.row_number().over(last)).filter("quern_n = 1").drop("quern_n")


def required(rows: DataFrame, column: str) -> DataFrame:
    """rows, failing where column is null or blank."""
    return rows.withColumn(column, F.when(F.coalesce(F.trim(column), F.lit("")) != "", F.col(column)).otherwise(F.raise_error(F.lit(f"{column} is empty"))))


def with_code(rows: DataFrame, column: str = "code_formatted") -> DataFrame:
    """Rows whose code isn't blank."""
    return rows.filter(F.coalesce(F.trim(column), F.lit("")) != "")


def write_report(rows: DataFrame, path: str, order: Sequence[str | Column], shown: Sequence[str] | None = None, mark: bool = True) -> None:
    """The shown columns of rows (else all) as one CSV file with a header, in order;
    mark: with the byte order mark that spreadsheets look for.

    Tasks write the rows of a range of the order each.  The parts are then joined below
    a hidden name, file by file on the driver without being held there, and the whole is
    renamed, so a report is either complete or not there.  An older one is replaced.
    """
    spark = rows.sparkSession
    line = lambda *cells: F.to_csv(F.struct(*cells), {"escape": '"', "emptyValue": "", "nullValue": ""})
    cells = [F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(shown or rows.columns)]
    sort = [F.expr(o) if isinstance(o, str) else o for o in order]
    ordered = rows.repartitionByRange(spark.sparkContext.defaultParallelism, *sort).sortWithinPartitions(*sort)
    parts = f"{scratch_dir(spark)}/quern-report-{uuid.uuid4().hex}"
    ordered.select(line(*cells).alias("line")).write.text(parts)
    header = spark.range(1).select(line(*(F.lit(c).alias(f"c{k}") for k, c in enumerate(shown or rows.columns)))).first()[0]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    target, source = of(path), of(parts)
    fs, from_fs = target.getFileSystem(conf), source.getFileSystem(conf)
    hidden = of(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    try:
        out.write(bytearray(("\ufeff" if mark else "").encode() + header.encode() + b"\n"))
        for name in sorted(s.getPath().getName() for s in from_fs.listStatus(source)):
            if name.startswith("part-"):
                part = from_fs.open(of(source, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                finally:
                    part.close()
    finally:
        out.close()
    fs.delete(target, True)
    if not fs.rename(hidden, target):
        raise OSError(f"{path} can't be written")
    from_fs.delete(source, True)
