"""What every job needs from a session: shared scratch space and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only on one machine (master local[...]) may the setting be absent; then a
    temporary folder is made and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("quern.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("quern.scratch.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    The result has no lineage beyond the files, so lost executors cost a
    re-read, never a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def reread(df: DataFrame) -> DataFrame:
    """A stashed table read anew, to be joined with itself."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._quern_path)
    out._quern_path = df._quern_path
    return out


def unstash(*frames: DataFrame | None) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_quern_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Parts for what is dealt by ranges: as many as shuffles have, or cores if those are
    more; the cores that have come up so far say too little about a large job."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` for a broadcast join if it has ``most`` rows or fewer, which is
    counted first; else for a shuffle join, whatever Spark guesses its size to be.  For
    narrow rows only."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")
