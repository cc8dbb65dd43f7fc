"""Scoring answers as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.operators.scoring import evaluated


def score_arrivals(arrivals: DataFrame, gold: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the scores of every micro-batch of answers to path as Parquet,
    a folder per batch, so a batch that is run again replaces its own rows.
    Scores depend on one row each; no state is kept."""

    def score(batch: DataFrame, number: int) -> None:
        evaluated(gold, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = arrivals.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
