"""Scoring sequences as they arrive: a stateless Structured Streaming query per model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kmerloom.functions.weights import Params
from kmerloom.operators import scoring


def score_stream(arrivals: DataFrame, model: DataFrame, params: Params, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """arrivals: a streaming DataFrame (seq_id, seq); scores of each micro-batch go to `path` as Parquet.

    The model's word scores are computed once and shared by all batches. A
    batch that is run again after a failure overwrites its own folder.
    """
    table = scoring.word_scores(model, params).persist()

    def batch(df: DataFrame, number: int) -> None:
        scoring.classify_with(df, table, params).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
