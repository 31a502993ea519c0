"""1-NN scoring of a stream of series: each micro-batch is classified against a training table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.neighbours import classify


def score_stream(stream: DataFrame, train: DataFrame, out_path: str, checkpoint: str, distance: str = "directa", **params):
    """Start the query; batch n is written to its own folder, so a batch that is run again replaces itself."""
    def one(batch: DataFrame, epoch: int) -> None:
        classify(batch, train, distance, params).write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
