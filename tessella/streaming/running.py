"""Min-max statistics over a stream: each micro-batch is fitted and merged into a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.minmax import STATS, merge_stats, minmax_fit


def run_minmax(stream: DataFrame, cols: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keep the statistics of all rows so far, one Parquet version per batch, under ``path``.
    Merging is idempotent, so a batch that is replayed after a failure changes nothing."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = minmax_fit(batch, cols)
        if batch_id:
            new = merge_stats(spark.read.schema(STATS).parquet(f"{path}/version={batch_id - 1}"), new)
        new.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
