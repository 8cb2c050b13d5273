"""Incremental batches: new files only, each id once, results merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def stream_once(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str, transform=lambda df: df) -> int:
    """Process what is new under ``source`` (Parquet) since the checkpoint and append it to ``sink``; ids met before are left out. Returns the batches run."""
    batches = []
    s = transform(spark.readStream.schema(schema).parquet(source)).dropDuplicates([key])

    def put(df: DataFrame, epoch: int) -> None:
        batches.append(epoch)
        df.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")  # a repeated epoch replaces itself

    q = s.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(batches)


def pending(manifest: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of a manifest without a result."""
    return manifest.join(done.select(key).distinct(), key, "left_anti")
