"""The incremental sync as a stream: files in, keyed upserts out, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.sources.tables import Store, upserted


def stream_upsert(spark: SparkSession, source: str, schema, store: Store, name: str, keys: list[str], checkpoint: str, updated_at: str = "updated_at"):
    """Start a stream over Parquet files that keeps a table's latest row of each key.

    Each micro-batch is reduced to one row a key before it is merged; a batch that is replayed
    after a failure merges to the same table.
    """

    def merge(batch: DataFrame, _: int) -> None:
        from pyspark.sql import functions as F

        rows = upserted(batch.withColumn("__seq", F.monotonically_increasing_id()), keys, updated_at, "__seq").drop("__seq")
        store.upsert(name, rows, keys, updated_at)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
