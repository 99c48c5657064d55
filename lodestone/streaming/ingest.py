"""Ingest of files as they arrive: a stream of rows whose batches are upserted by key into a table of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.incremental import upsert


def latest(batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key of a batch: the last version."""
    return batch.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(version)))).where("r = 1").drop("r")


def upsert_stream(spark: SparkSession, source: str, schema: str, root: str, keys: list[str], version: str, checkpoint: str):
    """A streaming query that folds Parquet files of a folder into root/snapshot=N; a batch that comes again writes the same snapshot.

    Each batch reads the snapshot before it, merges by key and writes the next one, so readers never see half a batch.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def fold(batch: DataFrame, n: int) -> None:
        new = latest(batch, keys, version)
        # only the first batch has no snapshot before it; one that cannot be read must stop the stream, not empty the table
        old = spark.read.schema(schema).parquet(f"{root}/snapshot={n - 1}") if n else spark.createDataFrame([], schema)
        upsert(old, new, keys).drop("state").write.mode("overwrite").parquet(f"{root}/snapshot={n}")

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events by type in tumbling windows, late ones within the watermark; the same plan serves a batch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
