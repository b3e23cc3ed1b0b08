"""Polled feeds as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import upsert_keep_last


def landed(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files in a folder, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(rows: DataFrame, time: str, value: str, keys: list[str], width: str = "5 minutes", late: str = "90 minutes") -> DataFrame:
    """n, and the largest value, of each key and tumbling window; rows later than ``late`` are dropped in streams."""
    timed = rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.max(value).alias("peak"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "peak")


def deduplicated(rows: DataFrame, keys: list[str], time: str, late: str = "90 minutes") -> DataFrame:
    """Each key once within the lateness: overlapping polls bring rows again."""
    return rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, partition: str) -> StreamingQuery:
    """Keeps a Parquet table with the last row of each key; only partitions that a batch touches are rewritten.

    New versions are written beside the table and swapped in by dynamic partition overwrite.  A batch that
    runs again gives the same rows.  ``partition`` must follow from the key.
    """
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path

    def merge(batch: DataFrame, n: int) -> None:
        fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        new = upsert_keep_last(batch, batch.limit(0), keys, order)
        if fs.exists(hadoop(path)):
            touched = new.select(partition).distinct()
            old = spark.read.schema(batch.schema).parquet(path).join(touched, partition, "left_semi")
            new = upsert_keep_last(old, batch, keys, order)
        beside = f"{path}__{n}"
        new.write.mode("overwrite").parquet(beside)
        spark.read.schema(batch.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        fs.delete(hadoop(beside), True)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tolerance: str, late: str = "90 minutes") -> DataFrame:
    """Rows of two streams of equal keys where the right one is at most ``tolerance`` older."""
    a = left.withColumn("_lt", F.col(left_time).cast("timestamp")).withWatermark("_lt", late).alias("a")
    b = right.withColumn("_rt", F.col(right_time).cast("timestamp")).withWatermark("_rt", late).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = (F.col("_rt") <= F.col("_lt")) & (F.col("_rt") >= F.col("_lt") - F.expr(f"INTERVAL {tolerance}"))
    on = near
    for s in same:
        on = on & s
    return a.join(b, on)


def tick(feed: DataFrame, checkpoint: str, body: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Runs ``body`` (infer, publish, prune) for what has arrived: once, or every ``every``."""
    writer = feed.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
