"""Structured Streaming on event files: watermarked windows and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream over Parquet files; the event time is a timestamp, as watermarks ask for."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; works on streams and batches alike."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def append_new(stream: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends rows whose key the target doesn't have yet: resuming and repeats leave one row a key."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
