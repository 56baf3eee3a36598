"""Structured Streaming: running per-user statistics with state, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as a stream."""
    return spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def running_moments(events: DataFrame) -> DataFrame:
    """Integer moments of each user's values so far, a row per user and trigger that touches it."""
    c = F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long")
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(c).alias("s1"), F.sum(c * c).alias("s2"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per event-time window and type; events later than the watermark are dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """All that is there, batch by batch into a table beside the checkpoint, and a view of it by this name: in complete
    mode of the last batch, else of all. A batch that runs again writes over what it wrote."""
    spark, root = stream.sparkSession, f"{checkpoint}/table"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(root)
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    rows.drop("batch").createOrReplaceTempView(name)
