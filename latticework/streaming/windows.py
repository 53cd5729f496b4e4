"""Windowed counts over the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def windowed(stream: DataFrame, kind: str) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows, or by user in sessions. State is kept for ten years of event time, so that no event of the tables is late."""
    w = {"tumbling": F.window("ts", "1 hour"), "sliding": F.window("ts", "1 hour", "30 minutes"), "session": F.session_window("ts", "2 hours")}[kind]
    by = "user_id" if kind == "session" else "event_type"
    d = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "3650 days").groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return d.select(F.col("w.start").cast("timestamp_ntz").alias("w_start"), F.col("w.end").cast("timestamp_ntz").alias("w_end"), by, "n", "v")


def drain(df: DataFrame, mode: str = "complete") -> DataFrame:
    """All rows that the stream gives for the input now at hand, written into the shared folder by the executors and read from there."""
    spark = df.sparkSession
    path, state = (f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("stream", "stream-state"))
    spark.createDataFrame([], df.schema).write.parquet(path)  # a stream may give no batch
    put = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)
    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    at = spark._jvm.org.apache.hadoop.fs.Path(state)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.schema(df.schema).parquet(path)
