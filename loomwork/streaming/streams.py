"""Structured Streaming: event-time windows, late rows and resumable reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema, per_trigger: int = 8) -> DataFrame:
    """A stream of new Parquet files, at most so many a trigger; the checkpoint is the cursor that a restart resumes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _until_late(events: DataFrame, late: str | None) -> DataFrame:
    """The events under a watermark, which needs times with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by event time; works alike on a table and on a stream (with a watermark)."""
    seen = _until_late(events, late)
    out = seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    seen = _until_late(events, late)
    out = seen.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events closer than the gap."""
    seen = _until_late(events, late)
    out = seen.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key; state is kept as long as the watermark allows duplicates."""
    seen = _until_late(events, late)
    return seen.dropDuplicatesWithinWatermark(keys) if events.isStreaming else seen.dropDuplicates(keys)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Takes all that is there into a Parquet table and ends; run again, it takes what is new."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The whole result of an aggregating stream once all that is there is taken: every batch writes it anew, the last one is returned."""
    spark = stream.sparkSession
    done = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        done.append(number)

    query = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    if not done:
        raise ValueError("the stream has nothing new")
    return spark.read.schema(stream.schema).parquet(f"{path}/batch-{done[-1]}")
