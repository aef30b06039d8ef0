"""Structured Streaming forms of the stateful operators (STM-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def deduplicated(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """STM-02: the first event of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def trailing_counts(stream: DataFrame, ts: str, window: str = "180 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """STM-03: counts over sliding windows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window, slide)).agg(F.count("*").alias("n")).select("window.start", "window.end", "n")


def session_counts(stream: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """STM-05: events of each user's sessions."""
    return (
        stream.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("events")).select(user, "s.start", "s.end", "events")
    )


def resume_new(stream: DataFrame, sink: str, key: str, checkpoint: str, work=None):
    """STM-01: each batch's keys that the sink lacks are worked on and appended; the query restarts where it stopped."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            fresh = fresh.join(spark.read.parquet(sink).select(key), key, "left_anti")
        (work(fresh) if work else fresh).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query) -> list[dict]:
    """STM-04: rows and duration of a query's recent batches."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["durationMs"].get("triggerExecution")} for p in query.recentProgress]
