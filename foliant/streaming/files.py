"""A folder as a stream of documents, and event-time operators with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.plans.convert import convert, units
from foliant.sources.files import scan_stream


def stream_units(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Units of each arriving file; documents are whole, so nothing is kept between batches."""
    return units(scan_stream(spark, path, glob))


def convert_stream(spark: SparkSession, path: str, out: str, checkpoint: str, glob: str = "*") -> StreamingQuery:
    """Each micro-batch converted and appended as Parquet; a file's aggregates are all in its batch. Batches write once by their number."""

    def write(batch: DataFrame, number: int) -> None:
        convert(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return scan_stream(spark, path, glob).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame, late: str) -> DataFrame:
    """With a watermark on ``ts``; times without a zone are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts per window and type; events later than the watermark are left out."""
    return _timed(events, late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
