"""Streams: pages observed as they arrive, logs counted by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.extract import with_extracted
from lodestar.sources.logs import read_lines
from lodestar.sources.scratch import fresh_path


def arriving_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def extracted_stream(pages: DataFrame, watermark: str | None = None, at: str = "fetched_at") -> DataFrame:
    """A stream of pages (url, html ...) with their records; with a watermark, each
    normalised URL once."""
    read = with_extracted(pages)
    if watermark is None:
        return read
    return read.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["normalized_url"])


def observe_stream(pages: DataFrame, observe: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Runs detectors over each micro-batch and appends their observations; a batch
    that is run again replaces its own output, so that each page counts once."""

    def one(batch: DataFrame, number: int) -> None:
        observe(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_hits(lines: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Crawler hits and server errors per day, of a stream of log lines."""
    hits = read_lines(lines).where("hit is not null").select("hit.*").where("rlike(user_agent, '(?i)googlebot|bingbot')")
    return hits.withWatermark("at", lateness).groupBy(F.window("at", "1 day").alias("day")).agg(F.count("*").alias("hits"), F.count_if(F.col("status") >= 500).alias("errors"))


def daily_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", lateness: str = "1 day") -> DataFrame:
    """Events per day and kind."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, "1 day").alias("day"), kind).agg(F.count("*").alias("n"))


def run_to_end(rows: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that a stream has so far, as a table in the shared folder: every batch
    replaces what the one before wrote."""
    path = fresh_path(rows.sparkSession, name)
    schema = rows.schema

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = rows.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(schema).parquet(path)
