"""Structured Streaming forms of the event operators.

All take and return streaming frames; the same functions work on batch frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.events import with_defaults
from plumbline.operators.joins import small_enough
from plumbline.schemas import EVENTS

LATENESS = "1 hour"
# Copies of the exclusion list when it is too large to broadcast to a stream; more for more executors.
LANES = 32


def stream_events(spark: SparkSession, folder: str, file_filter: str = "*.parquet", schema=EVENTS) -> DataFrame:
    """Events arriving as parquet files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_filter).parquet(folder)


def stream_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Event texts from a topic, for `parse_events`."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
        .select(F.col("value").cast("string").alias("value"))
    )


def parse_events(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) from JSON texts in column `value`.

    A text is rejected when it is not an object of the known shape or lacks a time.
    """
    fields = ", ".join(
        f"{f.name} {'string' if f.name == 'properties' else f.dataType.simpleString()}" for f in EVENTS.fields
    )
    parsed = texts.withColumn("e", F.from_json("value", f"{fields}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = F.coalesce(F.col("e._bad").isNull() & F.col("e.created_at").isNotNull(), F.lit(False))
    return parsed.where(good).select(*[f"e.{name}" for name in EVENTS.fieldNames()]), parsed.where(~good).select("value")


def deduplicated(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each id once, for redelivered events."""
    return events.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["id"])


def marked(events: DataFrame, devices: DataFrame, lanes: int = LANES) -> DataFrame:
    """Defaults and internal marks against the exclusion list as stored when the stream starts.

    A list too large to broadcast is repeated per lane, so that the events of one
    busy device are joined in as many tasks.
    """
    listed = devices.select(F.col("device_id").alias("session_id"), F.lit(True).alias("is_excluded")).distinct()
    rows = with_defaults(events)
    if small_enough(listed):
        joined = rows.join(F.broadcast(listed), "session_id", "left")
    else:
        copies = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_lane")
        joined = (
            rows.withColumn("_lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int"))
            .join(listed.select("*", copies), ["session_id", "_lane"], "left").drop("_lane")
        )
    excluded = F.coalesce("is_excluded", F.lit(False))
    return joined.withColumns({"is_excluded": excluded, "is_internal": excluded | F.col("self_tag")})


def _windowed(rows: DataFrame, lateness: str, window, *keys: str) -> DataFrame:
    counts = rows.withWatermark("created_at", lateness).groupBy(window, *keys).agg(F.count("*").alias("n"))
    bounds = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return counts.select(*bounds, *keys, "n")


def daily_counts(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return _windowed(rows, lateness, F.window("created_at", "1 day"), "app")


def hourly_counts(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return _windowed(rows, lateness, F.window("created_at", "1 hour"))


def rolling_week(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Seven-day counts, one window per day."""
    return _windowed(rows, lateness, F.window("created_at", "7 days", "1 day"))


def visit_sessions(rows: DataFrame, lateness: str = LATENESS, gap: str = "30 minutes") -> DataFrame:
    """Closed visits per device; a visit appears once the watermark has passed it."""
    sessions = (
        rows.where("device is not null").withWatermark("created_at", lateness)
        .groupBy(F.session_window("created_at", gap).alias("window"), "device").agg(F.count("*").alias("events"))
    )
    return sessions.select(
        "device", F.col("window.start").alias("started_at"), F.col("window.end").alias("closes_at"), "events"
    )
