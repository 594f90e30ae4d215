"""Bounded feeds: recent events, recent errors, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.outcomes import is_error
from plumbline.functions.properties import detail_of, detail_text, error_reason, json_text, truthy_text
from plumbline.functions.text import prefix
from plumbline.operators.events import newest

# Fixed values.
RECENT_SIZE = 60
FEEDBACK_SIZE = 200
ERRORS_PER_APP = 10
FEEDBACK_EVENT = "feedback"


def recent_events(rows: DataFrame, n: int = RECENT_SIZE) -> DataFrame:
    """The newest events, with the device shortened to eight characters."""
    return newest(rows.select("id", "created_at", "app", "event", "device"), n).select(
        "id", F.col("created_at").alias("time"), "app", "event", prefix(F.col("device"), 8).alias("device")
    )


def recent_errors(rows: DataFrame, n: int = ERRORS_PER_APP) -> DataFrame:
    """The newest errors per app; JSON is read only from the rows that remain."""
    order = W.partitionBy("app").orderBy(F.desc("created_at"), F.desc("id"))
    kept = (
        rows.where(is_error(F.col("event")))
        .select("app", "created_at", "id", "event", "properties")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
    )
    properties = F.col("properties")
    return kept.select(
        "app", "rank", error_reason(properties, F.col("event")).alias("reason"),
        detail_of(properties).alias("detail"), F.col("created_at").alias("time"),
    )


def readable_errors(errors: DataFrame) -> DataFrame:
    return errors.withColumn("detail", detail_text(F.col("detail")))


def feedback_feed(app_rows: DataFrame, n: int = FEEDBACK_SIZE) -> DataFrame:
    """The newest feedback, internal rows marked rather than hidden."""
    kept = newest(
        app_rows.where(F.col("event") == FEEDBACK_EVENT)
        .select("id", "created_at", "app", "properties", "is_internal"),
        n,
    )
    p = F.col("properties")

    def optional(key):
        return prefix(json_text(p, key), 64).alias(key)

    return kept.select(
        "id", F.col("created_at").alias("time"), "app",
        prefix(F.coalesce(truthy_text(p, "feedback_type"), F.lit("other")), 32).alias("feedback_type"),
        prefix(F.coalesce(truthy_text(p, "message"), F.lit("")), 2000).alias("message"),
        optional("version"), optional("commit"), optional("screen"),
        F.col("is_internal").alias("internal"),
    )
