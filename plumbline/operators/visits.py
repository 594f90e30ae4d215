"""Visits: a device's events with no idle gap above the limit.

Events are first reduced to the first and last time per device and time slot of
one gap's length. Two events in one slot are never more than a gap apart, so a
new visit can only start between slots. The reduction combines before the
shuffle and leaves at most one row per slot, however busy a device is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.calendar import time_slot
from plumbline.operators.joins import lookup_join
from plumbline.session import settle

GAP_SECONDS = 30 * 60


def device_slots(rows: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    return (
        rows.where(F.col("device").isNotNull() & F.col("created_at").isNotNull())
        .groupBy("device", time_slot(F.col("created_at"), gap).alias("slot"))
        .agg(
            F.min("created_at").alias("first_at"),
            F.max("created_at").alias("last_at"),
            F.count("*").alias("events"),
        )
    )


def _starts(slots: DataFrame, gap: int) -> DataFrame:
    order = W.partitionBy("device").orderBy("slot")
    idle = F.unix_micros("first_at") - F.unix_micros(F.lag("last_at").over(order))
    return slots.withColumn("starts", F.when(idle <= gap * 1_000_000, 0).otherwise(1))


def visits(rows: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Visits per device."""
    return _starts(device_slots(rows, gap), gap).groupBy("device").agg(F.sum("starts").alias("visits"))


def _numbered_slots(rows: DataFrame, gap: int) -> DataFrame:
    running = W.partitionBy("device").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    return _starts(device_slots(rows, gap), gap).withColumn("visit_no", F.sum("starts").over(running))


def visit_bounds(rows: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Start, end and size of every visit."""
    return _numbered_slots(rows, gap).groupBy("device", "visit_no").agg(
        F.min("first_at").alias("started_at"),
        F.max("last_at").alias("ended_at"),
        F.sum("events").alias("events"),
    )


def visit_events(rows: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Events with their visit number; each slot of a device lies in one visit."""
    numbered = _numbered_slots(rows, gap).select("device", "slot", "visit_no")
    slotted = rows.withColumn("slot", time_slot(F.col("created_at"), gap))
    return lookup_join(slotted, settle(numbered), ["device", "slot"], "id").drop("slot")
