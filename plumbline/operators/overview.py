"""Cross-app overview: time series, histograms and headline numbers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.calendar import time_slot
from plumbline.operators.events import Scope
from plumbline.operators.visits import GAP_SECONDS


def event_cube(rows: DataFrame) -> DataFrame:
    """Counts per app, event, day and hour; every plain count below derives from it."""
    return rows.groupBy("app", "event", "day", "hour").agg(F.count("*").alias("n"))


def daily_totals(rows: DataFrame) -> DataFrame:
    return rows.where("day is not null").groupBy("day").agg(F.count("*").alias("n"))


def daily_by_app(rows: DataFrame) -> DataFrame:
    return rows.where("day is not null").groupBy("app", "day").agg(F.count("*").alias("n"))


def daily_series(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Dense counts per app and day, from the first day to the later of it and today.

    The axis is made from the daily counts themselves. Each use keeps the count
    column, so that all of them share one aggregate of the events.
    """
    return dense_days(daily_by_app(rows), as_of)


def dense_days(daily: DataFrame, as_of: datetime) -> DataFrame:
    """Zero-filled days for counts per app and day."""
    first = daily.select(F.min(F.when(F.col("n") > 0, F.col("day")))).scalar()
    axis = F.sequence("first_day", F.greatest(F.col("first_day"), F.to_date(F.lit(as_of))))
    spine = (
        daily.groupBy("app").agg(F.sum("n").alias("total")).where("total > 0")
        .select("app", first.alias("first_day"))
        .select("app", F.explode(axis).alias("day"))
    )
    return spine.join(daily, ["app", "day"], "left").select("day", "app", F.coalesce("n", F.lit(0)).alias("n"))


def total_series(series: DataFrame) -> DataFrame:
    """All apps together, from a dense series."""
    return series.groupBy("day").agg(F.sum("n").alias("n"))


def events_by(rows: DataFrame, key: str, top: int | None = None) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), key).limit(top)


def hour_of_day(rows: DataFrame) -> DataFrame:
    """24 rows, zero-filled."""
    return dense_hours(rows.groupBy("hour").agg(F.count("*").alias("n")))


def dense_hours(counts: DataFrame) -> DataFrame:
    spine = counts.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return spine.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def bar_widths(counts: DataFrame, key: str) -> DataFrame:
    """Counts with their width relative to the largest one, in percent."""
    largest = counts.select(F.max("n")).scalar()
    return counts.select(key, "n", (F.col("n") * 100 / F.greatest(largest, F.lit(1))).alias("width_pct"))


def overview_kpis(sc: Scope, gap: int = GAP_SECONDS) -> DataFrame:
    """Headline numbers in one row, from one pass over the rows in range.

    The rows are reduced per device and time slot, as for visits; the numbers are
    sums over that small frame.
    """
    today = F.to_date(F.lit(sc.as_of))
    in_app = F.col("app") == sc.app if sc.app else F.lit(True)
    shown = in_app if sc.include_internal else in_app & ~F.col("is_internal")
    cells = sc.all_rows.groupBy("device", time_slot(F.col("created_at"), gap).alias("slot"), "day").agg(
        F.count("*").alias("scanned"),
        F.count_if(shown).alias("n"),
        F.count_if(in_app & ~shown).alias("hidden"),
        F.min(F.when(shown, F.col("created_at"))).alias("first_at"),
        F.max(F.when(shown, F.col("created_at"))).alias("last_at"),
    )
    earlier = W.partitionBy("device").orderBy("slot", "day").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("previous_at", F.last("last_at", ignorenulls=True).over(earlier))
    active = F.col("device").isNotNull() & F.col("first_at").isNotNull()
    idle = F.unix_micros("first_at") - F.unix_micros("previous_at")
    new_device = active & F.col("previous_at").isNull()
    on_days = lambda low, high: F.coalesce(
        F.sum(F.when(F.col("day").between(low, high), F.col("n"))), F.lit(0)
    )
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("hidden"), F.lit(0)).alias("hidden_internal_events"),
        # Only a cap that was asked for and reached leaves rows out.
        (F.coalesce(F.sum("scanned") >= sc.cap, F.lit(False)) if sc.cap is not None else F.lit(False)).alias("truncated"),
        F.count_if(new_device).alias("unique_devices"),
        F.count_if(new_device | (active & (idle > gap * 1_000_000))).alias("visits"),
        on_days(today, today).alias("events_today"),
        on_days(F.date_add(today, -6), today).alias("events_this_week"),
        F.size(F.collect_set(F.when(F.col("n") > 0, F.col("day")))).cast("long").alias("active_days"),
    )
