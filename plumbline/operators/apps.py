"""Per-app statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.outcomes import FUNNEL, is_error, is_opened, is_success
from plumbline.functions.text import one_decimal


def per_device(rows: DataFrame, steps=FUNNEL) -> DataFrame:
    """Counts and reached steps per (app, device); distinct devices become plain sums over it."""
    event = F.col("event")
    flags = [F.bool_or(test(event)).alias(f"step_{i}") for i, (_, _, test) in enumerate(steps)]
    return rows.groupBy("app", "device").agg(
        F.count("*").alias("n"),
        F.bool_or(is_opened(event)).alias("opened"),
        F.count_if(is_success(event)).alias("successes"),
        F.count_if(is_error(event)).alias("errors"),
        *flags,
    )


def app_stats(rows: DataFrame) -> DataFrame:
    """Totals, opening devices and success rate per app."""
    return stats_of(per_device(rows))


def stats_of(devices: DataFrame) -> DataFrame:
    outcomes = F.col("success_count") + F.col("error_count")
    return (
        devices.groupBy("app").agg(
            F.sum("n").alias("total_events"),
            F.count_if(F.col("opened") & F.col("device").isNotNull()).alias("total_sessions"),
            F.sum("successes").alias("success_count"),
            F.sum("errors").alias("error_count"),
        )
        .withColumn(
            "success_rate",
            F.when(outcomes > 0, one_decimal(F.col("success_count") / outcomes)),
        )
    )


def app_funnel(rows: DataFrame, steps=FUNNEL) -> DataFrame:
    """Devices per step, steps unordered in time; drop-off against the first step."""
    return funnel_of(per_device(rows, steps), steps)


def funnel_of(devices: DataFrame, steps=FUNNEL) -> DataFrame:
    counts = [
        F.count_if(F.col(f"step_{i}") & F.col("device").isNotNull()).alias(f"n_{i}")
        for i in range(len(steps))
    ]
    wide = devices.groupBy("app").agg(*counts)
    long = F.array(*[
        F.struct(
            F.lit(i + 1).alias("step_no"), F.lit(key).alias("step"), F.lit(label).alias("label"),
            F.col(f"n_{i}").alias("n"),
        )
        for i, (key, label, _) in enumerate(steps)
    ])
    base = F.col("base")
    return (
        wide.select("app", F.col("n_0").alias("base"), F.inline(long))
        .withColumn(
            "dropoff_pct",
            F.when(base > 0, one_decimal(1 - F.col("n") / base)).otherwise(F.lit(0.0)),
        )
        .drop("base")
    )


def app_event_counts(rows: DataFrame, top: int | None = None) -> DataFrame:
    """Events per app and raw event name; optionally the most frequent per app."""
    counts = rows.groupBy("app", "event").agg(F.count("*").alias("n"))
    if top is None:
        return counts
    order = W.partitionBy("app").orderBy(F.desc("n"), "event")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def events_per_app(rows: DataFrame) -> DataFrame:
    return rows.groupBy("app").agg(F.count("*").alias("n"))


def ranked_apps(rows: DataFrame) -> DataFrame:
    """Apps with their place by total events."""
    totals = events_per_app(rows)
    return totals.orderBy(F.desc("n"), "app")
