"""Device table and app statistics from stored states of each day, kept up to date by remaking only the days that changed.

A state row is what one device did in one app with one client on one day: sums, maxima and marks that merge over days. Whether a
device is on the exclusion list is not stored, so a change of the list needs no day made again. Every state row carries the
signature of its day's files; days are written by replacing their folders, so a run that fails leaves days that
are either old, and made again by the next run, or new.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.clients import browser_of, platform_of
from plumbline.functions.outcomes import FUNNEL, is_error, is_opened, is_success
from plumbline.operators.events import with_defaults
from plumbline.operators.joins import lookup_join
from plumbline.schemas import DAY_COLUMN
from plumbline.sources.days import NO_DAY, day_signatures, exists, read_days, remove_folder
from plumbline.session import settle

KEYS = ["device", "app", "self_tag", "platform", "browser"]
STEPS = [f"step_{i}" for i in range(len(FUNNEL))]


def states_of(events: DataFrame) -> DataFrame:
    """State rows of stored events, one for each day and `KEYS`."""
    rows, event = with_defaults(events), F.col("event")
    return rows.withColumns({"platform": platform_of(F.col("user_agent")), "browser": browser_of(F.col("user_agent"))}).groupBy(
        DAY_COLUMN, *KEYS).agg(
        F.count("*").alias("events"), F.max("created_at").alias("at"), F.bool_or(is_opened(event)).alias("opened"),
        F.count_if(is_success(event)).alias("successes"), F.count_if(is_error(event)).alias("errors"),
        *[F.bool_or(test(event)).alias(name) for name, (_, _, test) in zip(STEPS, FUNNEL)])


def _stored_signatures(spark: SparkSession, state_path: str) -> dict[str, int]:
    if not exists(spark, state_path):
        return {}
    day = F.coalesce(F.col(DAY_COLUMN).cast("string"), F.lit(NO_DAY))
    rows = spark.read.parquet(state_path).groupBy(day.alias("day")).agg(F.min("signature").alias("signature"))
    return {r["day"]: r["signature"] for r in rows.collect()}


def update_states(spark: SparkSession, path: str, state_path: str) -> tuple[list[str], list[str]]:
    """Bring the states up to date with the event table; the days made again and the days dropped."""
    now, old = day_signatures(spark, path), _stored_signatures(spark, state_path)
    remade = [day for day, signature in now.items() if old.get(day) != signature]
    dropped = [day for day in old if day not in now]
    if remade:
        signatures = spark.createDataFrame([(day, now[day]) for day in remade], "day string, signature long")
        states = states_of(read_days(spark, path, remade)).withColumn("day", F.coalesce(F.col(DAY_COLUMN).cast("string"), F.lit(NO_DAY)))
        # One row for each day that changed.
        signed = states.join(F.broadcast(signatures), "day").drop("day")
        signed.hint("rebalance", DAY_COLUMN).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(DAY_COLUMN).parquet(state_path)
        # A day whose files hold no row has no state to replace the old one.
        left = set(_stored_signatures(spark, state_path).items())
        dropped += [day for day in remade if day in old and (day, now[day]) not in left]
    for day in dropped:
        remove_folder(spark, f"{state_path}/{DAY_COLUMN}={day}")
    return remade, dropped


def marked_states(spark: SparkSession, path: str, state_path: str, devices: DataFrame, start: datetime | None = None) -> DataFrame:
    """State rows since `start` with the marks of the exclusion list; of the events only the first day is read, where it counts in part."""
    states = spark.read.parquet(state_path).drop("signature")
    if start is not None:
        first = [day for day in day_signatures(spark, path) if day == start.date().isoformat()]
        border = states_of(read_days(spark, path, first).where(F.col("created_at") >= F.lit(start)))
        states = states.where(F.col(DAY_COLUMN) > F.lit(start.date())).unionByName(border)
    listed = devices.select(F.col("device_id").alias("device"), F.lit(True).alias("internal")).distinct()
    marked = lookup_join(states, listed, "device", "events")
    internal = F.coalesce("internal", F.lit(False))
    return settle(marked.withColumns({"internal": internal, "is_internal": internal | F.col("self_tag"), "flagged": F.col("self_tag")}))


def per_device(states: DataFrame) -> DataFrame:
    """The reduction behind app statistics and funnel, merged over days."""
    return states.groupBy("app", "device").agg(
        F.sum("events").alias("n"), F.bool_or("opened").alias("opened"), F.sum("successes").alias("successes"),
        F.sum("errors").alias("errors"), *[F.bool_or(name).alias(name) for name in STEPS])
