"""Maintenance of the exclusion list and of single events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.text import filled, prefix, trimmed

NOTE_WIDTH = 200


def split_actions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a known action and a device id that is not blank."""
    device = filled(trimmed(F.col("device_id")))
    valid = F.coalesce(device.isNotNull() & F.col("action").isin("exclude", "include"), F.lit(False))
    return actions.where(valid).withColumn("device_id", device), actions.where(~valid)


def apply_exclusions(devices: DataFrame, actions: DataFrame) -> DataFrame:
    """The list after all accepted actions; the last action on a device decides."""
    accepted, _ = split_actions(actions)
    state = devices.select(
        "device_id", F.struct(F.lit(None).cast("long").alias("seq"), F.lit("exclude").alias("action"),
                              F.col("note").alias("note")).alias("state"),
    ).unionByName(accepted.select(
        "device_id", F.struct(F.col("seq").alias("seq"), F.col("action").alias("action"),
                              prefix(F.col("note"), NOTE_WIDTH).alias("note")).alias("state"),
    ))
    # Nulls order first, so a stored row loses against any action.
    last = state.groupBy("device_id").agg(F.max("state").alias("state"))
    return last.where("state.action = 'exclude'").select("device_id", "state.note")


def without_devices(devices: DataFrame, removed: DataFrame) -> DataFrame:
    return devices.join(removed.select("device_id").distinct(), "device_id", "left_anti")


def delete_by_id(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events without the listed ids."""
    return events.join(ids.select("id").distinct(), "id", "left_anti")
