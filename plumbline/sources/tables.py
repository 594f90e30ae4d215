"""The exclusion list as a stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from plumbline.operators.exclusions import apply_exclusions, split_actions
from plumbline.schemas import EXCLUDED_DEVICES, PROFILES
from plumbline.session import settle
from plumbline.sources.days import folder_names, remove_folder

BUCKETS = 256
# Folder column of a list in buckets; the name tells into how many it was divided.
BUCKET_PREFIX = "bucket_of_"


def read_excluded_devices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXCLUDED_DEVICES).parquet(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILES).parquet(path)


def save_exclusions(spark: SparkSession, path: str, actions: DataFrame, target: str) -> DataFrame:
    """Apply a batch of actions and write the new list beside the old one; returns the new list.

    Readers move to `target` once it is complete.
    """
    apply_exclusions(read_excluded_devices(spark, path), actions).write.mode("errorifexists").parquet(target)
    return read_excluded_devices(spark, target)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("device_id"), F.lit(buckets)).cast("int")


def _buckets_of(spark: SparkSession, path: str, default: int) -> int:
    found = {int(name[len(BUCKET_PREFIX):].split("=")[0]) for name in folder_names(spark, path) if name.startswith(BUCKET_PREFIX)}
    if len(found) > 1:
        raise ValueError(f"{path} is divided in several ways: {sorted(found)}")
    return found.pop() if found else default


def _write_buckets(devices: DataFrame, path: str, buckets: int) -> None:
    column = f"{BUCKET_PREFIX}{buckets}"
    (
        devices.select(*EXCLUDED_DEVICES.fieldNames(), _bucket(buckets).alias(column)).hint("rebalance", column)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    )


def read_bucketed_exclusions(spark: SparkSession, path: str, chosen: list[int] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The list in buckets, whole or only the chosen ones; a path without folders is an empty list."""
    column = f"{BUCKET_PREFIX}{_buckets_of(spark, path, buckets)}"
    if not any(name.startswith(BUCKET_PREFIX) for name in folder_names(spark, path)):
        return spark.createDataFrame([], EXCLUDED_DEVICES)
    stored = spark.read.schema(StructType([*EXCLUDED_DEVICES.fields]).add(column, IntegerType())).parquet(path)
    return (stored if chosen is None else stored.where(F.col(column).isin(chosen))).select(*EXCLUDED_DEVICES.fieldNames())


def update_bucketed_exclusions(spark: SparkSession, path: str, actions: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Apply a batch of actions to the list in buckets and return the buckets made again; the files of others stay.

    Only these buckets are read and written. The new rows are stored beside the list first, and a batch that is applied
    again after a failure gives the same list, since stored rows lose against any action. `buckets` counts for a new list
    only. A reader that starts while a batch is applied may see some buckets before and some after it; where that
    matters, use `save_exclusions`.
    """
    buckets = _buckets_of(spark, path, buckets)
    accepted, _ = split_actions(actions)
    touched = sorted(r[0] for r in accepted.select(_bucket(buckets)).distinct().collect())
    if not touched:
        return touched
    kept = settle(apply_exclusions(read_bucketed_exclusions(spark, path, touched, buckets), accepted))
    _write_buckets(kept, path, buckets)
    left = {r[0] for r in kept.select(_bucket(buckets)).distinct().collect()}
    for bucket in set(touched) - left:
        remove_folder(spark, f"{path}/{BUCKET_PREFIX}{buckets}={bucket}")
    return touched
