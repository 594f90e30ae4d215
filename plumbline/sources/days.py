"""Day folders of the stored event table: what they hold, and reading only some of them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StructType

from plumbline.operators.events import newest
from plumbline.schemas import DAY_COLUMN, EVENTS

NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it does not exist."""
    if not exists(spark, path):
        return []
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [entry.getPath().getName() for entry in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def day_signatures(spark: SparkSession, path: str) -> dict[str, int]:
    """Day by its folder name, newest first, rows without a day last, and a digest of its files' names, sizes and times.

    Spark lists the files; no file is opened. One number for each day reaches the driver.
    """
    if not exists(spark, path):
        return {}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    rows = files.select(
        F.regexp_extract("path", f"{DAY_COLUMN}=([^/]+)/", 1).alias("day"),
        F.xxhash64(F.regexp_extract("path", "([^/]+)$", 1), "length", "modificationTime").alias("file"),
    ).groupBy("day").agg(F.sum(F.col("file").cast("decimal(38,0)")).alias("total"), F.count("*").alias("files"))
    found = {r["day"]: hash((int(r["total"]), r["files"])) for r in rows.collect()}
    return {day: found[day] for day in sorted(found, key=lambda d: (d != NO_DAY, d), reverse=True)}


def read_days(spark: SparkSession, path: str, days: list[str], schema: StructType = EVENTS) -> DataFrame:
    """The rows of some day folders; no other folder is listed or read."""
    whole = StructType([*schema.fields]).add(DAY_COLUMN, DateType())
    if not days:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(*[f"{path}/{DAY_COLUMN}={day}" for day in days])


def newest_stored(
    spark: SparkSession, path: str, cap: int, start: datetime | None = None, keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The `cap` newest rows at or after `start` that `keep` leaves, reading the newest days only.

    Days are counted from the newest back, twice as many at a time as before, until they hold `cap` rows. A day is counted from the
    files' row counts alone unless rows have to be told apart. All rows of one instant lie in one day, so ties at the
    border are seen whole. Rows without a time come last.
    """
    days = list(day_signatures(spark, path))
    if start is not None:
        days = [day for day in days if day != NO_DAY and day >= start.date().isoformat()]

    def rows_of(chosen: list[str]) -> DataFrame:
        rows = read_days(spark, path, chosen)
        if start is not None:
            rows = rows.where(F.col("created_at") >= F.lit(start))
        return keep(rows) if keep else rows

    held, taken, step = 0, 0, 1
    while held < cap and taken < len(days):
        held += rows_of(days[taken:taken + step]).count()
        taken, step = taken + step, step * 2
    return newest(rows_of(days[:taken]), cap)
