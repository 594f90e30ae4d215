"""Reading, appending, rewriting and exporting events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.exclusions import delete_by_id
from plumbline.schemas import DAY_COLUMN, EVENTS
from plumbline.session import settle
from plumbline.sources.lookups import days_of_keys

ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
# Fixed value: columns of the raw export, in order.
EXPORT_COLUMNS = ["id", "created_at", "app", "event", "session_id", "path", "user_agent", "internal", "properties"]


def read_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Stored events with their day, from one or several tables with the same columns."""
    return spark.read.schema(EVENTS).parquet(*paths)


def read_events_jdbc(
    spark: SparkSession, url: str, table: str, low_id: int, high_id: int, partitions: int, **options: str,
) -> DataFrame:
    """Events of a database, read in parallel ranges of the id."""
    return (
        spark.read.format("jdbc").options(
            url=url, dbtable=table, partitionColumn="id", lowerBound=str(low_id), upperBound=str(high_id),
            numPartitions=str(partitions), **options,
        ).load().select(*EVENTS.fieldNames())
    )


def tag_internal(events: DataFrame, own_traffic) -> DataFrame:
    """Merge the internal mark into the properties where `own_traffic` holds."""
    fields = F.coalesce(F.from_json("properties", "map<string,variant>"), F.create_map())
    mark = F.create_map(F.lit("internal"), F.parse_json(F.lit("true")))
    tagged = F.map_concat(F.map_filter(fields, lambda k, v: k != "internal"), mark)
    return events.withColumn("properties", F.when(own_traffic, F.to_json(tagged)).otherwise(F.col("properties")))


def append_events(events: DataFrame, path: str) -> None:
    """Append to the table, one folder per UTC day.

    Rows are dealt by day first, in pieces of moderate size, so that a task does not leave a file in every folder.
    """
    (
        events.select(*EVENTS.fieldNames(), F.to_date("created_at").alias(DAY_COLUMN))
        .hint("rebalance", DAY_COLUMN)
        .write.mode("append").partitionBy(DAY_COLUMN).parquet(path)
    )


def delete_events(spark: SparkSession, path: str, ids: DataFrame, target: str) -> None:
    """Write the table without the listed ids to `target`.

    The stored table stays as it is until the caller points readers to the new one,
    so a lost executor or a failed job never leaves it half deleted.
    """
    stored = spark.read.parquet(path)
    delete_by_id(stored, ids).write.mode("errorifexists").partitionBy(DAY_COLUMN).parquet(target)


def delete_events_by_day(spark: SparkSession, path: str, ids: DataFrame) -> list:
    """Remove the listed ids from the stored table, rewriting only the days that hold them; the days are returned.

    A short list of ids is looked up in the value ranges and bloom filters of the files first (`lookups`).
    What stays of these days is stored first, so a failed job can be repeated. A day of which nothing stays loses
    its folder. Readers of these days should wait until it is done.
    """
    listed = ids.select("id").distinct()
    days = days_of_keys(spark, path, "id", listed)
    if not days:
        return days
    whole = spark.read.parquet(path)
    held = F.col(DAY_COLUMN).isin([d for d in days if d is not None])
    if None in days:
        held = F.coalesce(held, F.lit(False)) | F.col(DAY_COLUMN).isNull()
    kept = settle(delete_by_id(whole.where(held), listed))
    left = {r[0] for r in kept.select(DAY_COLUMN).distinct().collect()}
    kept.hint("rebalance", DAY_COLUMN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY_COLUMN).parquet(path)
    jvm = spark.sparkContext._jvm
    for day in set(days) - left:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{DAY_COLUMN}={day or '__HIVE_DEFAULT_PARTITION__'}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(days, key=str)


def raw_export(visible_rows: DataFrame) -> DataFrame:
    """The nine export columns of the filtered rows, as stored."""
    return visible_rows.select(
        "id", "created_at", F.col("raw_app").alias("app"), "event", "session_id", "path", "user_agent",
        F.col("is_internal").alias("internal"), "properties",
    )


def export_csv(export: DataFrame, path: str) -> None:
    """Header, empty cells for null, quotes only where needed and doubled inside."""
    (
        export.withColumn("created_at", F.date_format("created_at", ISO_TIME))
        .write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def export_json(export: DataFrame, path: str) -> None:
    """One object per row; the properties stay an object."""
    (
        export.withColumn("created_at", F.date_format("created_at", ISO_TIME))
        .withColumn("properties", F.try_parse_json("properties"))
        .write.option("ignoreNullFields", False).json(path)
    )
