"""Finding the rows of a few ids or devices without reading the whole event table.

Files written by `append_findable` are ordered by id and carry Parquet bloom filters on id and device. A short list
of keys becomes an IN condition, which the scan tests against the value range and the bloom filter of each
row group before it reads any of it; a long list is a semi-join over the two columns that are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.schemas import DAY_COLUMN, EVENTS

# Longer lists are joined: with thousands of keys nearly every row group holds one, and nothing is spared.
KEYS_AT_MOST = 1_000
FOUND_BY = ("id", "session_id")
ROW_GROUP_BYTES = 32 * 1024 * 1024


def append_findable(events: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Append to the day table, each file in order of the id, with bloom filters on id and device."""
    writer = (
        events.select(*EVENTS.fieldNames(), F.to_date("created_at").alias(DAY_COLUMN))
        .hint("rebalance", DAY_COLUMN).sortWithinPartitions(DAY_COLUMN, "id")
        .write.mode("append").option("parquet.block.size", row_group_bytes)
        # Sized to the distinct values of a row group, up to Parquet's bound in bytes.
        .option("parquet.bloom.filter.adaptive.enabled", "true")
    )
    for column in FOUND_BY:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.partitionBy(DAY_COLUMN).parquet(path)


def rows_of_keys(rows: DataFrame, column: str, keys: DataFrame, at_most: int = KEYS_AT_MOST) -> DataFrame:
    """Rows whose `column` is among the values of `keys`' column of that name; nulls match nothing.

    Any table will do; bloom filters only spare reading. At most `at_most` + 1 keys reach the driver.
    """
    listed = keys.select(column).where(F.col(column).isNotNull()).distinct()
    few = [r[0] for r in listed.limit(at_most + 1).collect()]
    if len(few) > at_most:
        return rows.join(listed, column, "left_semi").select(*rows.columns)
    return rows.where(F.col(column).isin(few)) if few else rows.where(F.lit(False))


def rows_scanned(rows: DataFrame) -> int:
    """Run a frame of one scan and tell how many rows the scan gave out, before its filter."""
    plan = rows._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def days_of_keys(spark: SparkSession, path: str, column: str, keys: DataFrame) -> list:
    """Days of the stored table that hold a row of these keys, null for rows without a time."""
    rows = spark.read.schema(EVENTS).parquet(path)
    return [r[0] for r in rows_of_keys(rows, column, keys).select(F.to_date("created_at")).distinct().collect()]
