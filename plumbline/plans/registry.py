"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ArrayType, ByteType, DateType, DecimalType, IntegerType, MapType, ShortType, TimestampType,
)

from plumbline.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Text forms of dates and times on the SQL side.
SQL_DAY = "'%Y-%m-%d'"
SQL_TIME = "'%Y-%m-%d %H:%M:%S.%f'"


def plain_columns(df: DataFrame) -> DataFrame:
    """Dates, times, lists, maps and money as plain text and numbers for comparison."""
    def plain(field):
        column = F.col(field.name)
        kind = field.dataType
        if isinstance(kind, DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, (ByteType, ShortType, IntegerType)):
            column = column.cast("long")
        elif isinstance(kind, DecimalType):
            column = column.cast("double")
        elif isinstance(kind, ArrayType):
            column = F.array_join(column, ",")
        elif isinstance(kind, MapType):
            column = F.to_json(column)
        return column.alias(field.name)

    return df.select(*[plain(field) for field in df.schema.fields])


def register(name: str, build: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        use_utc(spark)
        return plain_columns(build(spark, folder))

    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle
