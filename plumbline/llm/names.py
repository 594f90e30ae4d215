"""Column names that no column of a given frame has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def spare(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` is called so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of `df`, whatever characters their names have."""
    return [F.col("`" + column.replace("`", "``") + "`") for column in df.columns]
