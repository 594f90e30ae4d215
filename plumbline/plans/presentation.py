"""Nested shapes for display, made from small long-form results only.

Lists are bounded by the number of days or hours, maps by the number of names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def series_arrays(series: DataFrame) -> DataFrame:
    """Per app two aligned lists, days and counts, from a dense series."""
    pairs = F.array_sort(F.collect_list(F.struct("day", "n")))
    return series.groupBy("app").agg(pairs.alias("pairs")).select(
        "app",
        F.transform("pairs", lambda p: F.date_format(p["day"], "yyyy-MM-dd")).alias("dates"),
        F.transform("pairs", lambda p: p["n"]).alias("counts"),
    )


def hour_array(hours: DataFrame) -> DataFrame:
    """The 24 hourly counts as one list."""
    pairs = F.array_sort(F.collect_list(F.struct("hour", "n")))
    return hours.agg(F.transform(pairs, lambda p: p["n"]).alias("hours"))


def counts_map(counts: DataFrame, key: str) -> DataFrame:
    """Counts as one map from name to count, names in order; rows without a name are left out."""
    pairs = F.array_sort(F.collect_list(F.struct(key, "n")))
    return counts.where(F.col(key).isNotNull()).agg(F.map_from_entries(pairs).alias("counts"))
