"""Approximate distinct devices from stored sketches, for those who ask for them; exact counts stay the default.

A sketch per app and day answers any range of days without the events: sketches of the days are merged, and a device seen on
several days counts once. With 2^lg_k buckets the standard error of a merged sketch is 1.04 / sqrt(2^lg_k); `MOST_ERROR` is
three of them at the default. Counts that are small beside the buckets come out nearly exact.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

LG_K = 12
MOST_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)


def device_sketches(rows: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """app, day, sketch: the devices of an app on a day, in at most 2^lg_k bytes or so. Rows without a device or day are left out."""
    known = rows.where("device IS NOT NULL AND day IS NOT NULL")
    return known.groupBy("app", "day").agg(F.hll_sketch_agg("device", lg_k).alias("sketch"))


def merged_sketches(*parts: DataFrame) -> DataFrame:
    """Sketches of several loads as one table; the same rows twice change nothing."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("app", "day").agg(F.hll_union_agg("sketch").alias("sketch"))


def _estimate(sketch: str):
    return F.hll_sketch_estimate(F.hll_union_agg(sketch))


def approximate_devices(sketches: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """app and about how many devices it had from `first` to `last`; app null is all apps together, 0 without any sketch."""
    if first is not None:
        sketches = sketches.where(F.col("day") >= F.lit(first))
    if last is not None:
        sketches = sketches.where(F.col("day") <= F.lit(last))
    each = sketches.groupBy("app").agg(_estimate("sketch").alias("devices"))
    return each.unionByName(sketches.agg(F.lit(None).cast("string").alias("app"), _estimate("sketch").alias("devices")))
