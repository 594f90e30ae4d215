"""Lookup joins whose broadcast is decided by a measured size."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType, VariantType

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
# A key is hot from this share of all rows on, so there are at most that many hot keys.
HOT_KEYS_AT_MOST = 1_000


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure the frame and tell whether it may be broadcast; one row per partition meets in a task."""
    width = F.lit(16 * len(df.columns))
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            column = F.to_json(F.struct(column))
        elif not isinstance(field.dataType, StringType):
            continue
        width = width + F.coalesce(F.octet_length(column), F.lit(0))
    seen = (
        df.select(width.alias("width"))
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("width"), F.lit(0)).alias("bytes"))
        .first()
    )
    return seen["n"] <= max_rows and seen["bytes"] <= max_bytes


def lookup_join(
    facts: DataFrame, dim: DataFrame, key: str | list[str], spread_by: str,
    max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join with a frame that holds one row per key.

    A small `dim` is broadcast. Beyond the bound both sides are shuffled, and the
    fact rows of hot or null keys are spread over all partitions by `spread_by`:
    their answer comes from the few hot keys, looked up beforehand. What was measured as large is joined by merging:
    Spark would go by the size of the files, and a well compressed table would fill the driver as a broadcast.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if small_enough(dim, max_rows, max_bytes):
        return facts.join(F.broadcast(dim), keys, "left")

    payload = [c for c in dim.columns if c not in keys]
    dim = dim.hint("merge")
    incomplete = reduce(or_, [F.col(k).isNull() for k in keys])
    least = max(facts.count() // HOT_KEYS_AT_MOST, 1)
    hot = (
        facts.where(~incomplete).groupBy(*keys).agg(F.count("*").alias("_n"))
        .where(F.col("_n") > least).select(*keys)
        .join(dim, keys, "left")
        .select(*keys, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in payload])
    )
    is_hot = F.coalesce("_hot", F.lit(False))
    # All columns take part, since `spread_by` alone may be null or repeat.
    mixed = [f"`{f.name}`" for f in facts.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    lane = F.when(is_hot | incomplete, F.abs(F.xxhash64(spread_by, *mixed) % 1_000_000) + 1).otherwise(F.lit(0))
    spread = facts.join(F.broadcast(hot), keys, "left").withColumn("_lane", lane)
    # Always zero, but not a constant, so that the lane stays part of the shuffle key.
    lanes = dim.withColumn("_lane", F.pmod(F.xxhash64(*keys), F.lit(1))).hint("merge")
    answers = [F.when(is_hot, F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in payload]
    rest = [c for c in facts.columns if c not in keys]
    return spread.join(lanes, [*keys, "_lane"], "left").select(*keys, *rest, *answers)
