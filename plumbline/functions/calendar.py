"""Time expressions; all of them in UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def time_slot(at: Column, seconds: int) -> Column:
    """Start of the fixed-length slot that holds a time, in microseconds."""
    micros = F.unix_micros(at)
    return micros - F.pmod(micros, F.lit(seconds * 1_000_000))
