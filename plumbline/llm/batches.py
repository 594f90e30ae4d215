"""Bounded Arrow batches for work in Python tasks."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Rows of one Arrow batch; long texts make larger rows cost more memory than small ones.
TEXT_ROWS = 256


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Hold Arrow batches to `rows` rows, so that a task's memory follows the longest texts, not 10 000 of them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
