"""What may be kept: account data, audit logs and feedback."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.text import filled
from plumbline.operators.feeds import FEEDBACK_EVENT
from plumbline.operators.joins import lookup_join

# Fixed values.
ACCOUNT_DAYS = 30
AUDIT_MONTHS = 12
FEEDBACK_DAYS = 30


def _days_before(as_of: datetime, days: int):
    return F.lit(as_of) - F.make_dt_interval(F.lit(days))


def kept_accounts(profiles: DataFrame, as_of: datetime, days: int = ACCOUNT_DAYS) -> DataFrame:
    """Accounts that are live or were deleted less than the grace period ago."""
    return profiles.where(F.col("deleted_at").isNull() | (F.col("deleted_at") > _days_before(as_of, days)))


def kept_audit_rows(audit: DataFrame, profiles: DataFrame, as_of: datetime, months: int = AUDIT_MONTHS) -> DataFrame:
    """Audit rows (`id`, `user_id`) of accounts not deleted, or deleted less than the period ago."""
    # The last deletion counts where an account has several.
    deletions = profiles.where("deleted_at is not null").groupBy("user_id").agg(F.max("deleted_at").alias("deleted_at"))
    oldest = F.add_months(F.to_date(F.lit(as_of)), -months)
    marked = lookup_join(audit, deletions, "user_id", "id")
    return marked.where(F.col("deleted_at").isNull() | (F.to_date("deleted_at") > oldest)).drop("deleted_at")


def feedback_due(events: DataFrame, as_of: datetime, days: int = FEEDBACK_DAYS) -> DataFrame:
    """Feedback past its review period, to be archived or deleted."""
    return events.where((F.col("event") == FEEDBACK_EVENT) & (F.col("created_at") <= _days_before(as_of, days))).select(
        "id", "created_at", filled(F.col("session_id")).alias("device")
    )


def purge_report(before: DataFrame, kept: DataFrame, what: str) -> DataFrame:
    """Rows before, kept and purged, in one row."""
    return before.agg(F.count("*").alias("rows")).select(
        F.lit(what).alias("what"), "rows", kept.select(F.count("*")).scalar().alias("kept")
    ).withColumn("purged", F.col("rows") - F.col("kept"))
