"""The prepared event frame and the three row sets every report starts from."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.properties import self_tagged
from plumbline.functions.text import defaulted_app, filled
from plumbline.operators.joins import lookup_join
from plumbline.schemas import DAY_COLUMN

# Any other range name means no lower bound.
RANGE_DAYS = {"7d": 7, "30d": 30, "90d": 90}
# The cap of newest rows that callers may ask for.
ROW_CAP = 50_000


def since(range_name: str, as_of: datetime) -> datetime | None:
    days = RANGE_DAYS.get(range_name)
    return None if days is None else as_of - timedelta(days=days)


def in_range(events: DataFrame, range_name: str, as_of: datetime) -> DataFrame:
    """Rows at or after the lower bound.

    A plain comparison, so it reaches the scan; on a table stored by day it also
    leaves earlier folders unread.
    """
    start = since(range_name, as_of)
    if start is None:
        return events
    if DAY_COLUMN in events.columns:
        events = events.where(F.col(DAY_COLUMN) >= F.lit(start.date()))
    return events.where(F.col("created_at") >= F.lit(start))


def newest(events: DataFrame, cap: int) -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(cap)


def with_defaults(events: DataFrame) -> DataFrame:
    """Defaulted app, device, UTC day and hour, and the self-tag."""
    return events.withColumns({
        "raw_app": F.col("app"),
        "app": defaulted_app(F.col("app")),
        "device": filled(F.col("session_id")),
        "day": F.to_date("created_at"),
        "hour": F.hour("created_at"),
        "self_tag": self_tagged(F.col("properties")),
    })


def prepare_events(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Events with defaults and the internal marks of the exclusion list, in which a device may repeat."""
    listed = devices.select(F.col("device_id").alias("session_id"), F.lit(True).alias("is_excluded")).distinct()
    marked = lookup_join(with_defaults(events), listed, "session_id", "id")
    excluded = F.coalesce("is_excluded", F.lit(False))
    return marked.withColumns({"is_excluded": excluded, "is_internal": excluded | F.col("self_tag")})


@dataclass(frozen=True)
class Scope:
    all_rows: DataFrame      # in range; app list and device table
    app_rows: DataFrame      # plus app filter; feedback
    visible_rows: DataFrame  # plus internal filter; everything else
    as_of: datetime
    app: str | None
    include_internal: bool
    cap: int | None = None   # the cap of newest rows that was asked for


def scope(
    events: DataFrame, devices: DataFrame, as_of: datetime, range_name: str = "30d",
    app: str | None = None, include_internal: bool = False, cap: int | None = None,
) -> Scope:
    """The three row sets; uncapped unless a cap of newest rows is asked for."""
    rows = in_range(events, range_name, as_of)
    if cap is not None:
        rows = newest(rows, cap)
    prepared = prepare_events(rows, devices)
    app_rows = prepared if not app else prepared.where(F.col("app") == app)
    visible = app_rows if include_internal else app_rows.where(~F.col("is_internal"))
    return Scope(prepared, app_rows, visible, as_of, app, include_internal, cap)


def hidden_internal(sc: Scope) -> DataFrame:
    hidden = F.lit(0).cast("long") if sc.include_internal else F.count_if("is_internal")
    return sc.app_rows.agg(hidden.alias("hidden_internal_events"))


def all_apps(rows: DataFrame, selected: str | None = None) -> DataFrame:
    """Every app name before filtering, plus a stale selection if one is given."""
    names = rows.select("app").distinct()
    if selected is None:
        return names
    chosen = names.sparkSession.range(1).select(F.lit(selected).alias("app"))
    return names.union(chosen).distinct()


def excluded_traffic(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Audit of what the exclusion list hides."""
    return prepare_events(events, devices).where("is_excluded")


def visible_traffic(events: DataFrame, devices: DataFrame) -> DataFrame:
    return prepare_events(events, devices).where(~F.col("is_internal"))
