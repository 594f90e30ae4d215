"""The whole dashboard as one job: a few stored reductions of the events, then small frames."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.outcomes import is_error
from plumbline.operators import apps, devices, events as ev, feeds, overview
from plumbline.session import settle


@dataclass(frozen=True)
class Request:
    as_of: datetime
    range_name: str = "30d"
    app: str | None = None
    include_internal: bool = False


def _from_cube(cube: DataFrame, key: str) -> DataFrame:
    return cube.groupBy(key).agg(F.sum("n").alias("n"))


class Dashboard(Mapping):
    """Part name → frame. A part is built when it is asked for, and with it only the stored reductions that it needs, once.

    Stored are counts per app, event, day and hour; counts per app and device; one row per device, app and client; and the rows
    that are errors or feedback. Plain counts, statistics, funnel, devices, apps and two feeds come from those. Beside
    them, only the headline numbers and the newest events read the events again.
    """

    def __init__(self, sc: ev.Scope, request: Request):
        self.sc, self.request = sc, request
        self._parts = {
            "kpis": lambda: overview.overview_kpis(sc),
            "all_apps": lambda: ev.all_apps(self.clients),
            "apps": lambda: apps.stats_of(self.per_device),
            "app_events": self._app_events,
            "funnel": lambda: apps.funnel_of(self.per_device),
            "daily": lambda: overview.dense_days(self.cube.groupBy("app", "day").agg(F.sum("n").alias("n")), request.as_of),
            "events_by_app": lambda: _from_cube(self.cube, "app"),
            "events_by_name": lambda: _from_cube(self.cube, "event"),
            "hours": lambda: overview.dense_hours(_from_cube(self.cube, "hour")),
            "platforms": self._platforms,
            "devices": lambda: devices.table_of(self.clients),
            "recent_events": lambda: feeds.recent_events(sc.visible_rows),
            "recent_errors": lambda: feeds.recent_errors(self._shown(self.told)),
            "feedback": lambda: feeds.feedback_feed(self.told),
        }

    @cached_property
    def cube(self) -> DataFrame:
        return settle(overview.event_cube(self.sc.visible_rows))

    @cached_property
    def per_device(self) -> DataFrame:
        return settle(apps.per_device(self.sc.visible_rows))

    @cached_property
    def clients(self) -> DataFrame:
        return settle(devices.per_client(self.sc.all_rows))

    @cached_property
    def told(self) -> DataFrame:
        """Rows that are errors or feedback."""
        rows = self.sc.app_rows.where(is_error(F.col("event")) | (F.col("event") == feeds.FEEDBACK_EVENT))
        return settle(rows.select("id", "created_at", "app", "event", "properties", "is_internal"))

    def _shown(self, rows: DataFrame) -> DataFrame:
        return rows if self.request.include_internal else rows.where(~F.col("is_internal"))

    def _app_events(self) -> DataFrame:
        rank = W.partitionBy("app").orderBy(F.desc("n"), "event")
        per_event = self.cube.groupBy("app", "event").agg(F.sum("n").alias("n"))
        return per_event.withColumn("rank", F.row_number().over(rank))

    def _platforms(self) -> DataFrame:
        app = self.request.app
        return devices.platforms_of(self._shown(self.clients.where(F.col("app") == app) if app else self.clients))

    def __getitem__(self, name: str) -> DataFrame:
        return self._parts[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


def dashboard(events: DataFrame, excluded: DataFrame, request: Request) -> Dashboard:
    """All parts of the dashboard, each made on demand."""
    return Dashboard(
        ev.scope(events, excluded, request.as_of, request.range_name, request.app, request.include_internal), request)


def write_dashboard(parts: Mapping[str, DataFrame], folder: str) -> None:
    """Each part as a parquet table of its own."""
    for name, part in parts.items():
        part.write.mode("errorifexists").parquet(f"{folder}/{name}")
