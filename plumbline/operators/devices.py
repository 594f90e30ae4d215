"""Device roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.clients import browser_of, platform_of


# The client of a device is that of its newest event. Grouping by the client first
# leaves plain maxima for the large aggregate, which can then hash instead of sort.
# Of several clients at the very same instant the last by name is taken.


def per_client(rows: DataFrame) -> DataFrame:
    """One row per device, app, client and internal mark; what the functions below need of the events."""
    return rows.groupBy(
        "device", "app", "is_internal",
        platform_of(F.col("user_agent")).alias("platform"), browser_of(F.col("user_agent")).alias("browser"),
    ).agg(
        F.count("*").alias("events"),
        F.max("created_at").alias("at"),
        F.bool_or("self_tag").alias("flagged"),
        F.bool_or("is_excluded").alias("internal"),
    )


def platforms_of(clients: DataFrame) -> DataFrame:
    """Devices per platform of their newest event."""
    newest = clients.where("device is not null").groupBy("device", "platform").agg(F.max("at").alias("at"))
    newest = newest.groupBy("device").agg(F.max(F.struct("at", "platform")).alias("last"))
    return newest.groupBy("last.platform").agg(F.count("*").alias("n"))


def table_of(clients: DataFrame) -> DataFrame:
    """One row per device with its apps, newest client, count and marks.

    The apps of a device are as many as it has used: names come from clients, so a device shared by many has a long list.
    """
    return (
        clients.where("device is not null").groupBy("device").agg(
            F.max(F.struct("at", "platform", "browser")).alias("last"),
            F.sort_array(F.collect_set("app")).alias("apps"),
            F.sum("events").alias("events"),
            F.bool_or("flagged").alias("flagged"),
            F.bool_or("internal").alias("internal"),
        )
        .select(
            F.col("device").alias("device_id"), "last.platform", "last.browser", "apps", "events",
            F.col("last.at").alias("last_seen"), "flagged", "internal",
        )
    )


def devices_by_platform(rows: DataFrame) -> DataFrame:
    """Devices per platform of their newest event, an empty user agent included."""
    return platforms_of(per_client(rows.where("device is not null")))


def device_table(rows: DataFrame) -> DataFrame:
    """One row per device over all rows in range.

    Reduced per device, app and client first: apps and newest client are then found
    among a handful of rows instead of among all events.
    """
    return table_of(per_client(rows.where("device is not null")))


def latest_devices(table: DataFrame, n: int) -> DataFrame:
    return table.orderBy(F.desc("last_seen"), "device_id").limit(n)
