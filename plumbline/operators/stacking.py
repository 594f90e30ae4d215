"""Summaries of a clean suite table, per building of a roll."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.rent import floor_order
from plumbline.operators.joins import lookup_join
from plumbline.session import settle


def _area():
    return F.coalesce("sf", F.lit(0.0))


def _occupied():
    return F.col("status") != "vacant"


def _ratio():
    return F.when(F.col("total_sf") > 0, F.col("occupied_sf") / F.col("total_sf"))


def stack_summary(suites: DataFrame) -> DataFrame:
    """Suites, total and occupied area, and occupancy as a ratio, per building."""
    occupied = F.sum(F.when(_occupied(), _area()).otherwise(F.lit(0.0)))
    return suites.groupBy("file_id", "building").agg(
        F.count("*").alias("suites"),
        F.sum(_area()).alias("total_sf"),
        occupied.alias("occupied_sf"),
    ).withColumn("occupancy", _ratio())


def floors(suites: DataFrame) -> DataFrame:
    """Floors of every building; a larger `sort_key` is higher up."""
    return suites.groupBy("file_id", "building", "floor").agg(
        F.count("*").alias("suites"), F.sum(_area()).alias("sf")
    ).withColumn("sort_key", floor_order(F.col("floor")))


def floors_per_building(suites: DataFrame) -> DataFrame:
    return floors(suites).groupBy("file_id", "building").agg(F.count("*").alias("floors"))


def expiry_buckets(suites: DataFrame) -> DataFrame:
    """Suites and area by expiry year, with keys for month-to-month, no date and vacancy."""
    bucket = (
        F.when(F.col("status").isin("vacant", "mtm"), F.col("status"))
        .otherwise(F.coalesce(F.year("lease_end").cast("string"), F.lit("nodate")))
    )
    return suites.groupBy("file_id", "building", bucket.alias("bucket")).agg(
        F.count("*").alias("suites"), F.sum(_area()).alias("sf")
    )


def tenants(suites: DataFrame) -> DataFrame:
    """Suites and area per tenant, vacancy under its own key."""
    key = F.when(_occupied(), F.col("tenant")).otherwise(F.lit("vacant"))
    return suites.groupBy("file_id", key.alias("tenant"), (~_occupied()).alias("is_vacancy")).agg(
        F.count("*").alias("suites"), F.sum(_area()).alias("sf")
    )


def unique_tenants(suites: DataFrame) -> DataFrame:
    return tenants(suites).groupBy("file_id").agg(F.count_if(~F.col("is_vacancy")).alias("tenants"))


def summary_sheet(suites: DataFrame) -> DataFrame:
    """Label and value cells of a roll's summary sheet; row 5 is the occupancy, a plain number."""
    totals = stack_summary(suites).groupBy("file_id").agg(
        F.count("*").alias("buildings"), F.sum("suites").alias("suites"),
        F.sum("total_sf").alias("total_sf"), F.sum("occupied_sf").alias("occupied_sf"),
    ).withColumn("occupancy", _ratio())
    cells = [
        ("Buildings", "buildings"), ("Suites", "suites"), ("Total SF", "total_sf"),
        ("Occupied SF", "occupied_sf"), ("Occupancy %", "occupancy"),
    ]
    long = F.array(*[
        F.struct(F.lit(i + 1).alias("row_no"), F.lit(label).alias("label"), F.col(name).cast("double").alias("value"))
        for i, (label, name) in enumerate(cells)
    ])
    return totals.select("file_id", F.inline(long))


def roll_sheets(suites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roll sheets as (single-building rolls, multi-building rolls); only the latter have a Building column."""
    per_file = suites.groupBy("file_id").agg((F.min("building") != F.max("building")).alias("several"))
    marked = lookup_join(suites, settle(per_file), "file_id", "line_no")
    columns = ["suite", "tenant", "floor", "sf", "lease_end", "status"]
    return (
        marked.where("not several").select("file_id", *columns),
        marked.where("several").select("file_id", "building", *columns),
    )


def write_workbook(suites: DataFrame, path: str) -> None:
    """Summary and roll sheets as CSV tables, one folder per roll."""
    single, multi = roll_sheets(suites)
    sheets = {"summary": summary_sheet(suites), "rent_roll": single, "rent_roll_by_building": multi}
    for name, sheet in sheets.items():
        sheet.write.partitionBy("file_id").option("header", True).csv(f"{path}/{name}")
