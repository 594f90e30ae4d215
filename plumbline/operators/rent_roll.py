"""Messy rent-roll lines to a clean suite table.

Lines carry `file_id`, `line_no` and `line`. What a file says about itself (where
its header is, its delimiter, date order, as-of date) is reduced to one row per
file and joined back; a file's lines are never gathered in one place.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions import rent
from plumbline.functions.outcomes import mentions
from plumbline.operators.joins import lookup_join
from plumbline.session import settle

# The tests assert words of these texts.
WARNINGS = {
    "summary_rows": "summary/total rows were excluded",
    "non_suite_rows": "non-suite rows were ignored",
    "duplicate_rows": "duplicate suite rows were dropped",
    "negative_sf": "rows with a negative square-footage were ignored",
    "zero_sf": "rows with 0 SF were left out of the totals",
    "unreadable_dates": "lease dates couldn't be read",
    "ambiguous_dates": "dates are ambiguous; read as month/day",
    "no_tenant_column": "No Tenant column was found",
    "all_vacant": "Every suite parsed as vacant",
    "building_unmapped": "Building column differs on every row and was ignored",
    "unknown_floors": "suites whose floor is neither stated nor part of the suite",
    "no_header": "No header was recognised and nothing was read",
}


def file_headers(lines: DataFrame) -> DataFrame:
    """Per file: header line, delimiter, columns, whether its building is a guess, and the as-of date stated above the header."""
    line = F.col("line")
    tabbed = rent.is_tabbed(line)
    header = rent.canonical_headers(rent.split_cells(line, tabbed))
    guess = rent.with_guess(rent.split_cells(line, tabbed), header)
    known = F.size(F.array_distinct(F.filter(header, lambda h: h.isNotNull())))
    as_of = rent.title_as_of(line)
    told = (
        lines.where(mentions(F.lower(line), rent.TITLE_HINTS))
        .select(
            "file_id", "line_no", as_of.alias("as_of"), tabbed.alias("tabbed"),
            header.alias("header"), guess.alias("guess"), known.alias("known"),
        )
    )
    is_header = (F.col("known") >= 2) & F.array_contains("header", "suite")
    per_file = told.groupBy("file_id").agg(
        F.min(F.when(is_header, F.struct("line_no", "tabbed", "header", "guess"))).alias("head"),
        F.min(F.when(F.col("as_of").isNotNull(), F.struct("line_no", "as_of"))).alias("title"),
    )
    return per_file.where("head is not null").select(
        "file_id", F.col("head.line_no").alias("header_line"), "head.tabbed", F.col("head.guess").alias("header"),
        (~F.col("head.guess").eqNullSafe(F.col("head.header"))).alias("guessed"),
        F.when(F.col("title.line_no") < F.col("head.line_no"), F.col("title.as_of")).alias("as_of"),
    )


def map_columns(headers: DataFrame) -> DataFrame:
    """The recognised columns of every file and their positions from 0."""
    return (
        headers.select("file_id", F.posexplode("header").alias("position", "canonical"))
        .where("canonical is not null").groupBy("file_id", "canonical").agg(F.min("position").alias("position"))
    )


def _forced(header, forced: dict[str, int]):
    for column, position in forced.items():
        header = F.transform(
            header,
            lambda h, i: F.when(i == position, F.lit(column)).otherwise(F.when(~F.coalesce(h == column, F.lit(False)), h)),
        )
    return header


def classified_rows(lines: DataFrame, forced: dict[str, int] | None = None) -> DataFrame:
    """Lines below the header with their cells, each marked suite, summary, non_suite or blank.

    All lines of a file without a recognised header are kept, marked no_header.
    """
    headers = file_headers(lines)
    if forced:
        headers = headers.withColumn("header", _forced(F.col("header"), forced))
    rows = lookup_join(lines, settle(headers), "file_id", "line_no").where(
        F.col("header_line").isNull() | (F.col("line_no") > F.col("header_line")))
    rows = rows.withColumn("cells", rent.split_cells(F.col("line"), F.col("tabbed")))
    cell = {c: rent.cell_of(F.col("cells"), F.col("header"), c) for c in rent.HEADER_NAMES}
    rows = rows.select(
        "file_id", "line_no", "as_of", F.col("header_line").isNull().alias("unread"),
        F.coalesce(F.array_contains("header", "tenant"), F.lit(False)).alias("has_tenant"),
        # A column that the file itself calls Building is believed.
        (F.coalesce("guessed", F.lit(False)) | F.lit("building" in (forced or {}))).alias("building_guessed"),
        (F.trim(F.regexp_replace("line", "[,\t]", " ")) == "").alias("empty"),
        *[c.alias(name) for name, c in cell.items()],
    )
    kind = (
        F.when(F.col("unread"), "no_header").when(F.col("empty"), "blank")
        .when(F.col("suite").rlike(rent.SUMMARY_ROW) & (F.col("tenant") == ""), "summary")
        .when(rent.names_suite(*[F.col(c) for c in ("suite", "tenant", "sf", "start", "end")]), "suite")
        .otherwise("non_suite")
    )
    return rows.withColumn("kind", kind)


def _column_evidence(rows: DataFrame) -> DataFrame:
    """Per file: order of slashed dates, and whether every row has its own building."""
    first, second = rent.slashed_parts(F.col("end"))
    # A suite that is listed twice is one suite of its building.
    per_suite = rows.where("kind = 'suite'").groupBy("file_id", "building", "suite").agg(
        F.max(first).alias("first"), F.max(second).alias("second"))
    per_building = per_suite.groupBy("file_id", "building").agg(
        F.count("*").alias("n"), F.max("first").alias("first"), F.max("second").alias("second"),
        F.col("building").rlike(rent.ROW_CODE).alias("code"),
    )
    return per_building.groupBy("file_id").agg(
        F.coalesce((F.max("first") > 12) & (F.max("second") <= 12), F.lit(False)).alias("day_first"),
        F.coalesce((F.max("first") <= 12) & (F.max("second") <= 12), F.lit(False)).alias("ambiguous"),
        ((F.max("n") == 1) & (F.count("*") > 1) & F.bool_and("code")).alias("numbers_rows"),
    )


def parse_rent_roll(lines: DataFrame, as_of: date, forced: dict[str, int] | None = None) -> DataFrame:
    """Every line below a header with its parsed values; input to the functions below."""
    rows = classified_rows(lines, forced)
    rows = lookup_join(rows, settle(_column_evidence(rows)), "file_id", "line_no")
    end, sf = F.col("end"), rent.parse_number(F.col("sf"))
    lease_end = rent.parse_date(end, F.coalesce("day_first", F.lit(False)))
    unmapped = F.col("building_guessed") & F.coalesce("numbers_rows", F.lit(False))
    return rows.select(
        "file_id", "line_no", "kind", "has_tenant",
        F.when(unmapped, "").otherwise(F.col("building")).alias("building"), unmapped.alias("unmapped"),
        "suite", "tenant", rent.floor_of(F.col("floor"), F.col("suite")).alias("floor"),
        F.when(sf > 0, sf).alias("sf"), (sf < 0).alias("negative"), (sf == 0).alias("zero"),
        lease_end.alias("lease_end"), (rent.has_date_text(end) & lease_end.isNull()).alias("unreadable"),
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
        rent.lease_status(
            rent.is_vacant(F.col("tenant"), F.col("start"), end), end, lease_end, F.coalesce("as_of", F.lit(as_of))
        ).alias("status"),
    )


def suites(parsed: DataFrame) -> DataFrame:
    """The clean table: of repeated suites, the first line that carries an area."""
    order = W.partitionBy("file_id", "building", "suite").orderBy(F.col("sf").isNull(), "line_no")
    return (
        parsed.where("kind = 'suite'")
        .select("file_id", "line_no", "building", "suite", "tenant", "floor", "sf", "lease_end", "status")
        .withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    )


def roll_warnings(parsed: DataFrame) -> DataFrame:
    """Data-quality findings per file, long form, only those that occur."""
    is_suite = F.col("kind") == "suite"
    key = lambda name: F.when(is_suite, F.col(name)).alias(name)
    count = lambda condition, name: F.count_if(condition).alias(name)
    per_suite = parsed.groupBy("file_id", "kind", key("building"), key("suite")).agg(
        F.count("*").alias("lines"),
        count(F.col("negative"), "negative_sf"), count(F.col("zero"), "zero_sf"),
        count(F.col("unreadable"), "unreadable_dates"),
        # Of the line that is kept, as in `suites`.
        (F.min_by("status", F.struct(F.col("sf").isNull(), F.col("line_no"))) != "vacant").cast("long").alias("taken"),
        count(F.col("floor").isNull(), "unknown_floors"),
        F.bool_or("ambiguous").alias("ambiguous"), F.bool_or("unmapped").alias("unmapped"),
        F.bool_or("has_tenant").alias("has_tenant"),
    )
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))
    has_suites = F.count_if(is_suite) > 0
    once = lambda condition: condition.cast("long")
    per_file = per_suite.groupBy("file_id").agg(
        of("summary", F.col("lines")).alias("summary_rows"),
        of("non_suite", F.col("lines")).alias("non_suite_rows"),
        of("suite", F.col("lines") - 1).alias("duplicate_rows"),
        of("suite", F.col("negative_sf")).alias("negative_sf"),
        of("suite", F.col("zero_sf")).alias("zero_sf"),
        of("suite", F.col("unreadable_dates")).alias("unreadable_dates"),
        once(has_suites & F.bool_or("ambiguous")).alias("ambiguous_dates"),
        once(has_suites & ~F.bool_or("has_tenant")).alias("no_tenant_column"),
        once(has_suites & F.bool_or("has_tenant") & (of("suite", F.col("taken")) == 0)).alias("all_vacant"),
        once(has_suites & F.bool_or("unmapped")).alias("building_unmapped"),
        of("suite", F.col("unknown_floors")).alias("unknown_floors"),
        once(of("no_header", F.col("lines")) > 0).alias("no_header"),
    )
    long = F.array(*[F.struct(F.lit(code).alias("code"), F.col(code).alias("n")) for code in WARNINGS])
    return per_file.select("file_id", F.inline(long)).where("n > 0")


def warning_texts(warnings: DataFrame) -> DataFrame:
    """Warnings as readable lines."""
    text = None
    for code, words in WARNINGS.items():
        hit = F.col("code") == code
        text = F.when(hit, words) if text is None else text.when(hit, words)
    counted = ~F.col("code").isin("ambiguous_dates", "no_tenant_column", "all_vacant", "building_unmapped", "no_header")
    return warnings.withColumn("text", F.when(counted, F.concat_ws(" ", "n", text)).otherwise(text))
