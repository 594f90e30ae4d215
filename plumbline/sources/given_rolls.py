"""Rent-roll lines made from the `part` table: one roll per brand, five layouts.

`FACTS` is the content of the rolls; the SQL side computes its answers from it,
while the Spark side gets nothing but the text lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import settle
from plumbline.sources.given_tables import given, select_list, spread

# layout 0: csv, building column, ISO dates      1: tabs, month/day/year, lease start, as-of title
# layout 2: csv, day/month/year                  3: tabs, serial dates, a percentage column
# layout 4: csv, quoted tenants, no floor column, month/day/year, as-of title
# Suites are mostly numbers, some long, some names with and without digits; floors are numbers and letters.
FACTS = [
    "p_brand AS file_id",
    "p_partkey AS n",
    "CAST(substr(p_brand, 7) AS INT) % 5 AS layout",
    """CASE WHEN p_partkey % 9 = 0 OR p_brand = 'Brand#21' THEN CAST(p_partkey + 100 AS STRING)
       WHEN p_partkey % 47 = 0 THEN 'Retail ' || CAST(p_partkey AS STRING)
       WHEN p_partkey % 59 = 0 THEN '1200-1210-' || CAST(p_partkey + 10000 AS STRING)
       WHEN p_partkey % 61 = 0 THEN 'Penthouse ' || translate(CAST(p_partkey AS STRING), '0123456789', 'abcdefghij')
       ELSE CAST(p_partkey + 100 AS STRING) END AS suite""",
    """CASE WHEN p_brand = 'Brand#21' THEN '' WHEN p_partkey % 27 = 0 THEN '' WHEN p_partkey % 27 = 9 THEN 'VACANT' WHEN p_partkey % 27 = 18 THEN '*** VACANT ***'
       WHEN p_partkey % 23 = 5 THEN '株式会社' WHEN p_partkey % 23 = 7 THEN 'Ёлка'
       ELSE p_name || ' Co ' || CAST(p_partkey % 50 AS STRING) END AS tenant""",
    "p_partkey % 9 = 0 OR p_brand = 'Brand#21' AS vacant",
    """CASE p_size % 10 WHEN 0 THEN 'B1' WHEN 5 THEN 'P2' WHEN 7 THEN 'LL' WHEN 9 THEN 'G'
       ELSE CAST(p_size AS STRING) END AS level""",
    """CASE WHEN p_brand = 'Brand#25' THEN 'House ' || CAST(p_partkey AS STRING)
       WHEN p_brand = 'Brand#35' THEN 'B-' || CAST(p_partkey AS STRING)
       ELSE 'Tower ' || CAST(p_partkey % 4 AS STRING) END AS tower""",
    """CASE WHEN p_partkey % 41 = 0 THEN -500 WHEN p_partkey % 43 = 0 THEN 0 ELSE CAST(floor(p_retailprice) AS INT) END AS area""",
    """CASE WHEN p_partkey % 9 = 0 OR p_brand = 'Brand#21' THEN 'none' WHEN p_partkey % 17 = 0 THEN 'mtm' WHEN p_partkey % 53 = 0 THEN 'tbd'
       ELSE 'date' END AS ends""",
    "CAST(CASE WHEN p_brand = 'Brand#22' THEN p_partkey % 12 ELSE p_partkey % 3000 END AS INT) AS days",
]

HEADERS = [
    "Building,Suite,Tenant,Floor,RSF,Lease Expiration",
    "Suite\tTenant\tFloor\tRSF\tLease Start\tLease Exp",
    "Suite,Tenant,Floor,RSF,Lease Expiration",
    "Suite\tTenant\tRSF\t% of Bldg\tFloor\tLease Exp",
    'Unit,"Tenant Name",Sq Ft,Expiration Date',
]
FIRST_DAY = "2024-01-01"
# Rolls with something special: dates that read either way, no tenant column, a header nobody knows. Beside these, 21 has no
# tenant in any row and 25 a building of its own for every suite.
AMBIGUOUS, NO_TENANT, NO_HEADER = "Brand#22", "Brand#16", "Brand#24"
# A column that probably means the building, but numbers the rows.
ROW_CODES = "Brand#35"


def facts_sql() -> str:
    return f"SELECT {select_list(FACTS)} FROM part"


def roll_lines(spark: SparkSession, folder: str) -> DataFrame:
    facts = spread(given(spark, folder, "part").selectExpr(*FACTS))
    end = F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("days"))
    serial = F.datediff(end, F.lit("1899-12-30").cast("date")).cast("string")
    layout = F.col("layout")
    dated = (
        F.when(layout == 0, F.date_format(end, "yyyy-MM-dd"))
        .when(layout == 2, F.date_format(end, "dd/MM/yyyy"))
        .when(layout == 3, serial)
        .otherwise(F.date_format(end, "M/d/yyyy"))
    )
    ends = (
        F.when(F.col("ends") == "date", dated).when(F.col("ends") == "mtm", "MTM")
        .when(F.col("ends") == "tbd", "TBD").otherwise(F.when(layout == 1, "-").otherwise(""))
    )
    area, level = F.format_string("%d", "area"), F.col("level")
    csv = lambda *cells: F.concat_ws(",", *cells)
    tab = lambda *cells: F.concat_ws("\t", *cells)
    quoted = F.concat(F.lit('"'), F.col("tenant"), F.when(F.col("vacant"), "").otherwise(", ""The"""), F.lit('"'))
    row = (
        F.when(layout == 0, csv("tower", "suite", "tenant", level, area, ends))
        .when(layout == 1, tab("suite", "tenant", level, F.format_number(F.col("area"), 0),
                               F.when(F.col("vacant"), "-").otherwise("1/1/2020"), ends))
        .when(layout == 2, csv("suite", "tenant", level, area, ends))
        .when(layout == 3, tab("suite", "tenant", area, F.lit("1.5%"), level, ends))
        .otherwise(csv("suite", quoted, area, ends))
    )
    # Lines that are not suites: option repeats, subtotals, and prose.
    first = F.when(layout == 0, F.concat(F.col("tower"), F.lit(","))).otherwise("")
    gap = F.when(layout.isin(1, 3), "\t").otherwise(",")
    extra = F.array_compact(F.array(
        F.struct(F.lit(10).alias("base"), row.alias("line")),
        F.when(F.col("n") % 31 == 0, F.struct(
            F.lit(10_000_000).alias("base"),
            F.concat(first, F.col("suite"), gap, F.lit("One 5-yr option"), gap, gap).alias("line"))),
        F.when(F.col("n") % 29 == 0, F.struct(
            F.lit(20_000_000).alias("base"),
            F.concat(first, F.lit("Floor "), level, F.lit(" Subtotal"), gap, gap, gap).alias("line"))),
        F.when(F.col("n") % 37 == 0, F.struct(
            F.lit(30_000_000).alias("base"),
            F.concat(first, F.lit("Leased SF"), gap, area, gap).alias("line"))),
    ))
    body = facts.select("file_id", "n", F.inline(extra)).select(
        "file_id", (F.col("base") + F.col("n")).cast("long").alias("line_no"), "line"
    )
    titles = F.array(
        F.concat(F.lit("Rent roll of "), F.col("file_id")),
        F.when(layout.isin(1, 4), "As of June 30, 2026").otherwise("Prepared for the owner"),
        F.when(F.col("file_id") == NO_HEADER, "Nr,Mieter,qm")
        .when(F.col("file_id") == NO_TENANT, HEADERS[1].replace("Tenant", "Party"))
        .when(F.col("file_id") == ROW_CODES, HEADERS[0].replace("Building", "Bldg No."))
        .otherwise(F.element_at(F.array(*[F.lit(h) for h in HEADERS]), layout + 1)),
    )
    head = facts.select("file_id", "layout").distinct().select("file_id", F.posexplode(titles).alias("line_no", "line"))
    # Stored once, as files would be: a roll is read several times.
    return settle(head.select("file_id", F.col("line_no").cast("long").alias("line_no"), "line").unionByName(body))
