"""The given test tables read as this library's own tables.

Each mapping is a list of SQL projections that Spark and DuckDB both accept, so
that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(2024, 1, 30, 18, 0, 0)

# Reading `ts` with this layout keeps comparisons on it a scan filter.
GIVEN_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
GIVEN_ORDERS = (
    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
    "o_orderpriority string"
)
GIVEN_LINEITEM = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp"
)
LAYOUTS = {"events": GIVEN_EVENTS, "orders": GIVEN_ORDERS, "lineitem": GIVEN_LINEITEM}


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read
    if name in LAYOUTS:
        reader = reader.schema(LAYOUTS[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where the scan alone gives fewer tasks.

    The given files have one row group each; a table of any size keeps its splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def select_list(columns: list[str]) -> str:
    return ",\n  ".join(columns)


EVENT_COLUMNS = [
    "event_id AS id",
    "ts AS created_at",
    """CASE WHEN user_id % 4 = 0 THEN 'stacking' WHEN user_id % 4 = 1 THEN 'variance'
       WHEN user_id % 4 = 2 THEN 'ledger' WHEN event_id % 2 = 0 THEN '' END AS app""",
    """CASE event_type WHEN 'view' THEN 'app_opened' WHEN 'click' THEN 'Photo_Upload'
       WHEN 'purchase' THEN 'export_success' WHEN 'error' THEN 'export_failed' ELSE 'feedback' END AS event""",
    """CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN ''
       WHEN event_id % 10 = 3 THEN 'unknown' ELSE CAST(user_id AS STRING) END AS session_id""",
    """substr(props, 1, length(props) - 1)
       || CASE WHEN event_id % 50 = 0 THEN ', "internal": true' WHEN event_id % 50 = 7 THEN ', "internal": "true"'
          WHEN event_id % 50 = 11 THEN ', "internal": 1' ELSE '' END
       || CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN ', "reason": "timeout ' || CAST(event_id % 10 AS STRING) || '"'
          WHEN event_type = 'error' AND event_id % 4 = 1 THEN ', "reason": "", "message": "bad input"'
          WHEN event_type = 'error' AND event_id % 4 = 2 THEN ', "code": 502, "online": false, "source": "upload"'
          ELSE '' END
       || CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN ', "feedback_type": "bug", "message": "note ' || CAST(event_id AS STRING) || '"'
          WHEN event_type = 'signup' AND event_id % 3 = 1 THEN ', "feedback_type": "", "version": "1.' || CAST(event_id % 7 AS STRING) || '", "screen": "home"'
          ELSE '' END
       || '}' AS properties""",
    "'/tools/' || event_type AS path",
    """CASE event_id % 6 WHEN 0 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) CriOS/120.0 Safari/604.1'
       WHEN 1 THEN 'Mozilla/5.0 (iPad; CPU OS 17_0 like Mac OS X) Version/17.0 Safari/604.1'
       WHEN 2 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0'
       WHEN 3 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Gecko/20100101 Firefox/121.0'
       WHEN 4 THEN 'curl/8.0' ELSE '' END AS user_agent""",
]

DEVICE_COLUMNS = [
    "CAST(c_custkey AS STRING) AS device_id",
    "CASE WHEN c_custkey % 50 = 0 THEN 'office' END AS note",
]
DEVICE_FILTER = "c_custkey % 25 = 0"

ACTION_COLUMNS = [
    "event_id AS seq",
    "CASE event_type WHEN 'view' THEN 'exclude' WHEN 'click' THEN 'include' WHEN 'error' THEN 'toggle' ELSE 'exclude' END AS action",
    "CASE WHEN event_id % 11 = 0 THEN '   ' ELSE '  ' || CAST(user_id AS STRING) || ' ' END AS device_id",
    "CASE WHEN event_type <> 'purchase' THEN 'seen ' || repeat('x', 190) || CAST(event_id AS STRING) END AS note",
]

CLICK_COLUMNS = [
    "o_orderkey AS click_id",
    "CAST(o_custkey AS STRING) AS browser_id",
    """'https://site.example/signup?utm=mail&ref=' || CASE WHEN o_orderkey % 7 = 0 THEN 'x'
       ELSE (CASE WHEN o_orderkey % 2 = 0 THEN '%20refcde' ELSE 'REFCDE' END)
         || CAST(2 + o_orderkey % 8 AS STRING)
         || CAST(2 + CAST(floor(o_orderkey / 8) AS BIGINT) % 8 AS STRING) END || '#top' AS url""",
    "o_orderdate AS click_ts",
]

SIGNUP_COLUMNS = [
    "CAST(c_custkey AS STRING) AS user_id",
    "CAST(c_custkey AS STRING) AS browser_id",
    "TIMESTAMP '1998-01-01 00:00:00' + (c_custkey % 365) * INTERVAL '1' DAY AS signup_ts",
    "CASE WHEN c_custkey % 13 = 0 THEN ' refcde22 ' END AS explicit_code",
]

# The code of customer n is the n-th of the 64 codes above for n < 64, else one of its own.
PROFILE_COLUMNS = [
    "CAST(c_custkey AS STRING) AS user_id",
    "'  User' || CAST(c_custkey AS STRING) || '@Example.com ' AS email",
    "TIMESTAMP '1997-01-01 00:00:00' AS created_at",
    """CASE WHEN c_custkey < 64 THEN 'REFCDE' || CAST(2 + c_custkey % 8 AS STRING)
         || CAST(2 + CAST(floor(c_custkey / 8) AS BIGINT) AS STRING)
       WHEN c_custkey % 5 = 0 THEN NULL ELSE 'USERZZZ' || CAST(2 + c_custkey % 8 AS STRING) END AS referral_code""",
    "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 64 AS STRING) END AS referred_by",
    "CAST(c_custkey % 8 - 1 AS INT) AS referral_count",
    """CASE c_custkey % 4 WHEN 0 THEN '2024-02-15 00:00:00' WHEN 1 THEN '2023-12-01 00:00:00'
       WHEN 2 THEN 'soon' END AS free_until""",
    "CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' - (c_custkey % 60) * INTERVAL '1' DAY END AS deleted_at",
]


def events(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "events").selectExpr(*EVENT_COLUMNS)


def excluded_devices(spark: SparkSession, folder: str, repeats: bool = False) -> DataFrame:
    """The exclusion list, in which some devices are listed twice."""
    listed = given(spark, folder, "customer").where(DEVICE_FILTER).selectExpr(*DEVICE_COLUMNS)
    return listed.unionAll(listed.where("note is not null")) if repeats else listed


def exclusion_actions(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "events").selectExpr(*ACTION_COLUMNS)


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "orders").selectExpr(*CLICK_COLUMNS)


def signups(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "customer").selectExpr(*SIGNUP_COLUMNS)


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "customer").selectExpr(*PROFILE_COLUMNS)
