"""Ledger, budget, statement and utility frames made from line items, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import settle
from plumbline.sources.given_tables import given, select_list, spread

# Amounts are whole cents, computed in integers on both sides. Returned items are credits.
LEDGER_FACTS = [
    "n_name AS entity",
    "CAST(s_nationkey % 3 AS INT) AS layout",
    "p_type AS account",
    "CAST(l_shipdate AS DATE) AS gl_date",
    "substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) AS period",
    """CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS budget_cents""",
    """CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(floor((CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)
       * (100 - CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) * (100 + CAST(floor(l_tax * 100 + 0.5) AS BIGINT)) + 5000) / 10000) AS BIGINT) AS cents""",
    "'INV-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS ref_no",
    "CAST(l_quantity AS INT) AS quantity",
]
# Facts of a line item that need no other table.
EARLY_FACTS = ("budget_cents", "cents", "quantity")
LEDGER_TABLES = (
    "lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN nation ON s_nationkey = n_nationkey"
)
SECTION = "CASE WHEN account IN ('ECONOMY', 'STANDARD', 'MEDIUM') THEN 'revenue' ELSE 'expense' END"


def facts_sql() -> str:
    return f"SELECT {select_list(LEDGER_FACTS)} FROM {LEDGER_TABLES}"


def _facts(spark: SparkSession, folder: str, over_all_cores: bool = False) -> DataFrame:
    """The facts; what a line item alone tells is reckoned before the joins, so that these move whole numbers only."""
    lineitem, part, supplier, nation = (given(spark, folder, t) for t in ("lineitem", "part", "supplier", "nation"))
    # Not after the joins: to count their tasks would run them.
    lineitem = spread(lineitem) if over_all_cores else lineitem
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    early = [fact for fact in LEDGER_FACTS if fact.rsplit(" AS ", 1)[1] in EARLY_FACTS]
    late = [fact.rsplit(" AS ", 1)[1] if fact in early else fact for fact in LEDGER_FACTS]
    items = lineitem.selectExpr("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "CAST(l_shipdate AS DATE) AS l_shipdate", *early)
    return (
        items.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(*late)
    )


def money(cents: str):
    return (F.col(cents).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder).select(
        "entity", "account", "period", "gl_date", "ref_no", money("cents").alias("amount"))


def budget(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder).select("entity", "account", "period", money("budget_cents").alias("amount"))


def statements(spark: SparkSession, folder: str, prior: str, current: str) -> tuple[DataFrame, DataFrame]:
    """Line structure of one period and figures of the next."""
    rows = _facts(spark, folder).where(F.col("period").isin(prior, current)).withColumn("section", F.expr(SECTION))
    lines = (
        rows.where(F.col("period") == prior).select("entity", "section", "account").distinct()
        .withColumn("line_no", F.expr("ascii(account)").cast("int"))
    )
    figures = rows.where(F.col("period") == current).groupBy("entity", "section", "account").agg(
        F.sum(money("cents")).cast("decimal(28,2)").alias("actual"),
        F.sum(money("budget_cents")).cast("decimal(28,2)").alias("budget"),
    )
    return lines, figures


HEADERS = [
    "GLDate,Acct#,AcctDesc,Ent,Amt,RefNo",
    "\ufeffPosting Date;Account Number;Account Name;Property;Amount;Reference",
    "RefNo\tAmount\tDate\tAccount\tEnt\tDescription\tNet",
]


def ledger_lines(spark: SparkSession, folder: str) -> DataFrame:
    """`made_lines`, stored."""
    return settle(made_lines(spark, folder))


def made_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Export lines in three layouts.

    The third has quantities under `Amount` and the amounts under an unknown name.
    """
    facts = _facts(spark, folder, over_all_cores=True).withColumn("amount", money("cents"))
    layout, day = F.col("layout"), F.date_format("gl_date", "MM/dd/yyyy")
    name = F.concat("account", F.lit(" goods"))
    text = (
        F.when(layout == 0, F.concat_ws(
            ",", day, "account", name, "entity", F.concat(F.lit('"'), F.format_number("amount", 2), F.lit('"')), "ref_no"))
        .when(layout == 1, F.concat_ws(
            ";", F.date_format("gl_date", "yyyy-MM-dd"), "account", name, "entity",
            F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(",")), "ref_no"))
        .otherwise(F.concat_ws(
            "\t", "ref_no", F.col("quantity").cast("string"), day, "account", "entity", name,
            F.when(F.col("amount") < 0, F.concat(F.lit("("), F.abs("amount").cast("string"), F.lit(")")))
            .otherwise(F.col("amount").cast("string"))))
    )
    body = facts.select(F.col("entity").alias("file_id"), (F.abs(F.xxhash64("ref_no") % 1_000_000) + 1).alias("line_no"), text.alias("line"))
    head = (
        given(spark, folder, "supplier").join(given(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("file_id"), F.lit(0).cast("long").alias("line_no"),
                F.element_at(F.array(*[F.lit(h) for h in HEADERS]), (F.col("s_nationkey") % 3 + 1).cast("int")).alias("line"))
        .distinct()
    )
    return head.unionByName(body)


def utility_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    part = given(spark, folder, "part")
    tenants = part.selectExpr(
        "p_brand AS building", "p_type AS tenant_type", "CAST(p_retailprice AS DECIMAL(18,2)) AS rsf")
    # The type PROMO has no rate.
    rates = part.where("p_type <> 'PROMO'").selectExpr(
        "p_type AS tenant_type", "CAST(1 + length(p_type) * 0.25 AS DECIMAL(9,4)) AS rate").distinct()
    return tenants, rates
