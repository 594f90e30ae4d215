"""Owner statements: current figures in the line structure of the prior report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed values.
SECTIONS = ("revenue", "expense")
KEY = ["entity", "account"]
MONEY = "decimal(28,2)"


def compile_statement(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Prior lines with current actual, budget and variance; `missing` marks a line without figures."""
    variance = (F.col("actual") - F.col("budget")).cast(MONEY)
    return prior.join(current.select(*KEY, "actual", "budget"), KEY, "left").select(
        "entity", "line_no", "section", "account", "actual", "budget", variance.alias("variance"),
        (F.col("actual").isNull() & F.col("budget").isNull()).alias("missing"),
    )


def new_lines(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Current accounts the prior report has no line for; they need a look."""
    return current.join(prior.select(*KEY), KEY, "left_anti")


def statement_totals(statement: DataFrame) -> DataFrame:
    """Revenue, operating expense and net operating income per entity."""
    def sums(column):
        return [
            F.coalesce(F.sum(F.when(F.col("section") == section, F.col(column))), F.lit(0)).cast(MONEY).alias(f"{section}_{column}")
            for section in SECTIONS
        ]

    wide = statement.groupBy("entity").agg(*sums("actual"), *sums("budget"))
    net = lambda column: (F.col(f"revenue_{column}") - F.col(f"expense_{column}")).cast(MONEY)
    rows = [
        ("Total Revenue", F.col("revenue_actual"), F.col("revenue_budget")),
        ("Total Operating Expenses", F.col("expense_actual"), F.col("expense_budget")),
        ("Net Operating Income", net("actual"), net("budget")),
    ]
    long = F.array(*[
        F.struct(F.lit(name).alias("line"), actual.alias("actual"), budget.alias("budget"))
        for name, actual, budget in rows
    ])
    return wide.select("entity", F.inline(long)).withColumn(
        "variance", (F.col("actual") - F.col("budget")).cast(MONEY)
    )


def sections_present(statement: DataFrame, required=SECTIONS) -> DataFrame:
    """Whether each entity has figures in every required section."""
    filled = [
        F.bool_or((F.col("section") == section) & ~F.col("missing")) for section in required
    ]
    complete = filled[0]
    for test in filled[1:]:
        complete = complete & test
    return statement.groupBy("entity").agg(F.coalesce(complete, F.lit(False)).alias("complete"))
