"""Budget against actual: variances, the ledger lines behind them, and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.money import Materiality, dollars, is_material, variance_pct
from plumbline.operators.joins import lookup_join
from plumbline.session import settle

LINE = ["entity", "account", "period"]
ZERO = "decimal(28,2)"


def _totals(lines: DataFrame, name: str) -> DataFrame:
    return lines.groupBy(*LINE).agg(F.sum("amount").cast(ZERO).alias(name))


def variance_lines(budget: DataFrame, actual: DataFrame, rule: Materiality = Materiality()) -> DataFrame:
    """One line per entity, account and period on either side; the missing side counts as zero.

    Both sides are summed before they meet, so each key occurs once in the join.
    """
    nothing = F.lit(0).cast(ZERO)
    joined = _totals(budget, "budget").join(_totals(actual, "actual"), LINE, "full").select(
        *LINE, F.coalesce("budget", nothing).alias("budget"), F.coalesce("actual", nothing).alias("actual")
    )
    variance = (F.col("actual") - F.col("budget")).cast(ZERO)
    pct = variance_pct(F.col("variance"), F.col("budget"))
    return (
        joined.withColumn("variance", variance).withColumn("variance_pct", pct)
        .withColumn("material", is_material(F.col("variance"), F.col("variance_pct"), rule))
    )


def with_year_to_date(lines: DataFrame) -> DataFrame:
    """Current figures beside the running totals of the year; periods are `yyyy-MM`."""
    so_far = (
        W.partitionBy("entity", "account", F.substring("period", 1, 4)).orderBy("period")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    return lines.withColumns({
        f"ytd_{name}": F.sum(name).over(so_far).cast(ZERO) for name in ("budget", "actual", "variance")
    })


def with_favour(lines: DataFrame, is_revenue) -> DataFrame:
    """Whether a variance helps the result; the sign convention per account type is our own."""
    better = F.when(is_revenue, F.col("variance") > 0).otherwise(F.col("variance") < 0)
    return lines.withColumn("favourable", F.when(F.col("variance") != 0, better))


def largest_variances(lines: DataFrame, n: int) -> DataFrame:
    return lines.where("material").orderBy(F.desc(F.abs("variance")), *LINE).limit(n)


def variance_drivers(lines: DataFrame, ledger: DataFrame, top_k: int = 3) -> DataFrame:
    """The ledger entries with the largest amounts behind each material line."""
    flagged = lines.where("material").select(*LINE, "variance")
    behind = lookup_join(
        ledger.select(*LINE, "gl_date", "ref_no", "amount"), settle(flagged), LINE, "ref_no"
    ).where("variance is not null")
    order = W.partitionBy(*LINE).orderBy(F.desc(F.abs("amount")), "gl_date", "ref_no", "amount")
    return behind.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def narratives(lines: DataFrame, drivers: DataFrame) -> DataFrame:
    """One sentence per material line, the same for the same figures."""
    entry = F.concat(
        F.col("ref_no"), F.lit(" ("), F.when(F.col("amount") < 0, "-").otherwise(""), dollars(F.col("amount")),
        F.lit(" on "), F.date_format("gl_date", "yyyy-MM-dd"), F.lit(")"),
    )
    listed = drivers.groupBy(*LINE).agg(
        F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("entries")
    )
    amount = dollars(F.col("variance"))
    share = F.concat(F.lit(" ("), F.format_number(F.abs("variance_pct") * 100, 0), F.lit("%)"))
    sentence = F.concat(
        F.col("account"), F.lit(" came in "), amount,
        F.when(F.col("variance") > 0, " over budget").otherwise(" under budget"), F.coalesce(share, F.lit("")),
    )
    sources = F.array_join(F.transform("entries", lambda e: e["entry"]), ", ")
    return lines.where("material").join(listed, LINE, "left").select(
        *LINE, F.concat(sentence, F.coalesce(F.concat(F.lit("; largest entries: "), sources), F.lit("")), F.lit(".")).alias("text"),
    )


def variance_report(
    budget: DataFrame, ledger: DataFrame, rule: Materiality = Materiality(), top_k: int = 3,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variances, the entries behind them and sentences; the variances are computed once and stored."""
    lines = settle(variance_lines(budget, ledger, rule))
    drivers = settle(variance_drivers(lines, ledger, top_k))
    return lines, drivers, narratives(lines, drivers)


def markdown_lines(texts: DataFrame) -> DataFrame:
    """Narratives as markdown bullets."""
    return texts.select(F.concat(F.lit("- **"), "entity", F.lit(" · "), "period", F.lit("** "), "text").alias("value"))


def write_markdown(texts: DataFrame, path: str) -> None:
    markdown_lines(texts).write.text(path)
