"""Amounts: parsing, variances, materiality and readable sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Materiality:
    """When a variance is worth a comment; nothing below `floor` ever is.

    The sources of this rule disagree, so the mode is a parameter: `or` flags a
    line past either threshold, `and` only past both.
    """

    mode: str = "or"
    dollars: float = 5_000.0
    pct: float = 0.10
    floor: float = 0.0


# The stated combination: both $15k and 15 %, with a floor of $5k.
STRICT = Materiality("and", 15_000.0, 0.15, 5_000.0)


def parse_amount(text: Column) -> Column:
    """Money cell to decimal(18,2): separators, currency signs, brackets for negatives, decimal commas."""
    negative = text.startswith("(") | text.endswith("-")
    digits = F.rtrim(F.translate(text, "$€£ \u00a0()", ""), F.lit("-"))
    decimal_comma = F.substring(digits, -3, 1) == ","
    plain = F.when(decimal_comma, F.translate(digits, ",.", ".")).otherwise(F.translate(digits, ",", ""))
    return F.concat(F.when(negative, "-").otherwise(""), plain).try_cast("decimal(18,2)")


def variance_pct(variance: Column, budget: Column) -> Column:
    """Share of the budget, null without one."""
    return F.when(budget != 0, variance.cast("double") / F.abs(budget).cast("double"))


def is_material(variance: Column, pct: Column, rule: Materiality) -> Column:
    by_dollars = F.abs(variance) >= F.lit(rule.dollars).cast("decimal(18,2)")
    by_pct = F.coalesce(F.abs(pct) >= rule.pct, variance != 0)
    passed = by_dollars & by_pct if rule.mode == "and" else by_dollars | by_pct
    return passed & (F.abs(variance) >= F.lit(rule.floor).cast("decimal(18,2)"))


def dollars(amount: Column) -> Column:
    """`$7,650`, with cents only where there are some."""
    return F.concat(F.lit("$"), F.regexp_replace(F.format_number(F.abs(amount), 2), r"\.00$", ""))
