"""Utility cost estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.joins import lookup_join


def utility_cost(tenants: DataFrame, rates: DataFrame) -> DataFrame:
    """Area times the rate of the tenant type, per building; a month is a twelfth of the year."""
    by_type = tenants.groupBy("building", "tenant_type").agg(F.sum("rsf").alias("rsf"))
    priced = lookup_join(by_type, rates, "tenant_type", "building")
    cost = F.sum(F.col("rsf") * F.col("rate"))
    return priced.groupBy("building").agg(
        cost.cast("double").alias("annual_cost"), (cost.cast("double") / 12).alias("monthly_cost"),
        F.sum(F.when(F.col("rate").isNull(), F.col("rsf"))).cast("double").alias("unpriced_rsf"),
    )
