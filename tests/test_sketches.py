"""Merged device sketches against exact counts."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from plumbline.operators import sketches as S

SHAPE = "app string, day date, device string"


def test_sketches_merge_over_days_and_loads(spark):
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(5)]
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("app"),
        F.date_add(F.lit(days[0]), (F.col("id") % 5).cast("int")).alias("day"), (F.col("id") * 7919 % 20_011).cast("string").alias("device"))
    one, two = S.device_sketches(rows.where("day < '2024-01-03'")), S.device_sketches(rows.where("day >= '2024-01-02'"))
    both = S.merged_sketches(one, two)
    assert both.count() == 10
    for first, last in ((None, None), (days[1], days[3]), (days[2], days[2])):
        part = rows.where(F.col("day").between(F.lit(first or days[0]), F.lit(last or days[-1])))
        exact = {r["app"]: r["n"] for r in part.rollup("app").agg(F.countDistinct("device").alias("n")).collect()}
        about = {r["app"]: r["devices"] for r in S.approximate_devices(both, first, last).collect()}
        assert set(about) == set(exact) == {"a", "b", None}
        assert all(abs(about[k] - n) <= S.MOST_ERROR * n for k, n in exact.items())


def test_no_rows_and_rows_without_device(spark):
    none = S.device_sketches(spark.createDataFrame([("a", None, "d"), ("a", date(2024, 1, 1), None)], SHAPE))
    assert none.count() == 0 and [tuple(r) for r in S.approximate_devices(none).collect()] == [(None, 0)]
    few = S.device_sketches(spark.createDataFrame([("a", date(2024, 1, 1), str(k % 30)) for k in range(90)], SHAPE))
    assert {r["app"]: r["devices"] for r in S.approximate_devices(few).collect()} == {"a": 30, None: 30}
