"""Visits shown while they grow and closed by a timer."""

from datetime import datetime, timedelta

from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from plumbline.operators.visits import visit_bounds
from plumbline.streaming import visits as V
from plumbline.streaming.runs import append_to

START = datetime(2024, 3, 1, 6)


@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 9), st.integers(1, 5)), max_size=30), st.integers(1, 20), st.integers(0, 30))
def test_merging_in_parts_is_merging_at_once(parts, gap, cut):
    spans = [(first, first + length, size) for first, length, size in parts]
    whole = V.merged(spans, gap)
    assert V.merged([*V.merged(spans[:cut], gap), *spans[cut:]], gap) == whole
    assert all(b[0] - a[1] > gap for a, b in zip(whole, whole[1:]))
    assert sum(s[2] for s in whole) == sum(s[2] for s in spans)


def rows_at(spark, *events):
    return spark.createDataFrame([(d, START + timedelta(minutes=m) if m is not None else None) for d, m in events], "device string, created_at timestamp")


def run(spark, folder, target, checkpoint):
    stream = spark.readStream.schema("device string, created_at timestamp").parquet(folder)
    append_to(V.growing_visits(stream), target, checkpoint).awaitTermination()
    shown = spark.read.parquet(target)
    view = {(r["device"], (r["started_at"] - START).total_seconds() / 60, (r["closes_at"] - START).total_seconds() / 60, r["events"], r["is_closed"])
            for r in V.current_visits(shown).collect()}
    return shown, view


def test_visits_are_open_then_closed(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows_at(spark, ("a", 0), ("a", 20), ("a", 51), ("b", 10), (None, 3), ("c", None)).write.parquet(folder)
    shown, view = run(spark, folder, target, checkpoint)
    assert view == {("a", 0, 50, 2, False), ("a", 51, 81, 1, False), ("b", 10, 40, 1, False)}
    # An older event joins the two visits of a; b goes on.
    rows_at(spark, ("a", 40), ("b", 40)).write.mode("append").parquet(folder)
    shown, view = run(spark, folder, target, checkpoint)
    assert view == {("a", 0, 81, 4, False), ("b", 10, 70, 2, False)}
    # The watermark (one hour behind) reaches the end of b only, by the timer.
    rows_at(spark, ("d", 135)).write.mode("append").parquet(folder)
    shown, view = run(spark, folder, target, checkpoint)
    assert view == {("a", 0, 81, 4, False), ("b", 10, 70, 2, True), ("d", 135, 165, 1, False)}
    # b comes back, and a closes; late rows of a are dropped.
    rows_at(spark, ("b", 150), ("a", 30)).write.mode("append").parquet(folder)
    shown, view = run(spark, folder, target, checkpoint)
    assert view == {("a", 0, 81, 4, True), ("b", 10, 70, 2, True), ("b", 150, 180, 1, False), ("d", 135, 165, 1, False)}
    assert shown.where("is_closed").groupBy("device", "started_at").count().where("count > 1").count() == 0


def test_closed_visits_equal_the_batch_form(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    events = [(f"d{k % 5 if k % 3 else 0}", (k * 7919) % 1_500) for k in range(400)] + [("d0", 700)] * 300
    rows_at(spark, *events).repartition(3).write.parquet(folder)
    run(spark, folder, target, checkpoint)
    rows_at(spark, ("end", 5_000)).write.mode("append").parquet(folder)
    shown, view = run(spark, folder, target, checkpoint)
    want = visit_bounds(rows_at(spark, *events)).withColumn("closes_at", F.col("ended_at") + F.expr("INTERVAL 30 MINUTES"))
    assert {v for v in view if v[0] != "end"} == {
        (r["device"], (r["started_at"] - START).total_seconds() / 60, (r["closes_at"] - START).total_seconds() / 60, r["events"], True)
        for r in want.collect()}
