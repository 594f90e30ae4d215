"""Rows found by key, and the exclusion list in buckets."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators.exclusions import apply_exclusions
from plumbline.schemas import EVENTS, EXCLUDED_DEVICES, EXCLUSION_ACTIONS
from plumbline.sources import events as src, lookups as L, tables as T

START = datetime(2024, 3, 1)
ROWS = 40_000


@pytest.fixture(scope="module")
def findable(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("findable") / "events")
    spread = F.xxhash64("id")
    rows = spark.range(ROWS).select(
        "id", (F.lit(START) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(spread, F.lit(4 * 86_400)))).alias("created_at"),
        F.lit("a").alias("app"), F.lit("e").alias("event"), F.when(F.col("id") % 50 > 0, F.concat(F.lit("device-"), F.hex(F.xxhash64(F.col("id") % 9_000)))).alias("session_id"),
        F.repeat(F.hex(spread), 4).alias("properties"), F.lit("/").alias("path"), F.lit("").alias("user_agent"))
    L.append_findable(rows, path, row_group_bytes=64 * 1024)
    return path


@pytest.mark.parametrize("column", ["id", "session_id"])
@pytest.mark.parametrize("at_most", [0, 1_000])
def test_rows_of_keys_are_those_of_the_join(spark, findable, column, at_most):
    rows = src.read_events(spark, findable)
    keys = rows.where("id % 6007 = 5").select(column).unionByName(spark.sql(f"SELECT CAST(NULL AS {dict(rows.dtypes)[column]}) AS {column}"))
    keys = keys.unionByName(keys)
    got = L.rows_of_keys(rows, column, keys, at_most)
    assert got.columns == rows.columns
    want = rows.join(keys.distinct(), column, "left_semi")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()) != []
    assert L.rows_of_keys(rows, column, keys.limit(0)).count() == 0


@pytest.mark.parametrize("column, share", [("id", 0.1), ("session_id", 0.5)])
def test_few_keys_read_few_row_groups(spark, findable, column, share):
    rows = src.read_events(spark, findable)
    keys = rows.where("id = 20011").select(column)
    found = L.rows_of_keys(rows.select("id", "session_id"), column, keys)
    assert 0 < L.rows_scanned(found) <= share * ROWS
    assert L.rows_scanned(rows.select("id", "session_id").where("event = 'e'")) == ROWS


def test_absent_devices_read_hardly_anything(spark, findable):
    rows = src.read_events(spark, findable).select("id", "session_id")
    keys = spark.createDataFrame([("device-ABSENT",), ("device-5",)], "session_id string")
    found = L.rows_of_keys(rows, "session_id", keys)
    assert found.count() == 0 and L.rows_scanned(found) <= 0.2 * ROWS


def test_deletion_by_day_of_a_findable_table(spark, findable, tmp_path):
    path = str(tmp_path / "events")
    L.append_findable(src.read_events(spark, findable).select(*EVENTS.fieldNames()), path)
    ids = spark.createDataFrame([(7,), (7,), (20011,), (ROWS + 5,)], "id long")
    days = src.delete_events_by_day(spark, path, ids)
    assert 1 <= len(days) <= 2
    assert src.read_events(spark, path).count() == ROWS - 2
    assert src.delete_events_by_day(spark, path, ids) == []


def stamps(path):
    return {f"{folder}/{name}": os.stat(f"{folder}/{name}").st_mtime_ns
            for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def listed(frame):
    return sorted((r["device_id"], str(r["note"])) for r in frame.collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "list")
    assert T.read_bucketed_exclusions(spark, path).count() == 0
    devices = [(f"d{k}", "n" if k % 3 else None) for k in range(60)]
    first = spark.createDataFrame([(k, "exclude", d, n) for k, (d, n) in enumerate(devices)], EXCLUSION_ACTIONS)
    assert len(T.update_bucketed_exclusions(spark, path, first, buckets=8)) == 8
    assert listed(T.read_bucketed_exclusions(spark, path)) == sorted((d, str(n)) for d, n in devices)
    before = stamps(path)
    actions = spark.createDataFrame([
        (1, "exclude", " d1 ", "x" * 300), (2, "include", "d1", None), (3, "exclude", "d1", "again"),
        (4, "toggle", "d2", None), (5, "exclude", "  ", None), (6, None, "d4", None), (7, "include", None, None)], EXCLUSION_ACTIONS)
    # The stored division holds, whatever is asked for later.
    touched = T.update_bucketed_exclusions(spark, path, actions, buckets=99)
    assert len(touched) == 1
    after = stamps(path)
    kept = {f for f in before if f"bucket_of_8={touched[0]}/" not in f}
    assert kept and all(after[f] == before[f] for f in kept)
    want = apply_exclusions(spark.createDataFrame(devices, EXCLUDED_DEVICES), actions)
    assert listed(T.read_bucketed_exclusions(spark, path)) == listed(want)
    # Run again, as after a failure.
    assert T.update_bucketed_exclusions(spark, path, actions) == touched
    assert listed(T.read_bucketed_exclusions(spark, path)) == listed(want)


def test_emptied_buckets_lose_their_folders(spark, tmp_path):
    path = str(tmp_path / "list")
    actions = lambda what: spark.createDataFrame([(k, what, f"d{k}", None) for k in range(9)], EXCLUSION_ACTIONS)
    T.update_bucketed_exclusions(spark, path, actions("exclude"), buckets=4)
    T.update_bucketed_exclusions(spark, path, actions("include"))
    assert stamps(path) == {} and T.read_bucketed_exclusions(spark, path).count() == 0
    assert T.update_bucketed_exclusions(spark, path, actions("toggle")) == []
