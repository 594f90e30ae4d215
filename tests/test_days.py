"""Newest rows with an early stop, and states of days kept up to date."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import apps, devices, events as ev
from plumbline.schemas import EVENTS, EXCLUDED_DEVICES
from plumbline.sources import days as D, device_states as S, events as src

START = datetime(2024, 3, 1, 6)
AGENTS = ["Mozilla/5.0 (iPhone) Safari/604", "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0", "", None]
NAMES = ["app_opened", "export_success", "upload_failed", "photo_upload", None]


def row(k, day):
    return (k, START + timedelta(days=day, minutes=37 * (k % 40)), ["a", "b", "", None][k % 4], NAMES[k % 5], [f"d{k % 7}", "", None][k % 3 if k % 9 else 1],
            '{"internal": true}' if k % 11 == 0 else "{}", "/x", AGENTS[k % 4 if k % 3 else 0])


@pytest.fixture()
def stored(spark, tmp_path):
    path = str(tmp_path / "events")
    src.append_events(spark.createDataFrame([row(k, k // 20) for k in range(200)], EVENTS), path)
    return path


def listed(spark):
    return spark.createDataFrame([("d1", None), ("d1", "again"), ("d5", None)], EXCLUDED_DEVICES)


def test_days_are_listed_newest_first(spark, stored, tmp_path):
    found = list(D.day_signatures(spark, stored))
    assert found == sorted(found, reverse=True) and len(found) >= 10
    assert D.day_signatures(spark, str(tmp_path / "none")) == {} and D.read_days(spark, stored, []).count() == 0


@pytest.mark.parametrize("cap", [1, 20, 33, 500])
def test_newest_rows_of_few_days(spark, stored, cap):
    got = D.newest_stored(spark, stored, cap)
    want = ev.newest(src.read_events(spark, stored), cap)
    assert [r["id"] for r in got.orderBy(F.desc("created_at"), F.desc("id")).collect()] == [
        r["id"] for r in want.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    read = {f.split("event_date=")[1][:10] for f in got.inputFiles()}
    assert len(read) <= {1: 1, 20: 3, 33: 3, 500: 99}[cap]


def test_newest_rows_with_ties_bounds_and_filters(spark, tmp_path):
    path = str(tmp_path / "ties")
    rows = [(k, START + timedelta(days=k // 4), "a", "e", "s", "{}", "/", "") for k in range(16)]
    src.append_events(spark.createDataFrame(rows, EVENTS), path)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(D.newest_stored(spark, path, 6)) == [10, 11, 12, 13, 14, 15]
    assert ids(D.newest_stored(spark, path, 99, start=START + timedelta(days=2, seconds=1))) == [12, 13, 14, 15]
    assert ids(D.newest_stored(spark, path, 3, keep=lambda df: df.where("id % 4 = 0"))) == [4, 8, 12]


def check(spark, path, state_path, start=None):
    rows = src.read_events(spark, path)
    if start is not None:
        rows = rows.where(F.col("created_at") >= F.lit(start))
    rows = ev.prepare_events(rows, listed(spark))
    states = S.marked_states(spark, path, state_path, listed(spark), start)
    same = lambda a, b: sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))
    assert same(devices.table_of(states), devices.device_table(rows))
    visible, seen = states.where("NOT is_internal"), rows.where("NOT is_internal")
    assert same(apps.stats_of(S.per_device(visible)), apps.app_stats(seen))
    assert same(devices.platforms_of(visible), devices.devices_by_platform(seen))


def test_states_follow_appends_late_rows_and_deletions(spark, stored, tmp_path):
    states = str(tmp_path / "states")
    remade, dropped = S.update_states(spark, stored, states)
    assert len(remade) == len(D.day_signatures(spark, stored)) and dropped == []
    assert S.update_states(spark, stored, states) == ([], [])
    check(spark, stored, states)
    # A new day and a late row.
    src.append_events(spark.createDataFrame([row(900, 30), row(901, 2)], EVENTS), stored)
    remade, dropped = S.update_states(spark, stored, states)
    assert len(remade) == 2 and dropped == []
    check(spark, stored, states)
    check(spark, stored, states, START + timedelta(days=3, hours=5))
    # One row of a day goes, and all of another.
    gone = src.delete_events_by_day(spark, stored, spark.createDataFrame([(900,), (25,)], "id long"))
    remade, dropped = S.update_states(spark, stored, states)
    assert len(gone) == 2 and len(remade) == 1 and len(dropped) == 1
    check(spark, stored, states)
