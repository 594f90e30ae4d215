"""Reading, appending, exporting, rewriting."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import events as ev, ledger
from plumbline.plans.dashboard import Request, dashboard, write_dashboard
from plumbline.operators import apps, overview
from plumbline.schemas import EVENTS, EXCLUDED_DEVICES, EXCLUSION_ACTIONS
from plumbline.sources import events as src, given_tables as g, lines, tables as stored

T = datetime(2024, 3, 1, 23, 59, 59, 5)
ROWS = [
    (1, T, None, 'say "hi", ok', "d1", '{"a": {"b": 1}}', "/x", "line\nbreak"),
    (2, datetime(2024, 3, 2), "app", "feedback", None, None, "", "  padded "),
    (3, datetime(2024, 3, 2), "app", "feedback", "d2", '{"internal": true}', "/y", ""),
]


@pytest.fixture()
def events(spark):
    return spark.createDataFrame(ROWS, EVENTS)


def test_append_and_read_back(spark, events, tmp_path):
    path = str(tmp_path / "events")
    src.append_events(events, path)
    src.append_events(events.withColumn("id", F.col("id") + 10), path)
    back = src.read_events(spark, path)
    assert back.count() == 6 and back.columns == [*EVENTS.fieldNames(), "event_date"]
    assert back.where("event_date = '2024-03-01'").count() == 2
    week = ev.in_range(back, "7d", datetime(2024, 3, 9))
    assert week.count() == 4 and len(week.inputFiles()) > 0


def test_delete_writes_a_new_table(spark, events, tmp_path):
    path, target = str(tmp_path / "old"), str(tmp_path / "new")
    src.append_events(events, path)
    src.delete_events(spark, path, spark.createDataFrame([(3,), (9,)], "id long"), target)
    assert sorted(r["id"] for r in src.read_events(spark, target).collect()) == [1, 2]
    assert src.read_events(spark, path).count() == 3


def test_delete_by_day_touches_only_those_days(spark, events, tmp_path):
    path = str(tmp_path / "days")
    src.append_events(events, path)
    before = {str(p) for p in (tmp_path / "days").glob("*/*.parquet")}
    gone = events.where("id = 1").select(F.to_date("created_at")).first()[0]
    assert src.delete_events_by_day(spark, path, spark.createDataFrame([(1,), (9,)], "id long")) == [gone]
    assert sorted(r["id"] for r in src.read_events(spark, path).collect()) == [2, 3]
    after = {str(p) for p in (tmp_path / "days").glob("*/*.parquet")}
    assert {f for f in before if f"={gone}/" not in f} <= after
    assert src.delete_events_by_day(spark, path, spark.createDataFrame([(7,)], "id long")) == []


def test_internal_tag_keeps_other_properties(events):
    tagged = {r["id"]: r["properties"] for r in src.tag_internal(events, F.col("id") != 2).collect()}
    assert json.loads(tagged[1]) == {"a": {"b": 1}, "internal": True}
    assert tagged[2] is None and json.loads(tagged[3]) == {"internal": True}


def _export(spark, events):
    none = spark.createDataFrame([("d2", None)], EXCLUDED_DEVICES)
    return src.raw_export(ev.scope(events, none, T, "all", include_internal=True).visible_rows)


def test_csv_export_quoting(spark, events, tmp_path):
    path = str(tmp_path / "csv")
    src.export_csv(_export(spark, events).where("id < 3").orderBy("id").coalesce(1), path)
    (part,) = (tmp_path / "csv").glob("*.csv")
    body = part.read_text()
    assert body.startswith("id,created_at,app,event,session_id,path,user_agent,internal,properties\n")
    assert '1,2024-03-01T23:59:59.000005Z,,"say ""hi"", ok",d1,/x,"line\nbreak",false,"{""a"": {""b"": 1}}"\n' in body
    assert "2,2024-03-02T00:00:00.000000Z,app,feedback,,,  padded ,false,\n" in body


def test_json_export_keeps_objects(spark, events, tmp_path):
    path = str(tmp_path / "json")
    src.export_json(_export(spark, events), path)
    rows = [json.loads(line) for part in (tmp_path / "json").glob("*.json") for line in part.read_text().splitlines()]
    by_id = {r["id"]: r for r in rows}
    assert by_id[1]["properties"] == {"a": {"b": 1}} and by_id[2]["properties"] is None
    assert by_id[3]["internal"] is True and set(by_id[1]) == set(src.EXPORT_COLUMNS)


def test_saved_exclusions(spark, tmp_path):
    old, new = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([("a", "n")], EXCLUDED_DEVICES).write.parquet(old)
    actions = spark.createDataFrame([(1, "include", "a", None), (2, "exclude", "b", None)], EXCLUSION_ACTIONS)
    assert [r["device_id"] for r in stored.save_exclusions(spark, old, actions, new).collect()] == ["b"]


def test_line_numbers_rise_over_splits(spark, tmp_path):
    folder = tmp_path / "rolls"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.csv").write_text("\n".join(f"{name}{i:05d}" for i in range(3000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = lines.folder_lines(spark, str(folder))
        assert read.rdd.getNumPartitions() > 4
        rows = read.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name in ("a", "b"):
        own = sorted((r["line_no"], r["line"]) for r in rows if r["file_id"].endswith(f"{name}.csv"))
        assert [line for _, line in own] == [f"{name}{i:05d}" for i in range(3000)]
        assert len({n for n, _ in own}) == 3000


def test_ledger_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text(
        'GLDate,Acct#,AcctDesc,Ent,Amt,RefNo\n03/14/2026,6410,R&M-HVAC,PROP-04,"7,650.00",INV-88213\n'
        '03/22/2026,5220,Janitorial Svc,PROP-04,"-2,400.00",CR-4471\n')
    (tmp_path / "two.csv").write_text(
        "﻿Posting Date;Account;Account Name;Property;Net Amount;Ref\n2026-03-14;6410;R&M;PROP-04;7.650,00;A\n"
        "2026-03-15;6410;R&M;PROP-05;(12,50);B\n")
    got = ledger.normalise_ledger(lines.folder_lines(spark, str(tmp_path))).orderBy("gl_date", "ref_no").collect()
    assert [(str(r["gl_date"]), r["account"], r["entity"], float(r["amount"]), r["ref_no"]) for r in got] == [
        ("2026-03-14", "6410", "PROP-04", 7650.0, "A"), ("2026-03-14", "6410", "PROP-04", 7650.0, "INV-88213"),
        ("2026-03-15", "6410", "PROP-05", -12.5, "B"), ("2026-03-22", "5220", "PROP-04", -2400.0, "CR-4471")]


def test_dashboard_job_agrees_with_single_operators(spark, tables, tmp_path):
    events, excluded = g.events(spark, tables), g.excluded_devices(spark, tables)
    parts = dashboard(events, excluded, Request(g.AS_OF))
    write_dashboard(parts, str(tmp_path / "out"))
    sc = ev.scope(events, excluded, g.AS_OF)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for name, single in {
        "apps": apps.app_stats(sc.visible_rows), "funnel": apps.app_funnel(sc.visible_rows),
        "daily": overview.daily_series(sc.visible_rows, g.AS_OF), "hours": overview.hour_of_day(sc.visible_rows),
        "events_by_name": overview.events_by(sc.visible_rows, "event"), "kpis": overview.overview_kpis(sc),
    }.items():
        assert rows(spark.read.parquet(str(tmp_path / "out" / name))) == rows(single), name
