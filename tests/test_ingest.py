"""Replay-safe ingest and the correction of closed days by late rows."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.operators import events as ev
from plumbline.schemas import EXCLUDED_DEVICES
from plumbline.sources import device_states
from plumbline.streaming import events as st, ingest as I
from plumbline.streaming.runs import append_to, late_rows

START = datetime(2024, 3, 1, 6)


def text(k, at):
    return json.dumps({"id": k, "created_at": at.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "app": "ab"[k % 2], "event": "app_opened", "session_id": f"d{k % 3}",
                       "properties": {}, "path": "/", "user_agent": ""})


def put(folder, name, texts):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(texts) + "\n")


def stored(spark, path):
    return sorted((r["id"], str(r["event_date"])) for r in I.read_ingested(spark, path).collect())


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "0.txt", [text(k, START + timedelta(hours=5 * k)) for k in range(12)] + ["broken", "{}"])
    paths = [str(tmp_path / name) for name in ("events", "rejects", "counts")]
    checkpoint = str(tmp_path / "checkpoint")
    texts = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))

    # The first try dies after the events and rejects were written, before the batch is done.
    whole = I._replace

    def dying(rows, path, *folders):
        whole(rows, path, *folders)
        if path == paths[1]:
            raise RuntimeError("executor lost")

    monkeypatch.setattr(I, "_replace", dying)
    try:
        I.ingest(texts(), *paths, checkpoint).awaitTermination()
        raise AssertionError("the first try should fail")
    except Exception as error:
        assert "executor lost" in str(error)
    assert len(stored(spark, paths[0])) == 12
    monkeypatch.setattr(I, "_replace", whole)
    I.ingest(texts(), *paths, checkpoint).awaitTermination()
    once = stored(spark, paths[0])
    assert [k for k, _ in once] == list(range(12)) and spark.read.parquet(paths[1]).count() == 2
    put(tmp_path / "in", "1.txt", [text(100, START), "broken again"])
    I.ingest(texts(), *paths, checkpoint).awaitTermination()
    I.ingest(texts(), *paths, checkpoint).awaitTermination()
    assert len(stored(spark, paths[0])) == 13 and spark.read.parquet(paths[1]).count() == 3
    assert sorted(tuple(r) for r in spark.read.parquet(paths[2]).select("batch_id", "events", "rejects").collect()) == [(0, 12, 2), (1, 1, 1)]


def test_late_rows_correct_days_that_a_window_has_closed(spark, tmp_path):
    paths = [str(tmp_path / name) for name in ("events", "rejects", "counts")]
    texts = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    windows = lambda: st.daily_counts(st.parse_events(texts())[0])
    states = str(tmp_path / "states")
    for name, rows in (("0.txt", [(k, START + timedelta(hours=3 * k)) for k in range(30)]), ("1.txt", [(50, START + timedelta(days=9))]),
                       ("2.txt", [(60, START), (61, START + timedelta(hours=1))])):
        put(tmp_path / "in", name, [text(k, at) for k, at in rows])
        I.ingest(texts(), *paths, str(tmp_path / "c1")).awaitTermination()
        query = append_to(windows(), str(tmp_path / "windows"), str(tmp_path / "c2"))
        query.awaitTermination()
        remade, _ = device_states.update_states(spark, paths[0], states)
    assert late_rows(query) == 2 and remade == ["2024-03-01"]
    devices = spark.createDataFrame([], EXCLUDED_DEVICES)
    kept = I.corrected_daily_counts(device_states.marked_states(spark, paths[0], states, devices))
    rows = ev.prepare_events(I.read_ingested(spark, paths[0]), devices)
    want = sorted((r["day"], r["app"], r["n"]) for r in rows.groupBy("day", "app").agg(F.count("*").alias("n")).collect())
    assert sorted((r["day"], r["app"], r["n"]) for r in kept.collect()) == want
    closed = spark.read.parquet(str(tmp_path / "windows")).where("window_start = '2024-03-01'").agg(F.sum("n")).first()[0]
    assert sum(n for day, _, n in want if str(day) == "2024-03-01") == closed + 2
