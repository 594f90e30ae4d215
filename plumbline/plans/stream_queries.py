"""Streaming queries, run over the events present and read back.

Windows appear once the watermark (latest event minus one hour) has passed them,
which the SQL side states as a condition on the window's end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.event_queries import base_sql
from plumbline.plans.registry import SQL_DAY, SQL_TIME, register
from plumbline.session import fresh_folder
from plumbline.sources import device_states, given_tables as g
from plumbline.streaming import events as st, ingest as ing, visits
from plumbline.streaming.runs import drained


def _stream(spark, folder):
    return st.stream_events(spark, folder, "events.parquet", g.GIVEN_EVENTS).selectExpr(*g.EVENT_COLUMNS)


def _visible(spark, folder):
    return st.marked(_stream(spark, folder), g.excluded_devices(spark, folder)).where(~F.col("is_internal"))


BASE = base_sql(None) + ", mark AS (SELECT max(created_at) - INTERVAL 1 HOUR AS upto FROM v)\n"

register("stream_daily_counts", lambda s, f: drained(st.daily_counts(_visible(s, f)), "daily"), BASE + f"""
, c AS (SELECT date_trunc('day', created_at)::TIMESTAMP AS w, app, count(*) AS n FROM v GROUP BY 1, 2)
SELECT strftime(w, {SQL_TIME}) AS window_start, strftime(w + INTERVAL 1 DAY, {SQL_TIME}) AS window_end, app, n FROM c, mark
WHERE w + INTERVAL 1 DAY <= upto""")
register("stream_hourly_counts", lambda s, f: drained(st.hourly_counts(_visible(s, f)), "hourly"), BASE + f"""
, c AS (SELECT date_trunc('hour', created_at)::TIMESTAMP AS w, count(*) AS n FROM v GROUP BY 1)
SELECT strftime(w, {SQL_TIME}) AS window_start, strftime(w + INTERVAL 1 HOUR, {SQL_TIME}) AS window_end, n FROM c, mark
WHERE w + INTERVAL 1 HOUR <= upto""")
register("stream_rolling_week", lambda s, f: drained(st.rolling_week(_visible(s, f)), "week"), BASE + f"""
, c AS (SELECT date_trunc('day', created_at)::TIMESTAMP - k * INTERVAL 1 DAY AS w, count(*) AS n FROM v, range(7) t(k) GROUP BY 1)
SELECT strftime(w, {SQL_TIME}) AS window_start, strftime(w + INTERVAL 7 DAY, {SQL_TIME}) AS window_end, n FROM c, mark
WHERE w + INTERVAL 7 DAY <= upto""")
register("stream_visits", lambda s, f: drained(st.visit_sessions(_visible(s, f)), "visits"), BASE + f"""
, s AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY device ORDER BY created_at, id) <= INTERVAL 30 MINUTE
    THEN 0 ELSE 1 END AS starts FROM v WHERE device IS NOT NULL),
k AS (SELECT *, sum(starts) OVER (PARTITION BY device ORDER BY created_at, id) AS visit FROM s),
b AS (SELECT device, min(created_at) AS a, max(created_at) + INTERVAL 30 MINUTE AS z, count(*) AS events FROM k GROUP BY device, visit)
SELECT device, strftime(a, {SQL_TIME}) AS started_at, strftime(z, {SQL_TIME}) AS closes_at, events FROM b, mark WHERE z <= upto""")

register("stream_visits_provisional", lambda s, f: visits.current_visits(drained(visits.growing_visits(_visible(s, f)), "growing")), base_sql(None) + f"""
, d AS (SELECT * FROM v WHERE device IS NOT NULL), mark AS (SELECT max(created_at) - INTERVAL 1 HOUR AS upto FROM d),
s AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY device ORDER BY created_at, id) <= INTERVAL 30 MINUTE
    THEN 0 ELSE 1 END AS starts FROM d),
k AS (SELECT *, sum(starts) OVER (PARTITION BY device ORDER BY created_at, id) AS visit FROM s),
b AS (SELECT device, min(created_at) AS a, max(created_at) + INTERVAL 30 MINUTE AS z, count(*) AS events FROM k GROUP BY device, visit)
SELECT device, strftime(a, {SQL_TIME}) AS started_at, strftime(z, {SQL_TIME}) AS closes_at, events, z <= upto AS is_closed FROM b, mark""")


def _twice(spark, folder):
    return _stream(spark, folder).unionByName(_stream(spark, folder))


register(
    "stream_deduplicated",
    lambda s, f: drained(st.deduplicated(_twice(s, f)).select("id", "event"), "once"),
    base_sql(None) + "SELECT id, event FROM e",
)
register(
    "stream_marked",
    lambda s, f: drained(
        st.marked(_stream(s, f), g.excluded_devices(s, f)).select("id", "app", "is_excluded", "is_internal"), "marked"),
    base_sql(None) + "SELECT id, app, is_excluded, is_internal FROM e",
)


def _as_texts(rows):
    """Events as JSON texts, the error events cut short or without a time."""
    row = F.struct("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
                   "app", "event", "session_id", "properties", "path", "user_agent")
    text = F.to_json(row)
    broken = F.when(F.col("id") % 2 == 0, F.substring(text, 1, 40)).otherwise(
        F.to_json(F.struct("id", "event")))
    return rows.select(F.when(F.col("event") == "export_failed", broken).otherwise(text).alias("value"))


def _texts(spark, folder):
    return _as_texts(_stream(spark, folder))


register(
    "stream_ingest", lambda s, f: drained(st.parse_events(_texts(s, f))[0], "ingest"),
    base_sql(None) + f"""SELECT id, strftime(created_at, {SQL_TIME}) AS created_at, app, event, session_id, properties, path, user_agent
FROM raw WHERE event <> 'export_failed'""",
)
register(
    "stream_ingest_rejects",
    lambda s, f: drained(st.parse_events(_texts(s, f))[1], "rejects").select("value"),
    base_sql(None) + """SELECT CASE WHEN id % 2 = 0
  THEN substr('{"id":' || CAST(id AS STRING) || ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') || '","app"', 1, 40)
  ELSE '{"id":' || CAST(id AS STRING) || ',"event":"export_failed"}' END AS value FROM raw WHERE event = 'export_failed'""",
)


def _ingested(spark, folder):
    """Paths of events, rejects and counts after all texts were stored; the first batch then ran again, as after a failure."""
    paths = [fresh_folder(spark, name) for name in ("events", "rejects", "counts")]
    ing.ingest(_texts(spark, folder), *paths, fresh_folder(spark, "checkpoint")).awaitTermination()
    again = _given_texts(spark, folder)
    ing.store_batch(again, 0, *paths)
    return paths


def _given_texts(spark, folder):
    """The texts of the first batch as a plain frame: the given table is one file, hence one batch."""
    return _as_texts(g.events(spark, folder))


def _late_counts(spark, folder):
    """Daily counts of the stored days, brought up to date after a second load that is late throughout."""
    path, _, _ = _ingested(spark, folder)
    state_path = fresh_folder(spark, "states")
    device_states.update_states(spark, path, state_path)
    ing.store_batch(_as_texts(g.events(spark, folder).where("id % 5 = 0")), 1, path, fresh_folder(spark, "rejects"), fresh_folder(spark, "counts"))
    device_states.update_states(spark, path, state_path)
    states = device_states.marked_states(spark, path, state_path, g.excluded_devices(spark, folder))
    return ing.corrected_daily_counts(states.where("NOT is_internal"))


register(
    "stream_ingest_replayed",
    lambda s, f: ing.read_ingested(s, _ingested(s, f)[0]).select("id", "created_at", "app", "event", "session_id", "properties"),
    base_sql(None) + f"""SELECT id, strftime(created_at, {SQL_TIME}) AS created_at, app, event, session_id, properties
FROM raw WHERE event <> 'export_failed'""",
)
register(
    "stream_ingest_counts", lambda s, f: s.read.parquet(_ingested(s, f)[2]).select("events", "rejects"),
    base_sql(None) + "SELECT count(*) FILTER (WHERE event <> 'export_failed') AS events, count(*) FILTER (WHERE event = 'export_failed') AS rejects FROM raw",
)
register(
    "stream_late_corrected", _late_counts, base_sql(None) + f"""
SELECT strftime(day, {SQL_DAY}) AS day, app, CAST(sum(CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n
FROM v WHERE event <> 'export_failed' GROUP BY 1, 2""",
)
