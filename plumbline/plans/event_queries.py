"""Queries over the product events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.functions.text import html_escaped
from plumbline.operators import apps, devices, events as ev, exclusions, feeds, overview, sketches, visits
from plumbline.plans import presentation
from plumbline.plans.dashboard import Request, dashboard
from plumbline.plans.registry import ORACLES, SQL_DAY, SQL_TIME, register
from plumbline.sources import device_states, given_tables as g
from plumbline.sources.days import newest_stored
from plumbline.sources.lookups import append_findable, rows_of_keys
from plumbline.sources.paged import read_paged_events, write_pages
from plumbline.session import fresh_folder, settle
from plumbline.sources.events import append_events, delete_events_by_day, export_csv, export_json, raw_export, read_events, tag_internal
from plumbline.sources.tables import read_bucketed_exclusions, update_bucketed_exclusions

AS_OF = g.AS_OF


def _scope(spark, folder, **options):
    options.setdefault("as_of", AS_OF)
    return ev.scope(g.events(spark, folder), g.excluded_devices(spark, folder, repeats=True), **options)


def visible(build, **options):
    return lambda spark, folder: build(_scope(spark, folder, **options).visible_rows)


def scoped(build, **options):
    return lambda spark, folder: build(_scope(spark, folder, **options))


def base_sql(range_days: int | None = 30, app: str | None = None, internal: bool = False, as_of=AS_OF) -> str:
    """Common tables: e = all rows in range, a = app rows, v = visible rows."""
    bound = "" if range_days is None else f"WHERE created_at >= TIMESTAMP '{as_of - timedelta(days=range_days)}'"
    app_filter = "" if app is None else f"WHERE app = '{app}'"
    hide = "" if internal else "WHERE NOT is_internal"
    return f"""WITH raw AS (SELECT {g.select_list(g.EVENT_COLUMNS)} FROM events),
dev AS (SELECT {g.select_list(g.DEVICE_COLUMNS)} FROM customer WHERE {g.DEVICE_FILTER}),
marked AS (
  SELECT id, created_at, app AS raw_app, coalesce(nullif(app, ''), 'unknown') AS app, event, session_id,
    nullif(session_id, '') AS device, properties, path, user_agent, CAST(created_at AS DATE) AS day,
    CAST(extract(hour FROM created_at) AS BIGINT) AS hour,
    coalesce(json_extract_string(properties, '$.internal') = 'true', false) AS self_tag,
    coalesce(session_id IN (SELECT device_id FROM dev), false) AS is_excluded,
    lower(coalesce(event, '')) AS ev
  FROM raw {bound}),
e AS (
  SELECT *, is_excluded OR self_tag AS is_internal,
    (contains(ev, 'error') OR contains(ev, 'fail')) AS is_error,
    (contains(ev, 'success') OR contains(ev, 'export') OR contains(ev, 'complete')) AS reached,
    CASE WHEN regexp_matches(user_agent, 'iPhone', 'i') THEN 'iPhone' WHEN regexp_matches(user_agent, 'iPad', 'i') THEN 'iPad'
      WHEN regexp_matches(user_agent, 'Android', 'i') THEN 'Android'
      WHEN regexp_matches(user_agent, 'Macintosh|Mac OS X', 'i') THEN 'Mac'
      WHEN regexp_matches(user_agent, 'Windows', 'i') THEN 'Windows'
      WHEN user_agent <> '' THEN 'Other' ELSE 'Unknown' END AS platform,
    CASE WHEN regexp_matches(user_agent, 'Edg/', 'i') THEN 'Edge' WHEN regexp_matches(user_agent, 'CriOS|Chrome/', 'i') THEN 'Chrome'
      WHEN regexp_matches(user_agent, 'FxiOS|Firefox/', 'i') THEN 'Firefox'
      WHEN regexp_matches(user_agent, 'Safari/', 'i') THEN 'Safari' ELSE '' END AS browser
  FROM marked),
a AS (SELECT * FROM e {app_filter}),
v AS (SELECT * FROM a {hide})
"""


BASE = base_sql()

APP_STATS = """SELECT app, count(*) AS total_events,
  count(DISTINCT CASE WHEN ev = 'app_opened' THEN device END) AS total_sessions,
  count(*) FILTER (WHERE reached AND NOT is_error) AS success_count,
  count(*) FILTER (WHERE is_error) AS error_count,
  CASE WHEN count(*) FILTER (WHERE reached OR is_error) > 0 THEN
    floor(count(*) FILTER (WHERE reached AND NOT is_error) * 1.0::DOUBLE / count(*) FILTER (WHERE reached OR is_error) * 1000 + 0.5) / 10 END AS success_rate
FROM v GROUP BY app"""

register("app_stats", visible(apps.app_stats), BASE + APP_STATS)
register(
    "app_stats_7d_with_internal", visible(apps.app_stats, range_name="7d", include_internal=True),
    base_sql(7, internal=True) + APP_STATS,
)
register(
    "app_stats_all_time", visible(apps.app_stats, range_name="5d"), base_sql(None) + APP_STATS,
)

FUNNEL = """, c AS (
  SELECT app, count(DISTINCT CASE WHEN ev = 'app_opened' THEN device END) AS n1,
    count(DISTINCT CASE WHEN contains(ev, 'upload') OR contains(ev, 'photo') THEN device END) AS n2,
    count(DISTINCT CASE WHEN reached THEN device END) AS n3 FROM v GROUP BY app),
l AS (SELECT app, n1 AS base, CAST(1 AS BIGINT) AS step_no, 'opened' AS step, 'Opened' AS label, n1 AS n FROM c
  UNION ALL SELECT app, n1, 2, 'uploaded', 'Uploaded', n2 FROM c
  UNION ALL SELECT app, n1, 3, 'success', 'Success / Export', n3 FROM c)
SELECT app, step_no, step, label, n,
  CASE WHEN base > 0 THEN floor((1 - n / base::DOUBLE) * 1000 + 0.5) / 10 ELSE 0 END AS dropoff_pct FROM l"""
register("app_funnel", visible(apps.app_funnel), BASE + FUNNEL)

register("app_event_counts", visible(apps.app_event_counts), BASE + "SELECT app, event, count(*) AS n FROM v GROUP BY app, event")
register("app_event_counts_top10", visible(lambda v: apps.app_event_counts(v, 10)), BASE + """SELECT * FROM (
  SELECT app, event, n, row_number() OVER (PARTITION BY app ORDER BY n DESC, event) AS rank
  FROM (SELECT app, event, count(*) AS n FROM v GROUP BY app, event)) WHERE rank <= 10""")
register("apps_by_total", visible(apps.ranked_apps), BASE + "SELECT app, count(*) AS n FROM v GROUP BY app")

ERRORS = """, top AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY created_at DESC, id DESC) AS rank FROM v WHERE is_error),
f AS (SELECT app, rank, created_at, event, json_extract_string(properties, '$.reason') AS reason,
  json_extract_string(properties, '$.message') AS message, json_extract_string(properties, '$.code') AS code,
  json_extract_string(properties, '$.source') AS source, json_extract_string(properties, '$.online') AS online
  FROM top WHERE rank <= 10)
"""
RECENT_ERRORS = ERRORS + f"""SELECT app, rank,
  coalesce(nullif(reason, ''), nullif(message, ''), event) AS reason,
  CASE WHEN code IS NOT NULL THEN '{{"code":"' || code || '","online":"' || online || '","source":"' || source || '"}}' END AS detail,
  strftime(created_at, {SQL_TIME}) AS time FROM f"""
register("recent_errors_top10", visible(feeds.recent_errors), BASE + RECENT_ERRORS)
register(
    "recent_errors_readable", visible(lambda v: feeds.readable_errors(feeds.recent_errors(v))),
    BASE + ERRORS + f"""SELECT app, rank, coalesce(nullif(reason, ''), nullif(message, ''), event) AS reason,
  CASE WHEN code IS NOT NULL THEN code || ' · from:' || source || CASE WHEN online = 'false' THEN ' · offline' ELSE '' END ELSE '—' END AS detail,
  strftime(created_at, {SQL_TIME}) AS time FROM f""",
)

SPINE = """, b AS (SELECT min(day) AS first_day, greatest(min(day), DATE '{today}') AS last_day FROM v),
spine AS (SELECT CAST(unnest(generate_series(first_day::TIMESTAMP, last_day::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
dense AS (SELECT s.day, p.app, count(v.id) AS n FROM spine s CROSS JOIN (SELECT DISTINCT app FROM v) p
  LEFT JOIN v ON v.day = s.day AND v.app = p.app GROUP BY s.day, p.app)
"""
EARLIER = datetime(2024, 1, 20, 12)
register(
    "daily_series", scoped(lambda sc: overview.daily_series(sc.visible_rows, sc.as_of)),
    BASE + SPINE.format(today=AS_OF.date()) + f"SELECT strftime(day, {SQL_DAY}) AS day, app, n FROM dense",
)
register(
    "daily_series_with_future_events",
    scoped(lambda sc: overview.daily_series(sc.visible_rows, sc.as_of), as_of=EARLIER),
    base_sql(as_of=EARLIER) + SPINE.format(today=EARLIER.date())
    + f"SELECT strftime(day, {SQL_DAY}) AS day, app, n FROM dense",
)
register(
    "daily_totals", scoped(lambda sc: overview.total_series(overview.daily_series(sc.visible_rows, sc.as_of))),
    BASE + SPINE.format(today=AS_OF.date())
    + f"SELECT strftime(day, {SQL_DAY}) AS day, CAST(sum(n) AS BIGINT) AS n FROM dense GROUP BY day",
)
register(
    "events_per_day", visible(overview.daily_totals),
    BASE + f"SELECT strftime(day, {SQL_DAY}) AS day, count(*) AS n FROM v GROUP BY day",
)
register("event_cube", visible(overview.event_cube), BASE + f"""SELECT app, event, strftime(day, {SQL_DAY}) AS day, hour, count(*) AS n
FROM v GROUP BY app, event, day, hour""")
register("events_by_app", visible(lambda v: overview.events_by(v, "app")), BASE + "SELECT app, count(*) AS n FROM v GROUP BY app")
register(
    "events_by_name_top12", visible(lambda v: overview.events_by(v, "event", 12)),
    BASE + "SELECT event, count(*) AS n FROM v GROUP BY event ORDER BY n DESC, event LIMIT 12",
)
register(
    "events_by_name_bars", visible(lambda v: overview.bar_widths(overview.events_by(v, "event"), "event")),
    BASE + """SELECT event, n, n * 100 / max(n) OVER ()::DOUBLE AS width_pct
FROM (SELECT event, count(*) AS n FROM v GROUP BY event)""",
)
register("hour_of_day", visible(overview.hour_of_day), BASE + """SELECT CAST(h AS BIGINT) AS hour, count(v.id) AS n
FROM range(24) t(h) LEFT JOIN v ON v.hour = t.h GROUP BY h""")

KPIS = """, gaps AS (SELECT device, created_at - lag(created_at) OVER (PARTITION BY device ORDER BY created_at, id) AS idle
  FROM v WHERE device IS NOT NULL)
SELECT (SELECT count(*) FROM v) AS row_count,
  (SELECT count(*) FROM a) - (SELECT count(*) FROM v) AS hidden_internal_events,
  {truncated} AS truncated,
  (SELECT count(DISTINCT device) FROM v) AS unique_devices,
  (SELECT count(*) FROM gaps WHERE idle IS NULL OR idle > INTERVAL 30 MINUTE) AS visits,
  (SELECT count(*) FROM v WHERE day = DATE '{today}') AS events_today,
  (SELECT count(*) FROM v WHERE day BETWEEN DATE '{today}' - 6 AND DATE '{today}') AS events_this_week,
  (SELECT count(DISTINCT day) FROM v) AS active_days"""
register("overview_kpis", scoped(overview.overview_kpis), BASE + KPIS.format(today=AS_OF.date(), truncated="false"))
register(
    "overview_kpis_one_app", scoped(overview.overview_kpis, app="ledger", range_name="7d", as_of=EARLIER),
    base_sql(7, "ledger", as_of=EARLIER) + KPIS.format(today=EARLIER.date(), truncated="false"),
)
register(
    "overview_kpis_with_internal", scoped(overview.overview_kpis, include_internal=True, range_name="all"),
    base_sql(None, internal=True) + KPIS.format(today=AS_OF.date(), truncated="false"),
)

VISITS = """, s AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY device ORDER BY created_at, id) <= INTERVAL 30 MINUTE
    THEN 0 ELSE 1 END AS starts FROM v WHERE device IS NOT NULL),
n AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY device ORDER BY created_at, id) AS BIGINT) AS visit_no FROM s)
"""
VISITS_BY_DEVICE = BASE + VISITS + "SELECT device, CAST(sum(starts) AS BIGINT) AS visits FROM s GROUP BY device"
register("visits_by_device", visible(visits.visits), VISITS_BY_DEVICE)
register(
    "visits_session_window",
    visible(lambda v: v.where("device is not null")
            .groupBy("device", F.session_window("created_at", "30 minutes")).agg(F.count("*").alias("n"))
            .groupBy("device").agg(F.count("*").alias("visits"))),
    VISITS_BY_DEVICE,
)
register("visit_bounds", visible(visits.visit_bounds), BASE + VISITS + f"""SELECT device, visit_no,
  strftime(min(created_at), {SQL_TIME}) AS started_at, strftime(max(created_at), {SQL_TIME}) AS ended_at, count(*) AS events
FROM n GROUP BY device, visit_no""")
register(
    "visit_events", visible(lambda v: visits.visit_events(v).select("id", "device", "visit_no")),
    BASE + VISITS + "SELECT v.id, v.device, n.visit_no FROM v LEFT JOIN n ON n.id = v.id",
)

PLATFORMS = """SELECT platform, count(*) AS n FROM (
  SELECT device, arg_max(platform, (created_at, platform)) AS platform FROM v WHERE device IS NOT NULL GROUP BY device) GROUP BY platform"""
register("devices_by_platform", visible(devices.devices_by_platform), BASE + PLATFORMS)
DEVICE_TABLE = f"""SELECT device AS device_id, arg_max(platform, (created_at, platform, browser)) AS platform, arg_max(browser, (created_at, platform, browser)) AS browser,
  string_agg(DISTINCT app, ',' ORDER BY app) AS apps, count(*) AS events, strftime(max(created_at), {SQL_TIME}) AS last_seen,
  bool_or(self_tag) AS flagged, bool_or(is_excluded) AS internal FROM e WHERE device IS NOT NULL GROUP BY device"""
register("device_table", scoped(lambda sc: devices.device_table(sc.all_rows)), BASE + DEVICE_TABLE)
register(
    "latest_devices_top25", scoped(lambda sc: devices.latest_devices(devices.device_table(sc.all_rows), 25)),
    BASE + f"SELECT * FROM ({DEVICE_TABLE}) ORDER BY last_seen DESC, device_id LIMIT 25",
)

RECENT_EVENTS = f"""SELECT id, strftime(created_at, {SQL_TIME}) AS time, app, event,
  substr(device, 1, 8) AS device FROM v ORDER BY created_at DESC, id DESC LIMIT 60"""
register("recent_events", visible(feeds.recent_events), BASE + RECENT_EVENTS)
FEEDBACK = f"""SELECT id, strftime(created_at, {SQL_TIME}) AS time, app,
  substr(coalesce(nullif(json_extract_string(properties, '$.feedback_type'), ''), 'other'), 1, 32) AS feedback_type,
  substr(coalesce(json_extract_string(properties, '$.message'), ''), 1, 2000) AS message,
  substr(json_extract_string(properties, '$.version'), 1, 64) AS version,
  substr(json_extract_string(properties, '$.commit'), 1, 64) AS commit,
  substr(json_extract_string(properties, '$.screen'), 1, 64) AS screen, is_internal AS internal
FROM a WHERE event = 'feedback' ORDER BY created_at DESC, id DESC LIMIT 200"""
register("feedback_html", scoped(lambda sc: feeds.feedback_feed(sc.app_rows).select("id", html_escaped(F.col("message")).alias("html"))), BASE + f"""
SELECT id, replace(replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM ({FEEDBACK})""")
register("feedback_feed", scoped(lambda sc: feeds.feedback_feed(sc.app_rows)), BASE + FEEDBACK)

register("all_apps", scoped(lambda sc: ev.all_apps(sc.all_rows), app="ledger"), BASE + "SELECT DISTINCT app FROM e")
register(
    "all_apps_with_selection", scoped(lambda sc: ev.all_apps(sc.all_rows, "retired-app")),
    BASE + "SELECT DISTINCT app FROM e UNION SELECT 'retired-app'",
)
register(
    "hidden_internal", scoped(ev.hidden_internal),
    BASE + "SELECT count(*) AS hidden_internal_events FROM a WHERE is_internal",
)
_ROW = ["id", "app", "event", "session_id"]
register(
    "hidden_internal_semi",
    lambda s, f: ev.excluded_traffic(g.events(s, f), g.excluded_devices(s, f, repeats=True)).select(*_ROW),
    base_sql(None) + "SELECT id, app, event, session_id FROM e WHERE is_excluded",
)
register(
    "visible_anti", lambda s, f: ev.visible_traffic(g.events(s, f), g.excluded_devices(s, f, repeats=True)).select(*_ROW),
    base_sql(None) + "SELECT id, app, event, session_id FROM e WHERE NOT is_internal",
)
# A cap that leaves rows out of every given table but the smallest.
CAP = 1_000
register("event_scan_newest_capped", scoped(lambda sc: sc.all_rows.select(*_ROW), cap=CAP, range_name="all"), base_sql(None) + f"""
SELECT id, app, event, session_id FROM e ORDER BY created_at DESC, id DESC LIMIT {CAP}""")
register(
    "overview_kpis_capped", scoped(overview.overview_kpis, range_name="all", cap=CAP),
    base_sql(None).replace("FROM raw ", f"FROM (SELECT * FROM raw ORDER BY created_at DESC, id DESC LIMIT {CAP}) ")
    + KPIS.format(today=AS_OF.date(), truncated=f"(SELECT count(*) FROM e) >= {CAP}"),
)
register("raw_export", visible(raw_export), BASE + f"""SELECT id, strftime(created_at, {SQL_TIME}) AS created_at, raw_app AS app, event,
  session_id, path, user_agent, is_internal AS internal, properties FROM v""")


def _read_back_csv(spark, folder):
    path = fresh_folder(spark, "export-csv")
    export = raw_export(_scope(spark, folder).visible_rows)
    export_csv(export, path)
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("emptyValue", "").csv(path)
    return back.select(
        F.col("id").cast("long").alias("id"), F.to_timestamp("created_at").alias("created_at"), "app", "event", "user_agent",
        F.col("internal").cast("boolean").alias("internal"), "properties")


def _read_back_json(spark, folder):
    path = fresh_folder(spark, "export-json")
    export_json(raw_export(_scope(spark, folder).visible_rows), path)
    back = spark.read.schema("id long, created_at timestamp, app string, event string, internal boolean, properties string").json(path)
    # The properties are an object in the file.
    return back.withColumn("value", F.get_json_object("properties", "$.internal")).drop("properties")


def _read_back_append(spark, folder):
    path = fresh_folder(spark, "appended")
    append_events(tag_internal(g.events(spark, folder), F.col("session_id") == "unknown"), path)
    return read_events(spark, path).select("id", "created_at", "session_id", F.get_json_object("properties", "$.internal").alias("internal"))


register("export_csv_read_back", _read_back_csv, BASE + f"""SELECT id, strftime(created_at, {SQL_TIME}) AS created_at, nullif(raw_app, '') AS app, event,
  nullif(user_agent, '') AS user_agent, is_internal AS internal, properties FROM v""")
register("export_json_read_back", _read_back_json, BASE + f"""SELECT id, strftime(created_at, {SQL_TIME}) AS created_at, raw_app AS app, event,
  is_internal AS internal, json_extract_string(properties, '$.internal') AS value FROM v""")
register("append_read_back", _read_back_append, base_sql(None) + f"""SELECT id, strftime(created_at, {SQL_TIME}) AS created_at, session_id,
  CASE WHEN session_id = 'unknown' THEN 'true' ELSE json_extract_string(properties, '$.internal') END AS internal FROM raw""")


def _stored(spark, folder):
    """The given events as a stored table, appended in two loads, the second with late rows."""
    path = fresh_folder(spark, "stored")
    rows = g.events(spark, folder)
    append_events(rows.where("id % 3 > 0"), path)
    return path, rows.where("id % 3 = 0")


def _newest_early(spark, folder):
    path, late = _stored(spark, folder)
    append_events(late, path)
    return newest_stored(spark, path, CAP).select("id", "app", "event", "session_id")


def _recent_early(spark, folder):
    path, late = _stored(spark, folder)
    append_events(late, path)
    devices_ = g.excluded_devices(spark, folder, repeats=True)
    visible_ = lambda rows: ev.visible_traffic(rows, devices_)
    return feeds.recent_events(newest_stored(spark, path, feeds.RECENT_SIZE, ev.since("30d", AS_OF), visible_))


def _kept_states(spark, folder):
    """States made after the first load and brought up to date after the second, which has late rows."""
    path, late = _stored(spark, folder)
    state_path = fresh_folder(spark, "states")
    device_states.update_states(spark, path, state_path)
    append_events(late.where("id % 2 = 0"), path)
    append_events(late.where("id % 2 = 1"), path)
    device_states.update_states(spark, path, state_path)
    return device_states.marked_states(spark, path, state_path, g.excluded_devices(spark, folder, repeats=True), ev.since("30d", AS_OF))


def _approximate(spark, folder):
    """Devices from the sketches of two loads beside the exact numbers, and whether the error is in its bound."""
    rows = _scope(spark, folder).visible_rows
    loads = [settle(sketches.device_sketches(rows.where(part))) for part in ("id % 3 > 0", "id % 3 = 0 OR id % 7 = 0")]
    about = sketches.approximate_devices(sketches.merged_sketches(*loads))
    exact = rows.where("device IS NOT NULL").rollup("app").agg(F.countDistinct("device").alias("exact"))
    near = F.abs(F.col("devices") - F.col("exact")) <= F.ceil(sketches.MOST_ERROR * F.col("exact"))
    joined = about.withColumnRenamed("app", "a").join(exact, F.col("a").eqNullSafe(F.col("app")))
    return joined.select("app", "exact", near.alias("in_bound"))


def _paged(spark, folder):
    path = fresh_folder(spark, "pages")
    write_pages(g.events(spark, folder), path, range_keys=20_000)
    return ev.in_range(read_paged_events(spark, path), "30d", AS_OF).select(*_ROW, "properties")


register("devices_approximate", _approximate, BASE + """SELECT app, count(DISTINCT device) AS exact, true AS in_bound FROM v
WHERE device IS NOT NULL GROUP BY ROLLUP (app)""")
register("event_scan_paged", _paged, BASE + "SELECT id, raw_app AS app, event, session_id, properties FROM e")
register("event_scan_newest_early_stop", _newest_early, base_sql(None) + f"""
SELECT id, app, event, session_id FROM raw ORDER BY created_at DESC, id DESC LIMIT {CAP}""")
register("recent_events_early_stop", _recent_early, BASE + RECENT_EVENTS)
register("device_table_kept", lambda s, f: devices.table_of(_kept_states(s, f)), BASE + DEVICE_TABLE)
register(
    "app_stats_kept", lambda s, f: apps.stats_of(device_states.per_device(_kept_states(s, f).where("NOT is_internal"))),
    ORACLES["app_stats"])
register(
    "app_funnel_kept", lambda s, f: apps.funnel_of(device_states.per_device(_kept_states(s, f).where("NOT is_internal"))),
    ORACLES["app_funnel"])
register(
    "devices_by_platform_kept", lambda s, f: devices.platforms_of(_kept_states(s, f).where("NOT is_internal")),
    ORACLES["devices_by_platform"])

ACTIONS = f"""WITH dev AS (SELECT {g.select_list(g.DEVICE_COLUMNS)} FROM customer WHERE {g.DEVICE_FILTER}),
act AS (SELECT {g.select_list(g.ACTION_COLUMNS)} FROM events),
ok AS (SELECT seq, action, trim(device_id) AS device_id, substr(note, 1, 200) AS note FROM act
  WHERE trim(device_id) <> '' AND action IN ('exclude', 'include')),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seq DESC) AS k FROM ok) WHERE k = 1)
"""
register(
    "exclusion_upsert",
    lambda s, f: exclusions.apply_exclusions(g.excluded_devices(s, f), g.exclusion_actions(s, f)),
    ACTIONS + """SELECT device_id, note FROM last WHERE action = 'exclude'
UNION ALL SELECT device_id, note FROM dev WHERE device_id NOT IN (SELECT device_id FROM last)""",
)


def _bucketed(spark, folder):
    """The list in buckets after the older and then the newer half of the actions."""
    path = fresh_folder(spark, "exclusions")
    actions = g.exclusion_actions(spark, folder)
    half = actions.agg(F.max("seq")).first()[0] // 2
    listed = g.excluded_devices(spark, folder).select(
        F.lit(0).cast("long").alias("seq"), F.lit("exclude").alias("action"), "device_id", "note")
    update_bucketed_exclusions(spark, path, listed, buckets=16)
    update_bucketed_exclusions(spark, path, actions.where(F.col("seq") <= half))
    update_bucketed_exclusions(spark, path, actions.where(F.col("seq") > half))
    return read_bucketed_exclusions(spark, path)


register("exclusion_upsert_bucketed", _bucketed, ORACLES["exclusion_upsert"])
register(
    "exclusion_rejects", lambda s, f: exclusions.split_actions(g.exclusion_actions(s, f))[1],
    ACTIONS + """SELECT * FROM act WHERE trim(device_id) = '' OR action NOT IN ('exclude', 'include')""",
)
register(
    "exclusion_delete",
    lambda s, f: exclusions.without_devices(
        g.excluded_devices(s, f),
        exclusions.split_actions(g.exclusion_actions(s, f))[0].where("action = 'include'")),
    ACTIONS + "SELECT device_id, note FROM dev WHERE device_id NOT IN (SELECT device_id FROM ok WHERE action = 'include')",
)
def _deleted_by_day(spark, folder):
    path = fresh_folder(spark, "deleted-by-day")
    append_events(g.events(spark, folder), path)
    delete_events_by_day(spark, path, feeds.feedback_feed(_scope(spark, folder).app_rows).select("id"))
    return read_events(spark, path).select("id", "event", "session_id")


def _events_of_devices(spark, folder):
    path = fresh_folder(spark, "findable")
    append_findable(g.events(spark, folder), path)
    keys = g.excluded_devices(spark, folder, repeats=True).select(F.col("device_id").alias("session_id"))
    return rows_of_keys(read_events(spark, path), "session_id", keys).select("id", "event", "session_id", "created_at")


register(
    "event_rows_of_devices", _events_of_devices, base_sql(None) + f"""SELECT id, event, session_id, strftime(created_at, {SQL_TIME}) AS created_at FROM raw WHERE session_id IN (SELECT device_id FROM dev)""",
)
FEEDBACK_DELETED = BASE + """, shown AS (SELECT id FROM a WHERE event = 'feedback' ORDER BY created_at DESC, id DESC LIMIT 200)
SELECT id, event, session_id FROM raw WHERE id NOT IN (SELECT id FROM shown)"""
register("feedback_delete_by_day", _deleted_by_day, FEEDBACK_DELETED)
register(
    "feedback_delete",
    lambda s, f: exclusions.delete_by_id(
        g.events(s, f).select("id", "event", "session_id"),
        feeds.feedback_feed(_scope(s, f).app_rows).select("id")),
    FEEDBACK_DELETED,
)

register(
    "daily_series_arrays",
    scoped(lambda sc: presentation.series_arrays(overview.daily_series(sc.visible_rows, sc.as_of))),
    BASE + SPINE.format(today=AS_OF.date())
    + f"""SELECT app, string_agg(strftime(day, {SQL_DAY}), ',' ORDER BY day) AS dates, string_agg(CAST(n AS STRING), ',' ORDER BY day) AS counts
FROM dense GROUP BY app""",
)
register(
    "hour_of_day_array", visible(lambda v: presentation.hour_array(overview.hour_of_day(v))),
    BASE + """, h AS (SELECT h, count(v.id) AS n FROM range(24) t(h) LEFT JOIN v ON v.hour = t.h GROUP BY h)
SELECT string_agg(CAST(n AS STRING), ',' ORDER BY h) AS hours FROM h""",
)
register(
    "events_by_name_map", visible(lambda v: presentation.counts_map(overview.events_by(v, "event"), "event")),
    BASE + """, c AS (SELECT event, count(*) AS n FROM v GROUP BY event)
SELECT '{' || string_agg('"' || event || '":' || CAST(n AS STRING), ',' ORDER BY event) || '}' AS counts FROM c""",
)


def _dashboard(part):
    return lambda s, f: dashboard(g.events(s, f), g.excluded_devices(s, f, repeats=True), Request(AS_OF))[part]


for _part, _sql in {
    "apps": APP_STATS,
    "kpis": KPIS.format(today=AS_OF.date(), truncated="false"),
    "all_apps": "SELECT DISTINCT app FROM e",
    "app_events": """SELECT app, event, n, row_number() OVER (PARTITION BY app ORDER BY n DESC, event) AS rank
  FROM (SELECT app, event, count(*) AS n FROM v GROUP BY app, event)""",
    "funnel": FUNNEL,
    "events_by_app": "SELECT app, count(*) AS n FROM v GROUP BY app",
    "events_by_name": "SELECT event, count(*) AS n FROM v GROUP BY event",
    "platforms": PLATFORMS,
    "devices": DEVICE_TABLE,
    "recent_events": RECENT_EVENTS,
    "recent_errors": RECENT_ERRORS,
    "feedback": FEEDBACK,
}.items():
    register(f"dashboard_{_part}", _dashboard(_part), BASE + _sql)
register(
    "dashboard_daily", _dashboard("daily"),
    BASE + SPINE.format(today=AS_OF.date()) + f"SELECT strftime(day, {SQL_DAY}) AS day, app, n FROM dense",
)
register(
    "dashboard_hours", _dashboard("hours"),
    BASE + """SELECT CAST(h AS BIGINT) AS hour, count(v.id) AS n FROM range(24) t(h) LEFT JOIN v ON v.hour = t.h GROUP BY h""",
)
