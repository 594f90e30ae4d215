"""Hand-made frames for the rules that are easy to get wrong."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.functions import clients, properties as pr, referral_codes as rc, text
from plumbline.operators import apps, devices, events as ev, exclusions, feeds, overview, visits
from plumbline.schemas import EVENTS, EXCLUDED_DEVICES, EXCLUSION_ACTIONS

NOW = datetime(2024, 3, 10, 12)
T0 = datetime(2024, 3, 10, 0)


def make(spark, rows):
    """Rows as (event, device, time, properties, user agent), later items optional."""
    full = []
    for i, row in enumerate(rows):
        event, device, at, props, ua = (list(row) + [None] * 5)[:5]
        full.append((i + 1, at or T0 + timedelta(seconds=i), "app", event, device, props, "/", ua))
    return spark.createDataFrame(full, EVENTS)


def scoped(spark, rows, excluded=(), **options):
    listed = spark.createDataFrame([(d, None) for d in excluded], EXCLUDED_DEVICES)
    options.setdefault("as_of", NOW)
    return ev.scope(make(spark, rows), listed, **options)


def test_visit_gap_is_strict(spark):
    times = [T0, T0 + timedelta(minutes=30), T0 + timedelta(hours=1, seconds=1)]
    rows = scoped(spark, [("x", "d", t) for t in times]).visible_rows
    assert visits.visits(rows).first()["visits"] == 2
    assert overview.overview_kpis(scoped(spark, [("x", "d", t) for t in times])).first()["visits"] == 2


@pytest.mark.parametrize("gap", [60, 1800, 5400])
def test_visits_agree_with_a_row_by_row_count(spark, gap):
    state, times = 7, []
    for _ in range(400):
        state = (state * 1103515245 + 12345) % 2**31
        times.append((("a", "b", "unknown")[state % 3], T0 - timedelta(days=40) + timedelta(seconds=state % 400_000)))
    rows = scoped(spark, [("x", d, t) for d, t in times], range_name="all").visible_rows
    want, last = {}, {}
    for device, at in sorted(times, key=lambda p: p[1]):
        if device not in last or at - last[device] > timedelta(seconds=gap):
            want[device] = want.get(device, 0) + 1
        last[device] = at
    assert {r["device"]: r["visits"] for r in visits.visits(rows, gap).collect()} == want
    assert visits.visit_bounds(rows, gap).count() == sum(want.values())


def test_a_busy_device_leaves_one_row_per_slot(spark):
    rows = scoped(spark, [("x", "unknown", T0 + timedelta(seconds=i)) for i in range(0, 7200, 2)]).visible_rows
    slots = visits.device_slots(rows)
    assert slots.count() == 4 and slots.agg(F.sum("events")).first()[0] == 3600
    plan = slots._jdf.queryExecution().executedPlan().toString()
    # Two levels here, two for the distinct exclusion list.
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 4


def test_error_wins_and_both_reach_success(spark):
    rows = scoped(spark, [("export_failed", "a"), ("export_success", "b")]).visible_rows
    row = apps.app_stats(rows).first()
    assert (row["success_count"], row["error_count"], row["success_rate"]) == (1, 1, 50.0)
    assert apps.app_funnel(rows).where("step = 'success'").first()["n"] == 2


def test_no_outcomes_no_rate(spark):
    rows = scoped(spark, [("App_Opened", "a")]).visible_rows
    row = apps.app_stats(rows).first()
    assert row["success_rate"] is None and row["total_sessions"] == 1


def test_dropoff_can_be_negative_and_zero_without_base(spark):
    rows = scoped(spark, [("app_opened", "a"), ("upload_x", "a"), ("photo", "b")]).visible_rows
    assert apps.app_funnel(rows).where("step = 'uploaded'").first()["dropoff_pct"] == -100.0
    rows = scoped(spark, [("upload_x", "a")]).visible_rows
    assert {r["dropoff_pct"] for r in apps.app_funnel(rows).collect()} == {0.0}


def test_half_rounds_up_below_zero(spark):
    row = spark.range(1).select(text.one_decimal(F.lit(-0.0025)).alias("a"), text.one_decimal(F.lit(0.0025)).alias("b")).first()
    assert (row["a"], row["b"]) == (-0.2, 0.3)


def test_events_without_a_device_still_count(spark):
    sc = scoped(spark, [("x", None), ("x", ""), ("x", "d")])
    row = overview.overview_kpis(sc).first()
    assert (row["row_count"], row["unique_devices"], row["visits"]) == (3, 1, 1)
    assert devices.device_table(sc.all_rows).count() == 1


@pytest.mark.parametrize("props, internal", [
    ('{"internal": true}', True), ('{"internal": "true"}', True), ('{"internal": 1}', False),
    ('{"internal": "1"}', False), ('{"a": 1}', False), (None, False), ("not json internal", False),
    ('{"\\u0069nternal": true}', True),
])
def test_internal_forms(spark, props, internal):
    assert scoped(spark, [("x", "d", None, props)]).all_rows.first()["is_internal"] is internal


def test_ranges_and_scopes(spark):
    rows = [("x", "d", NOW - timedelta(days=7)), ("x", "d", NOW - timedelta(days=7, seconds=1)), ("x", "own", NOW)]
    assert scoped(spark, rows, range_name="7d").all_rows.count() == 2
    assert scoped(spark, rows, range_name="5d").all_rows.count() == 3
    sc = scoped(spark, rows, ["own"], range_name="all")
    assert sc.visible_rows.count() == 2 and ev.hidden_internal(sc).first()[0] == 1
    sc = scoped(spark, rows, ["own"], range_name="all", include_internal=True)
    assert sc.visible_rows.count() == 3 and ev.hidden_internal(sc).first()[0] == 0
    assert scoped(spark, rows, range_name="all", cap=1).all_rows.first()["session_id"] == "own"
    assert scoped(spark, rows, app="other").visible_rows.count() == 0


def test_truncation_flag_at_the_cap(spark):
    rows = [("x", "d"), ("x", "d")]
    for cap, told in ((1, True), (2, True), (3, False), (None, False)):
        assert overview.overview_kpis(scoped(spark, rows, cap=cap)).first()["truncated"] is told


def test_a_device_listed_twice_marks_once(spark):
    sc = scoped(spark, [("x", "d"), ("x", "e")], excluded=("d", "d"))
    assert sorted(r["is_excluded"] for r in sc.all_rows.collect()) == [False, True]


def test_platform_of_the_newest_event_even_when_empty(spark):
    rows = scoped(spark, [
        ("x", "d", T0, None, "Mozilla/5.0 (iPhone; like Mac OS X) Safari/604"), ("x", "d", NOW, None, None),
    ])
    assert devices.devices_by_platform(rows.visible_rows).first()["platform"] == "Unknown"
    row = devices.device_table(rows.all_rows).first()
    assert (row["platform"], row["browser"], row["last_seen"]) == ("Unknown", "", NOW)


def test_client_names(spark):
    agents = {
        "Mozilla (iphone; CPU)": ("iPhone", ""), "Android Chrome/1 Safari/5": ("Android", "Chrome"),
        "Windows Chrome/1 Edg/1": ("Windows", "Edge"), "Macintosh FxiOS": ("Mac", "Firefox"), "curl": ("Other", ""), "": ("Unknown", ""),
    }
    df = spark.createDataFrame([(a,) for a in agents], "ua string")
    found = df.select("ua", clients.platform_of(F.col("ua")), clients.browser_of(F.col("ua"))).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == agents


def test_empty_frames(spark):
    sc = scoped(spark, [("x", "d", NOW - timedelta(days=90))], range_name="7d")
    row = overview.overview_kpis(sc).first()
    assert (row["row_count"], row["visits"], row["events_today"], row["active_days"]) == (0, 0, 0, 0)
    assert overview.daily_series(sc.visible_rows, NOW).count() == 0
    assert overview.hour_of_day(sc.visible_rows).count() == 24


def test_axis_ends_today_or_at_a_later_first_day(spark):
    rows = scoped(spark, [("x", "d", NOW - timedelta(days=3)), ("x", "d", NOW + timedelta(days=2))]).visible_rows
    series = overview.daily_series(rows, NOW).orderBy("day").collect()
    assert [r["n"] for r in series] == [1, 0, 0, 0]
    rows = scoped(spark, [("x", "d", NOW + timedelta(days=2))]).visible_rows
    assert overview.daily_series(rows, NOW).count() == 1


@pytest.mark.parametrize("props, reason", [
    ('{"reason": "r", "message": "m"}', "r"), ('{"reason": "", "message": "m"}', "m"),
    ('{"reason": 0, "message": false}', "load_error"), ('{"reason": "0"}', "0"), (None, "load_error"), ("{bad", "load_error"),
])
def test_error_reason(spark, props, reason):
    rows = scoped(spark, [("load_error", "d", None, props)]).visible_rows
    assert feeds.recent_errors(rows).first()["reason"] == reason


def test_error_detail(spark):
    props = '{"code": 7, "source": "unknown", "online": false, "mic": null, "ua": "%s", "email": "x"}' % ("u" * 80)
    errors = feeds.recent_errors(scoped(spark, [("error", "d", None, props)]).visible_rows)
    assert errors.first()["detail"] == {"code": "7", "source": "unknown", "online": "false", "ua": "u" * 64}
    assert feeds.readable_errors(errors).first()["detail"] == "7 · offline · " + "u" * 64
    bare = feeds.recent_errors(scoped(spark, [("error", "d", None, '{"email": 1}')]).visible_rows)
    assert bare.first()["detail"] is None and feeds.readable_errors(bare).first()["detail"] == "—"


def test_feedback_fields(spark):
    props = '{"message": "%s", "version": "", "internal": true}' % ("m" * 3000)
    sc = scoped(spark, [("feedback", "d", None, props), ("Feedback", "d", None, "{}")])
    row = feeds.feedback_feed(sc.app_rows).collect()
    assert len(row) == 1 and len(row[0]["message"]) == 2000
    assert (row[0]["feedback_type"], row[0]["version"], row[0]["commit"], row[0]["internal"]) == ("other", "", None, True)


def test_exclusion_actions(spark):
    listed = spark.createDataFrame([("a", "old"), ("b", None)], EXCLUDED_DEVICES)
    actions = spark.createDataFrame([
        (1, "exclude", " a ", "n" * 300), (2, "include", "b", None), (3, "exclude", "c", None),
        (4, "include", "c", None), (5, "exclude", "c", "back"), (6, "drop", "a", None), (7, "exclude", "  ", None), (8, None, "a", None),
    ], EXCLUSION_ACTIONS)
    result = {r["device_id"]: r["note"] for r in exclusions.apply_exclusions(listed, actions).collect()}
    assert result == {"a": "n" * 200, "c": "back"}
    assert sorted(r["seq"] for r in exclusions.split_actions(actions)[1].collect()) == [6, 7, 8]


def test_html_escape_and_slug(spark):
    row = spark.range(1).select(
        text.html_escaped(F.lit('<a href="x">&</a>')).alias("h"), text.slug(F.lit("--Tools (A, B): x!")).alias("s")).first()
    assert row["h"] == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;" and row["s"] == "tools-a-b-x"


def test_referral_texts(spark):
    row = spark.range(1).select(
        rc.referral_code(F.lit("\tabcdef23 ")).alias("a"), rc.referral_code(F.lit("ABCDEFO1")).alias("b"),
        rc.code_from_url(F.lit("https://x.y/?a=1&ref=abcdef23&ref=zzzzzzzz#ref=q")).alias("c"),
        rc.code_from_url(F.lit("https://x.y/#?ref=abcdef23")).alias("d"),
        rc.code_from_url(F.lit("https://x.y/?ref=%zz")).alias("e"),
        rc.referral_link("https://s.io//", F.lit("AB CD")).alias("f"),
        rc.clean_email(F.lit("  A@B.co ")).alias("g"), rc.clean_email(F.lit("a@b")).alias("h"),
    ).first()
    assert tuple(row) == ("ABCDEF23", None, "ABCDEF23", None, None, "https://s.io?ref=AB%20CD", "a@b.co", None)
