"""Size-checked lookups, last-touch attribution and reward progress."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import referrals as ref
from plumbline.operators.joins import lookup_join, small_enough
from plumbline.schemas import CLICKS, PROFILES, SIGNUPS
from plumbline.session import settle

SIGNUP = datetime(2024, 3, 1, 12, 30)


def test_size_check(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert small_enough(df, 100, 200_000)
    assert not small_enough(df, 99, 200_000)
    assert not small_enough(df, 100, 90_000)


@pytest.mark.parametrize("max_rows", [1_000, 10])
def test_lookup_join_is_the_same_on_both_paths(spark, max_rows):
    """A third of the rows share one key and some have none."""
    facts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("key"), (F.col("id") % 5).alias("other"))
    dim = spark.range(0, 60, 2).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("value"))
    dim = dim.unionByName(spark.createDataFrame([("hot", 999)], "key string, value long"))
    got = {tuple(r) for r in lookup_join(facts, dim, "key", "id", max_rows).select("id", "key", "other", "value").collect()}
    want = {tuple(r) for r in facts.join(dim, "key", "left").select("id", "key", "other", "value").collect()}
    assert got == want and len(got) == 3000


def test_a_large_lookup_is_no_broadcast_however_small_its_files(spark):
    """A stored table of one repeated value takes few bytes, which is what Spark would go by."""
    facts = spark.range(3000).select("id", (F.col("id") % 100).cast("string").alias("key"))
    dim = settle(spark.range(100).select(F.col("id").cast("string").alias("key"), F.lit("the same").alias("value")))
    joined = lookup_join(facts, dim, "key", "id", 10)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "_lane" in x]
    assert joined.where("value = 'the same'").count() == 3000


@pytest.mark.parametrize("spread_by", ["id", "nothing"])
def test_lookup_join_spreads_the_hot_key(spark, spread_by):
    """The joined column is read, so the joins stay in the plan; `nothing` is null in every row."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = spark.range(6000).select(
            "id", F.lit(None).cast("string").alias("nothing"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"))
        dim = facts.select("key").distinct().withColumn("value", F.length("key"))
        joined = lookup_join(facts, dim, "key", spread_by, 10)
        counted = joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") >= 2
        rows = counted.collect()
        sizes = [r["n"] for r in rows]
        assert sum(sizes) == 6000 and max(sizes) < 2 * sum(sizes) / len(sizes)
        assert sum(r["v"] for r in rows) == 2000 * 3 + sum(len(f"k{i}") for i in range(6000) if i % 3)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def attributed(spark, clicks, signups, **options):
    clicks = spark.createDataFrame([(i, b, f"https://s.io/?ref={code}", at) for i, (b, code, at) in enumerate(clicks)], CLICKS)
    signups = spark.createDataFrame([(u, b, at, code) for u, b, at, code in signups], SIGNUPS)
    return {r["user_id"]: r["ref_code"] for r in ref.attribute_referrals(signups, clicks, **options).collect()}


@pytest.mark.parametrize("age, found", [
    (timedelta(0), True), (timedelta(days=30), True), (timedelta(days=30, microseconds=1), False), (-timedelta(microseconds=1), False),
])
def test_window_edges(spark, age, found):
    got = attributed(spark, [("b", "AAAAAAAA", SIGNUP - age)], [("u", "b", SIGNUP, None)])
    assert got == {"u": "AAAAAAAA" if found else None}


def test_last_valid_click_wins_and_an_explicit_code_overrides(spark):
    clicks = [("b", "AAAAAAAA", SIGNUP - timedelta(days=3)), ("b", "BBBBBBBB", SIGNUP - timedelta(days=2)),
              ("b", "nope", SIGNUP - timedelta(days=1)), ("c", "CCCCCCCC", SIGNUP)]
    signups = [("u", "b", SIGNUP, None), ("v", "b", SIGNUP, " given "), ("w", "c", SIGNUP, "  "), ("x", None, SIGNUP, None), ("y", "z", SIGNUP, None)]
    assert attributed(spark, clicks, signups) == {"u": "BBBBBBBB", "v": "given", "w": "CCCCCCCC", "x": None, "y": None}


def test_attribution_agrees_with_every_pair(spark):
    """A third of clicks and signups belong to one browser; all pairs are tried outside Spark."""
    state = 11

    def draw(n):
        nonlocal state
        state = (state * 1103515245 + 12345) % 2**31
        return (state >> 8) % n

    codes = ["AAAAAAAA", "BBBBBBBB", "CCCCCCCC", "bad"]
    browser = lambda: "hot" if draw(3) == 0 else f"b{draw(20)}"
    clicks = [(browser(), codes[draw(4)], SIGNUP + timedelta(minutes=draw(100_000))) for _ in range(500)]
    signups = [(f"u{i}", browser(), SIGNUP + timedelta(minutes=draw(140_000)), None) for i in range(300)]
    want = {}
    for user, b, at, _ in signups:
        near = [(t, i, c) for i, (cb, c, t) in enumerate(clicks) if cb == b and c != "bad" and timedelta(0) <= at - t <= timedelta(days=30)]
        want[user] = max(near)[2] if near else None
    assert attributed(spark, clicks, signups) == want
    assert attributed(spark, clicks, signups, slot_seconds=86_400 * 3) == want


def test_progress(spark):
    rows = [(str(c), f" U{c}@X.io ", SIGNUP, "ABCDEF23", None, c, free, None) for c, free in
            [(0, None), (2, "2030-01-01 00:00:00"), (3, "soon"), (-1, "2020-01-01 00:00:00")]]
    rows.append(("gone", "a@b.c", SIGNUP, None, None, 5, None, SIGNUP))
    got = {r["user_id"]: r for r in ref.referral_progress(spark.createDataFrame(rows, PROFILES), SIGNUP, "https://s.io/").collect()}
    assert {u: (r["count"], r["next_reward_at"], r["rewards_earned"], r["has_active_free_time"]) for u, r in got.items()} == {
        "0": (0, 3, 0, False), "2": (2, 1, 0, True), "3": (3, 3, 1, False), "-1": (0, 3, 0, False)}
    assert got["0"]["referral_link"] == "https://s.io?ref=ABCDEF23" and got["0"]["email"] == "u0@x.io"
    profiles = spark.createDataFrame(rows, PROFILES)
    assert ref.own_profile(profiles, "gone").count() == 0 and ref.own_profile(profiles, "2").count() == 1
