"""Referral attribution and reward progress."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.calendar import time_slot
from plumbline.functions.referral_codes import (
    REWARD_EVERY, clean_email, code_from_url, referral_code, referral_link,
)
from plumbline.operators.joins import lookup_join
from plumbline.session import settle

WINDOW_DAYS = 30
# Clicks and signups of one browser are ordered within slots of this length first.
SLOT_SECONDS = 60


def with_ref_codes(df: DataFrame, url: str) -> DataFrame:
    """Adds the valid code carried by a link, null otherwise."""
    return df.withColumn("ref_code", code_from_url(F.col(url)))


def _last_click_before(signups: DataFrame, clicks: DataFrame, slot_seconds: int) -> DataFrame:
    """Newest valid click at or before each distinct (browser, signup time).

    One row per browser and instant is left after the first aggregate. Within a
    browser's time slot a running maximum finds the click; what happened in earlier
    slots is carried as one row per slot. No pairs of clicks and signups are made,
    and no window holds more than one browser's slot or one browser's slots.
    """
    slot = time_slot(F.col("at"), slot_seconds).alias("slot")
    asked = signups.where("browser_id is not null").select(
        "browser_id", F.col("signup_ts").alias("at"), F.lit(True).alias("asked"),
        F.lit(None).cast("long").alias("click_id"), F.lit(None).cast("string").alias("ref_code"),
    )
    clicked = (
        with_ref_codes(clicks, "url").where("browser_id is not null and ref_code is not null")
        .select("browser_id", F.col("click_ts").alias("at"), F.lit(False).alias("asked"), "click_id", "ref_code")
    )
    instants = (
        asked.unionByName(clicked).groupBy("browser_id", slot, "at")
        .agg(F.bool_or("asked").alias("asked"), F.max(F.struct("click_id", "ref_code")).alias("click"))
        .withColumn("click", F.when(F.col("click.ref_code").isNotNull(), F.struct("at", "click.ref_code")))
    )
    in_slot = W.partitionBy("browser_id", "slot").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    near = instants.withColumn("near", F.max("click").over(in_slot))
    # Both uses of the instants read the same columns, so their shuffle is done once.
    per_slot = near.groupBy("browser_id", "slot").agg(
        F.max(F.when(F.col("at").isNotNull(), F.col("click"))).alias("click"), F.bool_or("asked").alias("asked"),
    )
    earlier = W.partitionBy("browser_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        per_slot.withColumn("carried", F.max("click").over(earlier)).where("asked")
        .select("browser_id", "slot", "carried")
    )
    return (
        near.where("asked").join(carried, ["browser_id", "slot"], "left")
        .select("browser_id", F.col("at").alias("signup_ts"), F.coalesce("near", "carried").alias("click"))
    )


def attribute_referrals(
    signups: DataFrame, clicks: DataFrame, window_days: int = WINDOW_DAYS, slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Code per signup: an explicit one as given, else that of the last valid click in the window."""
    found = _last_click_before(signups, clicks, slot_seconds).select("browser_id", "signup_ts", "click")
    joined = lookup_join(signups, settle(found), ["browser_id", "signup_ts"], "user_id")
    fresh = F.col("click.at") >= F.col("signup_ts") - F.make_dt_interval(F.lit(window_days))
    explicit = F.when(F.trim("explicit_code") != "", F.trim("explicit_code"))
    return joined.select(
        "user_id",
        F.coalesce(explicit, F.when(fresh, F.col("click.ref_code"))).alias("ref_code"),
        F.when(explicit.isNull() & fresh, F.col("click.at")).alias("click_ts"),
    )


def with_referrer(attributed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds the user whose code was used; the earliest user wins if a code is held twice."""
    owners = (
        profiles.where("deleted_at is null and referral_code is not null")
        .groupBy(F.col("referral_code").alias("code")).agg(F.min_by("user_id", F.struct("created_at", "user_id")).alias("referrer_id"))
    )
    coded = attributed.withColumn("code", referral_code(F.col("ref_code")))
    return lookup_join(coded, settle(owners), "code", "user_id").drop("code")


def referral_counts(profiles: DataFrame) -> DataFrame:
    """Signups credited to each user."""
    return (
        profiles.where("referred_by is not null").groupBy(F.col("referred_by").alias("user_id"))
        .agg(F.count("*").alias("referrals"))
    )


def referral_progress(
    profiles: DataFrame, as_of: datetime, site: str, threshold: int = REWARD_EVERY,
) -> DataFrame:
    """Reward progress of every live account."""
    count = F.greatest(F.lit(0), F.coalesce("referral_count", F.lit(0))).cast("long")
    until = F.try_to_timestamp("free_until")
    return profiles.where("deleted_at is null").select(
        "user_id",
        clean_email(F.col("email")).alias("email"),
        count.alias("count"),
        (F.lit(threshold) - count % threshold).alias("next_reward_at"),
        F.floor(count / threshold).alias("rewards_earned"),
        until.alias("free_until"),
        F.coalesce(until > F.lit(as_of), F.lit(False)).alias("has_active_free_time"),
        referral_link(site, F.col("referral_code")).alias("referral_link"),
    )


def own_profile(profiles: DataFrame, user_id: str) -> DataFrame:
    """The one live profile of a user, or nothing."""
    return profiles.where((F.col("user_id") == user_id) & F.col("deleted_at").isNull()).limit(1)
