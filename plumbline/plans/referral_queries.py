"""Queries over accounts and referrals."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import referrals as ref
from plumbline.plans.registry import SQL_TIME, register
from plumbline.sources import given_tables as g

SITE = "https://site.example//"

TABLES = f"""WITH clk AS (SELECT {g.select_list(g.CLICK_COLUMNS)} FROM orders),
sig AS (SELECT {g.select_list(g.SIGNUP_COLUMNS)} FROM customer),
prof AS (SELECT {g.select_list(g.PROFILE_COLUMNS)} FROM customer),
coded AS (SELECT click_id, browser_id, click_ts,
  upper(trim(url_decode(regexp_extract(url, '[?&]ref=([^&#]*)', 1)))) AS code FROM clk),
good AS (SELECT * FROM coded WHERE regexp_full_match(code, '[A-HJKMNP-Z2-9]{{8}}')),
att AS (SELECT s.user_id, s.signup_ts, trim(s.explicit_code) AS explicit,
  arg_max(c.code, (c.click_ts, c.click_id)) AS code, max(c.click_ts) AS click_ts
  FROM sig s LEFT JOIN good c ON c.browser_id = s.browser_id AND c.click_ts <= s.signup_ts
    AND c.click_ts >= s.signup_ts - INTERVAL 30 DAY
  GROUP BY ALL),
res AS (SELECT user_id, coalesce(explicit, code) AS ref_code,
  CASE WHEN explicit IS NULL THEN click_ts END AS click_ts FROM att)
"""


def _attributed(spark, folder):
    return ref.attribute_referrals(g.signups(spark, folder), g.clicks(spark, folder))


register("referral_clicks", lambda s, f: ref.with_ref_codes(g.clicks(s, f), "url").select("click_id", "ref_code"), TABLES + """
SELECT click_id, CASE WHEN regexp_full_match(code, '[A-HJKMNP-Z2-9]{8}') THEN code END AS ref_code FROM coded""")
register(
    "referral_codes_in_pages",
    lambda s, f: ref.with_ref_codes(g.given(s, f, "pages"), "url").groupBy("ref_code").agg(F.count("*").alias("n")),
    """SELECT CASE WHEN regexp_full_match(code, '[A-HJKMNP-Z2-9]{8}') THEN code END AS ref_code, count(*) AS n FROM (
  SELECT upper(trim(url_decode(regexp_extract(url, '[?&]ref=([^&#]*)', 1)))) AS code FROM pages) GROUP BY 1""",
)
register("referral_attribution", _attributed, TABLES + f"SELECT user_id, ref_code, strftime(click_ts, {SQL_TIME}) AS click_ts FROM res")
register(
    "referral_referrers", lambda s, f: ref.with_referrer(_attributed(s, f), g.profiles(s, f)).select("user_id", "ref_code", "referrer_id"),
    TABLES + """, own AS (SELECT referral_code, min(user_id) AS referrer_id FROM prof
  WHERE deleted_at IS NULL AND referral_code IS NOT NULL GROUP BY 1)
SELECT user_id, ref_code, referrer_id FROM res LEFT JOIN own ON own.referral_code = upper(trim(ref_code))""",
)
register("referral_counts", lambda s, f: ref.referral_counts(g.profiles(s, f)), TABLES + """
SELECT referred_by AS user_id, count(*) AS referrals FROM prof WHERE referred_by IS NOT NULL GROUP BY 1""")
register("referral_progress", lambda s, f: ref.referral_progress(g.profiles(s, f), g.AS_OF, SITE), TABLES + f"""
, c AS (SELECT *, CAST(greatest(0, referral_count) AS BIGINT) AS cnt, try_cast(free_until AS TIMESTAMP) AS until
  FROM prof WHERE deleted_at IS NULL)
SELECT user_id, lower(trim(email)) AS email, cnt AS count, 3 - cnt % 3 AS next_reward_at, CAST(floor(cnt / 3) AS BIGINT) AS rewards_earned,
  strftime(until, {SQL_TIME}) AS free_until, coalesce(until > TIMESTAMP '{g.AS_OF}', false) AS has_active_free_time,
  'https://site.example?ref=' || referral_code AS referral_link FROM c""")
register("own_profile", lambda s, f: ref.own_profile(g.profiles(s, f), "17").select("user_id", "referral_code"), TABLES + """
SELECT user_id, referral_code FROM prof WHERE user_id = '17' AND deleted_at IS NULL""")
