"""Stored table layouts."""

from pyspark.sql.types import (
    DateType, DecimalType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)


def _table(*fields):
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


MONEY = DecimalType(18, 2)
# Folder column of the stored event table.
DAY_COLUMN = "event_date"

EVENTS = _table(
    ("id", LongType(), False),
    ("created_at", TimestampType(), False),
    ("app", StringType(), True),
    ("event", StringType(), True),
    ("session_id", StringType(), True),
    ("properties", StringType(), True),
    ("path", StringType(), True),
    ("user_agent", StringType(), True),
)

EXCLUDED_DEVICES = _table(("device_id", StringType(), False), ("note", StringType(), True))

EXCLUSION_ACTIONS = _table(
    ("seq", LongType(), False),
    ("action", StringType(), True),
    ("device_id", StringType(), True),
    ("note", StringType(), True),
)

PROFILES = _table(
    ("user_id", StringType(), False),
    ("email", StringType(), True),
    ("created_at", TimestampType(), False),
    ("referral_code", StringType(), True),
    ("referred_by", StringType(), True),
    ("referral_count", IntegerType(), True),
    ("free_until", StringType(), True),
    ("deleted_at", TimestampType(), True),
)

CLICKS = _table(
    ("click_id", LongType(), False),
    ("browser_id", StringType(), True),
    ("url", StringType(), True),
    ("click_ts", TimestampType(), False),
)

SIGNUPS = _table(
    ("user_id", StringType(), False),
    ("browser_id", StringType(), True),
    ("signup_ts", TimestampType(), False),
    ("explicit_code", StringType(), True),
)

LINES = _table(("file_id", StringType(), False), ("line_no", LongType(), False), ("line", StringType(), True))

LEDGER = _table(
    ("gl_date", DateType(), True),
    ("account", StringType(), True),
    ("account_name", StringType(), True),
    ("entity", StringType(), True),
    ("amount", MONEY, True),
    ("ref_no", StringType(), True),
)
