"""Every registered query runs, and the contract holds."""

import pytest

import __spark_entry__ as entry_point
from compare import check
from plumbline.plans.catalogue import ORACLES, QUERIES


def test_entry(spark):
    frame = entry_point.entry(spark)
    assert "app" in frame.columns and frame.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", [
    "app_stats", "app_funnel", "daily_series", "overview_kpis", "device_table", "exclusion_upsert", "referral_attribution",
    "variance_narrative", "gl_cube", "section_index", "stream_visits",
])
def test_query_equals_sql(spark, tables, name):
    assert check(spark, tables, name).startswith("ok")
