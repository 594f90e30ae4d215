"""The paged source against the event table."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

from plumbline.schemas import EVENTS
from plumbline.sources import paged as P

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def events(spark):
    rows = [(k, START + timedelta(minutes=17 * ((k * 7) % 230), microseconds=k), None if k % 5 else "a", 'say "x"\n', None, "{}", "/", "") for k in range(230)]
    return spark.createDataFrame(rows, EVENTS)


@pytest.fixture(scope="module")
def pages(events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "p")
    P.write_pages(events, path, range_keys=100, page_rows=10)
    return path


def test_all_pages_are_the_event_table(spark, events, pages):
    back = P.read_paged_events(spark, pages, 10)
    assert back.schema == EVENTS or [f.name for f in back.schema] == EVENTS.fieldNames()
    assert sorted(back.collect()) == sorted(events.collect())
    assert back.rdd.getNumPartitions() == 3


@pytest.mark.parametrize("hours", [0, 5, 40, 65, 100])
def test_time_bounds_are_pushed(spark, events, pages, hours):
    at, end = START + timedelta(hours=hours), START + timedelta(hours=60)
    bounded = lambda df: sorted(r["id"] for r in df.where((F.col("created_at") >= F.lit(at)) & (F.col("created_at") < F.lit(end)) & (F.col("id") % 2 == 0)).collect())
    assert bounded(P.read_paged_events(spark, pages, 10)) == bounded(events)


def test_a_lower_bound_leaves_older_pages_unread(pages):
    def read(bound):
        reader = P.PagedReader(pages, 10)
        left = list(reader.pushFilters([GreaterThanOrEqual(("created_at",), bound), EqualTo(("id",), 3)]))
        assert [type(f) for f in left] == [EqualTo]
        return sum(1 for p in reader.partitions() for _ in reader.pages(p.folder))

    # Ranges of 100, 100 and 30 rows in pages of ten: the empty page behind a full last one is asked for, but there is none.
    assert read(datetime(2000, 1, 1, tzinfo=timezone.utc)) == 23
    assert read(START + timedelta(minutes=17 * 200)) < 9
    assert read(datetime(2100, 1, 1)) == 3


def test_short_empty_and_missing_pages_end_a_range(spark, events, tmp_path):
    path = str(tmp_path / "p")
    P.write_pages(events.where("id < 25"), path, range_keys=100, page_rows=10)
    reader = P.PagedReader(path, 10)
    assert [t.num_rows for t in reader.pages("low=0")] == [10, 10, 5]
    # A short page ends the range, whatever lies behind it.
    assert [t.num_rows for t in P.PagedReader(path, 11).pages("low=0")] == [10]
    (tmp_path / "p/low=500/page=0").mkdir(parents=True)
    (tmp_path / "p/low=500/page=0/part-0.json").write_text("")
    (tmp_path / "p/low=900").mkdir()
    assert [t.num_rows for t in reader.pages("low=500")] == [0] and list(reader.pages("low=900")) == []
    assert P.read_paged_events(spark, path, 10).count() == 25
    assert P.read_paged_events(spark, str(tmp_path / "none"), 10).count() == 0
