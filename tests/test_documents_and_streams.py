"""Section index, retention and streaming behaviour."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.functions.sections import anchor_id, section_id
from plumbline.operators import documents, retention
from plumbline.schemas import EVENTS, EXCLUDED_DEVICES, PROFILES
from plumbline.streaming import events as st
from plumbline.streaming.runs import LateRowCounter, append_to, drained, late_rows

TERMS = """# Terms\r
\r
**Acme** (operated by Acme Holdings)\r
\r
**Effective Date:** August 1, 2026  \r
**Last Updated:** July 28, 2026\r
\r
---\r
\r
## 1. ACCEPTANCE\r
text
## 5. SECURITY
### Client-Side Tools (A, B)
**5.2 API (A, B)**
**Important: not a section**
### 7.2 Next
## 5. AGAIN
#### 9.1 too deep
---
"""


@pytest.mark.parametrize("text, number, anchor", [
    ("5.2 API (A, B)", "5-2", "5-2"), ("12. ACCESSIBILITY", "12", "12"), ("7) x", "7", "7"),
    ("Client-Side Tools (A)", None, "client-side-tools-a"), ("5.2x", None, "5-2x"), ("!!", None, None),
    ("12.\u00a0ACCESS", "12", "12"), ("3\u2003x", "3", "3"),
])
def test_section_ids(spark, text, number, anchor):
    row = spark.range(1).select(section_id(F.lit(text)).alias("s"), anchor_id(F.lit(text)).alias("a")).first()
    assert (row["s"], row["a"]) == (number, anchor)


def test_document(spark, tmp_path):
    (tmp_path / "terms.md").write_bytes(TERMS.encode())
    (tmp_path / "plain.md").write_text("Some text with no preamble.")
    docs = documents.read_documents(spark, str(tmp_path / "*.md"))
    rows = {r["title"]: r for r in documents.doc_preamble(docs).collect()}
    terms = rows["Terms"]
    assert (terms["entity"], terms["effective_date"], terms["last_updated"]) == (
        "Acme (operated by Acme Holdings)", "August 1, 2026", "July 28, 2026")
    assert terms["body"].startswith("## 1. ACCEPTANCE\n") and terms["body"].endswith("---\n")
    assert rows[""]["body"] == "Some text with no preamble."
    index = documents.section_index(docs).orderBy("pos").collect()
    assert [(r["id"], r["label"], r["depth"]) for r in index] == [
        ("1", "1. ACCEPTANCE", 0), ("5", "5. SECURITY", 0), ("5-2", "5.2 API (A, B)", 1), ("7-2", "7.2 Next", 1)]
    anchors = {r["id"] for r in documents.heading_anchors(docs).collect()}
    assert "client-side-tools-a-b" in anchors and "9-1" in anchors


def test_retention_edges(spark):
    now = datetime(2026, 3, 1)
    ages = {"live": None, "d29": timedelta(days=29), "d30": timedelta(days=30), "y1": timedelta(days=366)}
    rows = [(u, None, now, None, None, 0, None, None if a is None else now - a) for u, a in ages.items()]
    profiles = spark.createDataFrame(rows, PROFILES)
    kept = retention.kept_accounts(profiles, now)
    assert {r["user_id"] for r in kept.collect()} == {"live", "d29"}
    assert tuple(retention.purge_report(profiles, kept, "accounts").first()) == ("accounts", 4, 2, 2)
    audit = spark.createDataFrame([(i, u) for i, u in enumerate([*ages, "stranger"])], "id long, user_id string")
    assert {r["user_id"] for r in retention.kept_audit_rows(audit, profiles, now).collect()} == {"live", "d29", "d30", "stranger"}


START = datetime(2024, 1, 1)


def batch(spark, folder, rows):
    """Append one file of (id, minutes after start, device)."""
    full = [(i, START + timedelta(minutes=m), "app", "x", d, None, "/", None) for i, m, d in rows]
    spark.createDataFrame(full, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_redelivered_events_count_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    batch(spark, folder, [(1, 0, "a"), (2, 1, "a"), (1, 0, "a")])
    batch(spark, folder, [(2, 1, "a"), (3, 2, "a")])
    assert rows_of(drained(st.deduplicated(st.stream_events(spark, folder)), "t"), "id") == [(1,), (2,), (3,)]


def test_visits_close_after_the_gap_and_late_rows_are_counted(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    batch(spark, folder, [(1, 0, "a"), (2, 30, "a"), (3, 61, "a"), (4, 300, "b")])
    stream = st.visit_sessions(st.marked(st.stream_events(spark, folder), spark.createDataFrame([], EXCLUDED_DEVICES)), "10 minutes")
    counter = LateRowCounter()
    spark.streams.addListener(counter)
    try:
        append_to(stream, out, check).awaitTermination()
        batch(spark, folder, [(5, 5, "a"), (6, 301, "b"), (7, 600, "c")])
        query = append_to(stream, out, check)
        query.awaitTermination()
        dropped = late_rows(query)
    finally:
        spark.streams.removeListener(counter)
    got = rows_of(spark.read.parquet(out), "device", "events")
    assert got == [("a", 1), ("a", 2), ("b", 2)] and dropped == 1


def test_marked_stream_is_the_same_on_both_paths(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "in")
    batch(spark, folder, [(i, i, "hot" if i % 3 else f"d{i}") for i in range(60)])
    listed = spark.createDataFrame([("hot", None), ("d3", None), ("other", None)], EXCLUDED_DEVICES)
    small = rows_of(drained(st.marked(st.stream_events(spark, folder), listed).select("id", "is_excluded"), "s"), "id", "is_excluded")
    monkeypatch.setattr(st, "small_enough", lambda df: False)
    large = rows_of(drained(st.marked(st.stream_events(spark, folder), listed).select("id", "is_excluded"), "l"), "id", "is_excluded")
    assert small == large and sum(excluded for _, excluded in small) == 41
