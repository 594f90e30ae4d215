"""Texts that are asked for by digest."""

import hashlib

from plumbline.llm import personal_data as P


def test_only_texts_in_the_bitmap_are_shuffled(spark, tmp_path):
    """The grouping by digest, which shuffles texts, reads the bitmap's join alone; the digests are joined above it."""
    rows = [(k, f"some text {k % 30}") for k in range(40)] + [(90, ""), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    asked = spark.createDataFrame([(md5(f"some text {k}"),) for k in (3, 3, 7, 50)], "digest string")
    # Read from a file, so that Spark expects to broadcast the digests.
    asked.write.parquet(str(tmp_path / "asked"))
    found = P.texts_of(docs, spark.read.parquet(str(tmp_path / "asked")))
    plan = [line.lstrip(" :+-") for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    got = sorted((r["digest"], r["text"]) for r in found.collect())
    assert got == sorted((md5(text), text) for text in ("some text 3", "some text 7"))
    grouping = next(n for n, line in enumerate(plan) if line.startswith("Aggregate") and "first(text" in line)
    joins = [n for n, line in enumerate(plan) if line.startswith("Join")]
    # One join above the grouping, and below it only that with the bitmap.
    assert len([n for n in joins if n < grouping]) == 1 and len([n for n in joins if n > grouping]) == 1
