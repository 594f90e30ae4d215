"""Section index of a corpus of markdown documents (`doc_id`, `markdown`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.sections import (
    ANY_HEADING, MAYBE_NUMBERED, anchor_id, heading_depth, heading_text, preamble_of, section_id,
)
from plumbline.functions.text import trimmed


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per file."""
    return spark.read.text(list(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("markdown")
    )


def doc_preamble(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", preamble_of(F.col("markdown")).alias("p")).select("doc_id", "p.*")


def _marked_lines(docs: DataFrame) -> DataFrame:
    """Body lines that can be headings, with their place in the body."""
    return (
        doc_preamble(docs).select("doc_id", F.posexplode(F.split("body", "\n")).alias("pos", "raw"))
        .select("doc_id", "pos", trimmed(F.col("raw")).alias("line"))
        .where(F.col("line").startswith("#") | F.col("line").startswith("**"))
    )


def _first_of_each(entries: DataFrame) -> DataFrame:
    """The first entry per document and id; reduced before the shuffle, however often an id repeats."""
    first = entries.groupBy("doc_id", "id").agg(F.min(F.struct("pos", "label", "depth")).alias("first"))
    return first.select("doc_id", "first.pos", "id", "first.label", "first.depth")


def section_index(docs: DataFrame) -> DataFrame:
    """Numbered sections of every document; the first line with an id wins."""
    line, number = F.col("line"), F.col("id")
    entries = (
        _marked_lines(docs).where(line.rlike(MAYBE_NUMBERED))
        .withColumn("label", heading_text(line)).where("label is not null")
        .withColumn("id", section_id(F.col("label"))).where("id is not null")
        .select("doc_id", "pos", "id", "label", heading_depth(line, number).alias("depth"))
    )
    return _first_of_each(entries)


def heading_anchors(docs: DataFrame) -> DataFrame:
    """Anchors of all headings, numbered ones by number and the others by slug."""
    line = F.col("line")
    entries = (
        _marked_lines(docs).where(line.rlike(ANY_HEADING))
        .select("doc_id", "pos", F.regexp_extract(line, ANY_HEADING, 2).alias("label"),
                F.length(F.regexp_extract(line, ANY_HEADING, 1)).alias("depth"))
        .withColumn("id", anchor_id(F.col("label"))).where("id is not null")
    )
    return _first_of_each(entries)
