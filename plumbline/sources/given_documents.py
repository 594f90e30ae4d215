"""Markdown documents made from the `documents` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import settle
from plumbline.sources.given_tables import given, spread

# In one document of three a no-break space follows the numbers and precedes the body. Every line of a text becomes a heading, a sub-heading, a bold section or plain text in turn;
# numbers start over after seven sections, so ids repeat. One document in ten has no preamble.
PREAMBLE = """CASE WHEN doc_id % 10 = 0 THEN '' ELSE '# ' || source || ' guide' || chr(10) || chr(10)
  || '**' || source || '** (operated by ' || lang || ')' || chr(10) || chr(10)
  || '**Effective Date:** May ' || CAST(doc_id % 28 + 1 AS STRING) || ', 2026  ' || chr(10)
  || '**Last Updated:** June 1, 2026' || chr(10) || chr(10) || '---' || chr(10) || CASE WHEN doc_id % 3 = 1 THEN chr(160) ELSE '' END
  || chr(10) END"""
NUMBER = "CAST(CAST(floor((i - {base}) / 4) AS BIGINT) % 7 + 1 AS STRING)"
LINE = """CASE (i - {base}) % 4 WHEN 0 THEN '## ' || {number} || '.' || CASE WHEN doc_id % 3 = 1 THEN chr(160) ELSE ' ' END || x WHEN 1 THEN '### ' || {number} || '.1 ' || x
  WHEN 2 THEN '**' || {number} || '.2 ' || x || '**' ELSE '## ' || x END"""


def _line(base: int) -> str:
    return LINE.format(base=base, number=NUMBER.format(base=base))


def markdown_sql() -> str:
    return f"""SELECT doc_id, {PREAMBLE} || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {_line(1)}), chr(10)) AS markdown
FROM documents"""


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    return settle(spread(given(spark, folder, "documents")).selectExpr(
        "doc_id", f"{PREAMBLE} || array_join(transform(split(text, '\\n'), (x, i) -> {_line(0)}), '\\n') AS markdown"
    ))
