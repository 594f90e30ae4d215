"""Section numbers, headings and preamble of markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.text import BLANK_CLASS, filled, slug, trimmed

BLANK = f"[{BLANK_CLASS}]"
# The marks of the document format.
SECTION_NUMBER = rf"^(\d+(?:\.\d+)*)[.)]?(?:{BLANK}|$)"
# For trimmed lines.
HEADING = rf"^(#{{2,3}}){BLANK}+(.+)$"
ANY_HEADING = rf"^(#{{1,6}}){BLANK}+(.*[^{BLANK_CLASS}#].*?)[{BLANK_CLASS}#]*$"
MAYBE_NUMBERED = rf"^(?:#{{2,3}}{BLANK}+|\*\*)\d"
BOLD_SECTION = r"^\*\*(\d+(?:\.\d+)+[^*]*?)\*\*$"
RULE = "\n-{3,}\n"
TITLE = rf"(?m)^#{BLANK}+(.+)$"
EFFECTIVE = rf"(?m)\*\*Effective Date:\*\*{BLANK}*(.+?){BLANK}*$"
UPDATED = rf"(?m)\*\*Last Updated:\*\*{BLANK}*(.+?){BLANK}*$"
ENTITY = rf"(?m)^\*\*(.+?)\*\*{BLANK}*(\(.*\)){BLANK}*$"


def section_id(text: Column) -> Column:
    """`5.2 …` to `5-2`, `12. …` to `12`, null without a number."""
    number = filled(F.regexp_extract(trimmed(text), SECTION_NUMBER, 1))
    return F.replace(number, F.lit("."), F.lit("-"))


def anchor_id(text: Column) -> Column:
    """Section id, or the slug of an unnumbered heading."""
    return F.coalesce(section_id(text), filled(slug(text)))


def heading_text(line: Column) -> Column:
    """Text of a second or third level heading or of a bold numbered line, null for other lines."""
    return (
        F.when(line.rlike(HEADING), F.regexp_extract(line, HEADING, 2))
        .when(line.rlike(BOLD_SECTION), F.regexp_extract(line, BOLD_SECTION, 1))
    )


def heading_depth(line: Column, number: Column) -> Column:
    level = F.length(F.regexp_extract(line, HEADING, 1)) - 2
    return F.when(number.contains("-") | line.rlike(BOLD_SECTION), 1).otherwise(level)


def unix_newlines(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))


def preamble_of(text: Column) -> Column:
    """Struct of title, entity, dates and body; a text without a title is kept whole."""
    source = unix_newlines(text)
    parts = F.split(source, RULE, 2)
    head, rest = parts[0], F.coalesce(F.get(parts, F.lit(1)), source)
    title = F.regexp_extract(head, TITLE, 1)
    entity = F.concat_ws(" ", F.regexp_extract(head, ENTITY, 1), F.regexp_extract(head, ENTITY, 2))
    body = F.when(title != "", F.regexp_replace(rest, f"^{BLANK}+", "")).otherwise(source)
    return F.struct(
        title.alias("title"), trimmed(entity).alias("entity"),
        F.regexp_extract(head, EFFECTIVE, 1).alias("effective_date"),
        F.regexp_extract(head, UPDATED, 1).alias("last_updated"), body.alias("body"),
    )
