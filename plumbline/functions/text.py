"""Small text and number expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space in the sense of a browser's trim, as characters and as a class for patterns.
BLANKS = " \t\n\r\f\x0b\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANK_CLASS = r"\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def filled(text: Column) -> Column:
    """Null for an empty string, the text otherwise."""
    return F.nullif(text, F.lit(""))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def defaulted_app(app: Column) -> Column:
    return F.coalesce(filled(app), F.lit("unknown"))


def prefix(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def one_decimal(ratio: Column) -> Column:
    """Percentage of a ratio with one decimal; halves go up, also below zero."""
    return F.floor(ratio * 1000 + 0.5) / 10


def html_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def slug(text: Column) -> Column:
    """Lower-case text with runs of other characters turned into single dashes."""
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))
