"""Platform and browser of a user-agent string."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values, first match wins.
PLATFORMS = [
    ("iPhone", "iPhone"),
    ("iPad", "iPad"),
    ("Android", "Android"),
    ("Mac", "Macintosh|Mac OS X"),
    ("Windows", "Windows"),
]
BROWSERS = [
    ("Edge", "Edg/"),
    ("Chrome", "CriOS|Chrome/"),
    ("Firefox", "FxiOS|Firefox/"),
    ("Safari", "Safari/"),
]


def _first_match(text: Column, table, fallback: Column) -> Column:
    out = None
    for name, pattern in table:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(fallback)


def platform_of(user_agent: Column) -> Column:
    ua = F.coalesce(user_agent, F.lit(""))
    return _first_match(ua, PLATFORMS, F.when(ua != "", "Other").otherwise("Unknown"))


def browser_of(user_agent: Column) -> Column:
    return _first_match(F.coalesce(user_agent, F.lit("")), BROWSERS, F.lit(""))
