"""Outcome classes and funnel steps, by substrings of the event name."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# Fixed values.
ERROR_WORDS = ("error", "fail")
SUCCESS_WORDS = ("success", "export", "complete")
UPLOAD_WORDS = ("upload", "photo")
OPENED = "app_opened"


def event_key(event: Column) -> Column:
    return F.lower(F.coalesce(event, F.lit("")))


def mentions(text: Column, words) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def is_error(event: Column) -> Column:
    return mentions(event_key(event), ERROR_WORDS)


def is_opened(event: Column) -> Column:
    return event_key(event) == OPENED


def reached_success(event: Column) -> Column:
    """Funnel test: failed exports count as reached too."""
    return mentions(event_key(event), SUCCESS_WORDS)


def is_success(event: Column) -> Column:
    """Outcome test: an event that also looks like an error is an error."""
    return reached_success(event) & ~is_error(event)


def is_upload(event: Column) -> Column:
    return mentions(event_key(event), UPLOAD_WORDS)


# (key, label, predicate over the event name)
FUNNEL = [
    ("opened", "Opened", is_opened),
    ("uploaded", "Uploaded", is_upload),
    ("success", "Success / Export", reached_success),
]
