"""Referral codes, links and e-mail addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.text import trimmed

# Fixed values.
CODE_PATTERN = "^[A-HJKMNP-Z2-9]{8}$"
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
# First `ref` parameter of the query part, ignoring the fragment.
REF_PARAMETER = r"^[^#?]*\?(?:[^#]*?&)?ref=([^&#]*)"
REWARD_EVERY = 3


def referral_code(text: Column) -> Column:
    code = F.upper(trimmed(text))
    return F.when(code.rlike(CODE_PATTERN), code)


def code_from_url(url: Column) -> Column:
    """Valid code of a link; a missing, malformed or invalid one gives null."""
    found = F.when(url.rlike(REF_PARAMETER), F.regexp_extract(url, REF_PARAMETER, 1))
    return referral_code(F.try_url_decode(found))


def referral_link(site: str, code: Column) -> Column:
    escaped = F.replace(F.url_encode(code), F.lit("+"), F.lit("%20"))
    return F.concat(F.regexp_replace(F.lit(site), "/+$", ""), F.lit("?ref="), escaped)


def clean_email(text: Column) -> Column:
    """Trimmed, lower-cased address; null when it does not look like one."""
    email = F.lower(trimmed(text))
    return F.when(email.rlike(EMAIL_PATTERN), email)
