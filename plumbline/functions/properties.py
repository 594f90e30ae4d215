"""Fields of the JSON `properties` text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.text import filled, prefix

# Fixed values.
DETAIL_KEYS = ["code", "source", "online", "mic", "ua"]
DETAIL_WIDTH = 64


def json_text(properties: Column, key: str) -> Column:
    return F.get_json_object(properties, f"$.{key}")


def self_tagged(properties: Column) -> Column:
    """True for `internal: true` and `internal: "true"` only.

    The substring test spares most rows the JSON parse; an escaped key still reaches it.
    """
    maybe = properties.contains("internal") | properties.contains("\\u")
    tagged = F.when(maybe, json_text(properties, "internal") == "true")
    return F.coalesce(tagged, F.lit(False))


def truthy_text(properties: Column, key: str) -> Column:
    """Text of a field, null where a script would call it falsy."""
    field = F.try_variant_get(F.try_parse_json(properties), f"$.{key}", "variant")
    raw = F.to_json(field)
    return F.when(~raw.isin("null", "false", "0", "-0", "0.0", '""'), json_text(properties, key))


def error_reason(properties: Column, event: Column) -> Column:
    return F.coalesce(truthy_text(properties, "reason"), truthy_text(properties, "message"), event)


def detail_of(properties: Column) -> Column:
    """Map of the allowed diagnostic keys, bounded text, null when none is present."""
    fields = F.from_json(properties, "map<string,string>")
    kept = F.map_filter(fields, lambda k, v: k.isin(DETAIL_KEYS) & v.isNotNull())
    short = F.transform_values(kept, lambda k, v: prefix(v, DETAIL_WIDTH))
    return F.when(F.size(kept) > 0, short)


def detail_text(detail: Column) -> Column:
    """One readable line for a detail map, a dash when there is nothing to say."""
    def known(key):
        value = filled(detail[key])
        return F.when(value != "unknown", value)

    parts = F.concat_ws(
        " · ",
        filled(detail["code"]),
        F.concat(F.lit("from:"), known("source")),
        F.when(detail["online"] == "false", "offline"),
        F.concat(F.lit("mic:"), known("mic")),
        filled(detail["ua"]),
    )
    return F.coalesce(filled(parts), F.lit("—"))
