"""Where a pattern matches, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,end:int,value:string,part:string>>"


def let(value: Column, body) -> Column:
    """`body` of `value`, which is worked out once however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine) -> Column:
    """Every prefix of an array of integers combined by an associative `combine`.

    Blocks of about the square root of the length are run through by themselves and then led on by the blocks
    before them, so that no array grows beyond that length one value at a time.
    """
    def prefixes(xs: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("all"))

        def step(state: Column, x: Column) -> Column:
            last = F.when(state["last"].isNull(), x).otherwise(combine(state["last"], x)).cast("int")
            return F.struct(last.alias("last"), F.concat(state["all"], F.array(last)).alias("all"))

        return F.aggregate(xs, start, step, lambda state: state["all"])

    def in_blocks(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        starts = F.sequence(F.lit(1), F.size(xs), width)
        blocks = F.transform(starts, lambda at: prefixes(F.slice(xs, at, width)))
        return let(blocks, lambda bs: let(prefixes(F.transform(bs, lambda b: F.element_at(b, -1))), lambda lead: F.flatten(
            F.transform(bs, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: combine(lead[i - 1], x).cast("int")))))))

    return let(values, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(in_blocks(xs)))


def match_spans(text: Column, pattern: str, part: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, value, part), in code points, end exclusive.

    `part` is the group returned beside the whole match. The pieces between the matches and the
    matches themselves come from the same regular expression, so their lengths add up to positions.
    """
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(part)) if part else values
    pieces = F.arrays_zip(gaps.alias("gap"), values.alias("value"), parts.alias("part"))

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, lambda p: F.length(p["gap"]) + F.length(p["value"])), lambda a, b: a + b)
        return let(ends, lambda at: F.transform(found, lambda p, i: F.struct(
            (at[i] - F.length(p["value"])).alias("start"), at[i].alias("end"), p["value"].alias("value"), p["part"].alias("part"))))

    return let(F.filter(pieces, lambda piece: piece["value"].isNotNull()), placed)


def guarded_spans(text: Column, guard: Column, pattern: str, part: int = 0) -> Column:
    """`match_spans` for texts that pass a cheap necessary condition; others have no match."""
    return F.when(guard, match_spans(text, pattern, part)).otherwise(F.array().cast(SPAN))


def kind_spans(spans: Column, kind: str, number: int) -> Column:
    """Spans with their kind and the kind's place in the stated order."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(number).alias("number"), s["end"].alias("end"),
        F.lit(kind).alias("kind"), s["value"].alias("value"),
    ))


def spelled(spans: Column) -> Column:
    """`kind:start:end`, comma-joined in the order of the array."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
