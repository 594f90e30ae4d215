"""Visits shown while they grow: provisional rows at once, a final row when a timer closes the visit.

The state of a device is its list of open visits, as first time, last time and size. A visit is closed once the
watermark has reached its last event plus the gap; from then on no event that is still accepted can join it, its row
is final and it leaves the state. A device without open visits has no state. While nothing arrives the watermark stands
still and visits stay open.

Rows are reduced per device and slot of one gap within each Arrow batch before they are shuffled, so that a device
with a third of all events sends a few rows a batch. A slot counts as late only if all of it is; what reaches behind
a closed visit starts a visit of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from plumbline.streaming.events import LATENESS

GAP_SECONDS = 30 * 60
SLOTS = "device string, first_us long, last_us long, events long"
STATE = "firsts array<long>, lasts array<long>, sizes array<long>"
SHOWN = "device string, first_us long, last_us long, events long, is_closed boolean, shown_ms long"


def merged(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Spans (first, last, size) in time order, those no more than `gap` apart made one."""
    whole: list[tuple[int, int, int]] = []
    for first, last, size in sorted(spans):
        if whole and first - whole[-1][1] <= gap:
            before = whole.pop()
            whole.append((before[0], max(before[1], last), before[2] + size))
        else:
            whole.append((first, last, size))
    return whole


def slots_of_batches(gap: int):
    def reduce(batches):
        for batch in batches:
            slot = batch["at_us"] // gap
            times = batch.groupby([batch["device"], slot.rename("slot")])["at_us"].agg(["min", "max", "size"]).reset_index()
            yield times[["device", "min", "max", "size"]].set_axis(["device", "first_us", "last_us", "events"], axis=1)

    return reduce


def grow_visits(gap: int):
    def grow(key, frames, state):
        import pandas as pd

        spans = list(zip(*state.get)) if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                spans = merged([*spans, *zip(frame["first_us"].tolist(), frame["last_us"].tolist(), frame["events"].tolist())], gap)
        mark = state.getCurrentWatermarkMs()
        still = [span for span in spans if span[1] + gap > mark * 1_000]
        if still:
            state.update(tuple([span[k] for span in still] for k in range(3)))
            # Rounded up, so that the timer never rings before the gap is over.
            state.setTimeoutTimestamp(max(-(-(min(span[1] for span in still) + gap) // 1_000), mark + 1))
        elif state.exists:
            state.remove()
        now = state.getCurrentProcessingTimeMs()
        rows = [(key[0], *span, span[1] + gap <= mark * 1_000, now) for span in spans]
        yield pd.DataFrame(rows, columns=["device", "first_us", "last_us", "events", "is_closed", "shown_ms"])

    return grow


def growing_visits(rows: DataFrame, lateness: str = LATENESS, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """All open visits of a device whenever it has new events or one of them closes, and every closed visit once.

    `shown_at` is the time of the batch; the rows of a device's newest batch replace its earlier open ones.
    Rows without a device or time are left out.
    """
    gap = gap_seconds * 1_000_000
    times = rows.where("device IS NOT NULL AND created_at IS NOT NULL").select("device", F.unix_micros("created_at").alias("at_us"))
    slots = times.mapInPandas(slots_of_batches(gap), SLOTS).withColumn("seen_at", F.timestamp_micros("last_us"))
    shown = slots.withWatermark("seen_at", lateness).groupBy("device").applyInPandasWithState(
        grow_visits(gap), SHOWN, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return shown.select(
        "device", F.timestamp_micros("first_us").alias("started_at"), F.timestamp_micros(F.col("last_us") + gap).alias("closes_at"),
        "events", "is_closed", F.timestamp_millis("shown_ms").alias("shown_at"))


def current_visits(shown: DataFrame) -> DataFrame:
    """The closed visits, and the open ones as they were last shown."""
    newest = shown.groupBy("device").agg(F.max("shown_at").alias("shown_at"))
    still = shown.where("NOT is_closed").join(newest, ["device", "shown_at"], "left_semi")
    return shown.where("is_closed").unionByName(still).drop("shown_at")
