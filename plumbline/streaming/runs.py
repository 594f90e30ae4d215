"""Running streams to the end of what is there, and watching them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from plumbline.session import fresh_folder

# Merge the visits of a busy device within each task before they are shuffled.
STREAM_SETTINGS = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def apply_stream_settings(spark: SparkSession) -> None:
    for key, value in STREAM_SETTINGS.items():
        spark.conf.set(key, value)


def append_to(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Start an append-only run over the files present; resumes from its checkpoint."""
    apply_stream_settings(rows.sparkSession)
    return (
        rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )


def drained(rows: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything available and read back what it wrote."""
    spark = rows.sparkSession
    target, checkpoint = fresh_folder(spark, f"{label}-out"), fresh_folder(spark, f"{label}-checkpoint")
    append_to(rows, target, checkpoint).awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)


def late_rows(query: StreamingQuery) -> int:
    """Rows a query has dropped as too late, over the progress it still holds."""
    return sum(
        int(state.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress for state in progress["stateOperators"]
    )


class LateRowCounter(StreamingQueryListener):
    """Totals of dropped late rows per query, kept on the driver as one number each."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        lost = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        self.dropped[str(progress.id)] = self.dropped.get(str(progress.id), 0) + lost

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
