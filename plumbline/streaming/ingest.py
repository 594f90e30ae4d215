"""Event texts into the stored table, so that a batch that is run again adds nothing, and late rows stay.

Every batch writes folders of its own, named by its number below the day. A batch that failed half way is run again
with the same number and the same texts, and replaces exactly these folders. Rejected texts and the batch's row counts are
stored the same way. Windowed streams drop rows behind their watermark; here they are appended to their old day, whose
states `device_states.update_states` then makes again, so that the counts of closed days are corrected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.schemas import DAY_COLUMN, EVENTS
from plumbline.streaming.events import parse_events

BATCH_COLUMN = "batch_id"


def _replace(rows: DataFrame, path: str, *folders: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def store_batch(texts: DataFrame, batch: int, path: str, rejects_path: str, counts_path: str) -> None:
    """The events and rejects of one batch, replacing what an earlier try of it left; then its counts, by observation."""
    texts = texts.persist()
    try:
        events, rejects = parse_events(texts)
        kept, refused = Observation(), Observation()
        events = events.observe(kept, F.count("*").alias("n")).withColumn(DAY_COLUMN, F.to_date("created_at"))
        numbered = events.select(*EVENTS.fieldNames(), DAY_COLUMN).withColumn(BATCH_COLUMN, F.lit(batch))
        _replace(numbered.hint("rebalance", DAY_COLUMN), path, DAY_COLUMN, BATCH_COLUMN)
        _replace(rejects.observe(refused, F.count("*").alias("n")).withColumn(BATCH_COLUMN, F.lit(batch)), rejects_path, BATCH_COLUMN)
        told = [(int(kept.get["n"]), int(refused.get["n"]), batch)]
        _replace(texts.sparkSession.createDataFrame(told, f"events long, rejects long, {BATCH_COLUMN} long"), counts_path, BATCH_COLUMN)
    finally:
        texts.unpersist()


def ingest(texts: DataFrame, path: str, rejects_path: str, counts_path: str, checkpoint: str) -> StreamingQuery:
    """Start storing a stream of texts (column `value`) over what is there; resumes from its checkpoint."""
    def store(batch_texts: DataFrame, batch: int) -> None:
        store_batch(batch_texts, batch, path, rejects_path, counts_path)

    return texts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """Stored events of all batches."""
    return spark.read.schema(EVENTS).parquet(path).select(*EVENTS.fieldNames(), DAY_COLUMN)


def corrected_daily_counts(states: DataFrame) -> DataFrame:
    """Rows per app and UTC day from day states, late rows included."""
    return states.groupBy(F.col(DAY_COLUMN).alias("day"), "app").agg(F.sum("events").alias("n"))
