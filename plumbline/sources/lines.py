"""Delimited text files as numbered lines and records, for rolls and ledger exports of unknown layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from plumbline.functions.delimited import leaves_open
from plumbline.operators.joins import lookup_join
from plumbline.session import settle, shuffles_freed


def _split_lines(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """file_id, split, line_no and line; `split` is where the part of the file starts that one task reads."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("split"),
        (F.col("_metadata.file_block_start") * 2 + place).alias("line_no"),
        F.col("value").alias("line"),
    )


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """`file_id`, `line_no`, `line`; line numbers rise within a file but have gaps.

    A file may be split over many tasks. Its number is made of where its split
    starts and of the row's place in the task: a task never holds more rows than
    a split has bytes, so a later split always numbers higher.
    """
    return _split_lines(spark, paths).drop("split")


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """`read_lines`, with the lines of a quoted cell that goes over several lines joined into one."""
    return joined_records(_split_lines(spark, paths))


def folder_lines(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """The records of all matching files of a folder."""
    return read_records(spark, f"{folder.rstrip('/')}/{pattern}")


def _after(anchor: Column, start: Column, turns: Column) -> Column:
    """The state after a line: that of the last line which sets it, or the one at the start, turned so many times since."""
    return F.pmod(F.coalesce(anchor, start) + turns, F.lit(2))


def joined_records(lines: DataFrame) -> DataFrame:
    """file_id, line_no of the first line, and line, for lines (file_id, split, line_no, line) with quoted line breaks.

    Before a line a quoted cell is open or not. What a line does to that is one of four maps: leave it, turn it, open it or close
    it. Maps combine associatively, so within a split running sums give the state at every line for either state in which
    the split may begin. Each split is thus one map, and a scan over the splits of a file tells which state it was. Lines are
    dealt and ordered once, by split, never by file. Only files in which some line can leave a cell open take part; other files
    pass as they are.

    Lines that are of one record whichever state the split began in are joined where they were dealt, and stored so: nearly all
    records are whole then, and only those that go on in another split, or depend on its state, are dealt again.

    A quote that is not closed until the end of its file opens nothing: from there on every line is a record. Line ends
    within a cell become a line feed; tabs separate no quoted cells.
    """
    spark = lines.sparkSession
    with shuffles_freed(spark):
        opens, stays = leaves_open(F.col("line"), False), leaves_open(F.col("line"), True)
        broken = lines.where(F.col("line").contains('"') & opens).select("file_id").distinct()
        # Numbers in place of paths, for what is shuffled; stored, so that they stay the same.
        broken = settle(broken.withColumn("_file", F.monotonically_increasing_id()))
        marked = lookup_join(lines, broken, "file_id", "line_no")
        calm = marked.where("_file IS NULL").select("file_id", "line_no", "line")

        in_split = W.partitionBy("_file", "split").orderBy("line_no")
        steps = marked.where("_file IS NOT NULL").select("_file", "split", "line_no", "line", opens.alias("opens"), stays.alias("stays"))
        steps = steps.withColumn("turns", F.sum(F.when(F.col("opens") & ~F.col("stays"), 1).otherwise(0)).over(in_split))
        # A line that sets the state is remembered less the turns so far.
        sets = F.when(F.col("opens") == F.col("stays"), F.col("opens").cast("int") - F.col("turns"))
        steps = steps.withColumn("anchor", F.last(sets, ignorenulls=True).over(in_split))
        for start in (0, 1):
            steps = steps.withColumn(f"after_{start}", _after(F.col("anchor"), F.lit(start), F.col("turns")))
            steps = steps.withColumn(f"before_{start}", F.lag(f"after_{start}", 1, start).over(in_split))
            begun = F.max(F.when(F.col(f"before_{start}") == 0, F.col("line_no"))).over(in_split)
            steps = steps.withColumn(f"record_{start}", begun)
        # Before the last line of a segment a cell is open in either state, so the least state after a line is that after the last.
        parts = F.sort_array(F.collect_list(F.struct("line_no", "line")))
        segments = steps.groupBy("_file", "split", "record_0", "record_1").agg(
            F.min("line_no").alias("line_no"), parts.alias("parts"), F.min("after_0").alias("after_0"), F.min("after_1").alias("after_1"))
        # How far back a record began is nearly always zero, and so takes no room.
        segments = settle(segments.select(
            "_file", "split", "line_no", F.array_join("parts.line", "\n").alias("line"), "after_0", "after_1",
            (F.col("line_no") - F.col("record_0")).alias("back_0"), (F.col("line_no") - F.col("record_1")).alias("back_1")))

        def begun_in(name: str) -> Column:
            return F.when(F.col("start") == 1, F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))

        in_file = W.partitionBy("_file").orderBy("split")
        last = F.max_by(F.struct("after_0", "after_1"), "line_no").alias("m")
        begun = [F.max(F.col("line_no") - F.col(f"back_{start}")).alias(f"record_{start}") for start in (0, 1)]
        whole = segments.groupBy("_file", "split").agg(*begun, last)
        whole = whole.select("_file", "split", "record_0", "record_1", "m.*").withColumn(
            "turns", F.sum(F.when(F.col("after_0") > F.col("after_1"), 1).otherwise(0)).over(in_file))
        sets = F.when(F.col("after_0") == F.col("after_1"), F.col("after_0") - F.col("turns"))
        ends = whole.withColumn("last", F.last(sets, ignorenulls=True).over(in_file)).withColumn(
            "end", _after(F.col("last"), F.lit(0), F.col("turns")))
        per_split = ends.withColumn("start", F.lag("end", 1, 0).over(in_file)).select(
            "_file", "split", "start", begun_in("record").alias("record"), begun_in("after").alias("after"))

        # The record in which a split begins, and the one that its file leaves open.
        earlier = in_file.rowsBetween(W.unboundedPreceding, -1)
        to_end = in_file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        carried = settle(per_split.select(
            "_file", "split", "start", F.max("record").over(earlier).alias("carried"),
            F.when(F.last("after").over(to_end) == 1, F.max("record").over(to_end)).alias("unclosed")).join(broken, "_file"))
        told = lookup_join(segments, carried, ["_file", "split"], "line_no").select(
            "file_id", "line_no", "line", begun_in("after").alias("after"),
            F.coalesce(F.col("line_no") - begun_in("back"), "carried").alias("record"), "unclosed")
        told = told.where("unclosed IS NULL OR record <> unclosed")
        single = (F.col("record") == F.col("line_no")) & (F.col("after") == 0)
        # Stored, so that readers who come twice join the parts once.
        several = settle(told.where(~single).groupBy("file_id", "record").agg(parts.alias("parts")).select(
            "file_id", F.col("record").alias("line_no"), F.array_join("parts.line", "\n").alias("line")))
        records = calm.unionByName(told.where(single).select("file_id", "line_no", "line")).unionByName(several)
        unclosed = carried.where("unclosed IS NOT NULL").select("file_id", "unclosed").distinct()
        if unclosed.isEmpty():
            return records
        rest = lookup_join(lines.select("file_id", "line_no", "line"), unclosed, "file_id", "line_no")
        return records.unionByName(rest.where("line_no >= unclosed").select("file_id", "line_no", "line"))
