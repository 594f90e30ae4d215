"""Text lines made from the given tables, written as files with line breaks in quoted cells and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import fresh_folder, shuffles_freed
from plumbline.sources.given_ledger import made_lines
from plumbline.sources.given_rolls import roll_lines
from plumbline.sources.lines import read_records


def through_files(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """`lines` (file_id, line_no, line) as one text file for each file_id, read back as records."""
    path = fresh_folder(spark, "files")
    dealt = lines.select("file_id", "line_no", "line").repartition("file_id")
    named = dealt.select(F.hex("file_id").alias("name"), "line_no", "line").sortWithinPartitions("name", "line_no")
    with shuffles_freed(spark):
        named.select("name", "line").write.partitionBy("name").text(path)
    name = F.regexp_extract("file_id", "name=([0-9A-F]+)", 1)
    return read_records(spark, f"{path}/*").withColumn("file_id", F.decode(F.unhex(name), "UTF-8"))


def broken_rolls(spark: SparkSession, folder: str) -> DataFrame:
    """Rolls in which the tenants of comma-separated files go over two lines."""
    bare = F.regexp_replace("line", r'(^|,)([^",\t]* )Co ([0-9]+)(?=,|$)', '$1"$2\nCo $3"')
    return through_files(spark, roll_lines(spark, folder).withColumn("line", F.regexp_replace(bare, r'("[^",\n]* )Co (?=[0-9])', "$1\nCo ")))


def broken_ledgers(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger exports in which the account names of comma- and semicolon-separated files go over two lines."""
    name = F.regexp_replace("line", r"(?<=[,;])([A-Z]+) goods(?=[,;])", '"$1\ngoods"')
    return through_files(spark, made_lines(spark, folder).withColumn("line", name))
