"""Quoted line breaks in delimited files, against Python's csv, with files cut at every byte."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.delimited import cells_of, leaves_open
from plumbline.session import FREE_SHUFFLES, settle, shuffles_freed
from plumbline.sources import events as src, given_ledger as G, lines as L
from plumbline.sources.given_files import broken_ledgers
from plumbline.schemas import EVENTS
from tests.test_sources import ROWS


def written(draw, rows):
    """A file of random cells; some have line breaks, marks and quotes."""
    def cell():
        text = "".join(draw.choice(["a", "b", "\n", ",", '"', " ", "é", ""]) for _ in range(draw.randrange(0, 6)))
        bare = not any(c in text for c in ',\n"') and draw.random() < 0.7
        return text if bare else '"' + text.replace('"', '""') + '"' + draw.choice(["", "", "x"])

    def inches():
        return draw.choice(['5"', 'a"b"', "q"])

    return "\n".join(",".join(draw.choice([cell, cell, inches])() or "z" for _ in range(draw.randrange(1, 5))) for _ in range(rows)) + "\n"


def cells(spark, folder):
    found = L.read_records(spark, folder).withColumn("cells", cells_of(F.col("line"), F.lit(",")))
    by_file = {}
    for row in found.orderBy("file_id", "line_no").collect():
        by_file.setdefault(row["file_id"].rsplit("/", 1)[1], []).append(row["cells"])
    return by_file


def want(path):
    with open(path, newline="") as file:
        return [[c.strip() for c in row] or [""] for row in csv.reader(file)]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 27])
def test_records_as_the_csv_module(spark, tmp_path, size):
    draw = random.Random(6)
    for k in range(5):
        (tmp_path / f"{k}.csv").write_text(written(draw, 12 if size == 1 else 40), newline="")
    (tmp_path / "calm.csv").write_text('1,"a, b",2\n\n3,4"x,"5"\n', newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size if size > 1 else 16))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = cells(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {p.name: want(p) for p in tmp_path.glob("*.csv")}


@pytest.mark.parametrize("at", [0, 5, 9, 16, 20, 23, 31, 40])
def test_a_file_cut_at_every_line_and_byte(spark, at):
    """The state scan alone, with a split that begins at any place."""
    text = 'a,"b\nc ""q""\n",d\ne\n"\n\n",f"g\n"h","i\nj"k,l\nm,"n"\n'
    rows, place = [], 0
    for line in text.split("\n")[:-1]:
        rows.append(("f", 0 if place < at else 1, place, line))
        place += len(line) + 1
    found = L.joined_records(spark.createDataFrame(rows, "file_id string, split long, line_no long, line string"))
    got = [r["line"] for r in found.orderBy("line_no").collect()]
    assert got == ['a,"b\nc ""q""\n",d', "e", '"\n\n",f"g', '"h","i\nj"k,l', 'm,"n"']


def test_a_quote_that_never_closes_opens_nothing(spark):
    rows = [("f", k // 2, k, line) for k, line in enumerate(['a,"x', 'y",b', 'c,"open', "d", 'e,"f"', "g"])]
    rows += [("g", 0, 0, 'p,"q'), ("h", 0, 0, "plain"), ("h", 0, 1, '1,"2"')]
    found = L.joined_records(spark.createDataFrame(rows, "file_id string, split long, line_no long, line string"))
    got = sorted((r["file_id"], r["line_no"], r["line"]) for r in found.collect())
    # The quote of `e,"f"` would close the open one, as in any reader.
    assert got == [("f", 0, 'a,"x\ny",b'), ("f", 2, 'c,"open\nd\ne,"f"'), ("f", 5, "g"), ("g", 0, 'p,"q'), ("h", 0, "plain"), ("h", 1, '1,"2"')]
    rows = [("f", 0, 0, 'a,"open'), ("f", 1, 1, "b"), ("f", 2, 2, "c,d")]
    found = L.joined_records(spark.createDataFrame(rows, "file_id string, split long, line_no long, line string"))
    assert sorted(r["line"] for r in found.collect()) == ['a,"open', "b", "c,d"]
    assert L.joined_records(spark.createDataFrame([], "file_id string, split long, line_no long, line string")).count() == 0


def test_lines_are_dealt_by_split_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(L, "settle", lambda df: stored.append(df.columns) or settle(df))
    rows = [("f", k // 3, k, line) for k, line in enumerate(['a,"x', 'y",b', "c", 'd,"', "e", '"', "f"])]
    found = L.joined_records(spark.createDataFrame(rows, "file_id string, split long, line_no long, line string"))
    assert [r["line"] for r in found.orderBy("line_no").collect()] == ['a,"x\ny",b', "c", 'd,"\ne\n"', "f"]
    assert sum("line" in columns and "split" in columns for columns in stored) == 1


def test_records_within_a_split_are_joined_where_they_were_dealt(spark, monkeypatch):
    stored = {}

    def told(df):
        out = settle(df)
        if "line" in df.columns:
            stored["split" in df.columns] = stored.get("split" in df.columns, 0) + out.count()
        return out

    monkeypatch.setattr(L, "settle", told)
    lines = [line for k in range(50) for line in (f'{k},"x', f'y",{k}')]
    # Line 50 goes on in the second split, and line 0 would close a cell that were open before it.
    rows = [("f", 0 if k < 51 else 1, k, line) for k, line in enumerate(lines)]
    found = L.joined_records(spark.createDataFrame(rows, "file_id string, split long, line_no long, line string"))
    assert [tuple(r) for r in found.orderBy("line_no").collect()] == [("f", 2 * k, f'{k},"x\ny",{k}') for k in range(50)]
    assert stored == {True: 52, False: 2}


def test_broken_ledgers_are_made_without_a_stored_copy_or_a_join_run_twice(spark, tables, monkeypatch):
    stored, spread_out = [], []
    monkeypatch.setattr(G, "settle", lambda df: stored.append(df.columns) or settle(df))
    monkeypatch.setattr(G, "spread", lambda df: spread_out.append(df.columns) or df)
    assert broken_ledgers(spark, tables).count() > spark.read.parquet(f"{tables}/lineitem.parquet").count()
    assert not stored and len(spread_out) == 1 and all(c.startswith("l_") for c in spread_out[0])


def test_shuffles_are_freed_within_alone(spark):
    before = spark.conf.get(FREE_SHUFFLES, None)
    with shuffles_freed(spark):
        with shuffles_freed(spark):
            pass
        assert spark.conf.get(FREE_SHUFFLES) == "true"
    assert spark.conf.get(FREE_SHUFFLES, None) == before


def test_cells_after_a_closing_quote_and_open_cells(spark):
    df = spark.createDataFrame([('"a"x,b',), ('100,"Acme',), ('a"b,"c ""d"""',), ('"x\ny",2',)], "line string")
    got = [r[0] for r in df.select(cells_of(F.col("line"), F.lit(","))).collect()]
    assert got == [["ax", "b"], ["100", "Acme"], ['a"b', 'c "d"'], ["x\ny", "2"]]
    states = df.select(leaves_open(F.col("line"), False), leaves_open(F.col("line"), True)).collect()
    assert [tuple(r) for r in states] == [(False, False), (True, False), (False, False), (False, False)]


def test_exports_are_read_back_by_our_own_reader(spark, tmp_path):
    events = spark.createDataFrame(ROWS, EVENTS).withColumn("event", F.concat("event", F.lit('\nwith "two", lines\n')))
    rows = events.withColumn("raw_app", F.col("app")).withColumn("is_internal", F.lit(False))
    src.export_csv(src.raw_export(rows).coalesce(1), str(tmp_path / "csv"))
    found = L.read_records(spark, str(tmp_path / "csv")).orderBy("line_no").select(cells_of(F.col("line"), F.lit(",")).alias("c")).collect()
    assert [r["c"][3] for r in found[1:]] == [(r[3] + '\nwith "two", lines\n').strip() for r in ROWS]
