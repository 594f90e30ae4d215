import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import line_dedup as L


def edits_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def plain(rows):
    """Brute force over (doc_id, text): cleaned texts and near counts."""
    order = sorted({(i is None, i or 0) for i, _ in rows})
    first = {}
    for doc in order:
        for i, text in rows:
            if (i is None, i or 0) == doc and text:
                for n, line in enumerate(text.split("\n")):
                    line = line.strip(" ")
                    if line:
                        first[line] = min(first.get(line, (doc, n)), (doc, n))
    lines = sorted(first, key=first.get)
    longer = [line for line in lines if len(line) >= L.NEAR_CHARS]
    near = {b for k, b in enumerate(longer) if any(edits_within_one(a, b) for a in longer[:k])}
    out = []
    for i, text in rows:
        if not text:
            out.append((i, text))
            continue
        kept = [raw for n, raw in enumerate(text.split("\n"))
                if not raw.strip(" ")
                or (first[raw.strip(" ")] == ((i is None, i or 0), n) and raw.strip(" ") not in near)]
        out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, extra=""):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r["doc_id"], r["text"]) for r in L.dedup_lines(docs).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    base = ["".join(draw.choice("abé ") for _ in range(n)).strip(" ") + "x" * 4 for n in (16, 31, 62, 63, 64, 65, 66, 126, 127, 128, 129, 200, 300)]
    made = []
    for line in base:
        for _ in range(9):
            at = draw.randrange(len(line))
            made.append(draw.choice([line, line[:at] + line[at + 1:], line[:at] + "q" + line[at:], line[:at] + "z" + line[at + 1:],
                                     line[:at] + "zz" + line[at + 2:], line + "e", line[1:]]))
    made += ["template line number %03d of the page" % k for k in range(40)] + ["short", "shart", "", "  "] * 3 + ["a" * 15, "a" * 16, "a" * 17]
    draw.shuffle(made)
    return [(k // 2 if k != 7 else None, "\n".join(made[k * 4:k * 4 + 4])) for k in range(0, len(made) // 4 + 1, 1)
            if k % 2 == 0 or k == 7]


def test_lines_match_brute_force(spark, rows):
    got, want = run(spark, rows), plain(rows)
    assert got == want
    assert sum(len(t or "") for _, t in want) < sum(len(t or "") for _, t in rows)


def test_defined_cases(spark):
    line = "a line that is long enough"
    cases = [(1, None), (2, ""), (3, line), (4, f"  {line} \nkept"), (None, line), (5, "tiny\ntiny"), (6, line[:-1]), (7, "tiny\nTiny\n\n ")]
    got = dict(run(spark, cases))
    assert got == {1: None, 2: "", 3: line, 4: "kept", None: "", 5: "tiny", 6: "", 7: "Tiny\n\n "}


def test_repeated_rows_are_one_document(spark):
    row = (1, "the very same line of text\nthe very same line of text")
    assert run(spark, [row, row]) == [(1, "the very same line of text")] * 2


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(1, "x", 2, 3)], "doc_id bigint, text string, kept int, `_lines` int")
    made = L.dedup_lines(docs)
    assert made.columns == ["doc_id", "text", "kept", "_lines", "_lines"]
    assert tuple(made.collect()[0])[:4] == (1, "x", 2, 3)


def test_giant_line(spark):
    giant = "".join(random.Random(1).choice("abcdefgh ") for _ in range(30_000)).strip(" ") + "x"
    rows = [(1, giant), (2, giant[:15_000] + "#" + giant[15_001:]), (3, giant[:100] + giant[101:]), (4, giant[:5] + "##" + giant[7:])]
    assert run(spark, rows) == plain(rows)
    assert [bool(t) for _, t in plain(rows)] == [True, False, False, True]


def test_a_bitmap_parts_rows_into_those_it_may_hold_and_the_others(spark):
    rows = spark.range(2000).select("id", F.xxhash64("id").alias("k"))
    bitmap = L.bitmap_of(rows.where("id < 3").select("k"))
    held = {r["id"] for r in L.in_bitmap(rows, F.col("k"), bitmap).collect()}
    others = {r["id"] for r in L.in_bitmap(rows, F.col("k"), bitmap, held=False).collect()}
    assert {0, 1, 2} <= held and held | others == set(range(2000)) and not held & others
    none = L.bitmap_of(rows.where("id < 0").select("k"))
    assert L.in_bitmap(rows, F.col("k"), none).count() == 0 and L.in_bitmap(rows, F.col("k"), none, held=False).count() == 2000
