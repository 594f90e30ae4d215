"""The pipeline against a plain version, the registry, and the SQL beside the queries."""

import random
import re
from collections import Counter

import corpus_pipeline
import duckdb
import pyarrow.parquet as pq
import pytest

from plumbline.llm import decontamination as D, line_dedup as L, pieces as T, simhash as S
from plumbline.llm.catalogue import LLM_ORACLES, LLM_QUERIES

SYLLABLES = ["ba", "de", "fi", "go", "lu", "mer", "nos", "tir"]


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in LLM_QUERIES if name.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in LLM_QUERIES
    assert set(LLM_ORACLES) <= set(LLM_QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Copies, near copies, repeated lines, a leaked item, junk, nulls."""
    draw = random.Random(11)
    say = lambda n: " ".join("".join(draw.choice(SYLLABLES) for _ in range(draw.randrange(1, 4))) for _ in range(n)).capitalize() + "."
    item = say(30)
    common = say(12)
    texts = ["\n".join(say(draw.randrange(20, 60)) for _ in range(4)) for _ in range(40)]
    texts += [texts[0], texts[1], "\n".join([texts[2], common]), "\n".join([texts[3], common])]
    texts += ["short", None, "", "same words " * 40, texts[5] + " " + item, say(40) + " " + item + " " + say(40), texts[6][:-1]]
    # Near copies in one long line, which line dedup leaves: some words in a hundred replaced.
    for _ in range(4):
        words = say(220).split()
        texts.append(" ".join(words))
        for at in draw.sample(range(5, 215), 4):
            words[at] = "replaced"
        texts.append(" ".join(words))
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, item


def plain_pipeline(rows, item):
    """The stages in plain Python; no cutoff passes the test with so few labels, so stage one is the base rules."""
    def good(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        count = Counter(windows)
        marked = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
        return len(words) >= 10 and 100 * len(marked) <= 20 * len(words)

    docs = {k: t for k, t, *_ in rows if good(t)}
    first: dict[str, tuple] = {}
    for k, t in docs.items():
        for n, line in enumerate(t.split("\n")):
            if line.strip(" "):
                first.setdefault(line.strip(" "), (k, n))
    lines = [line for line in first if len(line) >= L.NEAR_CHARS]
    near = {b for j, b in enumerate(lines) for a in lines[:j] if abs(len(a) - len(b)) < 2 and (a[:8] == b[:8] or a[-8:] == b[-8:])
            and duckdb.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0] <= 1}
    docs = {k: "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip(" ")
                         or (first[x.strip(" ")] == (k, n) and x.strip(" ") not in near)) for k, t in docs.items()}
    sets = {}
    for k, t in docs.items():
        words = t.lower().split()
        sets[k] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    lead = {k: k for k in docs}
    for _ in docs:  # labels spread to a fixed point
        before = dict(lead)
        for a in docs:
            for b in docs:
                if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    lead[a] = lead[b] = min(lead[a], lead[b])
        if lead == before:
            break
    beyond = [k for k in docs if lead[k] != k and (S.fingerprint(docs[k]) ^ S.fingerprint(docs[lead[k]])).bit_count() > 3]
    assert beyond, "no pair that fingerprints miss"
    docs = {k: t for k, t in docs.items() if lead[k] == k}
    asked, _ = D.question_and_answer(item)
    docs = {k: t for k, t in docs.items() if D.overlap(asked, D.words_of(t)) < D.OVERLAP}
    library = T.load(T.MODEL).library
    return sorted((k, tuple(library.encode(t))) for k, t in docs.items())


def test_pipeline_matches_a_plain_version(spark, corpus):
    folder, rows, item = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    want = plain_pipeline(rows, item)
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["round_trip"] for r in got) and 35 < len(want) < len(rows)


def test_stages_keep_the_columns(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), folder).count() == 0
    cleaned = corpus_pipeline.lines(spark, docs, folder).collect()
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cleaned)


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_queries_match_their_sql(spark, tables, name):
    frame = LLM_QUERIES[name](spark, tables)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    for table in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({LLM_ORACLES[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    if "collocations" not in name:
        assert len(got) == pq.read_metadata(f"{tables}/{'pages' if 'warc' in name else 'documents'}.parquet").num_rows
