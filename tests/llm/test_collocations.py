"""Collocations against a plain count, also where suffixes are routed as a whole and chunks are small."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import collocations as C

SHAPE = "doc_id bigint, text string, lang string, phrase string, rank int"


def plain(rows, least, top=2_000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i:i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    frequent = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    covered = {(lang, w[i:i + m]) for (lang, w), a in frequent.items() for m in range(2, len(w)) for i in range(len(w) - m + 1)
               if a >= frequent[lang, w[i:i + m]]}
    out = {}
    for (lang, words), a in frequent.items():
        if (lang, words) not in covered:
            cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]])
                    for k in range(1, len(words))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right, totals[lang]))
    return sorted((lang, rank, phrase.decode(), -a, left, right, n, -score) for lang, found in out.items()
                  for rank, (score, a, phrase, left, right, n) in enumerate(sorted(found)[:top], 1))


def answer(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    words = ["Of", "the", "in", "red", "blue", "Sea", "port", "Ärger", "日本", " x", "a\x1cb", "is"]
    say = lambda n: " ".join(draw.choice(words) + draw.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(n))
    texts = [(draw.choice(["en", "en", "en", "de", None]), say(draw.randrange(1, 120))) for _ in range(150)]
    texts += [("en", "of the red sea port")] * 60 + [("en", None), ("en", ""), ("fr", " .,; "), ("und", "of the of the of the " * 9)]
    return texts


def frame(spark, rows):
    return spark.createDataFrame([(None if k % 7 else k, t, lang, "clash", 1) for k, (lang, t) in enumerate(rows)], SHAPE).repartition(3)


@pytest.mark.parametrize("chunk, hot, sort_rows", [(C.CHUNK_WORDS, C.HOT, C.SORT_ROWS), (200, C.HOT, 50), (500, 1, 40)])
def test_equals_the_plain_count(spark, rows, monkeypatch, chunk, hot, sort_rows):
    monkeypatch.setattr(C.chunks, "__defaults__", (chunk,))
    monkeypatch.setattr(C, "HOT", hot)
    monkeypatch.setattr(C, "SORT_ROWS", sort_rows)
    for least in (5, 20):
        want = plain(rows, least)
        assert answer(C.collocations(frame(spark, rows), least=least)) == want and len(want) > 5
    assert answer(C.collocations(frame(spark, rows), least=5, top=3)) == plain(rows, 5, 3)


def test_empty_tables_have_no_phrases(spark, rows):
    assert C.collocations(frame(spark, rows).limit(0)).count() == 0
    assert C.collocations(frame(spark, [("en", None), (None, "")])).count() == 0


def test_repeated_rows_count(spark):
    docs = frame(spark, [("en", "very deep water")] * 40 + [("en", "very shallow water")] * 3)
    assert answer(C.collocations(docs, least=40)) == plain([("en", "very deep water")] * 40 + [("en", "very shallow water")] * 3, 40)


def test_three_way_counts_and_abandons():
    draw = random.Random(5)
    table = [[draw.randrange(1, 4) if d < draw.randrange(1, 6) else 0 for d in range(5)] for _ in range(300)]
    table = [row[:row.index(0)] + [0] * (5 - row.index(0)) if 0 in row else row for row in table]
    weights = np.array([draw.randrange(1, 5) for _ in table])
    want = Counter()
    for row, weight in zip(table, weights.tolist()):
        for depth in range(3, 6):
            if row[depth - 1]:
                want[tuple(row[:depth])] += weight
    for least in (1, 10, 40):
        got = {tuple(table[r][:d]): w for r, d, w in C.three_way(np.array(table), weights, least)}
        assert got == {k: w for k, w in want.items() if w >= least}


def test_long_texts_are_split_without_cutting_words(monkeypatch):
    text = "one two three. " * 500 + "x" * 300 + " end"
    whole = [t for ts in C.tokens_of(text) for t in ts]
    monkeypatch.setattr(C, "TEXT_BYTES", 40)
    assert [t for ts in C.tokens_of(text) for t in ts] == whole
