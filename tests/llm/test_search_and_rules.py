"""Decontamination, quality rules and SimHash against plain versions."""

import random
import re
from math import comb

import numpy as np
import pytest
import xxhash

from plumbline.llm import decontamination as D, quality_rules as Q, simhash as S

WORDS = [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("", "n", "r", "st")]
DOCS = "doc_id bigint, text string, lang string"


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n)).capitalize() + "."


# -- decontamination ------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def leaks():
    draw = random.Random(3)
    items = [(k, f"{sentence(draw, draw.randrange(8, 40))} {sentence(draw, draw.randrange(3, 9))}") for k in range(40)]
    items += [(40, "Of."), (41, None), (42, ""), (43, sentence(draw, 90) + " " + sentence(draw, 6)), (0, items[0][1])]
    docs = []
    for k in range(120):
        text = sentence(draw, draw.randrange(0, 400))
        if k % 3 == 0:
            words, at = text.split(" "), draw.randrange(0, len(text.split(" ")))
            item = (items[draw.randrange(0, 40)] if k % 9 else items[43])[1].split(" ")
            if k % 2:
                item[len(item) // 2] = "changed"
            text = " ".join(words[:at] + item + words[at:])
        docs.append((k, text, "en"))
    return docs + [(500, None, None), (501, "", ""), (502, docs[0][1], "en"), (502, docs[0][1], "en")], items


def score_all(docs, items, stride):
    """Every passage against every item, as BM25 says, then verified."""
    rows = {(i, t): D.words_of(t) for i, t in items if D.words_of(t)}
    total, mean = len([1 for i, t in items if D.words_of(t)]), None
    lengths = [len(D.words_of(t)) for i, t in items if D.words_of(t)]
    mean = sum(lengths) / total
    df = {}
    for i, t in items:
        for w in set(D.words_of(t)):
            df[w] = df.get(w, 0) + 1
    out = {}
    for (item, item_text), words in rows.items():
        tf = {w: words.count(w) for w in words}
        norm = 1.2 * (1 - 0.75 + 0.75 * len(words) / mean)
        weight = {w: np.log1p((total - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + norm) for w, n in tf.items()}
        asked, told = D.question_and_answer(item_text)
        for k, (doc, text, _) in enumerate(docs):
            body = D.words_of(text)
            for at in range(0, max(len(body), 1), stride):
                window = body[at:at + 2 * stride]
                score = sum(weight.get(w, 0) for w in set(window)) / sum(weight.values())
                if score >= D.RETRIEVE_AT and min(D.overlap(asked, window), D.overlap(told, window)) >= D.OVERLAP:
                    out[k, doc, item] = max(out.get((k, doc, item), 0), round(float(score), 9))
    return sorted((doc, item, score) for (_, doc, item), score in out.items())


@pytest.mark.parametrize("piece_words", [D.PIECE_WORDS, 300])
def test_all_leaks_are_found(spark, leaks, piece_words):
    docs, items = leaks
    found = D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"), piece_words)
    got = sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in found.collect())
    assert got == score_all(docs, items, 96)
    assert len({g[0] for g in got}) > 25


def test_nothing_to_find(spark, leaks):
    docs, items = leaks
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contaminated(spark.createDataFrame(docs, DOCS), none).count() == 0
    some = spark.createDataFrame(items, "item_id bigint, text string")
    assert D.contaminated(spark.createDataFrame([], DOCS), some).count() == 0
    kept = D.drop_contaminated(spark.createDataFrame([(1, items[3][1], "x"), (None, "own words", "y")], "doc_id bigint, text string, `_bad` string"), some)
    assert [tuple(r) for r in kept.collect()] == [(None, "own words", "y")]


# -- quality rules --------------------------------------------------------------------------------------------------

def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    again = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again),
            len(lines), sum(a == b for a, b in zip(words, words[1:])))


def test_text_stats_match_brute_force():
    draw = random.Random(2)
    for _ in range(300):
        text = "".join(draw.choice(["a", "b", "#", " ", "\n", "\x0b", "é", " ", "|"]) for _ in range(draw.randrange(60)))
        assert Q.text_stats(text) == plain_stats(text), repr(text)
    assert Q.text_stats(None) == Q.text_stats("") == (0,) * 7


def test_binomial_tail():
    for n, p in ((50, 0.1), (400, 0.0125)):
        for seen in range(int(n * p)):
            exact = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(seen + 1))
            assert Q.chance_of_at_most(seen, n, p) == pytest.approx(exact, rel=1e-9)
    assert Q.chance_of_at_most(5, 50, 0.1) == 1.0


def test_cutoffs_keep_good_documents(spark):
    draw = random.Random(4)
    rows, labels = [], []
    for k in range(2600):
        bad = k % 13 == 0
        words = sentence(draw, 30).split(" ")
        text = " ".join(w + "%%%" for w in words) if bad else " ".join(words)
        rows.append((k, text, "en" if k % 2 else "fr"))
        if k % 5:
            labels += [(k, 0 if bad else 1)] * (1 + k % 2)
    rows += [(9000, "few words", "en"), (9001, None, None), (9002, " ".join(w + "%%" for w in WORDS[:40]), "xx")]
    docs, given = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int")
    kept = {r["doc_id"]: r["kept"] for r in Q.quality_rules(docs, given).collect()}
    assert not any(kept[k] for k in range(0, 2600, 13))
    assert all(kept[k] for k in range(2600) if k % 13)
    assert not kept[9000] and not kept[9001]
    assert kept[9002]  # no labels in this stratum, so no cutoff
    good = Q.keep_good(docs.withColumnRenamed("lang", "lang").selectExpr("*", "1 AS `_passed`"), given)
    assert good.count() == sum(kept.values()) and good.columns == ["doc_id", "text", "lang", "_passed"]
    assert Q.quality_rules(docs.limit(0), given).count() == 0
    assert Q.keep_good(docs, given.limit(0)).count() == len([k for k in rows if k[0] not in (9000, 9001)])


# -- SimHash --------------------------------------------------------------------------------------------------------

def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)
    draw = random.Random(6)
    for n in (0, 1, 2, 3, 4, 8, 9, 10, 40):
        text = "ÉA\x0b" + "  ".join(draw.choice(WORDS) for _ in range(n)) if n else "\t "
        assert S.fingerprint(text) == plain_print(text)
    assert S.fingerprint(None) == 0


def test_components_match_brute_force(spark):
    draw = random.Random(8)
    prints = []
    for _ in range(60):
        value = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 12)):
            prints.append(value)
            for _ in range(draw.randrange(0, 5)):
                value ^= 1 << draw.randrange(64)
    rows = [(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(prints)]
    lead = list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                lead[max(x, y)] = min(x, y)
    found = S.classes(spark.createDataFrame(rows, "doc_id bigint, fp bigint"))
    got = {r["fp"]: r["component_id"] for r in found.collect()}
    assert [got[v] for _, v in rows] == [find(k) for k, _ in rows]
    # Any allocation finds the same links.
    frame = spark.createDataFrame([(v,) for v in {v for _, v in rows}], "fp bigint")
    groups = [list(range(k, 64, 3)) for k in range(3)]
    want = {tuple(sorted((a, b))) for a in got for b in got if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    for thresholds in ((0, 0, 1), (1, 0, 0), (2, 0, -1)):
        plan = [(g, t) for g, t in zip(groups, thresholds) if t >= 0]
        assert {tuple(r) for r in S.links(frame, plan).collect()} == want


def test_plan_follows_the_number_of_fingerprints():
    even = lambda n: np.full((64, 64), n // 4) + np.diag([n // 4] * 64)
    for n in (10, 10**5, 10**7, 10**10):
        plan = S.plan_partitions(n, even(n))
        bits = [b for g, _ in plan for b in g]
        assert len(bits) == len(set(bits))
    assert [t for _, t in S.plan_partitions(10**5, even(10**5))] == [0, 0, 0, 0]
    assert [t for _, t in S.plan_partitions(10**10, even(10**10))] == [1, 1]


def test_a_class_without_doc_ids_links_others(spark):
    prints = spark.createDataFrame([(9, 0b1111), (None, 0b11), (7, 0), (None, 0b1 << 40 | 0xFF << 50)], "doc_id bigint, fp bigint")
    got = sorted((r["fp"], r["lead"], r["component_id"]) for r in S.classes(prints).collect())
    assert got == [(0, 7, 7), (0b11, None, 7), (0b1111, 9, 7), (0b1 << 40 | 0xFF << 50, None, None)]


def test_near_duplicate_cases(spark):
    draw = random.Random(9)
    text = sentence(draw, 200)
    rows = [(5, text, "a"), (3, text.upper(), "b"), (9, None, "c"), (8, "", "d"), (None, text, "e"), (7, sentence(draw, 50), "f"), (5, text, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (9, 8), (8, 8), (None, 3), (7, 7)], key=str)
    assert sorted((r["doc_id"] for r in S.keep_leads(docs).collect()), key=str) == [3, 7, 8, None]
    assert S.near_duplicates(docs.limit(0)).count() == 0
