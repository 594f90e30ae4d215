"""Near copies against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import near_copies as N, simhash as S

WORDS = [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("", "n", "r", "st")]
DOCS = "doc_id bigint, text string"


def runs(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    lead = {k: k for k, _ in rows}
    sets = {k: runs(t) for k, t in rows}
    for _ in range(len(rows)):
        before = dict(lead)
        for a in sets:
            for b in sets:
                one, two = sets[a], sets[b]
                if one == two or 5 * len(one & two) >= 4 * len(one | two):
                    lead[a] = lead[b] = min(lead[a], lead[b])
        if lead == before:
            return lead


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(21)
    say = lambda n: [draw.choice(WORDS) for _ in range(n)]
    passage, out = say(30), []
    for k in range(24):
        words = say(draw.randrange(30, 200)) + (passage if k % 3 == 0 else [])
        out.append(words)
        for _ in range(draw.randrange(0, 4)):
            words = list(words)
            for _ in range(draw.randrange(1, 1 + max(1, len(words) // 40))):
                words[draw.randrange(len(words))] = draw.choice(WORDS)
            out.append(words)
    out += [["One"], ["one"], [], [], say(4)]
    draw.shuffle(out)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize("common_from", [N.COMMON_FROM, 2])
def test_all_similar_texts_are_linked(spark, rows, monkeypatch, common_from):
    monkeypatch.setattr(N, "COMMON_FROM", common_from)
    got = {r["doc_id"]: r["component_id"] for r in N.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == plain_groups(rows)
    assert len(set(got.values())) < len(rows)


def test_the_stage_takes_near_copies_beyond_three_bits(spark, tmp_path):
    draw = random.Random(5)
    words = [draw.choice(WORDS) for _ in range(120)]
    copy = list(words)
    for at in (20, 70):
        copy[at] = "other"
    one, two = " ".join(words), " ".join(copy)
    assert (S.fingerprint(one) ^ S.fingerprint(two)).bit_count() > S.MOST_DIFFERENT
    docs = spark.createDataFrame([(2, two), (1, one), (None, one), (3, "others say something else here")], DOCS)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 3, None]
    assert N.similar_groups(docs.limit(0)).count() == 0


def test_the_stage_takes_what_fingerprints_link(spark, tmp_path):
    """Texts that repeat one passage have few distinct runs, so another ending makes the sets unlike, not the fingerprints."""
    draw = random.Random(4)
    say = lambda n: [draw.choice(WORDS) for _ in range(n)]
    texts = []
    while len(texts) < 2:
        passage = say(30) * 12
        one, two = " ".join(passage + say(12)), " ".join(passage + say(12))
        if (S.fingerprint(one) ^ S.fingerprint(two)).bit_count() <= S.MOST_DIFFERENT:
            texts = [one, two]
    assert 5 * len(runs(texts[0]) & runs(texts[1])) < 4 * len(runs(texts[0]) | runs(texts[1]))
    # The third is alike to the second by its runs alone, so both ways together make one group.
    words = texts[1].split()
    third = " ".join(["other", *words[1:30], *words[-12:-1], "else"])
    assert 5 * len(runs(third) & runs(texts[1])) >= 4 * len(runs(third) | runs(texts[1]))
    assert all((S.fingerprint(third) ^ S.fingerprint(t)).bit_count() > S.MOST_DIFFERENT for t in texts)
    docs = spark.createDataFrame([(3, third), (2, texts[1]), (1, texts[0]), (4, " ".join(say(60))), (None, texts[1])], DOCS)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 4, None]


def test_a_text_without_doc_id_links_others(spark):
    """The first and the last are less than 0.8 alike; what lies between them has no doc_id."""
    draw = random.Random(8)
    words = [draw.choice(WORDS) for _ in range(120)]
    between, last = list(words), list(words)
    between[20] = last[20] = "other"
    last[70] = "another"
    last[100] = "third"
    texts = [" ".join(w) for w in (words, between, last)]
    one, two, three = map(runs, texts)
    assert 5 * len(one & two) >= 4 * len(one | two) and 5 * len(two & three) >= 4 * len(two | three)
    assert 5 * len(one & three) < 4 * len(one | three)
    found = N.similar_groups(spark.createDataFrame([(1, texts[0]), (None, texts[1]), (None, texts[1]), (2, texts[2])], DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in found) == [("1", 1), ("2", 1), ("None", 1), ("None", 1)]


def test_texts_that_share_a_passage_alone_are_not_compared(spark, monkeypatch):
    draw = random.Random(13)
    say = lambda n: [draw.choice(WORDS) for _ in range(n)]
    passage = say(12)
    rows = [(k, " ".join(say(60) + passage + say(60))) for k in range(40)]
    compared, likely_pairs = [], N.likely_pairs

    def told(pairs, classes):
        compared.append(pairs.count())
        return likely_pairs(pairs, classes)

    # Without common runs, the passage stands in the prefixes.
    monkeypatch.setattr(N, "COMMON_FROM", 10 ** 6)
    monkeypatch.setattr(N, "likely_pairs", told)
    got = {r["doc_id"]: r["component_id"] for r in N.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == plain_groups(rows) == {k: k for k in range(40)}
    assert sum(compared) < len(rows) // 2


def test_prefixes_of_similar_sets_share_as_many_runs_as_asked_for(spark):
    draw, cases = np.random.default_rng(3), []
    for n in [*range(1, 40), 100, 400, 1000]:
        for gone in {0, n // 12, n // 9, n // 6, n // 5}:
            one = np.unique(draw.integers(-2 ** 63, 2 ** 63 - 1, n))
            for new in {0, n // 12, n // 9, n // 4}:
                two = np.unique(np.concatenate([one[draw.permutation(n)[gone:]], draw.integers(-2 ** 63, 2 ** 63 - 1, new)]))
                both = len(np.intersect1d(one, two))
                if 5 * both >= 4 * (n + len(two) - both):
                    common = one[:n // 3]
                    alike = len(np.intersect1d(N.prefix_of(one, common), N.prefix_of(two, common)))
                    cases.append((n, len(two), alike))
    found = spark.createDataFrame(cases, "n int, m int, alike int").withColumn("least", N.least_shared(F.col("n"), F.col("m"))).collect()
    assert len(found) > 100 and max(r["least"] for r in found) > 50
    assert all(r["alike"] >= r["least"] >= 1 for r in found)


def test_passages_that_a_sample_misses_leave_the_prefixes(spark, monkeypatch):
    draw = random.Random(17)
    say = lambda n: [draw.choice(WORDS) for _ in range(n)]
    passage = say(30)
    docs = spark.createDataFrame([(k, " ".join(say(60) + passage + say(60))) for k in range(40)], DOCS)
    # The sample tells of no common run.
    monkeypatch.setattr(N, "COMMON_FROM", 10 ** 6)
    prefixes = N.prints_of(docs, "doc_id", "text").select(F.explode("prefix").alias("run"))
    crowded = prefixes.groupBy("run").count().where("count >= 16").count()
    # Counted once, so a run that moves up may be left.
    assert crowded <= 2


def test_links_do_not_depend_on_which_runs_are_crowded(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "CROWDED_FROM", 2, raising=False)
    got = {r["doc_id"]: r["component_id"] for r in N.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == plain_groups(rows)
