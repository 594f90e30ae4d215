"""Leaks with changed words."""

import random

import pyarrow.parquet as pq
import pytest

from plumbline.llm import decontamination as D


def index_of(items):
    rows = [{"item_id": k, "text": t, "words": D.words_of(t)} for k, t in enumerate(items)]
    df = {}
    for row in rows:
        for w in set(row["words"]):
            df[w] = df.get(w, 0) + 1
    for row in rows:
        row["df"] = {w: df[w] for w in row["words"]}
    return D.build_index(rows, len(rows), sum(len(r["words"]) for r in rows) / len(rows), max(D.STRIDE, *(len(r["words"]) for r in rows)))


@pytest.fixture(scope="module")
def items(tables):
    return pq.read_table(f"{tables}/benchmark.parquet")["text"].to_pylist()[:60]


def test_every_one_word_edit_of_an_item_is_found(items):
    index = index_of(items)
    texts, want = [], []
    for place, item in enumerate(index.item_ids):
        words = D.words_of(items[item])
        for at in range(len(words)):
            texts.append(" ".join(["before"] * 9 + words[:at] + ["xyzzy"] + words[at + 1:] + ["after"] * 9))
            want.append(place)
    found = {(place, item) for place, item, *_ in D.find_items(index, texts)}
    assert len(texts) > 500
    lost = [(k, texts[k]) for k, place in enumerate(want) if (k, place) not in found]
    assert not lost, (len(lost), len(texts), lost[:3])


def test_other_texts_of_the_same_words_are_no_leaks(items):
    index = index_of(items)
    draw = random.Random(1)
    mixed = []
    for item in items:
        words = D.words_of(item)
        draw.shuffle(words)
        mixed.append(" ".join(words))
    assert not [row for row in D.find_items(index, mixed) if len(index.questions[row[1]]) > 5]


def test_judging():
    asked, told = "what is the name of the river".split(), ["rhine"]
    assert D.judge(asked, told, "so what is the name of the river rhine then".split()) == (1.0, 1.0)
    assert D.judge(asked, told, "so what is the name of the river elbe then".split()) == (1.0, 0.0)
    assert D.judge(asked, told, "what was it the big name that of all is the long river rhine".split()) is None
    assert D.judge(["of"], [], ["on"]) is None
