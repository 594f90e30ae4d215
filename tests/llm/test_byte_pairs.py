"""Byte-level BPE against the public library, and the perfect hash."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from plumbline.llm import byte_pairs as B

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHAPE = "doc_id bigint, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(B.read_ranks(RANKS))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def ids_of(vocabulary, text):
    return B.encode_batch(vocabulary, regex.compile(public_tokenizers.PATTERN), [text])[0].tolist()


def test_the_perfect_hash_is_minimal(vocabulary):
    table = vocabulary.table
    at = table.slot_of(B.hashes(vocabulary.entries))
    assert sorted(at.tolist()) == list(range(len(vocabulary.entries)))
    assert vocabulary.whole(vocabulary.entries).tolist() == list(range(len(vocabulary.entries)))
    assert vocabulary.whole([b"\xff\xfe\xfd no such entry", b""]).tolist() == [-1, -1]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1_000])
def test_perfect_hashes_of_small_sets(size):
    keys = [str(k).encode() for k in range(size)]
    assert sorted(B.PerfectHash(keys).slot_of(B.hashes(keys)).tolist()) == list(range(size))


def test_random_strings_as_the_library(vocabulary, library):
    draw = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "​", "'s", "'ll", "'", "é", "日", "1", "²", "Ⅷ",
             "😀", "<|endoftext|>", "\x00", "́", "ß", ".", ",", "ab" * 40, "　", "﻿", "Word", " word"]
    for _ in range(1_500):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(0, 40)))
        assert ids_of(vocabulary, text) == library.encode_ordinary(text), repr(text)


def test_giant_words_and_texts_as_the_library(vocabulary, library, monkeypatch):
    draw = random.Random(2)
    giant = "".join(draw.choice("abcdefgh") for _ in range(20_000))
    assert ids_of(vocabulary, giant) == library.encode_ordinary(giant)
    text = " ".join("".join(draw.choice("abc \n'1") for _ in range(9)) for _ in range(3_000))
    monkeypatch.setattr(B, "CUT_AFTER", 64)
    monkeypatch.setattr(B, "MOST_TOKENS", 100)
    assert len(list(B.stretches(text, 64))) > 50 and "".join(B.stretches(text, 64)) == text
    assert ids_of(vocabulary, text) == library.encode_ordinary(text)


def test_encode_and_decode_frames(spark, library):
    rows = [(1, "Hello world, hello  again"), (None, "x"), (2, None), (3, ""), (3, "déjà vu\n\n"), (3, "déjà vu\n\n"), (4, "word " * 5_000)]
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], SHAPE)
    encoded = B.encode(docs, RANKS, public_tokenizers.PATTERN)
    decoded = B.decode(encoded, RANKS).collect()
    want = sorted(((k, library.encode_ordinary(t or ""), (t or "").encode()) for k, t in rows), key=str)
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in decoded), key=str) == want
    assert B.decode(B.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_ids_outside_the_vocabulary_cannot_be_decoded(vocabulary):
    with pytest.raises(ValueError):
        vocabulary.bytes_of(np.array([10 ** 6]))


def test_the_query_as_the_library(spark, tables, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()}
    rows = B.op13_byte_bpe(spark, tables).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_a_token_is_resolved_once_for_all_batches(vocabulary, library, monkeypatch):
    monkeypatch.setattr(B, "MEMO", 60)
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdexyzé ") for _ in range(draw.randrange(1, 12))) for _ in range(120)]
    split, known, asked = regex.compile(public_tokenizers.PATTERN), B.Resolved(vocabulary), []
    resolve = vocabulary.resolve
    monkeypatch.setattr(vocabulary, "resolve", lambda tokens: asked.append(tokens) or resolve(tokens))
    text = " ".join(words[:8])
    for _ in range(3):
        ids, counts = B.encode_batch(vocabulary, split, [text, None, text], known)
        want = library.encode(text, disallowed_special=())
        assert ids.tolist() == want * 2 and counts.tolist() == [len(want), 0, len(want)]
    assert len(asked) == 1
    # Beyond the bound all are forgotten, and the ids stay the same.
    for at in range(0, 120, 20):
        text = "\n".join(words[at:at + 20])
        assert B.encode_batch(vocabulary, split, [text], known)[0].tolist() == library.encode(text, disallowed_special=())
        assert len(known.number) <= 60 + len(split.findall(text))
