"""Byte-level BPE: texts into ids by the ranks of a vocabulary, and back.

A text is split into pre-tokens by the vocabulary's pattern. The pre-tokens that are new to a task go through two tiers. The first
is a minimal perfect hash over the vocabulary's entries (hash and displace: a key's bucket has a displacement, and both give
the key's slot; there are as many slots as entries), which resolves every pre-token that is an entry itself: one probe and one
comparison with the entry in the slot. The second takes the misses: their bytes are a linked list, the pairs of neighbours that
an entry joins wait in a heap by (rank, place), and the least is joined until none is left.

The vocabulary is read once, on the driver, and broadcast with its tables: a few numbers per entry, whatever the corpus.

Defined cases: a null text is an empty one and has no ids; texts of any length are cut at single spaces between other
characters, where no pre-token can cross, so that a batch holds a bounded number of pre-tokens (a longer stretch without such a
place is taken whole); strings of special tokens are ordinary text; repeated rows and null doc_ids are rows like others;
other columns are ignored; an empty table gives an empty result; ids outside the vocabulary cannot be decoded and raise an error;
null ids decode to nothing.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.batches import small_batches

# Keys per bucket of the perfect hash, on average, and displacements tried at once.
BUCKET_KEYS = 4
TRIES = 512
MIX = np.uint64(0x9E3779B97F4A7C15)
# Characters after which a text is cut, and pre-tokens resolved together.
CUT_AFTER = 1 << 18
MOST_TOKENS = 1 << 18
# Pre-tokens, and merged ones, that a task remembers, and bytes of the longest merged one.
MEMO, MEMO_BYTES = 1 << 18, 64


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file (base64 and rank on each line), by rank."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, file)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks of {path} have gaps")
    return [ranks[rank] for rank in range(len(ranks))]


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def slots(hashed: np.ndarray, displaced: np.ndarray, size: int) -> np.ndarray:
    """Slot of every hash under its displacement."""
    mixed = (hashed + displaced.astype(np.uint64) * MIX)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash: `slot_of` is a one-to-one map of the keys onto 0 … number of keys - 1."""

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // BUCKET_KEYS)
        # Displacement of every bucket; a negative one is the slot itself, for buckets of one key.
        self.displacement = np.zeros(self.buckets, np.int64)
        hashed = hashes(keys)
        if len(np.unique(hashed)) < self.size:
            raise ValueError("two keys have one hash")
        bucket = self._bucket(hashed)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(counts)
        free = np.ones(self.size, bool)
        singles = []
        for b in np.argsort(-counts, kind="stable"):
            members = hashed[order[ends[b] - counts[b]:ends[b]]]
            if len(members) == 1:
                singles.append(b)
            elif len(members):
                self.displacement[b] = self._place(members, free)
        self.displacement[singles] = -1 - np.flatnonzero(free)
        # Entry of every slot.
        self.key_at = np.empty(self.size, np.int64)
        self.key_at[self.slot_of(hashed)] = np.arange(self.size)

    def _bucket(self, hashed: np.ndarray) -> np.ndarray:
        return ((hashed >> np.uint64(17)) % np.uint64(self.buckets)).astype(np.int64)

    def _place(self, members: np.ndarray, free: np.ndarray) -> int:
        """The first displacement that puts all members on free slots of their own, which it takes."""
        for start in range(0, 1 << 31, TRIES):
            tried = np.arange(start, start + TRIES)
            at = slots(members[None, :], tried[:, None], self.size)
            apart = np.sort(at, axis=1)
            fits = free[at].all(axis=1) & (apart[:, 1:] != apart[:, :-1]).all(axis=1)
            if fits.any():
                best = int(np.argmax(fits))
                free[at[best]] = False
                return start + best
        raise ValueError("no displacement fits")

    def slot_of(self, hashed: np.ndarray) -> np.ndarray:
        shift = self.displacement[self._bucket(hashed)]
        return np.where(shift < 0, -1 - shift, slots(hashed, np.maximum(shift, 0), self.size))


class Vocabulary:
    """Entries by rank, their perfect hash, and all bytes in a row for decoding."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.ranks = {entry: rank for rank, entry in enumerate(entries)}
        self.table = PerfectHash(entries)
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.all_bytes = np.frombuffer(b"".join(entries), np.uint8)
        self._remember()

    def _remember(self) -> None:
        self.remembered = lru_cache(maxsize=MEMO)(self.merged)

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "remembered"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._remember()

    def whole(self, tokens: list[bytes]) -> np.ndarray:
        """Rank of every token that is an entry, -1 for others."""
        if not tokens:
            return np.zeros(0, np.int64)
        found = self.table.key_at[self.table.slot_of(hashes(tokens))]
        entries = self.entries
        return np.array([rank if entries[rank] == token else -1 for rank, token in zip(found.tolist(), tokens)], np.int64)

    def merged(self, token: bytes) -> list[int]:
        """Ranks that the merges leave of a token: least rank first, leftmost among equals."""
        rank_of, n = self.ranks.get, len(token)
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        heap = []
        for at in range(n - 1):
            rank = rank_of(token[at:at + 2])
            if rank is not None:
                heap.append((rank, at, at + 2))
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            # Either part may have been joined with another since; a part that is gone has no successor.
            middle = after[at]
            if middle < 0 or middle >= n or after[middle] != end:
                continue
            after[at], after[middle] = end, -1
            before[end] = at
            if end < n:
                far = after[end]
                rank = rank_of(token[at:far])
                if rank is not None:
                    heapq.heappush(heap, (rank, at, far))
            left = before[at]
            if left >= 0:
                rank = rank_of(token[left:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, end))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[token[at:after[at]]])
            at = after[at]
        return out

    def resolve(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens in a row, and how many each has."""
        found = self.whole(tokens)
        missed = np.flatnonzero(found < 0)
        if not len(missed):
            return found, np.ones(len(tokens), np.int64)
        parts = [(self.remembered if len(tokens[k]) <= MEMO_BYTES else self.merged)(tokens[k]) for k in missed.tolist()]
        counts = np.ones(len(tokens), np.int64)
        counts[missed] = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.empty(int(counts.sum()), np.int64)
        begins = np.cumsum(counts) - counts
        hit = found >= 0
        ids[begins[hit]] = found[hit]
        ids[spread(begins[missed], counts[missed])] = np.fromiter(chain.from_iterable(parts), np.int64, int(counts[missed].sum()))
        return ids, counts

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and how many each has."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.entries)):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        return self.all_bytes[spread(self.begins[ids], lengths)], lengths


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, … (count numbers) of every pair, in a row."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begins - (ends - counts), counts)


# A single space between other characters: every pre-token ends before it or starts with it.
SAFE = regex.compile(r"(?<=\S) (?=\S)")


def stretches(text: str, size: int = CUT_AFTER) -> Iterator[str]:
    """The text in stretches whose pre-tokens together are those of the text."""
    begin = 0
    while len(text) - begin > size:
        place = SAFE.search(text, begin + size)
        if place is None:
            break
        yield text[begin:place.start()]
        begin = place.start()
    yield text[begin:] if begin else text


class Resolved:
    """Pre-tokens that a task has resolved, and their ids in a row; all are forgotten when they are more than `MEMO`."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids_of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens in a row, and how many each has."""
        if len(self.number) > MEMO:
            self._forget()
        number = self.number
        new = [token for token in dict.fromkeys(tokens) if token not in number]
        if new:
            ids, counts = self.vocabulary.resolve([token.encode() for token in new])
            number.update(zip(new, range(len(number), len(number) + len(new))))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        at = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        begins = np.cumsum(self.counts) - self.counts
        counts = self.counts[at]
        return self.ids[spread(begins[at], counts)], counts


def encode_batch(vocabulary: Vocabulary, split: regex.Pattern, texts: list[str | None],
                 known: Resolved | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each has; `known` is what batches before have resolved."""
    known = known or Resolved(vocabulary)
    totals = np.zeros(len(texts), np.int64)
    done: list[np.ndarray] = []
    waiting: list[str] = []
    of_text: list[int] = []

    def finish() -> None:
        nonlocal waiting, of_text
        ids, counts = known.ids_of(waiting)
        done.append(ids.astype(np.int32))
        owners = np.repeat(np.array(of_text[::2], np.int64), np.array(of_text[1::2], np.int64))
        np.add.at(totals, owners, counts)
        waiting, of_text = [], []

    for k, text in enumerate(texts):
        for stretch in stretches(text or ""):
            tokens = split.findall(stretch)
            waiting += tokens
            of_text += (k, len(tokens))
            if len(waiting) >= MOST_TOKENS:
                finish()
    finish()
    return np.concatenate(done), totals


def encode(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every row of `docs`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(rank_file)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split = shared.value, regex.compile(pattern)
        known = Resolved(vocabulary)
        for batch in batches:
            ids, counts = encode_batch(vocabulary, split, batch.column("text").to_pylist(), known)
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, ids)], ["doc_id", "ids"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, ids and their bytes as `decoded`, for every row of `encoded` (doc_id, ids)."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(rank_file)))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            counts = np.asarray(column.value_lengths().fill_null(0))
            all_bytes, lengths = shared.value.bytes_of(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
            decoded = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(all_bytes.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, decoded], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, decoded again, as counts and digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = decode(encode(spark.read.parquet(f"{folder}/documents.parquet"), ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
