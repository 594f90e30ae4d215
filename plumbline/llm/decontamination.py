"""Benchmark decontamination by BM25 with block-max pruning.

The test items form an inverted index; every passage of every training text is a query. A passage is a window of twice
the stride, so each item of at most a stride's words lies within one passage; the stride grows with the longest
item. Item weights are divided by the item's score against itself, so one threshold, a share of that score, holds for
all items. Items are ordered by length and cut into blocks; the index keeps the largest weight of every term overall
and per block. A passage is given up when its terms' largest weights do not reach the threshold; then only blocks whose
block maxima reach it are scored. Both are upper bounds, so all items above the threshold are retrieved: this is
block-max WAND taken block by block, for all passages of a batch at once.

Retrieved pairs are verified: of the words of the item's question and of its answer (its last sentence), at least `OVERLAP`
must be aligned, that is, be a common subsequence with a span of the passage that is not much longer. A short part may miss
one word where the item as a whole is aligned, so that one changed word never hides an item of five words or more.

The index is shipped in pieces of bounded size; a larger benchmark means more pieces, each of which meets all texts.
Term statistics cover all items, so the pieces do not change any score.

Defined cases: null and empty texts have no passages; items without words are never found; an item of one sentence
has no answer and is judged by its question; items of fewer than five words are found only whole; repeated rows
repeat in the result, repeated item_ids are reported once with the best match; an empty table on either side gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

from plumbline.llm.batches import small_batches
from plumbline.llm.names import spare
from plumbline.session import settle

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
OVERLAP = 0.8
# Share of an item's score against itself from which on it is retrieved.
RETRIEVE_AT = 0.5
K1, B = 1.2, 0.75
STRIDE = 64
BLOCK_ITEMS = 8
# Words of the items in one piece of the index, which bounds what is broadcast.
PIECE_WORDS = 1_000_000
# Words of texts, and cells of passages and blocks, handled at a time.
BATCH_WORDS = 200_000
BATCH_CELLS = 4_000_000

RESULT = ("item_id bigint, score double, question_overlap double, answer_overlap double, start_word bigint, end_word bigint")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words up to the last sentence, and of the last sentence; the latter empty for a single sentence."""
    sentences = [w for w in map(words_of, SENTENCE_END.split(text or "")) if w]
    if len(sentences) < 2:
        return (sentences[0] if sentences else []), []
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def needed(n: int) -> int:
    """Least words of n that make up a share of `OVERLAP`."""
    return math.ceil(OVERLAP * n - 1e-9)


def best_span(wanted: list[str], passage: list[str]) -> tuple[int, int]:
    """(aligned words, start) of the span of `passage` whose longest common subsequence with `wanted` is longest.

    A span has at most len(wanted) / `OVERLAP` words. Only spans that reach `OVERLAP` are looked for; (0, 0) if there is none.
    """
    n, least = len(wanted), needed(len(wanted))
    have = Counter(passage)
    if sum(min(k, have[w]) for w, k in Counter(wanted).items()) < least:
        return 0, 0
    where: dict[str, int] = {}
    for i, word in enumerate(wanted):
        where[word] = where.get(word, 0) | 1 << i
    full, long = (1 << n) - 1, math.floor(n / OVERLAP + 1e-9)
    # A span that begins with an aligned word leaves at most n - least words before it.
    openers = set(wanted[:n - least + 1])
    best = (0, 0)
    for start, word in enumerate(passage):
        if word not in openers:
            continue
        # A zero bit at i: the subsequence grows with word i.
        row = full
        for other in passage[start:start + long]:
            hit = row & where.get(other, 0)
            row = ((row + hit) | (row - hit)) & full
        aligned = n - row.bit_count()
        if aligned >= least and aligned > best[0]:
            best = (aligned, start)
            if aligned == n:
                break
    return best


def overlap(wanted: list[str], passage: list[str]) -> float:
    """Share of the words of `wanted` aligned with one span of `passage`; 0 under `OVERLAP`, 1 if there are no words."""
    return best_span(wanted, passage)[0] / len(wanted) if wanted else 1.0


def aligned_parts(question: list[str], answer: list[str], passage: list[str]) -> tuple[int, int]:
    """Aligned words of question and answer in the best span of `passage` for the whole item."""
    item = question + answer
    found, start = best_span(item, passage)
    if not found:
        return 0, 0
    span = passage[start:start + math.floor(len(item) / OVERLAP + 1e-9)]
    rows = [[0] * (len(span) + 1)]
    for word in item:
        above, row = rows[-1], [0]
        for j, other in enumerate(span):
            row.append(above[j] + 1 if word == other else max(above[j + 1], row[j]))
        rows.append(row)
    i, j, parts = len(item), len(span), [0, 0]
    while i and j:
        if item[i - 1] == span[j - 1]:
            i, j = i - 1, j - 1
            parts[i >= len(question)] += 1
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return parts[0], parts[1]


def judge(question: list[str], answer: list[str], passage: list[str]) -> tuple[float, float] | None:
    """Shares of question and answer in the passage, or None if they are too small.

    Both reach `OVERLAP` anywhere in the passage; or the item as a whole reaches it in one span, and there each part
    reaches it or, since a changed word is a large share of a short part, misses one word only.
    """
    asked, told = overlap(question, passage), overlap(answer, passage)
    if asked >= OVERLAP and told >= OVERLAP:
        return asked, told
    if not answer:
        return None
    parts = aligned_parts(question, answer, passage)
    if any(k < min(needed(len(p)), len(p) - 1) for k, p in zip(parts, (question, answer))) or not sum(parts):
        return None
    return parts[0] / len(question), parts[1] / len(answer)


@F.pandas_udf(ArrayType(StringType()))
def item_words(texts: pd.Series) -> pd.Series:
    return pd.Series([words_of(text) for text in texts], dtype=object)


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + length), one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


@dataclass
class Index:
    """One piece: terms, their largest weights, and postings by block and by item."""

    terms: dict[str, int]
    largest: np.ndarray        # per term
    block_from: np.ndarray     # per term, into the block postings; one more at the end
    blocks: np.ndarray         # per block posting
    block_largest: np.ndarray
    item_from: np.ndarray      # per block posting, into the item postings; one more at the end
    items: np.ndarray          # per item posting, the item's place
    weights: np.ndarray
    item_ids: list[int]
    questions: list[list[str]]
    answers: list[list[str]]
    stride: int

    @property
    def n_blocks(self) -> int:
        return -(-len(self.item_ids) // BLOCK_ITEMS)


def build_index(rows: list, total: int, mean_length: float, stride: int) -> Index:
    """`rows` have item_id, text, words and df (documents per distinct term)."""
    rows = sorted(rows, key=lambda r: (len(r["words"]), r["item_id"] is None, r["item_id"] or 0, r["text"]))
    postings: dict[str, list[tuple[int, float]]] = {}
    for place, row in enumerate(rows):
        counts, df = Counter(row["words"]), dict(row["df"])
        norm = K1 * (1 - B + B * len(row["words"]) / mean_length)
        weight = {t: math.log1p((total - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in counts.items()}
        own = sum(weight.values())
        for term, w in weight.items():
            postings.setdefault(term, []).append((place, w / own))
    terms = {term: i for i, term in enumerate(sorted(postings))}
    largest, block_from, blocks, block_largest, item_from, items, weights = [], [0], [], [], [], [], []
    for term in terms:
        before = None
        for place, w in postings[term]:
            block = place // BLOCK_ITEMS
            if block != before:
                blocks.append(block)
                block_largest.append(w)
                item_from.append(len(items))
                before = block
            block_largest[-1] = max(block_largest[-1], w)
            items.append(place)
            weights.append(w)
        largest.append(max(w for _, w in postings[term]))
        block_from.append(len(blocks))
    split = [question_and_answer(row["text"]) for row in rows]
    return Index(
        terms, np.array(largest), np.array(block_from), np.array(blocks, dtype=np.int64), np.array(block_largest),
        np.array([*item_from, len(items)]), np.array(items, dtype=np.int64), np.array(weights),
        [row["item_id"] for row in rows], [q for q, _ in split], [a for _, a in split], stride)


def retrieve(index: Index, passages: np.ndarray, terms: np.ndarray, at: float = RETRIEVE_AT) -> list[tuple[int, int, float]]:
    """(passage, item's place, score) of all pairs with score >= `at`; input are distinct (passage, term) pairs."""
    slack = at - 1e-9  # bounds and scores are summed in different orders
    reach = np.bincount(passages, weights=index.largest[terms])
    alive = reach[passages] >= slack
    passages, terms = passages[alive], terms[alive]
    if not len(passages):
        return []
    lengths = index.block_from[terms + 1] - index.block_from[terms]
    entry = spread_ranges(index.block_from[terms], lengths)
    owner = np.repeat(passages, lengths)
    cell, where = np.unique(owner * index.n_blocks + index.blocks[entry], return_inverse=True)
    bound = np.bincount(where, weights=index.block_largest[entry])
    alive = bound[where] >= slack
    entry, owner = entry[alive], owner[alive]
    if not len(entry):
        return []
    lengths = index.item_from[entry + 1] - index.item_from[entry]
    posting = spread_ranges(index.item_from[entry], lengths)
    size = len(index.item_ids)
    pair, where = np.unique(np.repeat(owner, lengths) * size + index.items[posting], return_inverse=True)
    score = np.bincount(where, weights=index.weights[posting])
    found = np.flatnonzero(score >= slack)
    return [(int(pair[i] // size), int(pair[i] % size), float(score[i])) for i in found]


def find_items(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float, int, int]]:
    """(place of the text, item's place, score, overlaps, word range) of verified pairs, the best per text and item."""
    known = index.terms.get
    batch: list[tuple[int, list[str]]] = []
    size = 0
    for place, text in enumerate(texts):
        words = words_of(text)
        if words:
            batch.append((place, words))
            size += len(words)
        if batch and (size >= BATCH_WORDS or place == len(texts) - 1):
            yield from _find_in(index, batch, known)
            batch, size = [], 0
    if batch:
        yield from _find_in(index, batch, known)


def _find_in(index: Index, batch: list[tuple[int, list[str]]], known) -> Iterator[tuple]:
    stride = index.stride
    # Passage k of a text has the words of strides k and k + 1; texts follow one another with a spare stride between.
    first, ids, strides = [], [], []
    base = 1
    for _, words in batch:
        first.append(base)
        numbers = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        spots = np.flatnonzero(numbers >= 0)
        ids.append(numbers[spots])
        strides.append(spots // stride + base)
        base += -(-len(words) // stride) + 1
    terms, stride_of = np.concatenate(ids), np.concatenate(strides)
    n_terms = max(len(index.terms), 1)
    pairs = np.unique(np.concatenate([stride_of, stride_of - 1]) * n_terms + np.concatenate([terms, terms]))
    passages, terms = pairs // n_terms, pairs % n_terms
    most = max(1, BATCH_CELLS // max(index.n_blocks, 1))
    found: dict[tuple[int, int], tuple] = {}
    first_of = np.array(first)
    for low in range(0, base, most):
        here = slice(*np.searchsorted(passages, [low, low + most]))
        for passage, item, score in retrieve(index, passages[here] - low, terms[here]):
            passage += low
            # A text's passage before its first stride holds that stride alone, and passage 0 of the text covers it.
            k = int(np.searchsorted(first_of, passage, side="right")) - 1
            if k < 0:
                continue
            place, words = batch[k]
            begin = (passage - first[k]) * stride
            window = words[begin:begin + 2 * stride]
            shares = judge(index.questions[item], index.answers[item], window)
            if shares:
                asked, told = shares
                row = (place, item, score, asked, told, begin, begin + len(window))
                if (place, item) not in found or row[2] > found[place, item][2]:
                    found[place, item] = row
    yield from found.values()


def index_pieces(items: DataFrame, piece_words: int = PIECE_WORDS) -> list[Index]:
    """The index in pieces of about `piece_words` words; only one piece's rows are on the driver at a time."""
    rows = settle(items.select("item_id", "text", item_words("text").alias("words")).where(F.size("words") > 0))
    total, words, longest = rows.agg(
        F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0)), F.coalesce(F.max(F.size("words")), F.lit(0))).first()
    if not total:
        return []
    keyed = rows.withColumn("row", F.xxhash64("item_id", "text"))
    each = keyed.select("row", F.explode(F.array_distinct("words")).alias("term"))
    df = keyed.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    stats = each.distinct().join(df, "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("df"))
    full = settle(keyed.dropDuplicates(["row"]).join(stats, "row"))
    pieces = -(-words // piece_words)
    # A leaked item may be longer than the item by a share of `OVERLAP`; a window beside it holds it whole.
    stride = max(STRIDE, math.ceil(longest / OVERLAP))
    return [
        build_index(full.where(F.pmod("row", F.lit(pieces)) == p).select("item_id", "text", "words", "df").collect(),
                    total, words / total, stride)
        for p in range(pieces)]


def contaminated(docs: DataFrame, items: DataFrame, piece_words: int = PIECE_WORDS) -> DataFrame:
    """doc_id, item_id, score, overlaps and word range of every item found in every row of `docs`."""
    spark = docs.sparkSession
    small_batches(spark)
    # Keys travel as text: pandas would turn whole numbers into floats where some are null.
    key_type = docs.schema["doc_id"].dataType
    schema = f"doc_id string, {RESULT}"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    names = ["doc_id", *(part.split()[0] for part in RESULT.split(", "))]

    def search(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            piece = shared.value
            for batch in batches:
                keys = batch["doc_id"].tolist()
                out = [(keys[place], piece.item_ids[item], *rest) for place, item, *rest in find_items(piece, batch["text"].tolist())]
                yield pd.DataFrame(out, columns=names).astype({"item_id": "Int64", "doc_id": object})

        return rows.mapInPandas(find, schema).withColumn("doc_id", F.col("doc_id").cast(key_type))

    pieces = index_pieces(items, piece_words)
    if not pieces:
        return spark.createDataFrame([], schema).withColumn("doc_id", F.col("doc_id").cast(key_type))
    found = search(pieces[0])
    for piece in pieces[1:]:
        found = found.unionAll(search(piece))
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns; those without doc_id are judged as one."""
    key = spare(docs, "_bad")
    bad = settle(contaminated(docs, items).select(F.col("doc_id").alias(key)).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[key]), "left_anti")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
