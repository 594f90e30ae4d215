"""Collocations: phrases of two to five words that occur together more often than their parts suggest.

Every place of a word is a suffix, its words up to the depth of five or the end of its piece. Suffixes are counted by a multikey
three-way quicksort of pointers: the pointers are parted by the word at the current depth into less, equal and greater, and the
equal part, whose suffixes share one more word, is sorted on at the next depth. The weight of an equal part is the count of the
phrase that leads there. Parts with too little weight to hold a frequent phrase are abandoned.

Before that, suffixes are routed by their leading words. One pass counts words, one counts pairs of frequent words; a suffix ends
before the first word or pair that is infrequent, since no longer phrase can be frequent, and one of fewer than three words is
not sent: sizes of the parts of one and two words are known from the routing. Frequency is looked up in bitmaps of a fixed size, built from the counts; a false positive sends a suffix that is
abandoned later. Each task sends a distinct suffix once per chunk, with its weight. Suffixes that start with the same two words
meet in one group. Pairs that hold many suffixes are routed by the whole suffix in place of the pair, so no group grows with
them; the counts of their groups are parts, added up after the sort.

Arithmetic is whole-numbered, in decimals of 38 digits.

Defined cases: a null or empty text has no words; a null lang is `und`; repeated rows and null doc_ids count like other rows; other
columns are ignored; only A-Z are lowered; white space other than blanks, tabs and line ends belongs to words; an empty table
gives an empty result; texts of any length are read in chunks, which end with a piece.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.batches import small_batches
from plumbline.session import settle

LEAST, DEPTH, TOP = 100, 5, 2_000
# Bits of a bitmap, 8 MB; bits of one row of it.
BITMAP_BITS, ROW_BITS = 1 << 26, 32_768
# A pair is routed by whole suffixes from this count on, or from one part in HOT_SHARE of all pairs.
HOT, HOT_SHARE = 1_000_000, 2_000
# Words of a chunk, rows that are sorted together, bytes of text that are split at once.
CHUNK_WORDS, SORT_ROWS, TEXT_BYTES = 1 << 21, 1 << 19, 1 << 24

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_END = b"\xff"  # no byte of UTF-8
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _SEPARATORS, b"abcdefghijklmnopqrstuvwxyz " + _END * len(_SEPARATORS))


def tokens_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in lists, with `_END` after every piece."""
    whole = (text or "").encode().translate(_TABLE)
    begin = 0
    while begin < len(whole):
        end = len(whole)
        if end - begin > TEXT_BYTES:
            # No word is cut.
            ends = [at for at in (whole.find(b" ", begin + TEXT_BYTES), whole.find(_END, begin + TEXT_BYTES)) if at >= 0]
            end = min(ends, default=end)
        yield whole[begin:end].replace(_END, b" \xff ").split()
        begin = end
    yield [_END]


class _Words(dict):
    """Numbers of words, from 1 in the order in which they come; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


Chunk = tuple[str, list[bytes], np.ndarray]


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_WORDS) -> Iterator[Chunk]:
    """(lang, words by number, numbers of all words in order, 0 after every piece); a chunk ends with a piece."""
    held: dict[str, tuple[_Words, array]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for tokens in tokens_of(text):
                words, numbers = held.setdefault(lang, (_Words(), array("i")))
                known = len(words)
                numbers.extend(map(words.__getitem__, tokens))
                # A word that is new weighs more than a number.
                size += len(tokens) + 4 * (len(words) - known)
                if size >= most and numbers[-1] == 0:
                    yield from _flushed(held)
                    held, size = {}, 0
    yield from _flushed(held)


def _flushed(held: dict[str, tuple[_Words, array]]) -> Iterator[Chunk]:
    for lang, (words, numbers) in held.items():
        yield lang, list(words), np.frombuffer(numbers, np.int32).astype(np.int64)


class Bitmap:
    """Which (lang, phrase) may be in a set; phrases of the set always are."""

    def __init__(self, rows: list):
        self.bits = np.zeros(BITMAP_BITS // 8, np.uint8)
        for row in rows:
            held = np.frombuffer(row["bits"], np.uint8)
            self.bits[row["bucket"] * (ROW_BITS // 8):][:len(held)] = held

    def has(self, lang: str, phrases: list[bytes]) -> np.ndarray:
        prefix = lang.encode() + b"\x01"
        hashed = np.fromiter((xxhash.xxh64_intdigest(prefix + p, 42) for p in phrases), np.uint64, len(phrases))
        spot = (hashed % np.uint64(BITMAP_BITS)).astype(np.int64)
        return (self.bits[spot >> 3] >> (spot & 7)) & 1 == 1


def bitmap_of(phrases: DataFrame) -> Broadcast:
    """A bitmap of (lang, phrase); its size does not depend on their number."""
    spot = F.pmod(F.xxhash64(F.concat("lang", F.lit("\x01"), "phrase")), F.lit(BITMAP_BITS))
    rows = phrases.select(F.floor(spot / ROW_BITS).cast("int").alias("bucket"), (spot % ROW_BITS).alias("bit")).groupBy(
        "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    return phrases.sparkSession.sparkContext.broadcast(Bitmap(rows))


def _strings(phrases: list[bytes]) -> pa.Array:
    return pa.array(phrases, pa.binary()).cast(pa.string())


def _counted(lang: str, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(phrases), pa.string()), _strings(phrases), pa.array(counts.astype(np.int64))], ["lang", "phrase", "f"])


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, phrase (a word) and f."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, numbers in chunks(batches):
            yield _counted(lang, words[1:], np.bincount(numbers, minlength=len(words))[1:])

    return texts.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def pairs_of(numbers: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs of frequent words, the distinct pairs as one number each, which of them each place has, and counts."""
    places = np.flatnonzero(frequent[numbers[:-1]] & frequent[numbers[1:]])
    keys, which, counts = np.unique(numbers[places] * len(frequent) + numbers[places + 1], return_inverse=True, return_counts=True)
    return places, keys, which, counts


def _frequent(bitmap: Bitmap, lang: str, words: list[bytes]) -> np.ndarray:
    """Flags by number of the word; the end of a piece is not frequent."""
    flags = bitmap.has(lang, words)
    flags[0] = False
    return flags


def _pair_names(words: list[bytes], keys: np.ndarray) -> list[bytes]:
    return [words[a] + b" " + words[b] for a, b in zip((keys // len(words)).tolist(), (keys % len(words)).tolist())]


def pair_counts(texts: DataFrame, frequent_words: Broadcast) -> DataFrame:
    """lang, phrase (two words) and f of pairs of frequent words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, numbers in chunks(batches):
            _, keys, _, counts = pairs_of(numbers, _frequent(frequent_words.value, lang, words))
            yield _counted(lang, _pair_names(words, keys), counts)

    return texts.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def distinct_suffixes(numbers: np.ndarray, frequent: np.ndarray, pair_is_frequent: np.ndarray, places: np.ndarray,
                      which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes as rows of `DEPTH` numbers (0 behind the end) and their counts."""
    joined = np.zeros(len(numbers) + DEPTH, bool)
    joined[places] = pair_is_frequent[which]
    starts = np.flatnonzero(joined[:-1] & joined[1:])
    padded = np.concatenate([numbers, np.zeros(DEPTH, np.int64)])
    columns, goes_on = [padded[starts]], np.ones(len(starts), bool)
    group = np.unique(columns[0], return_inverse=True)[1]
    for depth in range(1, DEPTH):
        goes_on = goes_on & joined[starts + depth - 1]
        columns.append(np.where(goes_on, padded[starts + depth], 0))
        group = np.unique(group * len(frequent) + columns[-1], return_inverse=True)[1]
    _, first, counts = np.unique(group, return_index=True, return_counts=True)
    return np.stack(columns, axis=1)[first], counts


def suffixes(texts: DataFrame, frequent_words: Broadcast, frequent_pairs: Broadcast, hot_pairs: Broadcast) -> DataFrame:
    """lang, route, hot, suffix and weight: each distinct suffix of a chunk that starts with two frequent pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, numbers in chunks(batches):
            frequent = _frequent(frequent_words.value, lang, words)
            places, keys, which, _ = pairs_of(numbers, frequent)
            names = _pair_names(words, keys)
            rows, counts = distinct_suffixes(numbers, frequent, frequent_pairs.value.has(lang, names), places, which)
            pair = np.searchsorted(keys, rows[:, 0] * len(words) + rows[:, 1])
            hot = hot_pairs.value.has(lang, names)[pair]
            spelled = [b" ".join([words[w] for w in row if w]) for row in rows.tolist()]
            route = [s if h else names[p] for s, h, p in zip(spelled, hot.tolist(), pair.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(spelled), pa.string()), _strings(route), pa.array(hot), _strings(spelled), pa.array(counts.astype(np.int64))],
                ["lang", "route", "hot", "suffix", "weight"])

    return texts.mapInArrow(run, "lang string, route string, hot boolean, suffix string, weight bigint")


def three_way(ids: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, depth, weight) of the prefixes of three and more numbers whose rows weigh `least` together; `row` is one of them.

    Pointers to the rows are parted by the number at one depth, and the equal part goes on at the next.
    """
    stack = [(np.arange(len(ids)), 0)]
    while stack:
        at, depth = stack.pop()
        if len(at) == 1:
            # A single suffix needs no further parting.
            row = int(at[0])
            if weights[row] >= least:
                length = int(np.count_nonzero(ids[row]))
                yield from ((row, to, int(weights[row])) for to in range(max(3, depth + 1), length + 1))
            continue
        if not len(at) or weights[at].sum() < least:
            continue
        here = ids[at, depth]
        low, pivot, high = sorted((here[0], here[len(at) // 2], here[-1]))
        less, same, more = at[here < pivot], at[here == pivot], at[here > pivot]
        stack += [(less, depth), (more, depth)]
        if pivot:
            total = int(weights[same].sum())
            if total >= least:
                if depth >= 2:
                    yield int(same[0]), depth + 1, total
                if depth + 1 < ids.shape[1]:
                    stack.append((same, depth + 1))


def sorted_counts(suffix: list[bytes], weights: np.ndarray, least: int) -> tuple[list[bytes], np.ndarray]:
    """Phrases and weights from a table of suffixes."""
    words = _Words()
    ids = np.zeros((len(suffix), DEPTH), np.int64)
    for k, text in enumerate(suffix):
        parts = text.split(b" ")
        ids[k, :len(parts)] = [words[part] for part in parts]
    found = list(three_way(ids, weights, least))
    phrases = [b" ".join(suffix[row].split(b" ", depth)[:depth]) for row, depth, _ in found]
    return phrases, np.array([weight for _, _, weight in found], np.int64)


def phrase_counts(routed: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase and f of the frequent phrases of three to `DEPTH` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            langs, hot = np.array(table.column("lang").to_pylist(), object), table.column("hot").to_numpy(zero_copy_only=False)
            suffix = table.column("suffix").cast(pa.binary()).to_pylist()
            weights = table.column("weight").to_numpy()
            for lang in sorted(set(langs.tolist())):
                # The groups of a hot pair are parts, of which nothing may be abandoned.
                for chosen, floor in ((~hot, least), (hot, 1)):
                    rows = np.flatnonzero(chosen & (langs == lang))
                    yield _counted(lang, *sorted_counts([suffix[r] for r in rows.tolist()], weights[rows], floor))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SORT_ROWS:
                table = pa.concat_batches(held)
                # All but the last group are whole; that may go on.
                last, route = table.column("lang")[-1], table.column("route")
                changes = np.flatnonzero(np.asarray(pc.or_(
                    pc.not_equal(route, route[-1]), pc.not_equal(table.column("lang"), last))))
                whole = int(changes[-1]) + 1 if len(changes) else 0
                held = [table.slice(whole)]
                if whole:
                    yield from finish(table.slice(0, whole))
        if held:
            yield from finish(pa.concat_batches(held))

    dealt = routed.repartition("lang", "route").sortWithinPartitions("lang", "route")
    parts = dealt.mapInArrow(run, "lang string, phrase string, f bigint")
    return parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def counted_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n) with the number of all words, and (lang, phrase, f) of all phrases of one to `DEPTH` words with f >= `least`."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words = settle(word_counts(texts))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    word_bits = bitmap_of(frequent)
    pairs = settle(pair_counts(texts, word_bits).where(F.col("f") >= least))
    held = pairs.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    hot = bitmap_of(pairs.where(F.col("f") >= max(least, min(HOT, held // HOT_SHARE))))
    phrases = phrase_counts(suffixes(texts, word_bits, bitmap_of(pairs), hot), least)
    return totals, settle(frequent.select("lang", "phrase", "f").unionAll(pairs).unionAll(phrases))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best collocations of every language."""
    totals, counts = counted_phrases(docs, text, lang, least)
    candidates = counts.withColumn("words", F.split("phrase", " ", -1)).where(F.size("words") > 1)

    # Phrases inside a longer one that is as frequent.
    size = F.size("words")
    inner = candidates.where(size > 2).select("lang", F.col("f").alias("longer"), "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("length"))
    inner = inner.select("lang", "longer", "words", "length", F.explode(F.sequence(F.lit(1), size - F.col("length") + 1)).alias("begin"))
    inner = inner.select("lang", "longer", F.array_join(F.slice("words", F.col("begin"), F.col("length")), " ").alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    # 100 f(longer) >= 100 a, and a longer phrase is never more frequent.
    open_ = candidates.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f")))

    cuts = open_.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("rest"))
    sides = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    scored = cuts.join(sides, ["lang", "first"]).join(
        sides.select("lang", F.col("first").alias("rest"), F.col("l").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = {name: F.col(name).cast("decimal(19,0)") for name in "alrn"}
    scored = scored.withColumn("_up", (wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")).withColumn(
        "_down", (wide["l"] * wide["r"]).cast("decimal(38,0)")).withColumn("score", F.expr("_up div _down"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{folder}/documents.parquet"))


OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
numbered AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT lang, i, len(w) AS most, w, unnest(range(1, {DEPTH + 1})) AS m FROM numbered),
counts AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS f
  FROM grams WHERE i + m - 1 <= most GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= {LEAST}),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates q WHERE q.lang = c.lang AND q.m > c.m AND 100 * q.f >= 100 * c.f
      AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, f AS a, m, w, unnest(range(1, m)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
    (1000 * c.a::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN counts x ON x.lang = c.lang AND x.m = c.k AND x.phrase = array_to_string(list_slice(c.w, 1, c.k), ' ')
  JOIN counts y ON y.lang = c.lang AND y.m = c.m - c.k AND y.phrase = array_to_string(list_slice(c.w, c.k + 1, c.m), ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {TOP}"""
