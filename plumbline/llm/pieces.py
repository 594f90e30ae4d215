"""Encoding texts into SentencePiece ids and decoding them, giant texts chunk by chunk.

A text is cut into chunks. Whatever happens at a cut is a state: the piece that ends at or reaches over the cut, and how
far it reaches into the next chunk. A chunk's transfer matrix holds, in the max-plus sense, the best weight of a
segmentation that leads from a state at its left cut to one at its right cut. Matrices combine associatively;
from the combined ones every chunk learns its two states, and is then segmented on its own.

The given model is of the merge (BPE) kind, whose result is not the segmentation with the largest sum of scores. It has
an exact form as weights, though: a sequence of pieces is the model's result if and only if every piece, and
every two neighbours together, are segmented by the merges into just these pieces. So a step between two pieces
weighs 0 if they are compatible and minus infinity if not, and exactly one path is finite. The ids are those
of the library, which segments every chunk whose cuts no piece can cross: before a space mark that follows another
character. Only cuts inside a long run without spaces need more than one state.

Defined cases: a null text gives null ids and no tokens, an empty one an empty list; a literal space mark (U+2581)
in a text is a space to the model and is decoded as one; characters outside the vocabulary become byte pieces; repeated
rows and null doc_ids are rows like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.batches import small_batches
from plumbline.session import settle

MODEL = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
MARK = "▁"
# Characters of a chunk, and how far back from its end a safe cut is looked for.
CHUNK = 65_536
LOOK_BACK = 512
CLOSED = float("-inf")

State = tuple[str, int]
START: State = ("", 0)
Matrix = dict[tuple[State, State], float]


class Pieces:
    """The model with what the transfer matrices need."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids))
        # Cuts before a mark are safe if pieces have marks at their beginning only.
        self.marks_lead = all(re.fullmatch(f"{MARK}*[^{MARK}]*", piece) for piece in self.ids)
        self.compatible = lru_cache(maxsize=1 << 18)(self._compatible)
        self.whole = lru_cache(maxsize=1 << 16)(lambda piece: self.merge(piece) == [piece])

    def merge(self, text: str) -> list[str]:
        """The merges, best score first and leftmost among equals; for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = CLOSED, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1], CLOSED)
                if score > best:
                    best, at = score, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        if not left or left not in self.ids or right not in self.ids:
            return True
        return self.merge(left + right) == [left, right]

    def starting(self, text: str, at: int) -> Iterator[str]:
        """Pieces of `text` that start at `at`: from the vocabulary, or the single character."""
        yield text[at]
        for end in range(at + 2, min(at + self.longest, len(text)) + 1):
            piece = text[at:end]
            if piece in self.ids and self.whole(piece):
                yield piece

    def states_at(self, before: str, after: str) -> list[State]:
        """Every state a cut between the two texts may have."""
        found = []
        for back in range(1, min(self.longest, len(before)) + 1):
            for reach in range(0, min(self.longest - back, len(after)) + 1):
                piece = before[len(before) - back:] + after[:reach]
                if len(piece) == 1 or (piece in self.ids and self.whole(piece)):
                    found.append((piece, reach))
        return found

    def id_list(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces(path)


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def cut(model: Pieces, text: str, size: int = CHUNK) -> list[tuple[int, int, bool]]:
    """(begin, end, is the cut at `end` safe) of the chunks of a marked text."""
    chunks, begin = [], 0
    while len(text) - begin > size:
        end, safe = begin + size, False
        if model.marks_lead:
            for at in range(end, max(begin, end - min(LOOK_BACK, size // 2)), -1):
                if text[at] == MARK and text[at - 1] != MARK:
                    end, safe = at, True
                    break
        chunks.append((begin, end, safe))
        begin = end
    chunks.append((begin, len(text), True))
    return chunks


def walk(model: Pieces, chunk: str, after: str, entries: list[State]) -> tuple[list[dict[str, int]], dict[State, int]]:
    """Forward over a chunk: for every place, the pieces starting there and the entries (as bits) that lead to them; and the
    same for the states at the right cut."""
    text = chunk + after
    n = len(chunk)
    ending: list[dict[tuple[str, int], int]] = [{} for _ in range(n + 1)]
    exits: dict[State, int] = {}
    reached: list[dict[str, int]] = [{} for _ in range(n)]

    def arrive(piece: str, end: int, bits: int) -> None:
        if end >= n:
            state = (piece, end - n)
            exits[state] = exits.get(state, 0) | bits
        else:
            ending[end][piece, end] = ending[end].get((piece, end), 0) | bits

    for bit, (piece, reach) in enumerate(entries):
        arrive(piece, reach, 1 << bit)
    for at in range(n):
        if not ending[at]:
            continue
        for piece in model.starting(text, at):
            bits = 0
            for (left, _), led in ending[at].items():
                if model.compatible(left, piece):
                    bits |= led
            if bits:
                reached[at][piece] = bits
                arrive(piece, at + len(piece), bits)
    return reached, exits


def transfer(model: Pieces, chunk: str, after: str, entries: list[State]) -> Matrix:
    """The chunk's matrix: weight 0 for every pair of states that a finite path connects."""
    _, exits = walk(model, chunk, after, entries)
    return {(entries[bit], state): 0.0 for state, bits in exits.items() for bit in range(len(entries)) if bits >> bit & 1}


def combine(first: Matrix, second: Matrix) -> Matrix:
    """Max-plus product; associative."""
    onward: dict[State, list[tuple[State, float]]] = {}
    for (middle, end), weight in second.items():
        onward.setdefault(middle, []).append((end, weight))
    product: Matrix = {}
    for (begin, middle), weight in first.items():
        for end, more in onward.get(middle, ()):
            product[begin, end] = max(product.get((begin, end), CLOSED), weight + more)
    return product


def scan(matrices: list[Matrix]) -> list[Matrix]:
    """Products of all prefixes, by doubling: each round combines every product with the one a power of two before it."""
    products, step = list(matrices), 1
    while step < len(products):
        products = products[:step] + [combine(products[i - step], products[i]) for i in range(step, len(products))]
        step *= 2
    return products


def states_along(matrices: list[Matrix]) -> list[State]:
    """The state at every cut on the one finite path of a text, from its start to its end."""
    products = scan(matrices)
    ends = [(weight, end) for (begin, end), weight in products[-1].items() if begin == START and end[1] == 0]
    states = [max(ends)[1]]
    for product, matrix in zip(reversed(products[:-1]), reversed(matrices[1:])):
        ways = [(weight + matrix[middle, states[-1]], middle) for (begin, middle), weight in product.items()
                if begin == START and (middle, states[-1]) in matrix]
        states.append(max(ways)[1])
    return [START, *reversed(states)]


def backtrace(model: Pieces, chunk: str, after: str, entry: State, leave: State) -> list[str]:
    """Pieces that start in the chunk on the path from `entry` to `leave`."""
    reached, _ = walk(model, chunk, after, [entry])
    n = len(chunk)
    piece, end = leave[0], n + leave[1]
    out: list[str] = []
    while True:
        begin = end - len(piece)
        if begin < 0 or (begin, piece) == (entry[1] - len(entry[0]), entry[0]):
            break
        out.append(piece)
        if begin == entry[1] and model.compatible(entry[0], piece):
            break
        for size in range(1, min(model.longest, begin) + 1):
            left = (chunk + after)[begin - size:begin]
            if left in reached[begin - size] and model.compatible(left, piece):
                piece, end = left, begin
                break
        else:
            raise AssertionError("no path")
    return out[::-1]


def encode_closed(model: Pieces, texts: list[str]) -> list[list[int]]:
    """Ids of marked chunks that start with a mark and whose cuts are safe, by the library, which puts the first mark."""
    return model.library.encode([t[1:] for t in texts], out_type=int, num_threads=1)


def encode_texts(docs: DataFrame, model_path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text and ids of every row of `docs`.

    Texts of one chunk are segmented where they lie. The chunks of longer ones are dealt over all tasks twice: for
    their matrices, and, with the states found from these, for their ids. Between the two, a text's matrices meet in one
    task: a few states for every `chunk` characters of that text.
    """
    small_batches(docs.sparkSession)
    # Keys travel as text: pandas would turn whole numbers into floats where some are null.
    key_type = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    giant = F.coalesce(F.char_length("text"), F.lit(0)) >= chunk

    def encode_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(model_path)
        for batch in batches:
            ids = iter(encode_closed(model, [marked(t) for t in batch["text"] if t is not None]))
            yield batch.assign(ids=pd.Series([None if t is None else next(ids) for t in batch["text"]], dtype=object, index=batch.index))

    def cut_long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(model_path)
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                whole, left_safe = marked(text), True
                chunks = cut(model, whole, chunk)
                for low in range(0, len(chunks), 64):
                    out = []
                    for k, (begin, end, safe) in enumerate(chunks[low:low + 64], low):
                        reach = 0 if safe else model.longest
                        out.append((row, k, whole[max(0, begin - (0 if left_safe else model.longest)):begin], whole[begin:end], whole[end:end + reach]))
                        left_safe = safe
                    yield pd.DataFrame(out, columns=["row", "k", "before", "chunk", "after"])

    def matrix_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(model_path)
        for batch in batches:
            out = []
            for row, k, before, text, after in batch[["row", "k", "before", "chunk", "after"]].itertuples(index=False):
                if not before and not after:
                    matrix = {(START, START): 0.0}  # no piece crosses either cut
                else:
                    entries = model.states_at(before, text + after) if before else [START]
                    matrix = transfer(model, text, after, entries)
                    if not after:
                        # The right cut is safe or the text's end: what lies left of it does not matter beyond.
                        closed = {(e, START): w for (e, s), w in matrix.items() if s[1] == 0}
                        matrix = closed
                out.append((row, k, [(a[0], a[1], b[0], b[1], w) for (a, b), w in matrix.items()]))
            yield pd.DataFrame(out, columns=["row", "k", "matrix"])

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        matrices = [{((m["a"], m["ar"]), (m["b"], m["br"])): m["w"] for m in cells} for cells in pdf["matrix"]]
        states = states_along(matrices)
        return pd.DataFrame({
            "row": pdf["row"], "k": pdf["k"], "a": [s[0] for s in states[:-1]], "ar": [s[1] for s in states[:-1]],
            "b": [s[0] for s in states[1:]], "br": [s[1] for s in states[1:]]})

    def encode_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(model_path)
        for batch in batches:
            out = []
            for row, k, before, text, after, a, ar, b, br in batch[
                    ["row", "k", "before", "chunk", "after", "a", "ar", "b", "br"]].itertuples(index=False):
                if not before and not after:
                    ids = encode_closed(model, [text])[0]
                else:
                    leave = (b, int(br))
                    if not after:
                        _, exits = walk(model, text, after, [(a, int(ar))])
                        leave = next(s for s in exits if s[1] == 0)
                    ids = model.id_list(backtrace(model, text, after, (a, int(ar)), leave))
                out.append((row, k, ids))
            yield pd.DataFrame(out, columns=["row", "k", "ids"])

    short = rows.where(~giant).mapInPandas(encode_short, "doc_id string, text string, ids array<int>")
    long_rows = settle(rows.where(giant).withColumn("row", F.monotonically_increasing_id()))
    chunks = settle(long_rows.select("row", "text").mapInPandas(
        cut_long, "row bigint, k int, before string, chunk string, after string").repartition("row", "k"))
    cells = "array<struct<a:string,ar:int,b:string,br:int,w:double>>"
    matrices = chunks.mapInPandas(matrix_rows, f"row bigint, k int, matrix {cells}")
    states = matrices.groupBy("row").applyInPandas(along, "row bigint, k int, a string, ar int, b string, br int")
    encoded = chunks.join(states, ["row", "k"]).mapInPandas(encode_chunks, "row bigint, k int, ids array<int>")
    joined = encoded.groupBy("row").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda part: part["ids"])).alias("ids"))
    encoded_rows = short.unionAll(long_rows.join(joined, "row").select("doc_id", "text", "ids"))
    return encoded_rows.withColumn("doc_id", F.col("doc_id").cast(key_type))


def decode(model: Pieces, ids: np.ndarray | list[int] | None) -> str | None:
    return None if ids is None else model.library.decode([int(i) for i in ids])


def encode_and_decode(docs: DataFrame, model_path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids, n_tokens and whether the ids decode to the text (null for null texts)."""
    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(model_path)
        for batch in batches:
            same = [None if t is None else model.library.decode(ids.tolist()) == t.replace(MARK, " ")
                    for t, ids in zip(batch["text"], batch["ids"])]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "ids": batch["ids"], "n_tokens": [0 if i is None else len(i) for i in batch["ids"]],
                "round_trip": pd.Series(same, dtype=object, index=batch.index)})

    encoded = encode_texts(docs, model_path, chunk).withColumn("doc_id", F.col("doc_id").cast("string"))
    made = encoded.mapInPandas(back, "doc_id string, ids array<int>, n_tokens bigint, round_trip boolean")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def decode_ids(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """`encoded` (with `ids`) and the decoded `text`."""
    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        model = load(model_path)
        return pd.Series([decode(model, one) for one in ids], dtype=object)

    return encoded.withColumn("text", text_of("ids"))


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return encode_and_decode(spark.read.parquet(f"{folder}/documents.parquet"))
