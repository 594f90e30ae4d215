"""Near-duplicates by SimHash fingerprints, found with a generalised pigeonhole.

Fingerprints of 64 bits are linked when at most three bits differ. The bits are grouped into partitions so that
correlated bits share one; each partition gets a threshold between -1 (not probed) and 3, all thresholds adding
up to 3 - m + 1 for m partitions. If two fingerprints differed by more than the threshold in every partition, they
would differ in at least 4 bits, so probing each partition within its threshold finds every link. Partitions
and thresholds are chosen by dynamic programming on estimated candidate counts plus the probes to be written, from
the number of distinct fingerprints and the bits' joint counts over all of them. Candidates are verified within
the join, so only links leave it.

Equal fingerprints are one class before anything is joined: groups of copies never form pairs.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows
repeat in the result; a row with a null doc_id links others like any, and component_id is the smallest non-null doc_id of the
component, null if there is none; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from plumbline.llm.batches import small_batches
from plumbline.llm.components import components
from plumbline.llm.names import all_columns
from plumbline.session import settle

BITS = 64
SHINGLE = 3
SEED = 42
MOST_DIFFERENT = 3
# Shingles hashed at a time: bounds the memory of a very long text.
BLOCK = 65_536
# Cost of writing one probe, against verifying one candidate.
PROBE_COST = 4.0
MOST_PARTITIONS = 6


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned number; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    step = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        upto = min(at + BLOCK, total)
        hashes = np.fromiter(
            (digest(joined[s:e], SEED) for s, e in zip(starts[at:upto], ends[at + step:upto + step])), np.uint64, upto - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


@F.pandas_udf(LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    prints = np.array([fingerprint(text) for text in texts], dtype=np.uint64)
    return pd.Series(prints.view(np.int64))


def hex_digits(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both set.

    A task adds up its own rows; what reaches the driver is one 64 by 64 table whatever the input.
    """
    def add(batches):
        both, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64).view(np.uint64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
            n += len(values)
        yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), n)})

    summed = prints.select("fp").mapInPandas(add, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for row in summed.collect():
        table[row["cell"]] = row["n"]
    return int(table[-1]), table[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """`parts` groups of nearly equal size; each grows by the bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        # Start from the most even bit that is left, ties by number.
        group = [min(left, key=lambda b: (round(abs(p[b] - 0.5), 9), b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: round(float(related[b, group].sum()), 9))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, group: list[int], threshold: int) -> float:
    """Estimated share of pairs that differ in at most `threshold` bits of the group."""
    ways = np.zeros(threshold + 1)
    ways[0] = 1.0
    for b in group:
        differ = 2 * p[b] * (1 - p[b])
        ways[1:] = ways[1:] * (1 - differ) + ways[:-1] * differ
        ways[0] *= 1 - differ
    return float(ways.sum())


def ball(width: int, threshold: int) -> int:
    from math import comb
    return sum(comb(width, k) for k in range(threshold + 1))


@lru_cache(maxsize=64)
def flips(group: tuple[int, ...], threshold: int) -> tuple[int, ...]:
    """All values, as signed numbers, that differ from zero in at most `threshold` bits of the group."""
    masks = [sum(1 << b for b in chosen) for k in range(threshold + 1) for chosen in combinations(group, k)]
    return tuple(m - (1 << 64) if m >= 1 << 63 else m for m in masks)


def allocate(n: int, p: np.ndarray, groups: list[list[int]]) -> tuple[float, list[int]]:
    """Thresholds with the least cost; table over (partitions used, sum of thresholds so far)."""
    goal = MOST_DIFFERENT - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        following: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for threshold in range(-1, MOST_DIFFERENT + 1):
                extra = 0.0
                if threshold >= 0:
                    candidates = 0.5 * n * n * within(p, group, threshold)
                    extra = candidates + PROBE_COST * n * (1 + ball(len(group), threshold))
                if total + threshold not in following or cost + extra < following[total + threshold][0]:
                    following[total + threshold] = (cost + extra, [*chosen, threshold])
        best = following
    return best[goal]


def plan_partitions(n: int, both: np.ndarray) -> list[tuple[list[int], int]]:
    """The (bits, threshold) that are probed; those with threshold -1 are left out."""
    p = np.diag(both) / max(n, 1)
    plans = []
    for parts in range(2, MOST_PARTITIONS + 1):
        groups = group_bits(n, both, parts)
        cost, thresholds = allocate(n, p, groups)
        plans.append((cost, parts, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(plans, key=lambda plan: plan[:2])[2]


def links(prints: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints `fp` that differ in at most three bits, each once."""
    stored, probes = [], []
    for number, (group, threshold) in enumerate(partitions):
        mask = sum(1 << b for b in group)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        value = F.col("fp").bitwiseAND(F.lit(mask))
        stored.append(F.struct(F.lit(number).alias("part"), value.alias("value")))
        probes += [F.struct(F.lit(number).alias("part"), value.bitwiseXOR(F.lit(flip)).alias("value"))
                   for flip in flips(tuple(group), threshold)]
    left = prints.select(F.col("fp").alias("a"), F.explode(F.array(*stored)).alias("k")).select("a", "k.part", "k.value")
    right = prints.select(F.col("fp").alias("b"), F.explode(F.array(*probes)).alias("k")).select("b", "k.part", "k.value")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_DIFFERENT
    found = left.join(right, (left["part"] == right["part"]) & (left["value"] == right["value"]) & (F.col("a") < F.col("b")) & near)
    return found.select("a", "b").distinct()


def rooted_prints(prints: DataFrame) -> DataFrame:
    """(fp, lead, root) for every distinct fingerprint, stored; `prints` has doc_id and fp, root is a fingerprint of the component."""
    leads = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("lead")))
    n, both = bit_counts(leads)
    pairs = links(leads.select("fp"), plan_partitions(n, both))
    # Classes are linked by fingerprint, so one whose rows all lack a doc_id still links others.
    roots = components(pairs)
    return settle(leads.join(roots, leads["fp"] == roots["node"], "left").select("fp", "lead", F.coalesce("root", "fp").alias("root")))


def classes(prints: DataFrame) -> DataFrame:
    """(fp, lead, component_id) for every distinct fingerprint; `prints` has doc_id and fp."""
    rooted = rooted_prints(prints)
    least = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    return rooted.join(least, "root").select("fp", "lead", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row of `docs`.

    The fingerprints are stored once; the join back to the documents is on the fingerprint, where copies may
    crowd, with one row per fingerprint on the other side, which adaptive execution splits.
    """
    small_batches(docs.sparkSession)
    prints = settle(docs.select(F.col(key).alias("doc_id"), fingerprint_of(text).alias("fp")))
    return prints.join(classes(prints), "fp", "left").select("doc_id", "fp", "component_id")


def keep_leads(docs: DataFrame) -> DataFrame:
    """One document of every component, that with the smallest doc_id; documents without doc_id stay."""
    found = near_duplicates(docs)
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*all_columns(docs))


def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
