"""Near copies by the Jaccard similarity of their five-word runs, exactly, and by the fingerprints of `simhash`.

Two texts are linked when the sets of their runs of `SHINGLE` words have a Jaccard similarity of at least 0.8. Every link is
found: with the runs of all texts in one fixed order, two sets that similar share a run among the first n - ceil(0.8 n) + 1 of
either, so only these prefixes are compared. Any order is right; runs that are common in a sample come last, before them those
that the prefixes of many texts would have, the rest by hash, so that common passages seldom stand in a prefix. A sample
alone misses passages of some hundred texts, whose pairs grow with the square of the corpus. Both bear on the cost alone.

Texts of equal sets are one class before anything is joined. A run shared by many prefixes ties each of its texts to the
smallest only; of a text's ties one is compared first, the others only where they lead to another component, so a large group
of near copies gives about one comparison a text. What is left are texts that share a run, are of similar size and lie in
different components; these are compared as well. Three bounds come first, which lose nothing: on sizes, on the number
of runs that the prefixes share, and on parities. For each of at least four times as many buckets as a set has runs, one bit tells whether their number is odd; two sets
differ in as many runs at least as in bits. Only pairs that pass are compared run by run.

Where fingerprints are asked for, as in the pipeline, texts that the operator of op3 links are linked too: neither way finds
all that the other does. A component of fingerprints ties each of its classes to the smallest, so that the components are those of both.

Defined cases: words are split and lowered as for the fingerprints of `simhash`; null, empty and blank texts have no runs and
are one class; texts of fewer words than a run have one run; repeated rows repeat in the result; a class without any doc_id
links others; component_id is the smallest non-null doc_id of the component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from plumbline.llm.batches import small_batches
from plumbline.llm.components import components
from plumbline.llm.line_dedup import BUCKET_BITS, bitmap_of, in_bitmap
from plumbline.llm.names import all_columns
from plumbline.llm.simhash import fingerprint_of, rooted_prints
from plumbline.session import settle

SHINGLE = 5
SEED = 42
# Least similarity, as a fraction of whole numbers.
LEAST, OF = 4, 5
# Texts in which common runs are looked for, texts of these that make a run common, and most common runs.
SAMPLE_ROWS, COMMON_FROM, MOST_COMMON = 4_096, 8, 50_000
# Rows whose prefixes would have a run that make it crowded; bits of the map of such runs.
CROWDED_FROM, CROWDED_BITS = 16, 1 << 24
# Buckets of the parities for each run of a set, at least.
BUCKETS_A_RUN = 4


def runs_of(text: str | None) -> np.ndarray:
    """Hashes of the distinct runs of a text, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    step = min(SHINGLE, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[step:])), np.uint64, len(words) - step)
    return np.unique(hashes.view(np.int64))


def digest_of(runs: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(runs.tobytes())


def prefix_of(runs: np.ndarray, common: np.ndarray, crowded: np.ndarray | None = None) -> np.ndarray:
    """The first runs in the order (common, crowded or neither, hash), as many as a similar set must share one of."""
    least = -(-len(runs) * LEAST // OF)
    if not len(runs):
        return runs
    late = 2 * np.isin(runs, common, assume_unique=True)
    if crowded is not None:
        spot = runs.astype(np.int32) & (CROWDED_BITS - 1)
        late = np.maximum(late, crowded[spot >> 3] >> (spot & 7) & 1)
    return runs[np.argsort(late, kind="stable")[:len(runs) - least + 1]]


@F.pandas_udf(ArrayType(LongType()))
def all_runs(texts: pd.Series) -> pd.Series:
    return pd.Series([runs_of(text) for text in texts], dtype=object)


def common_runs(docs: DataFrame, text: str) -> np.ndarray:
    """Runs that many texts of a sample have, `MOST_COMMON` at most; they only set the order."""
    share = max(1, docs.count() // SAMPLE_ROWS)
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(share)) == 0).select(text).distinct()
    counted = sample.select(F.explode(all_runs(text)).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    rows = counted.where(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "run").limit(MOST_COMMON).collect()
    return np.array(sorted(r["run"] for r in rows), dtype=np.int64)


def parities(runs: np.ndarray) -> np.ndarray:
    """For each of a power of two of buckets one bit: is the number of runs in it odd? The halves of a map, combined by
    exclusive or, are the map of half as many buckets."""
    buckets = max(64, 1 << (BUCKETS_A_RUN * len(runs) - 1).bit_length()) if len(runs) else 64
    odd = np.bincount((runs.view(np.uint64) >> np.uint64(32)).astype(np.int64) & (buckets - 1), minlength=buckets) % 2 == 1
    return np.packbits(odd).view(np.int64)


def crowded_runs(docs: DataFrame, text: str, common: Broadcast) -> np.ndarray:
    """A map of 2 MB in bits, by the last bits of a run, of those that the prefixes of many rows have after `common` alone.

    Every row is counted, so the runs left in prefixes have few rows at any size; what falls on a bit of others comes late
    as well, for all texts alike.
    """
    @F.pandas_udf("array<int>")
    def firsts(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(prefix_of(runs_of(value), common.value).astype(np.int32)) for value in texts], dtype=object)

    counted = docs.select(F.explode(firsts(text)).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    spot = F.col("run").bitwiseAND(CROWDED_BITS - 1)
    rows = counted.where(F.col("n") >= CROWDED_FROM).groupBy(F.floor(spot / BUCKET_BITS).cast("int").alias("bucket")).agg(
        F.bitmap_construct_agg((spot % BUCKET_BITS).cast("long")).alias("bits")).collect()
    crowded = np.zeros(CROWDED_BITS // 8, dtype=np.uint8)
    for row in rows:
        part = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        crowded[row["bucket"] * BUCKET_BITS // 8:][:len(part)] = part
    return crowded


def prints_of(docs: DataFrame, key: str, text: str, fingerprints: bool = False) -> DataFrame:
    """doc_id, hash of the text, digest of the set (id), its size, prefix and parities of every row, and its fingerprint (fp)
    where asked for, stored.

    A prefix has 32 bits of each run; runs that they do not tell apart only make further candidates.
    """
    context = docs.sparkSession.sparkContext
    common = context.broadcast(common_runs(docs, text))
    crowded = context.broadcast(crowded_runs(docs, text, common))

    @F.pandas_udf("id binary, n int, prefix array<int>, parity array<bigint>")
    def reduced(texts: pd.Series) -> pd.DataFrame:
        sets = [runs_of(value) for value in texts]
        return pd.DataFrame({
            "id": [digest_of(s) for s in sets], "n": [len(s) for s in sets],
            "prefix": [prefix_of(s, common.value, crowded.value).astype(np.int32) for s in sets], "parity": [parities(s) for s in sets]})

    made = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("h"), reduced(text).alias("r"))
    own = [fingerprint_of("t").alias("fp")] if fingerprints else []
    return settle(made.select("doc_id", "h", *own, "r.*"))


def similar_size(n: Column, m: Column) -> Column:
    return OF * F.least(n, m) >= LEAST * F.greatest(n, m)


def _folded(parity: Column, words: Column) -> Column:
    """Parities in `words` words; similar sets differ by one fold at most."""
    half = F.zip_with(F.slice(parity, F.lit(1), words), F.slice(parity, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(parity) > words, half).otherwise(parity)


def likely_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parities do not rule out, with the rows that have their texts, stored."""
    one = classes.select(F.col("id").alias("a"), F.struct("lead", "h").alias("at_a"), "n", "parity")
    two = classes.select(F.col("id").alias("b"), F.struct("lead", "h").alias("at_b"), F.col("n").alias("m"), F.col("parity").alias("other"))
    ends = pairs.join(one, "a").join(two, "b").where(similar_size(F.col("n"), F.col("m")))
    words = F.least(F.size("parity"), F.size("other"))
    unequal = F.zip_with(_folded(F.col("parity"), words), _folded(F.col("other"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(unequal, F.lit(0), lambda s, x: s + x)
    # With d runs in one set alone, the similarity is at most (n + m - d) / (n + m + d).
    most = F.lit(OF) * (F.col("n") + F.col("m") - apart) >= F.lit(LEAST) * (F.col("n") + F.col("m") + apart)
    return settle(ends.where(most).select("a", "b", "at_a", "at_b"))


def sets_of(asked: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """id and runs of the classes in `asked` (id, lead, h), stored; the lead may be null, h is the hash of its text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [runs_of(value) for value in batch["_text"]]
            # A repeated doc_id with other text must not answer for this set.
            right = [digest_of(s) == bytes(i) for s, i in zip(sets, batch["id"])]
            yield pd.DataFrame({"id": batch["id"], "runs": pd.Series(sets, dtype=object, index=batch.index)})[right]

    # Stored first, so that no set is made for a text that was not asked for; a bitmap keeps the others out of the shuffle.
    own = in_bitmap(docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text")), F.col("_h"),
                    bitmap_of(asked.select(F.col("h").alias("k"))))
    texts = settle(own.join(asked, (F.col("_h") == F.col("h")) & F.col("_key").eqNullSafe(F.col("lead"))).select("id", "_text"))
    return settle(texts.mapInPandas(run, "id binary, runs array<bigint>").dropDuplicates(["id"]))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets are similar enough."""
    likely = likely_pairs(pairs, classes)
    asked = settle(likely.select(F.col("a").alias("id"), "at_a.*").unionAll(likely.select("b", "at_b.*")).distinct())
    sets = sets_of(asked, docs, key, text)
    both = likely.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("runs").alias("one")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("runs").alias("two")), "b")
    shared = both.select("a", "b", (F.size("one") + F.size("two")).alias("total"), F.size(F.array_intersect("one", "two")).alias("shared"))
    return settle(shared.where(F.lit(OF) * F.col("shared") >= F.lit(LEAST) * (F.col("total") - F.col("shared"))).select("a", "b"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in different components."""
    one = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    two = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    ends = pairs.join(one, "a", "left").join(two, "b", "left")
    return ends.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def least_shared(n: Column, m: Column) -> Column:
    """Runs that the prefixes of two similar sets of these sizes share at least.

    Of the two prefixes one ends first in the order; what the sets share up to there is in both, and beyond it that set
    has no more runs than its prefix leaves, fewer than `LEAST / OF` of its size.
    """
    def share(size: Column, of: int) -> Column:
        return F.ceil(F.lit(LEAST) * size / F.lit(of)).cast("int")

    return F.greatest(F.lit(1), share(n + m, LEAST + OF) - F.greatest(share(n, OF), share(m, OF)) + 1)


def enough(shared: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be similar by their sizes (n, m), the runs that their prefixes share (alike) and the runs
    that 32 bits do not tell apart in one of them (lost)."""
    many = F.col("alike") + F.col("lost") >= least_shared(F.col("n"), F.col("m"))
    return shared.where(similar_size(F.col("n"), F.col("m")) & many).select("a", "b")


def links(classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (a, b) of ids that connect all similar sets."""
    told_apart = F.array_distinct("prefix")
    postings = classes.select("id", "n", (F.size("prefix") - F.size(told_apart)).alias("lost"), F.explode(told_apart).alias("run"))
    # Only numbers are shuffled for runs that stand in one text alone, which most do; a bitmap keeps them out of the join.
    shared = settle(postings.groupBy("run").agg(F.count("*").alias("texts")).where("texts > 1").select("run"))
    near = settle(in_bitmap(postings, F.xxhash64("run"), bitmap_of(shared.select(F.xxhash64("run").alias("k")))).join(shared, "run"))
    # A run's smallest id combines before the shuffle; a run that many texts have is split in the join.
    first = settle(near.groupBy("run").agg(F.min(F.struct("id", "n", "lost")).alias("first")))
    # Runs that tie a pair are some of those it shares; pairs with too few of them are left to the last step.
    ties = settle(enough(near.join(first, "run").where(F.col("id") != F.col("first.id")).groupBy(
        F.col("first.id").alias("a"), F.col("id").alias("b"), F.col("first.n").alias("n"), F.col("n").alias("m"),
        F.greatest("first.lost", "lost").alias("lost")).agg(F.count("*").alias("alike"))))
    # One tie of every text first; most others then join what is joined already.
    chosen = settle(ties.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    found = verified(chosen, classes, docs, key, text)
    more = settle(_apart(ties.join(chosen, ["a", "b"], "left_anti"), components(found)))
    found = settle(found.unionAll(verified(more, classes, docs, key, text)))

    roots = components(found)
    placed = settle(near.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "run", "id", "n", "lost", F.coalesce("root", "id").alias("root")))
    mixed = settle(placed.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("run"))
    # Similar sizes lie in one class of sizes or in neighbouring ones.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.01 * OF / LEAST))).cast("int")
    open_ = settle(placed.join(mixed, "run", "left_semi").withColumn("step", step))
    reach = open_.select("run", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"),
                         F.col("id").alias("b"), F.col("n").alias("m"), F.col("lost").alias("lost_b"), F.col("root").alias("root_b"))
    left = open_.withColumnRenamed("id", "a").join(reach, ["run", "step"]).where(
        (F.col("a") < F.col("b")) & (F.col("root") != F.col("root_b")) & similar_size(F.col("n"), F.col("m")))
    # Every run that two texts of different components share is mixed, so all that they share are counted here.
    alike = left.groupBy("a", "b", "n", "m", F.greatest("lost", "lost_b").alias("lost")).agg(F.count("*").alias("alike"))
    rest = settle(enough(alike).join(chosen.unionAll(more), ["a", "b"], "left_anti"))
    return found.unionAll(verified(rest, classes, docs, key, text))


def fingerprint_ties(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids that connect the classes of each component of fingerprints; `prints` has doc_id, id and fp."""
    roots = rooted_prints(prints.select("doc_id", "fp")).select("fp", "root")
    # A class may have several fingerprints: they count how often a run occurs.
    placed = settle(prints.select("id", "fp").distinct().join(roots, "fp").select("root", "id").distinct())
    # Most components are one class, which needs no tie.
    first = settle(placed.groupBy("root").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("root", "a"))
    return settle(placed.join(first, "root").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", fingerprints: bool = False) -> DataFrame:
    """doc_id and component_id of every row of `docs`; with `fingerprints`, what op3 links is linked too."""
    small_batches(docs.sparkSession)
    prints = prints_of(docs, key, text, fingerprints)
    # The row that stands for a class: that of the smallest doc_id, any if none has one.
    at = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("lead"), "h")).alias("at")
    classes = settle(prints.groupBy("id").agg(
        at, F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity")
    ).select("id", "at.lead", "at.h", "n", "prefix", "parity"))
    pairs = links(classes, docs, key, text)
    if fingerprints:
        pairs = pairs.unionAll(fingerprint_ties(prints))
    whole = settle(classes.select("id", "lead").join(components(pairs).withColumnRenamed("node", "id"), "id", "left"))
    leads = whole.where("root IS NOT NULL").groupBy("root").agg(F.min("lead").alias("component_id"))
    found = whole.join(leads, "root", "left").select("id", F.coalesce("component_id", "lead").alias("component_id"))
    return prints.select("doc_id", "id").join(found, "id").select("doc_id", "component_id")


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """One document of every component, that with the smallest doc_id; documents without doc_id stay.

    The components are those of near copies and of fingerprints together.
    """
    found = similar_groups(docs, fingerprints=True)
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*all_columns(docs))
