"""Quality rules whose cutoffs are chosen under a guarantee.

Every rule rejects documents whose share of something exceeds a cutoff. Labelled good documents that pass the
base rules are the holdout: per stratum and rule, cutoffs are tried from the most lenient one on, and each is
accepted only while an exact binomial test rules out that more than the allowed share of good documents
would be rejected. Testing in a fixed order needs no correction along the order; over all rules and strata the
error is divided (Bonferroni), and the allowed share is divided among the rules, so that with probability
1 - `error` no stratum loses more than `risk` of its good documents to all rules together. Of the accepted cutoffs
that is used which gains most: bad documents rejected, less `COST` for each good one; a rule without gain is not used.

Defined cases: a null or wordless text has no words, zero counts, and fails the base rules; a null stratum is a
stratum of its own; a stratum with too few labels gets no cutoff and loses nothing beyond the base rules;
labels of unknown documents are ignored, repeated equal labels count once, and a document labelled both ways is
no good document; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType
from pyspark.sql.window import Window

from plumbline.llm.batches import small_batches
from plumbline.llm.names import spare
from plumbline.operators.joins import lookup_join
from plumbline.session import settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

RISK = 0.05
# Bad documents that a rejected good one outweighs when a cutoff is taken from the accepted ones.
COST = 10
ERROR = 0.05
# Shares tried as cutoffs, from lenient to strict.
CUTOFFS = tuple(round(0.6 - 0.02 * k, 2) for k in range(30))
# Rule name and the share it looks at.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "echoes": ("n_echo_words", "n_words"),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echo_words")
STATS_TYPE = StructType([StructField(name, LongType()) for name in STATS])


def count_repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words which occurs at least twice.

    Windows are numbered by pairing the numbers of shorter windows, so equal numbers mean equal words.
    """
    if len(ids) <= window:
        return 0
    numbers = ids
    for length in range(2, window + 1):
        paired = numbers[: len(ids) - length + 1] * (int(ids.max()) + 1) + ids[length - 1:]
        _, numbers, counts = np.unique(paired, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[numbers] > 1)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of `STATS` for one text."""
    if not text:
        return (0,) * len(STATS)
    words = WORD.findall(text)
    numbers: defaultdict[str, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)),
        count_repeat_words(ids), len(lines), int((ids[1:] == ids[:-1]).sum()),
    )


@F.pandas_udf(STATS_TYPE)
def stats_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(text) for text in texts], columns=list(STATS), dtype="int64")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def with_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Key, stratum, the counts and the base verdict of every document; one row per row of `docs`."""
    small_batches(docs.sparkSession)
    counted = docs.select(key, F.coalesce(stratum, F.lit("")).alias("stratum"), stats_of(text).alias("s"))
    return counted.select(key, "stratum", "s.*").withColumn("base_failed", base_failed())


def share(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def chance_of_at_most(seen: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= seen), summed from the largest term down; 1.0 above the mean, where no test can pass."""
    if seen >= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(seen + 1) - math.lgamma(n - seen + 1)
                    + seen * math.log(p) + (n - seen) * math.log1p(-p))
    total = 0.0
    for k in range(seen, -1, -1):
        total += term
        if term <= total * 1e-17:
            break
        term *= k / (n - k + 1) * (1 - p) / p
    return min(total, 1.0)


def choose_cutoffs(
    stats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, key: str = "doc_id",
) -> DataFrame:
    """One row per stratum with a cutoff for each rule, null where none is safe.

    `labels` has the key and `quality`, 1 for good. Counting is one aggregation of (stratum, rule, level); what
    follows handles that many rows only.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy(key).agg((F.min("quality") == 1).alias("good"))
    held = stats.where(~F.col("base_failed")).join(known, key)
    # The first level at which a document is rejected; len(CUTOFFS) stands for none.
    levels = [F.struct(F.lit(rule).alias("rule"), first_level(share(rule)).alias("level")) for rule in RULES]
    counted = (
        held.select("stratum", "good", F.explode(F.array(*levels)).alias("at"))
        .groupBy("stratum", "at.rule", "at.level").agg(F.struct(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).alias("n")))
    order = Window.partitionBy("stratum", "rule").orderBy("level")
    all_rows = Window.partitionBy("stratum", "rule")
    chains = (
        counted.groupBy("stratum", "rule").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("m"))
        .select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(len(CUTOFFS)))).alias("level"), "m")
        .select("stratum", "rule", "level", F.element_at("m", F.col("level")).alias("here"))
        .withColumn("rejected", F.sum(F.coalesce("here.good", F.lit(0))).over(order))
        .withColumn("gain", F.sum(F.coalesce("here.bad", F.lit(0))).over(order) - COST * F.col("rejected"))
        .withColumn("n", F.sum(F.coalesce("here.good", F.lit(0))).over(all_rows))
        .where(F.col("level") < len(CUTOFFS)))
    tests = len(RULES) * max(counted.where("n.good > 0").select("stratum").distinct().count(), 1)
    limit, allowed = error / tests, risk / len(RULES)

    @F.pandas_udf(BooleanType())
    def safe(seen: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([chance_of_at_most(int(x), int(m), allowed) <= limit for x, m in zip(seen, n)], dtype=bool)

    accepted = chains.withColumn("safe", safe("rejected", "n")).withColumn("ok", F.min("safe").over(order)).where("ok")
    best = F.max_by("level", F.struct("gain", -F.col("level")))
    cutoff = F.element_at(F.array(*[F.lit(c) for c in CUTOFFS]), best + 1)
    chosen = accepted.where("gain > 0").groupBy("stratum", "rule").agg(cutoff.alias("cutoff"))
    return chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))


def first_level(value: Column) -> Column:
    """Number of leading cutoffs that `value` does not exceed."""
    passed = F.lit(0)
    for cutoff in CUTOFFS:
        passed = passed + F.when(value <= cutoff, 1).otherwise(0)
    return passed


def judge(stats: DataFrame, cutoffs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`stats` with `kept`: the base rules and every chosen cutoff hold."""
    joined = lookup_join(stats, cutoffs, "stratum", spread_by=key)
    kept = ~F.col("base_failed")
    for rule in RULES:
        kept = kept & (F.col(rule).isNull() | (share(rule) <= F.col(rule)))
    return joined.withColumn("kept", kept)


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Counts, cutoffs and verdict of every document. The counts are stored once and read for both uses."""
    stats = settle(with_stats(docs))
    cutoffs = settle(choose_cutoffs(stats, labels, risk, error))
    return judge(stats, cutoffs)


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The documents that pass, with all their columns."""
    stats = settle(with_stats(docs))
    cutoffs = settle(choose_cutoffs(stats, labels, risk, error))
    key = spare(docs, "_passed")
    passed = judge(stats, cutoffs).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(passed, docs["doc_id"].eqNullSafe(passed[key]), "left_semi")


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL_SHARES = " UNION ALL ".join(
    f"SELECT doc_id, stratum, '{rule}' AS rule, CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0.0 END AS share,"
    f" base_failed FROM stats" for rule, (part, whole) in RULES.items())

OP2_SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
five AS (SELECT doc_id, i, w[i:i + 4] AS x FROM spots WHERE i + 4 <= len(w)),
again AS (SELECT doc_id, unnest(range(i, i + 5)) AS i FROM
  (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM five) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i) AS n FROM again GROUP BY doc_id),
echoes AS (SELECT doc_id, count(*) AS n FROM spots WHERE i > 1 AND w[i] = w[i - 1] GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT doc_id, stratum, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(e.n, 0) AS n_echo_words
  FROM words LEFT JOIN repeats r USING (doc_id) LEFT JOIN echoes e USING (doc_id) LEFT JOIN line_counts USING (doc_id)),
stats AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed
  FROM counted),
shares AS ({_SQL_SHARES}),
known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT * FROM shares JOIN known USING (doc_id) WHERE NOT base_failed),
grid AS (SELECT unnest(range({len(CUTOFFS)})) AS level, unnest({list(CUTOFFS)})::DOUBLE AS cutoff),
chains AS (SELECT stratum, rule, level, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND share > cutoff) AS seen,
    count(*) FILTER (NOT good AND share > cutoff) - {COST} * count(*) FILTER (good AND share > cutoff) AS gain
  FROM held CROSS JOIN grid GROUP BY ALL),
tests AS (SELECT {ERROR} / ({len(RULES)} * greatest(count(DISTINCT stratum) FILTER (good), 1)) AS most, {RISK} / {len(RULES)} AS p FROM held),
tested AS (SELECT c.*, CASE WHEN seen >= n * p THEN false ELSE
    list_sum(list_transform(range(seen + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
      + k * ln(p) + (n - k) * ln(1 - p)))) <= most END AS safe FROM chains c CROSS JOIN tests),
chosen AS (SELECT stratum, rule, max_by(cutoff, (gain, cutoff)) AS cutoff FROM
  (SELECT *, bool_and(safe) OVER (PARTITION BY stratum, rule ORDER BY level) AS ok FROM tested) WHERE ok AND gain > 0 GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM shares JOIN chosen USING (stratum, rule) WHERE share > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM stats"""
