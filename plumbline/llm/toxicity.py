"""Toxicity by weak supervision.

1. A lexicon is mined from the labelled training rows: all words and word beginnings that stand out in toxic texts, hashed to a
   fixed number of places.
2. Its terms are dealt to many voters; pattern voters (shouting, stress, symbols) join them. A voter fires or not.
3. A generative label model estimates, from how voters fire together over all training texts, labelled or not, how
   often each fires on toxic and on other texts (its accuracy), and which pairs are correlated beyond that; correlated
   voters count less. Only a table of voter pairs is needed, so one pass over the texts does it.
4. The posterior of each row of a bounded sample of labelled rows, with the row's own label as one more voter, which
   the voters may weaken, trains a logistic regression over the terms and patterns, which scores every text.

Rows whose crc32(doc_id) mod 3 is 1 are held out: neither their labels nor their texts take part in 1 to 4. Labels,
language, source and doc_id are inputs of no score.

Defined cases: null and empty texts have no terms and get the score of the intercept; labels of unknown documents, null
labels and repeated labels are harmless (the highest label counts); a null doc_id is not held out and has no label;
without any labels all scores are equal; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.batches import small_batches

# Bound of the rows that train the classifier, drawn by a hash of doc_id from the labelled training rows.
SAMPLE_ROWS = 10_000
# What a term of the lexicon must show: fewest toxic texts that have it, least share of toxic among texts with it.
LEAST_TOXIC, LEAST_SHARE = 4, 0.6
# Terms are hashed to so many places; every term that shows enough takes part, whatever their number.
PLACES = 1 << 18
# Places of terms that a task remembers.
MEMO = 1 << 19
LEXICON_VOTERS = 24
STEM = 5
# How much a label itself is trusted beside the voters, and the most log odds that the voters together may give: they weaken a
# label, but do not overturn it unless this is set above log(0.97 / 0.03).
LABEL_ACCURACY, MOST_ODDS = 0.97, 3.0
PREDICT_AT = 0.7

LETTERS = re.compile(r"[^\W\d_]+")
PATTERNS = ("shouting", "stress", "symbols", "second person")
SECOND_PERSON = frozenset(("you", "your", "du", "dich", "tu", "toi", "te", "usted"))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def terms_of(text: str) -> set[str]:
    """Distinct words in lower case and the beginnings of longer ones."""
    words = set(LETTERS.findall(text.lower()))
    return words | {word[:STEM] + "*" for word in words if len(word) > STEM}


def patterns_of(text: str) -> list[bool]:
    """Does each pattern voter fire?"""
    letters = sum(map(str.isalpha, text))
    words = set(LETTERS.findall(text.lower()))
    return [
        letters > 0 and sum(map(str.isupper, text)) > 0.3 * letters,
        text.count("!") > 0.01 * len(text),
        sum(text.count(c) for c in "#*$%&") > 0.02 * len(text),
        not SECOND_PERSON.isdisjoint(words),
    ]


class _Places(dict):
    """Place of a term by its hash; forgotten and made again when too many are held."""

    def __missing__(self, term: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[term] = place = xxhash.xxh64_intdigest(term, 42) % PLACES
        return place


def mine_lexicon(docs: DataFrame, labels: DataFrame) -> tuple[list[int], float]:
    """Places of terms by strength, strongest first, and the share of toxic rows; from all labelled training rows.

    Every term that shows enough is in; only their places, `PLACES` at most, reach the driver.
    """
    # A shuffle at every size: the labels grow with the documents.
    rows = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text").join(labels.hint("merge"), "doc_id")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stems = F.transform(F.filter("words", lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    terms = rows.select("toxic", words.alias("words")).select(
        "toxic", F.explode(F.array_distinct(F.concat("words", stems))).alias("term"))
    counted = terms.groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"))
    strength = F.col("n_toxic") * F.log(F.col("n_toxic") / F.col("n") + 1)
    shown = counted.where((F.col("n_toxic") >= LEAST_TOXIC) & (F.col("n_toxic") >= LEAST_SHARE * F.col("n")))
    best = shown.groupBy(F.pmod(F.xxhash64("term"), F.lit(PLACES)).alias("place")).agg(F.max(strength).alias("strength")).collect()
    base = labels.where(~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
    return [r["place"] for r in sorted(best, key=lambda r: (-r["strength"], r["place"]))], min(max(base or 0.0, 0.001), 0.999)


@dataclass
class Voters:
    """Places of terms dealt to voters in turn, so that strong terms are spread; pattern voters follow."""

    lexicon: list[int]
    features: dict[int, int] = field(init=False)
    place_of: _Places = field(init=False)

    def __post_init__(self):
        self.features = {place: i for i, place in enumerate(self.lexicon)}
        self.place_of = _Places()

    def fired(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """Features (of the lexicon, then patterns) and votes of one text."""
        text = text or ""
        found = set(map(self.place_of.__getitem__, terms_of(text)))
        features = sorted(self.features[place] for place in found & self.features.keys())
        votes = np.zeros(LEXICON_VOTERS + len(PATTERNS), dtype=bool)
        votes[[f % LEXICON_VOTERS for f in features]] = True
        patterns = patterns_of(text)
        votes[LEXICON_VOTERS:] = patterns
        return features + [len(self.lexicon) + k for k, p in enumerate(patterns) if p], votes


def voter_pairs(docs: DataFrame, voters: Voters) -> tuple[int, np.ndarray]:
    """Number of training texts and, per pair of voters, in how many both fire: one fixed-size table."""
    size = LEXICON_VOTERS + len(PATTERNS)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((size, size)), 0
        for batch in batches:
            votes = np.array([voters.fired(text)[1] for text in batch["text"]], dtype=float).reshape(-1, size)
            both += votes.T @ votes
            n += len(votes)
        yield pd.DataFrame({"cell": np.arange(size * size + 1), "n": np.append(both.ravel(), n).astype("int64")})

    summed = docs.where(~held_out(F.col("doc_id"))).select("text").mapInPandas(add, "cell int, n bigint")
    table = np.zeros(size * size + 1)
    for row in summed.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[row["cell"]] = row["n"]
    return int(table[-1]), table[:-1].reshape(size, size)


@dataclass
class LabelModel:
    """P(fires | toxic), P(fires | not) and the weight of each voter."""

    base: float
    on_toxic: np.ndarray
    on_other: np.ndarray
    weight: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        yes = np.log(self.on_toxic / self.on_other)
        no = np.log((1 - self.on_toxic) / (1 - self.on_other))
        return np.log(self.base / (1 - self.base)) + np.where(votes, yes, no) @ self.weight


def fit_label_model(n: int, both: np.ndarray, base: float) -> LabelModel:
    """Accuracies from triplets of covariances, correlations from what they leave unexplained.

    If voters are independent given the label, Cov(i, j) = g_i g_j with g_i = (P(i|1) - P(i|0)) sqrt(base (1 - base)), so
    g_i^2 = Cov(i, j) Cov(i, k) / Cov(j, k) for every pair j, k; the median over pairs stands up to correlated ones.
    """
    n = max(n, 1)
    mean = np.diag(both) / n
    cov = both / n - np.outer(mean, mean)
    size = len(mean)
    gap = np.zeros(size)
    for i in range(size):
        squares = [cov[i, j] * cov[i, k] / cov[j, k] for j, k in combinations([x for x in range(size) if x != i], 2)
                   if abs(cov[j, k]) > 1e-9]
        strength = np.sqrt(max(float(np.median(squares)), 0.0)) if squares else 0.0
        others = np.delete(cov[i], i)
        gap[i] = strength if others.sum() >= 0 else -strength
    spread = gap / np.sqrt(base * (1 - base))
    clip = lambda p: np.clip(p, 1e-4, 1 - 1e-4)
    on_toxic, on_other = clip(mean + (1 - base) * spread), clip(mean - base * spread)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    left = np.abs(cov - np.outer(gap, gap)) / np.outer(sd, sd)
    np.fill_diagonal(left, 0.0)
    weight = 1 / (1 + np.where(left > 0.05, left, 0.0).sum(axis=1))
    return LabelModel(base, on_toxic, on_other, weight)


def fit_linear(rows: list[list[int]], target: np.ndarray, size: int, penalty: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; the last weight is the intercept."""
    if not rows:
        return np.zeros(size + 1)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    features = np.array([f for r in rows for f in r], dtype=np.int64)
    weights, ahead = np.zeros(size + 1), np.zeros(size + 1)
    most = max(1, max(len(r) for r in rows))
    # Scaling by how often a feature occurs lets rare terms learn as fast as frequent ones.
    scale = 1 / np.sqrt(np.append(np.bincount(features, minlength=size), len(rows)) / len(rows) + 1e-3)
    rate = 1.0 / (0.25 * (min(most, 50) + 1))
    for k in range(steps):
        margin = np.bincount(at, weights=(ahead[:-1] * scale[:-1])[features], minlength=len(rows)) + ahead[-1] * scale[-1]
        miss = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target
        slope = np.append(np.bincount(features, weights=miss[at], minlength=size), miss.sum()) * scale / len(rows)
        slope[:-1] += penalty * ahead[:-1]
        new = ahead - rate * slope
        ahead = new + k / (k + 3) * (new - weights)
        weights = new
    return weights * scale


@dataclass
class ToxicityModel:
    voters: Voters
    labels: LabelModel
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        features, _ = self.voters.fired(text)
        margin = self.weights[features].sum() + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit everything on rows that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lexicon, base = mine_lexicon(docs, known)
    voters = Voters(lexicon)
    model = fit_label_model(*voter_pairs(docs, voters), base)
    # At most `sample_rows` keys, which is the bound of what is broadcast here; their texts are reduced where they lie.
    drawn = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fired = [voters.fired(text) for text in batch["text"]]
            yield pd.DataFrame({
                "toxic": batch["toxic"].astype(int), "features": [f for f, _ in fired], "votes": [v.tolist() for _, v in fired]})

    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic").mapInPandas(
        reduce, "toxic int, features array<int>, votes array<boolean>").collect()
    votes = np.array([r["votes"] for r in rows], dtype=bool).reshape(len(rows), LEXICON_VOTERS + len(PATTERNS))
    own = np.where([r["toxic"] == 1 for r in rows], 1.0, -1.0) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    posterior = 1 / (1 + np.exp(-(np.clip(model.log_odds(votes), -MOST_ODDS, MOST_ODDS) + own)))
    weights = fit_linear([r["features"] for r in rows], posterior, len(lexicon) + len(PATTERNS))
    return ToxicityModel(voters, model, weights)


def score_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a score sees the text alone."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(text) for text in texts], dtype=float)

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return score_texts(docs, train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
