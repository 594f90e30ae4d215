"""Whitening of embeddings by spectral divide and conquer.

The covariance V of all vectors is shifted by a number between its least and greatest eigenvalue. The polar factor of the
shifted matrix, found by the dynamically weighted Halley iteration in its form with QR factorisations (QDWH), is +1 on the
directions above the shift and -1 on those below, so half of (factor + identity) projects on the upper invariant subspace.
Bases of it and of its complement split V into two blocks, which are split again until a block is a single number or a
multiple of the identity. Blocks that cannot hold one of the components asked for are left alone.

Spark sums the vectors, then the products of the centred vectors, task by task and then cell by cell; only numbers per
dimension and per pair of dimensions reach the driver, whatever the number of rows. The components, dimensions times at most
`MOST` numbers, go out with the tasks that project the vectors.

Every entry c becomes the whole number floor(1024 c) + 100000 first, so sums and deviations are exact.

Defined cases: vectors that are null, empty or hold a null, NaN or infinity are dropped; vectors of another length than the most
common one (the smaller among equals) cannot be compared and are dropped; a null vec_id and repeated rows are rows like
others; other columns are ignored; a component without variance (as many as vectors are missing, or constant entries) has
whitened 0 and explained 0 and is left out of identity_error; equal eigenvalues share a subspace, any basis of which is right;
an empty table gives an empty result. A deviation beyond 64 bits raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.session import settle

# Components that are returned.
MOST = 8
SCALE, SHIFT = 1024.0, 100_000
EPS = float(np.finfo(np.float64).eps)
# Steps of the iteration; from a least singular value of EPS it takes seven.
STEPS = 12


def polar_factor(a: np.ndarray) -> np.ndarray | None:
    """Orthogonal polar factor of a symmetric matrix; None if the matrix is singular to working precision."""
    size = len(a)
    scale = np.linalg.norm(a)
    if not scale:
        return None
    x, least = a / scale, EPS
    for _ in range(STEPS):
        square = least * least
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(size)]))
        moved = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        change = np.linalg.norm(moved - x)
        x = (moved + moved.T) / 2
        least = min(1.0, least * (wa + wb * square) / (1 + wc * square))
        if 1 - least < 10 * EPS and change < np.cbrt(EPS):
            break
    return x if np.linalg.norm(x @ x - np.eye(size)) < 1e-9 * size else None


def split_basis(block: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first columns, so many, span the upper invariant subspace; None if nothing splits."""
    size = len(block)
    mean = np.trace(block) / size
    spread = np.linalg.norm(block - mean * np.eye(size)) / np.sqrt(size)
    start = np.random.default_rng(size).standard_normal((size, size))
    # The mean lies strictly between the extremes; it is moved a little where it meets an eigenvalue.
    for move in (0.0, 0.05, -0.05, 0.11, -0.11, 0.23, -0.23, 0.01, -0.01):
        factor = polar_factor(block - (mean + move * spread) * np.eye(size))
        if factor is None:
            continue
        upper = (factor + np.eye(size)) / 2
        lower = np.eye(size) - upper
        rank = round(float(np.trace(upper)))
        if not 0 < rank < size:
            continue
        one, two = upper @ start[:, :rank], lower @ start[:, rank:]
        for _ in range(2):
            one = upper @ np.linalg.qr(one)[0]
            two = lower @ np.linalg.qr(two)[0]
        basis = np.linalg.qr(np.hstack([one, two]))[0]
        if np.linalg.norm(basis[:, :rank].T @ block @ basis[:, rank:]) < 1e-10 * np.linalg.norm(block):
            return basis, rank
    return None


def leading_components(v: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns; `most` of them at most."""
    whole = np.linalg.norm(v)
    values, vectors = [], []
    blocks = [(np.eye(len(v)), v)]
    while blocks and len(values) < most:
        basis, block = blocks.pop()
        size = len(block)
        flat = np.linalg.norm(block - np.trace(block) / size * np.eye(size)) <= 4 * size * EPS * whole
        found = None if flat or size == 1 else split_basis(block)
        if found is None:
            # A single direction, or a subspace in which every direction is a component.
            values.extend(np.diag(block))
            vectors.extend(basis.T)
            continue
        turn, rank = found
        inner = turn.T @ block @ turn
        inner = (inner + inner.T) / 2
        blocks.append((basis @ turn[:, rank:], inner[rank:, rank:]))
        blocks.append((basis @ turn[:, :rank], inner[:rank, :rank]))
    order = np.argsort(-np.array(values), kind="stable")[:most]
    return np.array(values)[order], np.array(vectors).reshape(-1, len(v))[order].T


def usable(vector: Column) -> Column:
    """Is the vector there, with finite entries throughout?"""
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole_numbers(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(length, matrix of whole numbers) of the vectors of a batch, for each length or for `size` alone."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    numbers = np.floor(SCALE * entries).astype(np.int64) + SHIFT
    of_row = np.repeat(lengths, lengths)
    for length in np.unique(lengths) if size is None else [size]:
        yield int(length), numbers[of_row == length].reshape(-1, int(length))


def sums_by_length(vectors: DataFrame) -> DataFrame:
    """length, n, pos, total: how many vectors have a length, and their exact sum at each place."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for length, x in whole_numbers(batch.column("vector")):
                n, total = held.get(length, (0, 0))
                held[length] = (n + len(x), total + x.sum(axis=0))
        for length, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(length, length, np.int32)), pa.array(np.full(length, n)),
                pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], ["length", "n", "pos", "total"])

    parts = vectors.select("vector").mapInArrow(partial, "length int, n bigint, pos int, total bigint")
    return parts.groupBy("length", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def covariance(vectors: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """Covariance with divisor n; every vector is centred before it is multiplied."""
    size = len(mean)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((size, size))
        for batch in batches:
            for _, x in whole_numbers(batch.column("vector"), size):
                centred = x - mean
                products += centred.T @ centred
        for i in range(size):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(size, i, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(products[i])], ["i", "j", "part"])

    cells = vectors.select("vector").mapInArrow(partial, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("part"))
    v = np.zeros((size, size))
    for row in cells.collect():
        v[row["i"], row["j"]] = row["part"] / n
    return (v + v.T) / 2


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum over the places of (n x - sum) squared, exactly."""
    apart = n * x - sums
    furthest = int(np.abs(apart).max(initial=0))
    if furthest * furthest * apart.shape[1] < 2 ** 63:
        return (apart * apart).sum(axis=1)
    exact = [sum(int(d) ** 2 for d in row) for row in apart]
    if max(exact) >= 2 ** 63:
        raise OverflowError("a deviation needs more than 64 bits")
    return np.array(exact, dtype=np.int64)


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """vec_id, deviation, whitened (array, a number per component), n, explained (array) and identity_error of every usable vector."""
    rows = table.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector")).where(usable(F.col("vector")))
    kind = table.schema[key].dataType.simpleString()
    shape = f"vec_id {kind}, deviation bigint, whitened array<double>"
    summed = sums_by_length(rows)
    lengths = summed.where("pos = 0").orderBy(F.desc("n"), "length").limit(1).collect()
    if not lengths:
        return table.sparkSession.createDataFrame([], f"{shape}, n bigint, explained array<double>, identity_error double")
    size, n = lengths[0]["length"], lengths[0]["n"]
    sums = np.zeros(size, np.int64)
    for row in summed.where(F.col("length") == size).collect():
        sums[row["pos"]] = row["total"]
    alike = rows.where(F.size("vector") == size)
    mean = sums / n
    v = covariance(alike, n, mean)
    values, directions = leading_components(v, most)
    varied = values > size * EPS * max(float(np.trace(v)), 0.0)
    turn = directions / np.where(varied, np.sqrt(np.abs(values)), 1.0) * varied
    explained = np.where(varied, values, 0.0) / max(float(np.trace(v)), np.finfo(float).tiny)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole_numbers(batch.column("vector"), size):
                white = (x - mean) @ turn
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id"), pa.array(deviations(x, n, sums)),
                    pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1], white.ravel())],
                    ["vec_id", "deviation", "whitened"])

    white = settle(alike.mapInArrow(project, shape))
    counted = np.flatnonzero(varied)
    pairs = [(int(i), int(j)) for i in counted for j in counted if i <= j]
    error = 0.0
    if pairs:
        found = white.agg(*[F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))) for i, j in pairs]).first()
        error = max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))
    return white.withColumns({
        "n": F.lit(n).cast("long"), "explained": F.array(*[F.lit(float(e)) for e in explained]), "identity_error": F.lit(float(error))})


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    each = white.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                       F.get("explained", F.col("at")).alias("explained"), "identity_error")
