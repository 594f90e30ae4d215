"""Whitening against a plain eigenvalue decomposition, and its defined cases."""

import math
import random

import numpy as np
import pytest

from plumbline.llm import whitening as W

SHAPE = "vec_id bigint, embedding array<float>, label int, deviation string"


def plain(vectors):
    x = np.floor(1024.0 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    centred = x - x.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / len(x))
    values, directions = values[::-1][:8], directions[:, ::-1][:, :8]
    sums = [int(s) for s in x.sum(axis=0)]
    deviation = [sum((len(x) * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return x, values, centred @ directions / np.sqrt(values), deviation


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(3)
    return (draw.standard_normal((400, 12)) @ draw.standard_normal((12, 12))).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for k, v in rows], SHAPE)


def test_equals_the_plain_decomposition(spark, vectors):
    table = frame(spark, enumerate(vectors)).repartition(5)
    got = sorted(W.whiten(table).collect(), key=lambda r: r["vec_id"])
    _, values, white, deviation = plain(vectors)
    assert [r["deviation"] for r in got] == deviation and {r["n"] for r in got} == {400}
    found = np.array([r["whitened"] for r in got])
    assert np.allclose(np.abs((found * white).mean(axis=0)), 1, atol=1e-9)
    signs = np.sign((found * white).mean(axis=0))
    assert np.allclose(found * signs, white, atol=1e-8)
    assert got[0]["identity_error"] < 1e-9
    assert np.allclose(got[0]["explained"], values / np.trace(np.cov(plain(vectors)[0].T, bias=True)))


def test_the_query_on_the_given_table(spark, tables):
    rows = W.op11_whitening(spark, tables).collect()
    table = spark.read.parquet(f"{tables}/embeddings.parquet").collect()
    assert len(rows) == 8 * len(table) and {r["component"] for r in rows} == set(range(1, 9))
    _, _, white, deviation = plain([r["embedding"] for r in table])
    size = {(r["vec_id"], k + 1): abs(w) for r, ws in zip(table, white) for k, w in enumerate(ws)}
    exact = {r["vec_id"]: d for r, d in zip(table, deviation)}
    assert all(math.isclose(abs(r["whitened"]), size[r["vec_id"], r["component"]], abs_tol=1e-8) for r in rows)
    assert all(r["deviation"] == exact[r["vec_id"]] and r["identity_error"] < 1e-4 for r in rows)


def test_odd_vectors_are_dropped_and_rows_repeat(spark, vectors):
    rows = [(k, v) for k, v in enumerate(vectors[:50])]
    odd = [(None, vectors[0]), (3, vectors[3]), (90, None), (91, []), (92, [1.0, None] + [0.0] * 10), (93, [float("nan")] * 12),
           (94, [float("inf")] * 12), (95, [1.0, 2.0])]
    got = W.whiten(frame(spark, rows + odd)).collect()
    assert sorted((r["vec_id"] for r in got), key=str) == sorted([*range(50), None, 3], key=str)
    assert {r["n"] for r in got} == {52}


def test_empty_single_and_flat_tables(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    one = W.whiten(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert one[0]["whitened"] == [0, 0] and one[0]["explained"] == [0, 0] and one[0]["identity_error"] == 0 and one[0]["deviation"] == 0
    flat = W.whiten(frame(spark, [(k, [k / 8, 1.0, -k / 8]) for k in range(9)])).collect()
    assert all(abs(r["whitened"][1]) < 1e-9 and r["identity_error"] < 1e-9 for r in flat)


@pytest.mark.parametrize("size", [1, 2, 3, 8, 40, 150])
def test_components_of_random_matrices(size):
    draw = np.random.default_rng(size)
    a = draw.standard_normal((size, size + 2))
    v = a @ a.T
    values, directions = W.leading_components(v, size)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-10, atol=1e-10 * values[0])
    assert np.allclose(directions.T @ directions, np.eye(size), atol=1e-12)
    assert np.allclose(directions @ np.diag(values) @ directions.T, v, atol=1e-10 * values[0])


def test_repeated_and_missing_eigenvalues():
    draw = np.random.default_rng(0)
    turn = np.linalg.qr(draw.standard_normal((9, 9)))[0]
    v = turn @ np.diag([5.0, 5, 5, 3, 3, 1, 0, 0, 0]) @ turn.T
    values, directions = W.leading_components((v + v.T) / 2)
    assert np.allclose(values, [5, 5, 5, 3, 3, 1, 0, 0], atol=1e-12)
    assert np.allclose(v @ directions, directions * values, atol=1e-11)


def test_polar_factor_is_orthogonal_and_takes_the_signs():
    draw = random.Random(4)
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((6, 6)))[0]
    values = np.array([draw.uniform(-3, 3) for _ in range(5)] + [1e-9])
    factor = W.polar_factor(turn @ np.diag(values) @ turn.T)
    assert np.allclose(factor, turn @ np.diag(np.sign(values)) @ turn.T, atol=1e-6)
    assert W.polar_factor(np.zeros((3, 3))) is None


def test_deviations_stay_exact_and_say_when_they_cannot():
    x = np.array([[2 ** 30, 0], [0, 1]])
    assert W.deviations(x, 2, x.sum(axis=0)).tolist() == [2 ** 60 + 1, 2 ** 60 + 1]
    with pytest.raises(OverflowError):
        W.deviations(np.array([[2 ** 40, 0]]), 3, np.array([0, 0]))
