"""Whitening: the solver on hard squares, and the operator against numpy's own eigenvectors and exact whole numbers."""

import math

import numpy as np
import pytest
from checks import DATA
from pyspark.sql import functions as F

from docket_spark.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, component string, __x int"


def expected(rows, components=4):
    """From (vec_id, vec) in plain Python: rows of the contract, whitened up to the sign of a component."""
    good = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = {}
    for i, x in good:
        off = [n * c - s for c, s in zip(x, sums)]
        out.setdefault(i, []).append((n, sum(o * o for o in off), (np.array([o / n for o in off]) @ u / np.sqrt(e)).tolist()))
    return out, e / (centred**2).sum() * n


def same_as_expected(df, rows, components=4, places=1e-9):
    want, explained = expected(rows, components)
    got = {}
    for r in df.collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert set(got) == set(want)
    signs = [None] * components
    for i, found in got.items():
        assert len(found) == components * len(want[i])
        for r in found:
            k = r["component"] - 1
            n, deviation, white = want[i][0]
            assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-9
            assert abs(r["explained"] - explained[k]) < 1e-9 * explained[k]
            if signs[k] is None and abs(white[k]) > 1e-3:
                signs[k] = np.sign(white[k] * r["whitened"])
            assert abs(abs(white[k]) - abs(r["whitened"])) < places * max(1, abs(white[k]))
            assert signs[k] is None or abs(white[k] - signs[k] * r["whitened"]) < places * max(1, abs(white[k]))


def hard_squares():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    yield "random", np.linalg.qr(rng.normal(size=(900, 40)), mode="r")
    yield "nearly equal", np.linalg.qr(rng.normal(size=(200_000, 16)), mode="r")
    yield "equal", np.eye(12)
    yield "two groups", np.diag([1.0] * 20 + [0.5] * 20) @ turn
    yield "close groups", np.diag(np.concatenate([1 + 1e-9 * np.arange(20), 0.5 + 1e-13 * np.arange(20)])) @ turn
    yield "graded", np.diag(10.0 ** -np.arange(30)) @ turn[:30, :30]
    yield "ranks", np.diag([3.0, 2, 1, 0, 0])
    yield "one row", np.vstack([np.ones(7), np.zeros((6, 7))])
    yield "pairs", np.linalg.cholesky(np.diag(np.abs(np.arange(-10.0, 11))) + np.eye(21, k=1) + np.eye(21, k=-1) + 12 * np.eye(21)).T


@pytest.mark.parametrize("name, r", list(hard_squares()))
def test_solver(name, r):
    e, v = whitening.eigen(r, r.shape[1])
    s = np.linalg.svd(r, compute_uv=False)
    assert np.abs(e - s**2).max() < 1e-13 * s[0] ** 2
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-12
    assert np.abs(r.T @ (r @ v) - v * e).max() < 1e-13 * s[0] ** 2


def test_small_singular_values_keep_their_digits():
    a, b = 10.0 ** -np.arange(12), 0.3 * 10.0 ** -np.arange(11)
    inverse = np.linalg.inv(np.diag(a) + np.diag(b, 1))  # its largest value is the smallest one's inverse
    assert abs(np.sqrt(whitening.dqds(a, b)[-1]) * np.linalg.norm(inverse, 2) - 1) < 1e-12


def test_equals_plain_covariance(spark):
    rng = np.random.default_rng(2)
    vecs = (rng.normal(size=(400, 6)) * [3, 2, 1.5, 1, 0.5, 0.1] + [5, -70, 0, 0, 1, 2]).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vecs)] + [(i + 1000, vecs[0]) for i in range(300)] + [(5, vecs[5]), (None, vecs[1])]
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf"), *vecs[0][1:]]), (2004, [1.0, 2.0]), (2005, [])]
    df = spark.createDataFrame([(i, v, 1, "x", 1) for i, v in rows], SCHEMA).repartition(7)
    plain = [(i, v) for i, v in rows if (v is None or len(v) == 6) and i is not None]
    found = whitening.whitened(df).cache()
    same_as_expected(found.where("vec_id IS NOT NULL"), plain)
    assert found.where("vec_id IS NULL").count() == 4 and found.where("vec_id = 5").count() == 8
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(2**40 + i * 7 % 13), float(i * 2**38), 1.5]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(df, 1).collect()}
    xs = [[math.floor(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*xs)]
    want = {i: sum((9 * c - s) ** 2 for c, s in zip(x, sums)) for i, x in enumerate(xs)}
    assert got == {i: d if d < 2**63 else None for i, d in want.items()} and None in got.values()


def test_tables_without_directions(spark):
    kind = "vec_id int, embedding array<double>"
    for rows in ([], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(9)], [(1, None), (2, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, kind)).count() == 0
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], kind))
    assert line.select("component").distinct().count() == 1 and abs(line.first()["explained"] - 1) < 1e-12


def test_given_table(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.select("vec_id", "embedding").collect()]
    same_as_expected(queries.op11_whitening(spark, DATA), rows)
    parted = vectors.repartition(40, F.col("vec_id"))
    same_as_expected(whitening.whitened(parted), rows)
