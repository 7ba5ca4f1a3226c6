"""Whitening against numpy's own eigenvectors and exact fractions."""

import math
import random

import numpy as np
import pytest

from alertloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, n int, part int, component int"


def test_spectral_split():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 17, 64):
        for kind in range(5):
            a = rng.standard_normal((3 * d, d))
            if kind == 1:
                a[:, d // 2 :] = a[:, : d - d // 2]
            elif kind == 2:
                a *= np.logspace(0, -7, d)
            elif kind == 3:
                a = np.repeat(a[:, :1], d, 1)
            c = a.T @ a if kind < 4 else np.eye(d)
            values, axes = whitening.components(c)
            scale = np.linalg.norm(c)
            assert np.abs(values - np.linalg.eigvalsh(c)[::-1]).max() < 1e-13 * scale
            assert np.abs(axes.T @ axes - np.eye(d)).max() < 1e-13
            assert np.abs(c @ axes - axes * values).max() < 1e-13 * scale


def test_polar_factor():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    signs = np.where(np.arange(30) % 3, 1.0, -1.0)
    a = (q * (signs * np.logspace(0, -12, 30))) @ q.T
    want = (q * signs) @ q.T
    assert np.abs(whitening.polar_factor((a + a.T) / 2) - want).max() < 1e-3
    a = (q * (signs * np.linspace(1, 9, 30))) @ q.T
    assert np.abs(whitening.polar_factor((a + a.T) / 2) - want).max() < 1e-13


def compared(rows, got, count=4):
    d = max(len(v) for _, v in rows)
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    fitted = sorted({tuple(v) for _, v in x})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fitted, float) - mean
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(count, int((values > 1e-12 * values[0]).sum())) if values[0] > 0 else 0
    assert len(got) == k * len(rows)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    sign = {}
    for i, own in x:
        exact = sum((n * a - s) ** 2 for a, s in zip(own, sums))
        for j in range(k):
            r = by[i, j + 1].pop()
            want = (np.array(own) - mean) @ axes[:, j] / math.sqrt(values[j])
            sign.setdefault(j, math.copysign(1, r.whitened * want)) if abs(want) > 1e-3 else None
            assert r.n == n and r.deviation == (exact if exact < 1 << 63 else None)
            assert abs(r.whitened - sign.get(j, 1) * want) < 1e-8 * max(1, abs(want))
            assert abs(r.explained / (values[j] / v.trace()) - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
    return d


def test_whitening(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + 3 * j) for j in range(12)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(7, rows[7][1]), (None, rows[8][1])]
    bad = [None, [None] * 12, [1.0] * 11 + [float("nan")], [float("inf")] + [0.0] * 11, [1.0] * 5, []]
    data = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    frame = [(i, v, 1, 2, 3, 4, 5) for i, v in data + [(5000 + k, v) for k, v in enumerate(bad)]]
    df = spark.createDataFrame(frame, SCHEMA).repartition(5)
    compared(data, whitening.whiten(df, key="vec_id", vector="embedding").collect())
    compared(data, whitening.whiten(df, key="vec_id", vector="embedding", count=2).collect(), 2)


@pytest.mark.parametrize(
    "vectors",
    [
        [], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [[1.0], [3.0]], [[0.0, 1.0], [0.5, 1.0], [2.0, 1.0]],
        [[3e30, 1.0], [1.0, 2.0], [7.0, -3e30]], [[1e6, 2e6], [3e6, -1e6], [0.1, 0.2]], [[]],
    ],
)
def test_edges(spark, vectors):
    frame = [(i, [float(np.float32(c)) for c in v], 1, 2, 3, 4, 5) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(frame, SCHEMA), key="vec_id", vector="embedding").collect()
    if any(abs(c) > 1e20 for v in vectors for c in v):
        assert {r.vec_id for r in got} == {0, 1, 2} and all(r.deviation is None for r in got)
    elif vectors and vectors[0]:
        compared([(r[0], r[1]) for r in frame], got)
    else:
        assert got == []


def test_sums_over_many_tasks(spark):
    df = spark.createDataFrame([(i, [float(i % 97), float(i % 13), float(i % 5)], 1, 2, 3, 4, 5) for i in range(3000)], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = whitening.whiten(df.repartition(40), key="vec_id", vector="embedding").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    compared([(i, [float(i % 97), float(i % 13), float(i % 5)]) for i in range(3000)], got)


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compared(rows, whitening.op11_embedding_whitening(spark, sf).collect())
