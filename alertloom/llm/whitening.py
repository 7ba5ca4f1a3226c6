"""Whitening of embeddings by principal components that a spectral divide and conquer finds.

Entries are put on a grid (floor of 256 times the entry), so that equal vectors are equal exactly. The covariance is taken over
the distinct vectors, in two passes over a written table of them: exact integer sums first, then products
of the centred vectors. Tasks add up their own rows, and their matrices are added by groups of tasks, level by level;
the driver gets one matrix of dimension squared, never vectors.

The matrix is split there: the polar factor of the covariance less a shift is the sign of its spectrum, so half of
(factor + identity) projects on the components above the shift. The factor comes from the QDWH iteration (dynamically weighted
Halley steps, by QR factorisations as long as the matrix is ill-conditioned, by Cholesky ones after that). Bases of both
subspaces turn the matrix into two smaller ones, and each is split again, down to single components.
Mean and whitening matrix are broadcast (dimension times components, whatever the number of rows), and every row is
projected in place.

Null vectors, and those with null or non-finite entries, are dropped; so are vectors of any length but the most
frequent one (of equally frequent ones the longest). Repeated rows are all returned, but fitted once. Entries whose grid value
passes a long are set to the nearest long; a deviation that passes a long is null. A component whose
variance is below rounding (so all of them, if all vectors are equal) is not returned. A null id is carried through,
other columns are ignored. No usable rows: no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.store import saved
from alertloom.llm.sums import summed

COMPONENTS = 4
GRID = 256.0
#: Vectors taken at once.
BLOCK = 4096
EPS = np.finfo(np.float64).eps

RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its sign. QDWH; the lower bound of the singular values sets the weights."""
    n = len(a)
    one = np.eye(n)
    bound = np.sqrt(np.abs(a).sum(0).max() * np.abs(a).sum(1).max())
    if bound == 0:
        return one
    x = a / bound
    try:
        least = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        least = 0.0
    least = min(max(least if np.isfinite(least) else 0.0, EPS), 1.0)
    for _ in range(12):
        square = least * least
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        before = x
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
            x = (wb / wc) * x + ((wa - wb / wc) / np.sqrt(wc)) * (q[:n] @ q[n:].T)
        else:
            low = np.linalg.cholesky(one + wc * (x.T @ x))
            half = np.linalg.solve(low, x.T)
            x = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(low.T, half).T
        x = (x + x.T) / 2
        least = min(least * (wa + wb * square) / (1 + wc * square), 1.0)
        if np.linalg.norm(x - before) <= (4 * EPS) ** (1 / 3) * np.linalg.norm(x) and 1 - least < 10 * EPS:
            break
    return x


def _basis(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    q = rng.standard_normal((len(projector), rank))
    for _ in range(3):
        q, _ = np.linalg.qr(projector @ q)
    return q


def _split(a: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    n = len(a)
    diagonal = np.diag(a).copy()
    if n == 1 or np.linalg.norm(a - np.diag(diagonal)) <= EPS * scale:
        return diagonal, np.eye(n)
    one, mean = np.eye(n), diagonal.mean()
    spread = np.linalg.norm(a - mean * one) / np.sqrt(n)
    # the mean lies strictly inside the spectrum; others only for an eigenvalue just there
    for shift in (np.median(diagonal), mean, mean + spread / 8, mean - spread / 8):
        projector = (polar_factor(a - shift * one) + one) / 2
        rank = int(round(np.trace(projector)))
        if 0 < rank < n and np.linalg.norm(projector @ projector - projector) < 1e-6:
            break
    else:
        return diagonal, one  # a multiple of the identity but for rounding
    values, vectors = [], []
    for side, size in ((projector, rank), (one - projector, n - rank)):
        q = _basis(side, size, rng)
        inner = q.T @ a @ q
        own, turned = _split((inner + inner.T) / 2, scale, rng)
        values.append(own)
        vectors.append(q @ turned)
    return np.concatenate(values), np.hstack(vectors)


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    values, vectors = _split((covariance + covariance.T) / 2, float(np.linalg.norm(covariance)), np.random.default_rng(7))
    # one step towards exact orthogonality, and the values that belong to the result
    vectors = vectors @ (1.5 * np.eye(len(vectors)) - 0.5 * (vectors.T @ vectors))
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(0), np.arange(len(values))]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


def usable(vector: Column) -> Column:
    value = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, value)


def on_grid(column: pa.Array, size: int) -> np.ndarray:
    """A batch of vectors, a row each, as long values on the grid."""
    scaled = np.floor(GRID * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), size)
    top = 2.0**63
    out = np.clip(scaled, -top, np.nextafter(top, 0)).astype(np.int64)
    out[scaled >= top] = np.iinfo(np.int64).max
    return out


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector in as few bytes as its entries need, the width in front."""
    widest = np.abs(x.astype(np.float64)).max(1)
    out = []
    for row, w in zip(x, widest):
        kind, mark = ("<i2", b"2") if w < 32_000 else ("<i4", b"4") if w < 2e9 else ("<i8", b"8")
        out.append(mark + row.astype(kind).tobytes())
    return out


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    out = np.empty((len(column), size), np.int64)
    for k, data in enumerate(column.to_pylist()):
        out[k] = np.frombuffer(data, f"<i{data[:1].decode()}", size, 1)
    return out


def _moments(vectors: DataFrame, dimension: int, turned, size: int) -> np.ndarray:
    """Sum over all vectors of the outer square of turned(block of them)."""

    def squares(batch):
        for a in range(0, batch.num_rows, BLOCK):
            y = turned(_unpacked(batch.column("x").slice(a, BLOCK), dimension))
            yield y.T @ y

    return summed(vectors, size * size, squares).reshape(size, size)


def _sums(vectors: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their entries."""

    def run(batches):
        n, total = 0, [0] * dimension
        for batch in batches:
            x = _unpacked(batch.column("x"), dimension)
            n += len(x)
            safe = len(x) == 0 or float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0**62
            own = x.sum(0).tolist() if safe else [sum(c) for c in x.T.tolist()]
            total = [a + b for a, b in zip(total, own)]
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([[str(t) for t in total]], pa.list_(pa.string()))})

    parts = vectors.mapInArrow(run, "n long, sums array<string>")
    entries = parts.select("n", F.posexplode("sums").alias("at", "own"))
    rows = entries.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("own").cast("decimal(38,0)")).alias("own")).collect()  # one row per dimension
    total = {r["at"]: int(r["own"]) for r in rows}
    return (rows[0]["n"], [total[j] for j in range(dimension)]) if rows else (0, [0] * dimension)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n * x - sum) squared, exactly; null beyond a long."""
    top = max(map(abs, sums), default=0)
    if n * (abs(int(x.min())) + abs(int(x.max()))) + top < 1 << 62:
        off = n * x - np.array(sums, np.int64)
        rough = (off.astype(np.float64) ** 2).sum(1)
        out = np.einsum("ij,ij->i", off, off).tolist()
        if rough.max() < 9.2e18:
            return out
    else:
        rough, out = np.full(len(x), np.inf), [None] * len(x)
    for k in np.flatnonzero(rough >= 9.2e18):
        exact = sum((n * v - s) ** 2 for v, s in zip(x[k].tolist(), sums))
        out[k] = exact if exact < 1 << 63 else None
    return out


def whiten(rows: DataFrame, *, key: str, vector: str, count: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: its projection over the component's standard deviation."""
    spark = rows.sparkSession
    held = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    shape = held.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if shape is None or shape["d"] == 0:
        return spark.createDataFrame([], RESULT)
    dimension = shape["d"]
    held = held.where(F.size("vector") == dimension)

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_packed(on_grid(batch.column("vector"), dimension)), pa.binary())], ["x"])

    vectors = saved(held.select("vector").mapInArrow(pack, "x binary").distinct())
    n, sums = _sums(vectors, dimension)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    covariance = _moments(vectors, dimension, lambda x: x - mean, dimension) / n
    values, axes = components(covariance)
    trace = float(np.trace(covariance))
    real = values > 4 * dimension * EPS * trace
    values, axes = values[real][:count], axes[:, real][:, :count]
    k = len(values)
    if not k:
        return spark.createDataFrame([], RESULT)
    matrix = axes / np.sqrt(values)
    checked = _moments(vectors, dimension, lambda x: np.hstack([np.ones((len(x), 1)), (x - mean) @ matrix]), k + 1) / n
    error = float(np.abs(checked[1:, 1:] - np.outer(checked[0, 1:], checked[0, 1:]) - np.eye(k)).max())
    shared = spark.sparkContext.broadcast((n, sums, mean, matrix, values / trace))

    def project(batches):
        n, sums, mean, matrix, explained = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = on_grid(part.column("vector"), dimension)
                z = (x - mean) @ matrix
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), n)),
                        pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                        pa.array(z.ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(each), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return held.mapInArrow(project, RESULT)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), key="vec_id", vector="embedding")
