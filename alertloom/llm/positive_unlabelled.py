"""Quality classifier learned from trusted positives and unlabelled text: no negative label is read.

The features of a text are the shares of neighbouring byte classes (lower case, upper case, digits, kinds of
punctuation, ...) by their roots, and a few numbers about its words. They are computed once and written; every pass over the corpus reads them instead of the text.

The model is logistic and linear. With class prior p, positives P and unlabelled texts U its unbiased risk is
p * E_P[loss as positive] + (E_U[loss as negative] - p * E_P[loss as negative]). The bracket estimates the risk on
negatives and can't be below zero in truth, so it counts as zero there (non-negative risk). For the logistic loss
the unbiased risk is convex and gives Newton directions; the length of each step is the one with the least non-negative
risk, and training ends where none lowers it. Gradients, curvatures and risks run over all rows and are added up on Spark; the driver
gets sums of a fixed size only.

The prior is estimated from the same rows: of all score limits, the one where the share of unlabelled texts above it over that of
positives is least, with an allowance for chance (best bin estimation). A first fit with a prior of one half gives the
scores for this, a second fit uses the estimate.

Unlabelled are all texts that aren't held out, the labelled ones included. Rows are held out by the checksum of doc_id; a null doc_id
counts as an empty text there and is held out. A document is trusted if all its labels are 1. Null text is scored like
empty text. Repeated rows count and are scored each; other columns are never read. Without a trusted positive every
score is the prior's first guess, 0.5. No documents: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.encoder import blocks
from alertloom.llm.store import saved
from alertloom.llm.sums import summed

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: The penalty is RIDGE, and RIDGE_ROWS over the number of trusted positives.
RIDGE, RIDGE_ROWS = 1e-3, 2.0
PASSES = 12
#: Newton steps are tried at these lengths.
LENGTHS = (1.0, 0.5, 0.25, 0.0625, 0.0)
#: Standardised features beyond that are set to it.
FARTHEST = 8.0
#: Score limits tried for the prior, in log odds.
LIMITS = np.linspace(-12, 12, 481)
CHANCE = 0.1

#: Classes of bytes: members of each; the last three are other ASCII characters, lead bytes and continuation bytes.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ".", ",;:", "!?", "'\"()-", "|/\\_=+~^`@", "#*$%&<>"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _members in enumerate(_CLASSES):
    _CLASS[list(_members.encode())] = _k
_CLASS[0xC0:] = len(_CLASSES) + 1
_CLASS[0x80:0xC0] = len(_CLASSES) + 2
_KINDS = len(_CLASSES) + 3
SIZE = _KINDS * _KINDS + 4


def features(texts: pa.Array) -> np.ndarray:
    """A row of single-precision numbers for each text; all zero for a text without bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _CLASS[data]
    pairs = kind[:-1] * np.uint8(_KINDS) + kind[1:]
    out = np.zeros((len(texts), SIZE), np.float32)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b - a > 1:
            out[k, : _KINDS * _KINDS] = np.sqrt(np.bincount(pairs[a : b - 1], minlength=_KINDS * _KINDS) / (b - a - 1))
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    owner, ids = owner[real], words.dictionary_encode().indices.to_numpy(zero_copy_only=False)[real]
    n = np.bincount(owner, minlength=len(texts))
    different = np.bincount(np.unique((owner << 32) | ids) >> 32, minlength=len(texts))
    sizes = np.diff(offsets)
    out[:, -4] = np.log1p(n)
    out[:, -3] = np.log1p(sizes)
    out[:, -2] = np.minimum(sizes / np.maximum(n, 1), 40)
    out[:, -1] = different / np.maximum(n, 1)
    return out


def _described(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in blocks(batches):
            rows = [r.tobytes() for r in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), SIZE).astype(np.float64)


class Scale:
    """Puts features on a common scale and adds a constant; features that never vary are dropped."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        self.mean, self.factor = mean, np.where(deviation > 1e-6, 1 / np.maximum(deviation, 1e-6), 0.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.factor, -FARTHEST, FARTHEST)
        return np.hstack([z, np.ones((len(z), 1))])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def _parts(batch: pa.RecordBatch, scale: Scale, step: int = 4096):
    """Scaled rows that aren't held out, and which of them are trusted."""
    for a in range(0, batch.num_rows, step):
        own = batch.slice(a, step)
        own = own.filter(pc.invert(own.column("held_out")))
        if own.num_rows:
            yield scale(_matrix(own.column("x"))), own.column("trusted").to_numpy(zero_copy_only=False)


def _risks(rows: DataFrame, scale: Scale, tried: np.ndarray, prior: float, n_p: float, n_u: float) -> tuple[np.ndarray, np.ndarray]:
    """For each weight vector (a column): the risk on positives, and the estimated risk on negatives."""

    def losses(batch):
        for z, trusted in _parts(batch, scale):
            g = z @ tried
            yield np.concatenate([_softplus(-g[trusted]).sum(0), _softplus(g[trusted]).sum(0), _softplus(g).sum(0)])

    on_p, against_p, against_u = summed(rows, 3 * tried.shape[1], losses).reshape(3, -1)
    return prior * on_p / n_p, against_u / n_u - prior * against_p / n_p


def fit(rows: DataFrame, scale: Scale, prior: float, weights: np.ndarray, n_p: float, n_u: float, passes: int = PASSES) -> np.ndarray:
    """Minimises the non-negative risk plus a ridge penalty (none on the constant), from these weights on."""
    size = len(weights)
    penalty = np.append(np.full(size - 1, RIDGE + RIDGE_ROWS / n_p), 1e-9)

    def slopes(batch, w):
        for z, trusted in _parts(batch, scale):
            s = _sigmoid(z @ w)
            yield np.concatenate([z[trusted].sum(0), z.T @ s, ((z.T * (s * (1 - s))) @ z).ravel()])

    for _ in range(passes):
        total = summed(rows, 2 * size + size * size, lambda batch, w=weights: slopes(batch, w))
        gradient = total[size : 2 * size] / n_u - prior * total[:size] / n_p + penalty * weights
        curvature = total[2 * size :].reshape(size, size) / n_u + np.diag(penalty + 1e-9)
        direction = np.linalg.solve(curvature, -gradient)
        if -gradient @ direction < 1e-7:
            break
        tried = weights[:, None] + direction[:, None] * np.array(LENGTHS)
        positive, negative = _risks(rows, scale, tried, prior, n_p, n_u)
        risk = positive + np.maximum(negative, 0) + 0.5 * (penalty[:, None] * tried**2).sum(0)
        best = int(risk.argmin())
        if LENGTHS[best] == 0:
            break
        weights = tried[:, best]
    return weights


def class_prior(rows: DataFrame, scale: Scale, weights: np.ndarray, n_p: float, n_u: float) -> float:
    """Share of positives among the unlabelled rows, by the score limit above which it can be read best."""

    def above(batch):
        for z, trusted in _parts(batch, scale):
            at = np.searchsorted(LIMITS, z @ weights, "right")
            yield np.concatenate([np.bincount(at[trusted], minlength=len(LIMITS) + 1), np.bincount(at, minlength=len(LIMITS) + 1)]).astype(float)

    of_p, of_u = summed(rows, 2 * (len(LIMITS) + 1), above).reshape(2, -1)[:, ::-1].cumsum(1) / np.array([[n_p], [n_u]])
    allowance = (1 + 0.01) * (np.sqrt(np.log(4 / CHANCE) / (2 * n_u)) + np.sqrt(np.log(4 / CHANCE) / (2 * n_p)))
    held = of_p > allowance
    if not held.any():
        return 0.5
    best = min(np.flatnonzero(held), key=lambda j: (of_u[j] + allowance) / of_p[j])
    return float(np.clip(of_u[best] / of_p[best], 0.01, 0.99))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    trusted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    trusted = trusted.agg((F.min("quality") == 1).alias("trusted")).where("trusted")
    trusted = trusted.where(~held_out)  # no other label is read
    rows = saved(
        _described(docs).join(trusted, "doc_id", "left")
        .select("doc_id", "x", held_out.alias("held_out"), F.coalesce("trusted", F.lit(False)).alias("trusted"))
    )

    def moments(batch):
        for a in range(0, batch.num_rows, 4096):
            own = batch.slice(a, 4096)
            own = own.filter(pc.invert(own.column("held_out")))
            if own.num_rows:
                x = _matrix(own.column("x"))
                yield np.concatenate([[pc.sum(own.column("trusted").cast("int64")).as_py(), len(x)], x.sum(0), (x**2).sum(0)])

    total = summed(rows, 2 + 2 * SIZE, moments)
    n_p, n_u = total[:2]
    weights = np.zeros(SIZE + 1)
    mean = total[2 : 2 + SIZE] / max(n_u, 1)
    scale = Scale(mean, np.sqrt(np.maximum(total[2 + SIZE :] / max(n_u, 1) - mean**2, 0)))
    if n_p:
        weights = fit(rows, scale, 0.5, weights, n_p, n_u)
        prior = class_prior(rows, scale, weights, n_p, n_u)
        weights = fit(rows, scale, prior, weights, n_p, n_u)
    shared = docs.sparkSession.sparkContext.broadcast((scale, weights))

    def score(batches):
        scale, weights = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                own = batch.slice(a, 4096)
                s = _sigmoid(scale(_matrix(own.column("x"))) @ weights)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op13_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
