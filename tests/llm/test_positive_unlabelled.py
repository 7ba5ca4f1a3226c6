"""Held-out accuracy of the quality classifier, its risk against a plain version, and rows with nulls and repeats."""

import random
import zlib

import numpy as np
import pyarrow as pa

from alertloom.llm import positive_unlabelled as pu
from test_operators import SCHEMA, TEXTS


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = pu.op13_positive_unlabelled(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    own = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in own if y], [s for s, y, _ in own if not y]
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([y == p for _, y, p in own]) > 0.95


def test_no_label_of_held_out_rows_matters(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a = {r.doc_id: r.score for r in pu.scores(docs, labels).collect()}
    # the negative labels are never read either
    b = {r.doc_id: r.score for r in pu.scores(docs, turned.where("quality = 1")).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_minimum_of_the_risk(spark):
    """Newton's weights are where no small step in any of many directions lowers the non-negative risk."""
    rng = np.random.default_rng(5)
    x = np.zeros((600, pu.SIZE), np.float32)
    x[:, :3] = rng.standard_normal((600, 3)) + np.where(np.arange(600) % 3, 1.2, -1.2)[:, None]
    trusted = (np.arange(600) % 3 > 0) & (np.arange(600) % 4 > 0)
    rows = [(i, bytearray(x[i].tobytes()), False, bool(trusted[i])) for i in range(600)]
    rows += [(-1, bytearray(np.full(pu.SIZE, 5, np.float32).tobytes()), True, False)]
    from alertloom.llm.store import saved

    df = saved(spark.createDataFrame(rows, "doc_id long, x binary, held_out boolean, trusted boolean").repartition(3))
    n_p, n_u = int(trusted.sum()), 600
    scale = pu.Scale(x.mean(0).astype(float), x.std(0).astype(float))
    z = scale(x.astype(float))
    start = pu.fit(df, scale, 0.5, np.zeros(pu.SIZE + 1), n_p, n_u)
    prior = pu.class_prior(df, scale, start, n_p, n_u)
    assert abs(prior - 2 / 3) < 0.12

    def risk(w, p):
        g = z @ w
        loss = lambda v: np.logaddexp(0, v)
        negative = loss(g).mean() - p * loss(g[trusted]).mean()
        return p * loss(-g[trusted]).mean() + max(negative, 0) + 0.5 * (pu.RIDGE + pu.RIDGE_ROWS / n_p) * (w[:-1] ** 2).sum()

    for p in (0.4, prior):
        w = pu.fit(df, scale, p, np.zeros(pu.SIZE + 1), n_p, n_u, passes=25)
        positive, negative = pu._risks(df, scale, w[:, None], p, n_p, n_u)
        assert abs(positive[0] + max(negative[0], 0) + 0.5 * (pu.RIDGE + pu.RIDGE_ROWS / n_p) * (w[:-1] ** 2).sum() - risk(w, p)) < 1e-9
        for _ in range(60):
            step = np.zeros(pu.SIZE + 1)
            step[[0, 1, 2, -1]] = rng.standard_normal(4)
            assert risk(w + 1e-2 * step, p) >= risk(w, p) - 1e-5


def test_features():
    texts = ["", "a", "Ab c!! Ab|", "é 1\n\n", None, "x" * 70_000]
    got = pu.features(pa.array(texts, pa.string()))
    assert np.isfinite(got).all() and not got[0].any() and not got[4].any()
    sliced = pu.features(pa.array(["zz", *texts], pa.string()).slice(1))
    assert (sliced == got).all()
    shares = got[2, : pu._KINDS**2] ** 2
    assert abs(shares.sum() - 1) < 1e-6 and abs(shares[pu._KINDS * 1 + 0] - 2 / 9) < 1e-6  # upper then lower: Ab, Ab
    assert abs(got[2, -1] - 1) < 1e-6 and abs(np.expm1(got[2, -4]) - 3) < 1e-5


def test_edges(spark):
    rng = random.Random(1)
    rows = [(i, t, "en", "s", 1, 9, 9, 9, 9, "k", 9, 9, 9) for i, t in TEXTS.items()] + [(None, "a b", "", "", *[1] * 5, "", 1, 1, 1)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, rng.randint(0, 1), 0, "x") for i in range(40)] + [(3, 0, 0, "y"), (None, 1, 0, "z"), (5, None, 0, "z")], "doc_id long, quality int, toxic int, x string")
    got = pu.scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.doc_id is None for r in got) == 2 and all(r.held_out == held(r.doc_id) for r in got)
    assert {r.score for r in pu.scores(docs, labels.where("quality = 0")).collect()} == {0.5}
    assert pu.scores(docs.limit(0), labels).collect() == [] and pu.scores(docs.limit(0), labels.limit(0)).collect() == []
