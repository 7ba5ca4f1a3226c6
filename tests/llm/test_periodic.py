"""Runs of words against a search over all periods; the query's planted texts against a plain version of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from alertloom.llm import periodic
from test_operators import SCHEMA, TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every run, from the stretches of places that equal the place one period on."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        first = 0
        while first + q < n:
            last = first
            while last + q < n and words[last] == words[last + q]:
                last += 1
            length = last - first + q
            own = words[first : first + length]
            if last > first and length >= max(6, 4 * q) and all(own[d:] != own[:-d] for d in range(1, q)):
                out.append((first, length, q))
            first = last + 1
    return sorted(out)


def expected(doc_id, text, plant):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    longest = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (
        doc_id, len(found), *longest, None if longest[0] is None else 1000 * longest[1] // longest[2],
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def key(row):
    return tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in row)


def test_runs_of_words():
    rng = random.Random(2)
    for _ in range(3000):
        words = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 2)):
            p, a = rng.randint(1, 9), rng.randint(0, 50)
            for i in range(a, min(len(words), a + rng.randint(5, 40))):
                words[i] = words[a + (i - a) % p] if a + (i - a) % p < len(words) else 0
        assert periodic.runs_of(words) == plain_runs(words)


def test_cutting_loses_no_run():
    rng = random.Random(4)
    texts = []
    for _ in range(200):
        words = [rng.randint(0, rng.choice([3, 40, 4000])) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.6 and len(words) > 8:
            p, a = rng.randint(1, 12), rng.randrange(len(words))
            words[a:] = [words[a + (i - a) % p] if a + (i - a) % p < len(words) else 0 for i in range(a, len(words))]
        texts.append(words)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    first, end = periodic._stretches(np.array([w for t in texts for w in t], np.int32), bounds)
    found = [[] for _ in texts]
    for a, b in zip(first.tolist(), end.tolist()):
        k = int(np.searchsorted(bounds, a, "right")) - 1
        assert b <= bounds[k + 1]
        found[k] += [(a - int(bounds[k]) + s, n, q) for s, n, q in periodic.runs_of(texts[k][a - bounds[k] : b - bounds[k]])]
    assert [sorted(f) for f in found] == [plain_runs(t) for t in texts] and sum(map(len, found)) > 50
    assert sum(end - first) < 0.7 * bounds[-1]


@pytest.mark.parametrize("plant", [False, True])
def test_periodic_runs(spark, plant):
    rng = random.Random(8)
    texts = [(i, t) for i, t in TEXTS.items() if i != 49]  # the brute force takes squared time
    texts += [(100 + i, " ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    texts += [(3, TEXTS[3]), (None, "a b " * 9), (400, "x\ty\x0bz " * 5 + "  é x"), (401, "w " * 300), (402, "  "), (-7, "p q r s t u v w " * 9)]
    rows = [(i, t, "en", "s", 1, 9, 9, 9, 9, "k", 9, 9, 9) for i, t in texts]
    got = periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA).repartition(3), plant=plant)
    want = sorted((expected(i, t, plant) for i, t in texts), key=key)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=key) == want
    assert sum(w[1] > 0 for w in want) > (15 if plant else 5)
    for r in got.collect():
        assert len(r.runs) == r.n_runs and r.n_dropped <= r.n_words
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts(spark):
    """A very long periodic text and a very long one without repeats are linear work."""
    words = [f"w{k}" for k in range(7000)]
    rows = [(1, " ".join(words * 6)), (2, " ".join(f"u{k}" for k in range(200_000))), (3, "z " * 120_000)]
    got = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].start, got[1].length, got[1].period, got[1].n_dropped) == (0, 42_000, 7000, 35_000)
    assert got[2].n_runs == 0 and (got[3].length, got[3].period, got[3].n_dropped) == (120_000, 1, 119_999)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000").collect()
    want = {r.doc_id: expected(r.doc_id, r.text, True) for r in docs}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in periodic.op12_periodic_runs(spark, sf).collect()}
    assert all(got[i] == w for i, w in want.items()) and len(want) > 150
