"""Links and blocks of similar signatures against all pairs; many signatures on one address pair; hot keys of lookups."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from alertloom.config import TriageConfig
from alertloom.operators import signatures as sig
from alertloom.operators.dedup import dedup
from alertloom.operators.skew import hot_keys, lookup_join
from test_dedup import SCHEMA, naive_groups


def variants(rng, n):
    words = ["login", "failed", "Scan", "port", "attempt", "brute", "force", "é", "x" * 210, "İ", "ß", ""]
    out = {""}
    while len(out) < n:
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(text) + 1)
            text = text[:k] + rng.choice(["", "a", "Z", "-"]) + text[k + rng.randrange(0, 2) :]
        out |= {text, text.upper()} if rng.random() < 0.1 else {text}
    return sorted(out)


def ratio(a, b):
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_links_and_blocks(spark, threshold):
    texts = variants(random.Random(threshold), 130)
    df = spark.createDataFrame([(t,) for t in texts], "signature string").repartition(3)
    want = {(a, b) for a in texts for b in texts if a != b and ratio(a, b) >= threshold}
    assert {tuple(r) for r in sig.links(df, threshold).collect()} == want and len(want) > 30
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {t for pair in want for t in pair}
    got = {r.signature: r.block for r in sig.blocks(df, TriageConfig(dedup_fuzzy_threshold=threshold)).collect()}
    assert got == {t: find(t) for t in linked}
    few = [t for t in texts if t not in linked][:5]
    assert sig.blocks(spark.createDataFrame([(t,) for t in few], "signature string"), TriageConfig(dedup_fuzzy_threshold=threshold)) is None


def test_bounds_hold():
    rng = random.Random(1)
    for t in (0.5, 0.75, 0.85, 0.9, 0.97):
        size, met = sig.token_size(t), 0
        for _ in range(8000):
            a = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))
            b = list(a)
            for _ in range(rng.randint(0, 4)):
                if b and rng.random() < 0.6:
                    b.pop(rng.randrange(len(b)))
                else:
                    b.insert(rng.randint(0, len(b)), rng.choice("abcd"))
            b = "".join(b)
            if difflib.SequenceMatcher(None, a, b).ratio() >= t:
                met += 1
                common = len(set(sig._tokens(a, size)) & set(sig._tokens(b, size)))
                assert len(b) in sig.partner_lengths(len(a), t)
                assert common >= max(sig.least_shared(len(a), t, size), sig.least_shared(len(b), t, size))
        assert met > 300


def test_many_signatures_on_one_pair(spark):
    """A chain of blocks on one hot pair, out of order, over many tasks."""
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(22)) for _ in range(120)]
    rows = []
    for k in range(900):
        name = rng.choice(names)
        if rng.random() < 0.4:
            name = name[:-1] + rng.choice("xyz")
        minute = k + rng.choice([0, 0, -70, 50])
        rows.append((k, f"a{k}", f"2026-01-{1 + (minute + 100) // 1440:02d}T{(minute + 100) // 60 % 24:02d}:{(minute + 100) % 60:02d}:00", "1.1.1.1", None, name))
    result = dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), TriageConfig())
    got = {}
    for r in result.members().collect():
        got.setdefault(r.group_seq, []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == naive_groups(rows)
    assert result.rows.select("block").distinct().count() > 100


def test_bounds_of_cells_suffice(spark):
    """Alerts in order of time, many in a cell: nothing is sorted row by row, no row goes through a loop."""
    rows = [(k, f"a{k}", f"2026-01-01T{k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}", "1.1.1.1", None, f"rule {k % 3 * 1111}") for k in range(5000)]
    result = dedup(spark.createDataFrame(rows, SCHEMA), TriageConfig(), fuzzy=False)
    assert result.row_groups is None and result.groups.count() == 3
    cells = result.cell_groups._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in cells


def test_hot_keys(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 500 as string)) as k", "id as seq").withColumn("k", F.expr("if(seq % 50 = 1, null, k)"))
    table = rows.select("k").distinct().where("k is not null").select("k", F.hash("k").alias("v"))
    table = table.unionByName(table.where("k = '7'").withColumn("v", F.lit(1)))  # several rows of one key
    cfg = TriageConfig(hot_key_rows=300, join_salts=5)
    assert hot_keys(rows, ["k"], cfg).count() == 2 and hot_keys(rows.limit(0), ["k"], cfg) is None
    for how in ("left", "inner"):
        got, want = lookup_join(rows, table, ["k"], cfg, how), rows.join(table, ["k"], how)
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    salted = lookup_join(rows, table, ["k"], cfg)
    assert salted.groupBy("k").count().count() == want.groupBy("k").count().count() + 1
