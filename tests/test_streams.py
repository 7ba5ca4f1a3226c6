"""Merging streams against the batch and the plain loop; reputations that change while a stream runs."""

import datetime as dt
import random
from collections import Counter
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from alertloom.config import TriageConfig
from alertloom.operators import intel
from alertloom.streaming import jobs
from test_dedup import SCHEMA, naive_groups, random_batch

CFG = TriageConfig()


def written(spark, rows, path):
    """A file per call; Spark reads them in the order of their times."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def counted(rows):
    return sorted((r.group_seq, r.occurrence_count) for r in rows)


def test_all_groups_of_a_stream(spark, tmp_path):
    """Ordered input with missing times, both kinds of times and missing addresses; nothing is late."""
    rows = random_batch(random.Random(4), 150, 0, 30)
    written(spark, rows, str(tmp_path / "in"))
    for name, job, threshold in (("exact", jobs.exact_dedup_stream, 2.0), ("fuzzy", jobs.fuzzy_dedup_stream, 0.9)):
        stream = job(jobs.read_alerts(spark, str(tmp_path / "in")), CFG, delay="10 minutes")
        got = jobs.all_groups(stream, str(tmp_path / name))
        want = naive_groups(rows, threshold=threshold)
        found = got.collect()
        assert counted(found) == sorted((k, len(v)) for k, v in want.items())
        # untimed groups never close, and the last ones are still open
        assert {r.closed for r in found} == {True, False}
        by_seq = {r[0]: r for r in rows}
        for r in found:
            stamps = [by_seq[k][2] for k in want[r.group_seq] if by_seq[k][2]]
            assert (r.first_seen, r.last_seen) == (min(stamps, default=None), max(stamps, default=None))
            assert (r.src_ip, r.dest_ip, r.signature) == (by_seq[r.group_seq][3], by_seq[r.group_seq][4], by_seq[r.group_seq][5])


def test_a_stream_goes_on(spark, tmp_path):
    """Groups grow over several starts of the query; what closed stays as it came out."""
    at = lambda minute: f"2026-01-01T{10 + minute // 60:02d}:{minute % 60:02d}:00Z"
    part = lambda seqs, minutes: [(s, f"a{s}", at(m) if m is not None else None, "1.1.1.1", None, "Port Scan") for s, m in zip(seqs, minutes)]
    path, folder = str(tmp_path / "in"), str(tmp_path / "run")

    def run():
        return jobs.all_groups(jobs.exact_dedup_stream(jobs.read_alerts(spark, path), CFG, delay="5 minutes"), folder)

    written(spark, part([0, 1, 2], [0, 30, None]), path)
    assert counted(run().collect()) == [(0, 2), (2, 1)]
    written(spark, part([3, 4], [85, None]), path)
    assert counted(run().collect()) == [(0, 3), (2, 2)]
    written(spark, part([5], [400]), path)
    rows = run().collect()
    assert counted(rows) == [(0, 3), (2, 2), (5, 1)]
    assert {r.group_seq for r in rows if r.closed} == {0}


class State:
    """One key's state in memory, with the calls that reach it."""

    def __init__(self):
        self.rows, self.calls, self.timers = {}, Counter(), set()

    def getMapState(self, *_):
        return self

    def iterator(self):
        return iter(list(self.rows.items()))

    def updateValue(self, key, value):
        self.calls["write"] += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls["write"] += 1
        del self.rows[key]

    def registerTimer(self, at):
        self.calls["timer"] += 1
        self.timers.add(at)


HOUR = 3_600_000_000


def micro_batch(state, rows, now=0):
    """The rows (seq, micros, signature) of a micro-batch, then the timers; gives (first number, count) of what closes."""
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
    job = jobs.OpenGroups(0.9, HOUR, False)
    job.init(state)
    frame = pd.DataFrame([(s, us, g, None) for s, us, g in rows], columns=["seq", "us", "signature", "stamp"])
    if rows:
        frames = (frame[k : k + 700] for k in range(0, len(frame), 700))
        list(job.handleInputRows(("=a", "=b", 2), frames, times))
    closed = []
    for at in sorted(t for t in state.timers if t < now):
        closed += [f for f in job.handleExpiredTimer(("=a", "=b", 2), times, None)]
        state.timers.discard(at)
    return sorted((r.group_seq, r.occurrence_count) for f in closed for r in f.itertuples())


def loop_of(rows):
    base = dt.datetime(1970, 1, 1)
    stamped = [(s, "", (base + dt.timedelta(microseconds=us)).isoformat(), "a", "b", g) for s, us, g in sorted(rows)]
    return sorted((k, len(v)) for k, v in naive_groups(stamped).items())


def test_many_open_groups_of_a_key():
    """Rows that go over the same weeks again and again, in an order unlike that of their numbers: as in the plain
    loop, with few calls to the state and one timer."""
    rng = random.Random(7)
    names = ["SSH Brute Force Login Attempt", "SSH Brute-Force Login Attempt", "Port Scan Detected"]
    passes = [sorted(rng.randrange(60) * 7 * HOUR + rng.randrange(3) * HOUR // 2 + rng.randrange(3) for _ in range(300)) for _ in range(5)]
    rows = [(s, us, rng.choice(names)) for s, us in enumerate(us for p in passes for us in p)]
    rng.shuffle(rows)
    want = loop_of(rows)
    assert len(want) > 150
    state = State()
    assert micro_batch(state, rows) == []
    assert state.calls["write"] <= 1 + len(want) // 100 and state.calls["timer"] == 1
    state.calls.clear()
    assert micro_batch(state, [], 10**10) == want
    assert not state.rows and state.calls["write"] <= 1 + len(want) // 100


def test_parts_of_open_groups_close_apart():
    """More groups than a part holds close as time goes by, those left go on."""
    state = State()
    first = [(s, s * 2 * HOUR, "Port Scan") for s in range(700)]
    assert micro_batch(state, first) == []
    assert len(state.rows) == 3
    hours = lambda n: n * 3_600_000 + 2
    # groups up to number 300 are an hour behind; two rows join later ones, one starts anew
    later = [(700, 600 * 2 * HOUR + HOUR, "port scan"), (701, 699 * 2 * HOUR, "Port Scan"), (702, 3000 * HOUR, "Port Scan")]
    assert micro_batch(state, later, hours(601)) == [(s, 1) for s in range(301)]
    assert micro_batch(state, [], hours(1201)) == [(s, 1) for s in range(301, 600)]
    assert micro_batch(state, [], hours(1202)) == [(600, 2)]
    rest = [(s, 1) for s in range(601, 699)] + [(699, 2), (702, 1)]
    assert micro_batch(state, [], hours(9999)) == rest
    assert not state.rows and not state.timers


def test_reputations_by_batch(spark, tmp_path):
    """Two snapshots, one for each micro-batch, and the caller's trigger."""
    table = intel.fuse(
        spark.sql(
            """SELECT 'ip' AS ioc_type, '8.8.8.8' AS ioc, 'abuseipdb' AS provider, timestamp'2026-01-01 00:00:00' AS fetched_at, CAST(NULL AS string) AS error,
               90 AS abuse_confidence_score, 1 AS total_reports, 'NL' AS country, false AS is_tor, CAST(NULL AS map<string,int>) AS stats,
               CAST(NULL AS int) AS pulse_count, CAST(NULL AS array<string>) AS names, CAST(NULL AS string) AS type_description"""
        ),
        CFG,
    )
    intel.write_snapshot(table, str(tmp_path / "s0"))
    intel.write_snapshot(table.withColumn("verdict", F.lit("clean")), str(tmp_path / "s1"))
    alert = lambda s: f"{s}L AS seq, '8.8.8.8' AS src_ip, CAST(NULL AS string) AS dest_ip, 'x' AS message, '' AS raw"
    now = F.lit("2026-01-01 00:10:00").cast("timestamp")
    for s in range(2):
        spark.sql(f"SELECT {alert(s)}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_alerts(spark, str(tmp_path / "in"))
        query = jobs.enrich_stream(stream, lambda n: str(tmp_path / f"s{n}"), CFG, str(tmp_path / "run"), as_of=now, processingTime="0 seconds")
        query.processAllAvailable()
        query.stop()
    got = {r.seq: r.verdict for r in spark.read.parquet(str(tmp_path / "run" / "out")).where("slot = 'src_ip'").collect()}
    assert got == {0: "malicious", 1: "clean"}
