import datetime as dt
import difflib
import random

import pandas as pd
import pytest
from dateutil import parser
from pyspark.sql import functions as F

from alertloom.config import TriageConfig
from alertloom.functions.similarity import SignatureIndex, ratio
from alertloom.operators.dedup import _group_rows, _group_sessions, dedup, gap_islands, match_signatures, with_event_time

SCHEMA = "seq bigint, id string, timestamp string, src_ip string, dest_ip string, signature string"


def parse(text, year=2024):
    if not text:
        return None
    try:
        return parser.parse(text, default=dt.datetime(year, 1, 1))
    except (ValueError, OverflowError):
        return None


def naive_groups(alerts, minutes=60, threshold=0.9):
    """The definition, as a loop: {seq of first member: [seq, ...]}."""
    groups = []
    for seq, _, stamp, src, dest, signature in alerts:
        ts = parse(stamp)
        for g in groups:
            if g["pair"] != (src, dest):
                continue
            if g["signature"] != signature and (
                difflib.SequenceMatcher(None, g["signature"].lower(), signature.lower()).ratio() < threshold
            ):
                continue
            if (g["ts"] is None) != (ts is None):
                continue
            if ts is not None:
                if (g["ts"].tzinfo is None) != (ts.tzinfo is None):
                    continue
                if abs((g["ts"] - ts).total_seconds()) > minutes * 60:
                    continue
                g["ts"] = max(g["ts"], ts)
            g["members"].append(seq)
            break
        else:
            groups.append({"pair": (src, dest), "signature": signature, "ts": ts, "members": [seq]})
    return {g["members"][0]: g["members"] for g in groups}


def spark_groups(spark, alerts, cfg=TriageConfig(), **kw):
    result = dedup(spark.createDataFrame(alerts, SCHEMA), cfg, **kw)
    out = {}
    for r in result.members().collect():
        out.setdefault(r.group_seq, []).append(r.seq)
    groups = {k: sorted(v) for k, v in out.items()}
    counts = {r.group_seq: r.occurrence_count for r in result.groups.collect()}
    assert counts == {k: len(v) for k, v in groups.items()}
    return groups, result


def alert(i, signature, stamp, src="1.2.3.4", dest="5.6.7.8"):
    return (i, f"a{i}", stamp, src, dest, signature)


PAIRS = [
    ("SSH Brute Force", "2026-01-01T10:00:00", "SSH Brute Force", "2026-01-01T10:05:00", {}, 1),
    ("SSH Brute Force", "2026-01-01T10:00:00", "SSH Brute Force", "2026-02-15T10:00:00", {}, 2),
    ("SSH Brute Force Attempt", "2026-01-01T10:00:00", "SSH Brute-Force Attempt", "2026-01-01T10:02:00", {}, 1),
    ("SSH Brute Force", "2026-01-01T10:00:00", "Port Scan Detected", "2026-01-01T10:01:00", {}, 2),
    ("SSH Brute Force", None, "SSH Brute Force", None, {}, 1),
    ("SSH Brute Force", None, "SSH Brute Force", "2026-01-01T10:00:00", {}, 2),
    ("SSH Brute Force", "2026-01-01T10:00:00", "SSH Brute Force", "2026-01-01T10:01:00", {"src": "9.9.9.9"}, 2),
    ("S", "2026-01-01T10:00:00", "S", "2026-01-01T11:00:00", {}, 1),
    ("S", "2026-01-01T10:00:00", "S", "2026-01-01T11:00:00.000001", {}, 2),
    ("S", "2026-01-01T10:00:00", "S", "2026-01-01T10:00:00Z", {}, 2),
    ("S", "2026-01-01T10:00:00Z", "S", "2026-01-01T12:30:00+02:00", {}, 1),
    ("S", "", "S", "not a time", {}, 1),
]


@pytest.mark.parametrize("case", PAIRS)
def test_two_alerts(spark, case):
    a, ta, b, tb, other, want = case
    rows = [alert(0, a, ta), alert(1, b, tb, **other)]
    assert naive_groups(rows).keys().__len__() == want
    groups, _ = spark_groups(spark, rows)
    assert len(groups) == want


SIGNATURES = [
    "SSH Brute Force Login Attempt",
    "SSH Brute-Force Login Attempt",
    "SSH Brute Force Login Attempts!",
    "ssh brute force login attempt",
    "SSH Brute Farce Logon Attempt",
    "Port Scan Detected",
    "Port Scan Detected.",
    "",
]


def random_batch(rng, n, disorder, span_hours, pairs=2):
    base = dt.datetime(2026, 1, 1)
    rows = []
    times = sorted(rng.uniform(0, span_hours * 3600) for _ in range(n))
    for i, t in enumerate(times):
        if rng.random() < 0.3:
            t = round(t / 1800) * 1800  # exact half hours meet the window edge
        times[i] = t
    times.sort()
    keyed = sorted(range(n), key=lambda i: times[i] + rng.uniform(0, disorder))
    for seq, i in enumerate(keyed):
        stamp = (base + dt.timedelta(seconds=times[i])).isoformat()
        kind = rng.random()
        if kind < 0.08:
            stamp = None
        elif kind < 0.2:
            stamp += "Z"
        src = None if rng.random() < 0.3 else f"10.0.0.{rng.randrange(pairs)}"
        rows.append((seq * 3, f"a{seq}", stamp, src, None, rng.choice(SIGNATURES)))
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("disorder", [0, 60, 1500, 10**6])
def test_equals_the_naive_loop(spark, seed, disorder):
    rng = random.Random(f"{seed}/{disorder}")
    rows = []
    # Many small batches at once, told apart by their target address.
    for b in range(25):
        batch = random_batch(rng, rng.randrange(2, 40), disorder, rng.choice([2, 8, 30]))
        rows += [(len(rows) + k, i, t, s, f"d{b}", g) for k, (_, i, t, s, _, g) in enumerate(batch)]
    cfg = TriageConfig(block_rows=7)
    assert spark_groups(spark, rows, cfg)[0] == naive_groups(rows)
    exact = naive_groups(rows, threshold=2.0)
    assert spark_groups(spark, rows, cfg, fuzzy=False)[0] == exact


def test_time_order_equals_the_loop_over_sorted_input(spark):
    rng = random.Random(5)
    rows = random_batch(rng, 300, 10**6, 40)
    floor = dt.datetime(1, 1, 1)

    def when(r):
        ts = parse(r[2])
        return (ts.replace(tzinfo=None) if ts else floor, r[0])

    want = {k: sorted(v) for k, v in naive_groups(sorted(rows, key=when)).items()}
    got, result = spark_groups(spark, rows, TriageConfig(dedup_order="time"))
    assert got == want and result.row_groups is None


def test_ordered_input_never_goes_row_by_row(spark):
    rows = random_batch(random.Random(1), 400, 0, 60)
    _, result = spark_groups(spark, rows)
    assert result.row_groups is None


def test_group_columns(spark):
    rows = [
        alert(0, "B", "2026-01-01T10:10:00", src="2.2.2.2"),
        alert(1, "A", "2026-01-01T10:00:00"),
        alert(2, "A", "2026-01-01T9:30:00"),
        alert(3, "A", "2026-01-01T10:40:00"),
        alert(4, "C", None),
        alert(5, "C", ""),
    ]
    _, result = spark_groups(spark, rows)
    reps = {r.seq: r for r in result.representatives().collect()}
    assert sorted(reps) == [0, 1, 4]
    r = reps[1]
    # First and last seen compare as text.
    assert (r.id, r.occurrence_count, r.first_seen, r.last_seen) == ("a1", 3, "2026-01-01T10:00:00", "2026-01-01T9:30:00")
    assert (reps[4].first_seen, reps[4].occurrence_count, reps[4].bucket_seq) == (None, 2, 1)
    parts = {(p.group_seq, p.part): p.related_ids for p in result.related_ids().collect()}
    assert parts[(1, 0)] == ["a1", "a2", "a3"]


def test_timestamps_agree_with_dateutil(spark):
    texts = [
        "2025-01-01T10:00:00Z", "2025-01-01 10:00:00.5", "2025-01-01T10:00:00,25+05:30", "2025-01-01T10:00:00-0800",
        "2025-01-01T10:00", "2025-01-01", "20250101T100000Z", "Jan  5 10:00:00", "Feb 29 10:00:00", "feb 3 1:00",
        "Wed, 01 Jan 2025 10:00:00 +0000", "01/02/2025 10:00 PM", "2025-13-01 00:00:00", "2025-02-30T00:00:00",
        "2025-01-01T24:00:00", "2025-01-01T10:00:60Z", "1735725600", "1735725600000", "x", "", None,
        "Jan 1, 2025 @ 10:00:00.000", "2025-01-01T10:00:00.123456789Z", "0000-01-01T00:00:00Z", "Dec 31 23:59:59",
        "2025-01-01T10:00.5", "1969-07-20T20:17:40Z", "2025-01-01T10:00:00+14:00", "2025-1-1 9:00",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, timestamp string")
    rows = with_event_time(df, TriageConfig()).orderBy("i").collect()
    epoch = dt.datetime(1970, 1, 1)
    for text, row in zip(texts, rows):
        ts = parse(text)
        if ts is None:
            want = (None, 0)
        elif ts.tzinfo is None:
            want = ((ts - epoch) // dt.timedelta(microseconds=1), 1)
        else:
            utc = ts.astimezone(dt.timezone.utc).replace(tzinfo=None)
            want = ((utc - epoch) // dt.timedelta(microseconds=1), 2)
        assert (row.ts_us, row.ts_zone) == want, text


def test_index_loses_no_match():
    rng = random.Random(3)
    words = ["login", "failed", "scan", "port", "attempt", "brute", "force", "é", "x" * 230]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 5))) + rng.choice("!. ") for _ in range(150)]
    index = SignatureIndex(0.8)
    for t in texts:
        index.number(t)
    for t, n in index.numbers.items():
        want = [m for u, m in index.numbers.items() if u == t or ratio(u, t) >= 0.8]
        assert index.matching(n) == sorted(want)


def test_match_signatures(spark):
    pairs = [("SSH Brute Force Attempt", "SSH Brute-Force Attempt"), ("a", "a"), ("abc", "xyz"), ("short", "x" * 50)]
    rows = match_signatures(
        spark.createDataFrame(pairs * 2, "group_signature string, signature string"), TriageConfig()
    ).collect()
    got = {(r.group_signature, r.signature): r.match for r in rows}
    assert got == {pairs[0]: True, pairs[1]: True, pairs[2]: False, pairs[3]: False}
    assert [r.ratio for r in rows if not r.match] == [None, None]


def test_islands(spark):
    rows = [
        alert(0, "A", "2026-01-01T10:00:00"),
        alert(1, "B", "2026-01-01T12:00:01"),
        alert(2, "C", "2026-01-01T11:00:00"),
        alert(3, "A", None),
    ]
    got = {r.seq: (r.ts_zone, r.island) for r in gap_islands(spark.createDataFrame(rows, SCHEMA), TriageConfig()).collect()}
    assert got == {0: (1, 0), 2: (1, 0), 1: (1, 1), 3: (0, 0)}


def test_only_odd_times_go_through_python(spark, monkeypatch):
    """Times that built-in expressions read never meet dateutil; the others still get their time."""
    from alertloom.operators import dedup as module

    stamps = ["2025-01-01T10:00:00Z", "2025-01-01 10:00:00", "Jan  1 10:00:00", "2025-01-01", None, ""]
    odd = ["1 January 2025 10:00 UTC", "no time at all"]
    row = lambda i, t: (i, str(i), t, f"rule {i}", "10.0.0.1", "10.0.0.2")
    schema = "seq long, id string, timestamp string, signature string, src_ip string, dest_ip string"
    sent = []
    parse_rest = module.parse_rest

    def watched(rows, text, cfg):
        sent.extend(r.timestamp for r in rows.select(text).collect())
        return parse_rest(rows, text, cfg)

    monkeypatch.setattr(module, "parse_rest", watched)
    cfg = TriageConfig()
    assert dedup(spark.createDataFrame([row(i, t) for i, t in enumerate(stamps)], schema), cfg).groups.count() == 6
    assert sent == []
    df = spark.createDataFrame([row(i, t) for i, t in enumerate(stamps + odd)], schema)
    want = {(r.seq, r.ts_us, r.ts_zone) for r in with_event_time(df, cfg).collect()}
    assert {(r.seq, r.ts_us, r.ts_zone) for r in module.staged_with_time(df, cfg).collect()} == want
    assert sorted(sent) == sorted(odd)


def test_few_groups_meet_alerts_without_a_shuffle(spark):
    schema = "seq long, id string, timestamp string, signature string, src_ip string, dest_ip string"
    df = spark.createDataFrame([(i, str(i), "2025-01-01T10:00:00Z", "rule", "10.0.0.1", "10.0.0.2") for i in range(50)], schema)
    first = dedup(df, TriageConfig()).representatives()
    assert [r.occurrence_count for r in first.collect()] == [50]
    assert "BroadcastHashJoin" in first._jdf.queryExecution().sparkPlan().toString()


def test_small_islands_share_frames():
    """Islands are many and small: what comes in as one batch goes out as one frame, and one for what stays in doubt."""
    n = 300
    rows = pd.DataFrame(
        {"src_key": "=a", "dest_key": "=b", "zone": 2, "block": [k // 2 for k in range(n)], "island": 0, "signature": [f"S{k % 2}" for k in range(n)],
         "session": range(n), "first_us": 0, "end": 0, "late": 0, "unsure": [k // 2 % 10 == 0 for k in range(n)]}
    )
    # the second batch begins inside an island
    frames = list(_group_sessions(0.9, 10)(iter([rows[:201], rows[201:]])))
    assert len(frames) <= 5
    out = pd.concat(frames)
    placed = out[out.part.isna()]
    assert placed.session.tolist() == placed.group_seq.tolist() == list(range(n))
    doubtful = out[out.part.notna()]
    assert sorted(zip(doubtful.block, doubtful.signature)) == [(b, f"S{j}") for b in range(0, n // 2, 10) for j in range(2)]
    one = rows.assign(seq=range(n), id="", us=0, stamp=None, part=0)
    frames = list(_group_rows(0.9, 10)(iter([one[:201], one[201:]])))
    assert len(frames) == 2 and pd.concat(frames).group_seq.tolist() == list(range(n))
