"""Structured Streaming jobs: normalise, merge repeats, attach reputations.

The stateless part is the batch code unchanged. Merging keeps the open groups of an address pair until
event time has moved past their window; rows later than the watermark are dropped. Alerts without a
usable time merge with each other, as in the batch. Groups come out once they are closed, and those
still open can be read from the state at any time, so nothing is lost when the input ends.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from alertloom.config import TriageConfig
from alertloom.functions.similarity import SignatureIndex
from alertloom.functions.timestamps import NO_TIME
from alertloom.operators import attack, intel
from alertloom.operators.dedup import _key, with_event_time
from alertloom.operators.ioc import ioc_table, with_extraction
from alertloom.operators.normalize import normalize
from alertloom.operators.validate import valid_alerts
from alertloom.schemas import PARSED
from alertloom.sources.ingest import route_lines, stream_log_lines

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_lines(spark: SparkSession, path: str, jsonl: bool = False) -> DataFrame:
    """(seq, file, kind, record) of log files as they arrive. ``seq`` tells lines apart but does not order
    them; merging such a stream goes by event time (``dedup_order="time"``)."""
    return route_lines(stream_log_lines(spark, path), jsonl)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Normalised alerts with ``seq`` from Parquet files as they arrive."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def normalized_stream(records: DataFrame) -> DataFrame:
    """Normalise, validate, tag and extract: stateless, so any trigger and any parallelism will do."""
    alerts = valid_alerts(normalize(records)).select("seq", *[f.name for f in PARSED.fields])
    return with_extraction(attack.tag_with_rules(alerts))


def _keyed(alerts: DataFrame, cfg: TriageConfig, delay: str) -> DataFrame:
    """What grouping reads. A null event time is never late and never moves the watermark."""
    timed = with_event_time(alerts, cfg).withColumn("event_time", F.timestamp_micros("ts_us"))
    return timed.withWatermark("event_time", delay).select(
        "seq", "event_time",
        F.coalesce("ts_us", F.lit(0).cast("bigint")).alias("us"),
        F.when(F.col("ts_us").isNull(), F.lit(NO_TIME)).otherwise(F.col("ts_zone")).alias("zone"),
        F.coalesce("signature", F.lit("")).alias("signature"),
        F.when(F.col("timestamp") != "", F.col("timestamp")).alias("stamp"),
        _key("src_ip").alias("src_key"), _key("dest_ip").alias("dest_key"),
    )


GROUP_OUT = (
    "group_seq bigint, src_key string, dest_key string, zone int, signature string, "
    "occurrence_count int, first_seen string, last_seen string"
)
_GROUP_FIELDS = ["seq", "signature", "us", "n", "first_seen", "last_seen"]
_PART_STATE = (
    "seq array<bigint>, signature array<string>, us array<bigint>, n array<bigint>, "
    "first_seen array<string>, last_seen array<string>"
)
# Open groups that share a row of the state: each access to it is a call to the JVM.
PART_GROUPS = 256
# Rows that are Python objects at a time; the others of a micro-batch wait in arrays.
BLOCK_ROWS = 100_000


class _Rows:
    """One key's rows of a micro-batch, in arrays."""

    def __init__(self, frames: Iterator[pd.DataFrame], index: SignatureIndex) -> None:
        parts = [
            (
                f["seq"].to_numpy(), f["us"].to_numpy(dtype=np.int64), self._numbers(f["signature"], index),
                pa.array(f["stamp"], pa.large_string(), from_pandas=True),
            )
            for f in frames
        ]
        seq, self.us, self.number = (np.concatenate([p[k] for p in parts]) for k in range(3))
        self.no_seq = pd.isna(seq)
        self.seq = np.where(self.no_seq, 0, seq).astype(np.int64)
        self.stamp = pa.concat_arrays([p[3] for p in parts])

    @staticmethod
    def _numbers(signatures: pd.Series, index: SignatureIndex) -> np.ndarray:
        codes, distinct = pd.factorize(signatures)
        return np.array([index.number(s) for s in distinct], dtype=np.int32)[codes]

    def in_order(self, by_time: bool) -> Iterator[tuple[int | None, int, int, str | None]]:
        order = np.lexsort((self.seq, self.no_seq, self.us) if by_time else (self.seq, self.no_seq))
        for start in range(0, len(order), BLOCK_ROWS):
            at = order[start : start + BLOCK_ROWS]
            seq = self.seq[at].tolist()
            if self.no_seq[at].any():
                seq = [None if missing else s for s, missing in zip(seq, self.no_seq[at].tolist())]
            yield from zip(seq, self.us[at].tolist(), self.number[at].tolist(), self.stamp.take(pa.array(at)).to_pylist())


class _Groups:
    """Open groups [seq, signature, latest time, count, first stamp, last stamp] in order of creation, and
    those of each signature by the stretch of a window that their latest time lies in: a row looks at its own stretch and the
    two beside it, however many groups are open."""

    def __init__(self, window: int, index: SignatureIndex, known: list[list]) -> None:
        self.window, self.index, self.width = window, index, max(1, window)
        self.all: list[list] = []
        self.number: list[int] = []
        self.stretches: list[dict[int, list[int]]] = []
        self.accepting: dict[int, list[dict[int, list[int]]]] = {}
        for group in known:
            self._add(index.number(group[1]), group)

    def _of(self, number: int) -> dict[int, list[int]]:
        while len(self.stretches) <= number:
            self.stretches.append({})
        return self.stretches[number]

    def _add(self, number: int, group: list) -> None:
        self._of(number).setdefault(group[2] // self.width, []).append(len(self.all))
        self.all.append(group)
        self.number.append(number)

    def place(self, seq: int | None, us: int, number: int, stamp: str | None) -> int:
        """The number of the first group that takes the row. All signatures have their numbers by now."""
        accepting = self.accepting.get(number)
        if accepting is None:
            accepting = self.accepting[number] = [self._of(k) for k in self.index.matching(number)]
        groups, window = self.all, self.window
        best, here = len(groups), us // self.width
        for stretches in accepting:
            for k in (here, here - 1, here + 1):
                for g in stretches.get(k, ()):
                    if g >= best:
                        break
                    if -window <= groups[g][2] - us <= window:
                        best = g
                        break
        if best == len(groups):
            self._add(number, [seq, self.index.texts[number], us, 1, stamp, stamp])
            return best
        group = groups[best]
        if us > group[2]:
            was = group[2] // self.width
            group[2] = us
            if was != here:
                self._move(self.stretches[self.number[best]], best, was, here)
        group[3] += 1
        if stamp is not None:
            if group[4] is None or stamp < group[4]:
                group[4] = stamp
            if group[5] is None or stamp > group[5]:
                group[5] = stamp
        return best

    @staticmethod
    def _move(stretches: dict[int, list[int]], g: int, was: int, now: int) -> None:
        left = stretches[was]
        del left[bisect_left(left, g)]
        if not left:
            del stretches[was]
        insort(stretches.setdefault(now, []), g)


class OpenGroups(StatefulProcessor):
    """The open groups of one address pair and zone class (and of one signature, where equal ones are merged only).

    The state holds them in parts of up to PART_GROUPS; a micro-batch writes back the parts it touched. A key
    has a timer for the group that event time leaves behind first: it closes what is due and sets the next one.
    Groups without a time have no timer: like in a batch, they stay open as long as the stream lives.
    """

    def __init__(self, threshold: float, window: int, by_time: bool) -> None:
        self.threshold, self.window, self.by_time = threshold, window, by_time

    def init(self, handle) -> None:
        self.handle = handle
        self.groups = handle.getMapState("groups", "part bigint", _PART_STATE)
        # Keys whose due groups this micro-batch has closed.
        self.settled: set[tuple] = set()

    def _open(self) -> dict[int, list[list]]:
        """The state's parts."""
        return {k[0]: [list(g) for g in zip(*v)] for k, v in self.groups.iterator()}

    def _write(self, part: int, groups: list[list]) -> None:
        if groups:
            self.groups.updateValue((part,), tuple(list(values) for values in zip(*groups)))
        else:
            self.groups.removeKey((part,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = self._open()
        places = sorted(((g, part) for part, held in parts.items() for g in held), key=lambda p: p[0][0] if p[0][0] is not None else math.inf)
        index = SignatureIndex(self.threshold)
        batch = _Rows(rows, index)
        groups = _Groups(self.window, index, [g for g, _ in places])
        touched = {groups.place(*row) for row in batch.in_order(self.by_time)}

        changed = {places[g][1] for g in touched if g < len(places)}
        last = max(parts, default=0)
        for g in range(len(places), len(groups.all)):
            if len(parts.get(last, ())) >= PART_GROUPS:
                last += 1
            parts.setdefault(last, []).append(groups.all[g])
            changed.add(last)
        for part in changed:
            self._write(part, parts[part])
        if key[2] != NO_TIME:
            self._set_timer(groups.all, timerValues)
        return iter(())

    def _due(self, group: list) -> int:
        """Milliseconds from which no alert can join any more."""
        return (group[2] + self.window) // 1000 + 1

    def _set_timer(self, groups: list[list], timerValues) -> None:
        self.handle.registerTimer(max(min(map(self._due, groups)), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.settled:
            return
        self.settled.add(key)
        now = timerValues.getCurrentWatermarkInMs()
        closed, left, changed = [], [], []
        parts = self._open()
        for part, held in parts.items():
            kept = [g for g in held if self._due(g) > now]
            if len(kept) < len(held):
                closed += [g for g in held if self._due(g) <= now]
                left += kept
                changed.append(part)
                parts[part] = []
        # What is left of the parts moves together.
        for at, part in enumerate(changed):
            parts[part] = left[at * PART_GROUPS : (at + 1) * PART_GROUPS]
            self._write(part, parts[part])
        still_open = [g for held in parts.values() for g in held]
        if still_open:
            self._set_timer(still_open, timerValues)
        if closed:
            rows = [(g[0], key[0], key[1], key[2], g[1], g[3], g[4], g[5]) for g in sorted(closed, key=lambda g: (g[0] is None, g[0]))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in GROUP_OUT.split(", ")])

    def close(self) -> None:
        pass


def _merged(alerts: DataFrame, cfg: TriageConfig, delay: str, threshold: float, extra: list[str]) -> DataFrame:
    return (
        _keyed(alerts, cfg, delay)
        .groupBy("src_key", "dest_key", "zone", *extra)
        .transformWithStateInPandas(
            statefulProcessor=OpenGroups(threshold, cfg.window_micros, cfg.dedup_order == "time"),
            outputStructType=GROUP_OUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def exact_dedup_stream(alerts: DataFrame, cfg: TriageConfig, delay: str) -> DataFrame:
    """Equal signatures of an address pair, merged as in the batch. A group comes out once it is
    closed; ``open_groups`` has the others."""
    return _merged(alerts, cfg, delay, 2.0, ["signature"])


def fuzzy_dedup_stream(alerts: DataFrame, cfg: TriageConfig, delay: str) -> DataFrame:
    """Similar signatures of an address pair, merged as in the batch."""
    return _merged(alerts, cfg, delay, cfg.dedup_fuzzy_threshold, [])


def open_groups(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The groups that a merging stream still holds, read from its state; the stream may go on later."""
    state = spark.read.format("statestore").option("stateVarName", "groups").load(checkpoint)
    each = state.select("key", F.inline(F.arrays_zip(*[f"user_map_value.{c}" for c in _GROUP_FIELDS])))
    return each.select(
        F.col("seq").alias("group_seq"), F.col("key.src_key").alias("src_key"),
        F.col("key.dest_key").alias("dest_key"), F.col("key.zone").alias("zone"), "signature",
        F.col("n").cast("int").alias("occurrence_count"), "first_seen", "last_seen",
    )


def start(stream: DataFrame, folder: str, **trigger):
    """The running query that appends a stream's rows to ``folder``/out. ``trigger`` as in ``trigger()``; by
    default it takes what there is and ends. Started again on the same folder it goes on where it stopped."""
    # Merging keeps a row per group, which only this store does.
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def batch_of(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything there is and give its output as a table."""
    start(stream, folder).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def all_groups(stream: DataFrame, folder: str) -> DataFrame:
    """The same for a merging stream, with the groups still open at the end."""

    def address(key: str) -> Column:
        return F.when(F.col(key) != "", F.substring(key, 2, 2**31 - 1))

    closed = batch_of(stream, folder).withColumn("closed", F.lit(True))
    still_open = open_groups(stream.sparkSession, f"{folder}/checkpoint").withColumn("closed", F.lit(False))
    return closed.unionByName(still_open).select(
        "group_seq", address("src_key").alias("src_ip"), address("dest_key").alias("dest_ip"), "signature",
        "occurrence_count", "first_seen", "last_seen", "closed",
    )


def enrich_stream(
    alerts: DataFrame,
    snapshot: str | Callable[[int], str],
    cfg: TriageConfig,
    folder: str,
    as_of: Column | None = None,
    **trigger,
):
    """The running query that attaches reputations to alerts as they arrive and writes ``folder``/out, a folder per micro-batch.

    ``snapshot`` is the path of the reputation table, or gives it by the number of the micro-batch; a
    path is read anew each time. ``trigger`` as in ``trigger()``; by default the query takes what there is and ends. A
    repeated micro-batch overwrites its own output.
    """
    path_of = snapshot if callable(snapshot) else lambda batch_id: snapshot

    def attach(batch: DataFrame, batch_id: int) -> None:
        now = as_of if as_of is not None else F.current_timestamp()
        known = intel.fresh(batch.sparkSession.read.parquet(path_of(batch_id)), now, cfg)
        results = intel.attach(ioc_table(batch), known, cfg)
        results.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    return (
        alerts.writeStream.foreachBatch(attach)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
