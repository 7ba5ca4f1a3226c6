"""Merging repeated alerts.

An alert joins the first group of its address pair whose signature is similar enough and whose
latest member is at most the window away; groups form in input order (``seq``). Done literally
that is one sequential loop per address pair, and one pair may hold a third of all rows. So:

1. Signatures fall into *blocks* of similar ones (``operators/signatures.py``); no group spans two.
   A pair's rows are dealt out by block, and every step below looks at one block of one pair.
2. Rows shrink to *cells*: one row per (pair, signature, small part of the window), combined before
   the shuffle. The rest works on cells, whose number follows the time span, not the rows.
3. Where a block of a pair is silent for longer than the window no group can span the silence, in
   any input order. These *islands* are independent.
4. Cells of one signature without such a gap form a *session*. When input order follows time up
   to a lateness L, all rows of a session land in one group, provided no gap that matters lies
   within L of the window length. Then groups form over sessions instead of rows. L is read off the
   cells' first and last times and sequence numbers, like a zone map: rows of a cell are late by its
   width at most, rows of different cells by what their bounds allow. No row is sorted for that.
   Islands where this bound is too coarse have their lateness measured row by row, and only they.
5. An island with one signature needs no more: a group is a session. Islands with several
   signatures stream their sessions, in order, through a small grouping loop.
6. Only signatures for which step 4 cannot be shown to hold go row by row, and only with the
   signatures of the same island they can be mixed up with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from alertloom.config import TriageConfig
from alertloom.functions.similarity import SignatureIndex, signature_ratio
from alertloom.functions.timestamps import NO_TIME, SHAPE, parse_built_in, parse_rest, parse_timestamp
from alertloom.operators.materialize import staged
from alertloom.operators.signatures import blocks, candidates
from alertloom.operators.skew import lookup_join

PAIR = ["src_key", "dest_key", "zone"]
# What is grouped apart from everything else.
UNIT = [*PAIR, "block"]
# Cells to a window.
CELLS = 64


def _key(name: str) -> Column:
    """A null-free stand-in, so that missing addresses group and join as equals."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))


def _cell_micros(cfg: TriageConfig) -> int:
    return max(1, cfg.window_micros // CELLS)


def with_event_time(alerts: DataFrame, cfg: TriageConfig) -> DataFrame:
    """Adds ``ts_us`` (UTC micros, null when there is no usable time) and ``ts_zone``."""
    return parse_timestamp(alerts, "timestamp", cfg)


def staged_with_time(alerts: DataFrame, cfg: TriageConfig) -> DataFrame:
    """The same, written. Only rows whose time no built-in expression reads go through Python, from the written table."""
    if not cfg.lenient_timestamps:
        return staged(with_event_time(alerts, cfg))
    first = staged(parse_built_in(alerts, "timestamp", cfg))
    other = F.coalesce(F.col(SHAPE) == "other", F.lit(False))
    if first.filter(other).isEmpty():
        return first.drop(SHAPE)
    rest = staged(parse_rest(first.filter(other), "timestamp", cfg))
    return first.filter(~other).unionByName(rest).drop(SHAPE)


def _written(alerts: DataFrame, cfg: TriageConfig) -> DataFrame:
    """What grouping reads of alerts, with their times; a table that has these is read as it is."""
    if "ts_us" in alerts.columns:
        return alerts
    kept = [c for c in ("seq", "id", "src_ip", "dest_ip", "timestamp", "signature") if c in alerts.columns]
    return staged_with_time(alerts.select(*kept), cfg)


def _narrow(timed: DataFrame, cfg: TriageConfig) -> DataFrame:
    """Only what grouping reads. Rows without a time share one instant of their own zone class."""
    us = F.coalesce("ts_us", F.lit(0).cast("bigint"))
    width = F.lit(_cell_micros(cfg))
    return timed.select(
        "seq",
        (F.col("id") if "id" in timed.columns else F.lit(None).cast("string")).alias("id"),
        _key("src_ip").alias("src_key"),
        _key("dest_ip").alias("dest_key"),
        F.when(F.col("ts_us").isNull(), F.lit(NO_TIME)).otherwise(F.col("ts_zone")).alias("zone"),
        us.alias("us"),
        ((us - F.pmod(us, width)) / width).cast("bigint").alias("cell"),
        F.coalesce("signature", F.lit("")).alias("signature"),
        F.when(F.col("timestamp") != "", F.col("timestamp")).alias("stamp"),
    )


# --- islands -----------------------------------------------------------------------------


def gap_islands(alerts: DataFrame, cfg: TriageConfig) -> DataFrame:
    """(seq, src_ip, dest_ip, ts_zone, island): the independent stretch each alert falls into,
    numbered per pair; a new one starts after each silence longer than the window."""
    rows = _narrow(_written(alerts, cfg), cfg)
    in_time = Window.partitionBy(*PAIR).orderBy("cell")
    cells = (
        rows.groupBy(*PAIR, "cell")
        .agg(F.min("us").alias("min_us"), F.max("us").alias("max_us"))
        .withColumn("cut", F.col("min_us") - F.lag("max_us").over(in_time) > cfg.window_micros)
        .withColumn("island", F.count_if("cut").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
        .select(*PAIR, "cell", "island")
    )
    placed = lookup_join(rows.select("seq", *PAIR, "cell"), cells, [*PAIR, "cell"], cfg)

    def address(key: str) -> Column:
        return F.when(F.col(key) != "", F.substring(key, 2, 2**31 - 1))

    return placed.select(
        "seq",
        address("src_key").alias("src_ip"),
        address("dest_key").alias("dest_ip"),
        F.col("zone").alias("ts_zone"),
        "island",
    )


# --- sessions ----------------------------------------------------------------------------


def _in_blocks(rows: DataFrame, cfg: TriageConfig, fuzzy: bool) -> DataFrame:
    """The rows with their signature's block: a number that all signatures of a block have, and few others."""
    if not fuzzy:
        return rows.withColumn("block", F.xxhash64("signature"))
    known = blocks(rows.select("signature").distinct(), cfg)
    if known is None:
        return rows.withColumn("block", F.xxhash64("signature"))
    known = known.select("signature", F.xxhash64("block").alias("block"))
    return rows.join(known, "signature", "left").withColumn("block", F.coalesce("block", F.xxhash64("signature")))


def _gathered(by_time: bool) -> list[Column]:
    return [
        F.min(F.struct("us", "seq") if by_time else F.struct("seq", "us")).alias("first"),
        F.min("us").alias("min_us"),
        F.max("us").alias("max_us"),
        F.max("seq").alias("max_seq"),
        F.count("*").alias("n"),
        F.min("stamp").alias("first_seen"),
        F.max("stamp").alias("last_seen"),
    ]


def _cells(rows: DataFrame, cfg: TriageConfig) -> DataFrame:
    """One row per (unit, signature, cell)."""
    return rows.groupBy(*UNIT, "signature", "cell").agg(*_gathered(cfg.dedup_order == "time"))


def _measured_cells(rows: DataFrame, cfg: TriageConfig) -> DataFrame:
    """The same with ``late``: how far a row of the cell lies behind the latest time its unit has shown in it before.

    In input order it is measured in stretches of ``block_rows`` sequence numbers, so that a hot
    cell is spread over many tasks, and carried from one to the next by their bounds.
    """
    combine = [
        F.min("first").alias("first"),
        F.min("min_us").alias("min_us"),
        F.max("max_us").alias("max_us"),
        F.max("max_seq").alias("max_seq"),
        F.sum("n").alias("n"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("late").alias("late"),
    ]
    stretch = [*UNIT, "cell", "stretch"]
    before = Window.partitionBy(*stretch).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.withColumn("stretch", (F.col("seq") / cfg.block_rows).cast("bigint"))
        .withColumn("late", F.max("us").over(before) - F.col("us"))
        .groupBy(*stretch, "signature")
        .agg(*_gathered(False), F.max("late").alias("late"))
    )
    earlier = Window.partitionBy(*UNIT, "cell").orderBy("stretch").rangeBetween(Window.unboundedPreceding, -1)
    lag_behind = F.max("max_us").over(earlier) - F.col("min_us")
    return (
        parts.withColumn("late", F.greatest("late", lag_behind, F.lit(0).cast("bigint")))
        .groupBy(*UNIT, "cell", "signature")
        .agg(*combine)
    )


def _session_cells(cells: DataFrame, cfg: TriageConfig) -> DataFrame:
    """The cells, each with its island, its session and whether that session can be trusted.

    ``island`` is the number of its first cell. ``session`` is the sequence number of the
    session's first row, unique over all sessions. Every step below is partitioned by unit or
    finer, so the cells are shuffled once more in all.
    """
    window = F.lit(cfg.window_micros)
    in_time = Window.partitionBy(*UNIT).orderBy("cell")
    this_cell = in_time.rangeBetween(0, 0)
    past = in_time.rangeBetween(Window.unboundedPreceding, -1)
    up_to_here = in_time.rangeBetween(Window.unboundedPreceding, 0)
    silence = F.min("min_us").over(this_cell) - F.max("max_us").over(past)
    if cfg.dedup_order == "time":
        df = cells.withColumn("late", F.lit(0).cast("bigint"))
    elif "late" in cells.columns:
        df = cells
    else:
        # Not measured: no more than the cell is wide.
        df = cells.withColumn("late", F.max("max_us").over(this_cell) - F.min("min_us").over(this_cell))
    df = df.withColumn("silence", silence)
    starts = F.when(F.col("silence").isNull() | (F.col("silence") > window), F.col("cell"))
    df = df.withColumn("island", F.max(starts).over(up_to_here)).drop("silence")

    island = Window.partitionBy(*UNIT, "island")
    if cfg.dedup_order == "time":
        df = df.withColumn("island_late", F.col("late"))
    else:
        # Read in input order, a cell opens at its first row and closes at its last. Its rows may
        # lag behind any later cell opened before it closes.
        df = df.withColumn(
            "event",
            F.explode(
                F.array(
                    F.struct(F.col("first.seq").alias("at"), F.lit(0).alias("closing")),
                    F.struct(F.col("max_seq").alias("at"), F.lit(1).alias("closing")),
                )
            ),
        )
        so_far = island.orderBy("event.at", "event.closing").rowsBetween(Window.unboundedPreceding, 0)
        df = (
            df.withColumn("top_cell", F.max("cell").over(so_far))
            .withColumn("top_us", F.max("max_us").over(so_far))
            .filter("event.closing = 1")
        )
        behind = F.when(F.col("top_cell") > F.col("cell"), F.col("top_us") - F.col("min_us"))
        df = df.withColumn("island_late", F.max(F.greatest("late", behind)).over(island)).drop(
            "event", "top_cell", "top_us"
        )

    own = Window.partitionBy(*UNIT, "island", "signature").orderBy("cell")
    late = F.col("island_late")
    near_edge = (F.col("gap") > window - late) & (F.col("gap") <= window + late)
    df = (
        df.withColumn("gap", F.col("min_us") - F.lag("max_us").over(own))
        .withColumn(
            "session_no",
            F.count_if(F.col("gap") > window).over(own.rowsBetween(Window.unboundedPreceding, 0)),
        )
        # A gap too close to the window length for the lateness at hand, or lateness out of bounds.
        .withColumn("unsure", (late > window / 2) | F.coalesce(near_edge, F.lit(False)))
    )
    session = Window.partitionBy(*UNIT, "island", "signature", "session_no")
    return (
        df.withColumn("session", F.min("first").over(session)["seq"])
        .withColumn("alone", F.min("signature").over(island) == F.max("signature").over(island))
        .drop("gap", "session_no", "late", "max_seq")
    )


def _sessions(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*UNIT, "island", "signature", "session").agg(
        F.min("first").getField("us").alias("first_us"),
        F.min("min_us").alias("start"),
        F.max("max_us").alias("end"),
        F.max("island_late").alias("late"),
        F.max("unsure").alias("unsure"),
    )


# --- grouping loops (inside tasks) --------------------------------------------------------

_STREAM_KEY = [*UNIT, "island"]
_SESSION_OUT = "src_key string, dest_key string, zone int, block bigint, island bigint, signature string, session bigint, group_seq bigint, part bigint"


def _runs(batch: pd.DataFrame, key: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Where consecutive rows have one key: (key, start, stop). A key may go on in the next batch."""
    columns = [batch[k].to_numpy() for k in key]
    change = np.ones(len(batch), dtype=bool)
    change[1:] = False
    for values in columns:
        change[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(change).tolist()
    for start, stop in zip(starts, [*starts[1:], len(batch)]):
        yield tuple(values[start] for values in columns), start, stop


def _components(index: SignatureIndex) -> list[int]:
    """For each signature, the smallest number it is linked to through matches in any direction."""
    root = list(range(len(index.texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(root)):
        for j in index.matching(i):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(root))]


class _SessionGroups:
    """Groups over one island's sessions, taken in order of their first row."""

    def __init__(self, threshold: float, window: int) -> None:
        self.window = window
        self.index = SignatureIndex(threshold)
        # Per signature: the signatures whose groups accept it, refreshed as new ones lead.
        self.accepting: dict[int, list[int]] = {}
        self.checked: dict[int, int] = {}
        # Per leading signature its latest group (older ones are out of reach): rank, end, id.
        self.latest: dict[int, list[int]] = {}
        self.created = 0
        self.unsure: set[int] = set()

    def accepting_of(self, number: int) -> list[int]:
        known = self.checked.get(number, 0)
        total = len(self.index.texts)
        if known < total:
            self.accepting.setdefault(number, []).extend(self.index.matching(number, known))
            self.checked[number] = total
        return self.accepting[number]

    def place(self, signature: str, session: int, first_us: int, end: int, late: int, unsure: bool) -> int:
        number = self.index.number(signature)
        if unsure:
            self.unsure.add(number)
        best = None
        for leader in self.accepting_of(number):
            group = self.latest.get(leader)
            if group is None:
                continue
            silence = first_us - group[1]
            if silence <= self.window:
                if best is None or group[0] < best[0]:
                    best = group
            elif silence <= self.window + late:
                self.unsure.add(number)
        if best is None:
            best = self.latest[number] = [self.created, end, session]
            self.created += 1
        elif end > best[1]:
            best[1] = end
        return best[2]

    def doubtful(self) -> list[tuple[str, int]]:
        """(signature, part) of all signatures linked to an unsure one."""
        if not self.unsure:
            return []
        part = _components(self.index)
        bad = {part[n] for n in self.unsure}
        return [(text, part[n]) for n, text in enumerate(self.index.texts) if part[n] in bad]


def _group_sessions(threshold: float, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, groups = None, None

        def doubtful() -> list[tuple]:
            return [(*current, text, None, None, part) for text, part in groups.doubtful()] if groups else []

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=[*_STREAM_KEY, "signature", "session", "group_seq", "part"]).astype(
                {"session": "Int64", "group_seq": "Int64", "part": "Int64"}
            )

        # Islands are many and mostly small: a frame per batch, not per island.
        for batch in batches:
            columns = [batch[c].tolist() for c in ("signature", "session", "first_us", "end", "late", "unsure")]
            rows, ids, doubts = list(zip(*columns)), [], []
            for key, start, stop in _runs(batch, _STREAM_KEY):
                if key != current:
                    doubts += doubtful()
                    current, groups = key, _SessionGroups(threshold, window)
                ids += [groups.place(*row) for row in rows[start:stop]]
            if doubts:
                yield frame(doubts)
            if ids:
                yield batch[[*_STREAM_KEY, "signature", "session"]].assign(
                    group_seq=ids, part=pd.array([None] * len(ids), dtype="Int64")
                )
        if doubts := doubtful():
            yield frame(doubts)

    return run


class _RowGroups:
    """The plain loop: each row joins the first fitting group. Groups are kept per leading
    signature as (rank, latest time, id) arrays in order of creation."""

    def __init__(self, threshold: float, window: int) -> None:
        self.window = window
        self.index = SignatureIndex(threshold)
        self.accepting: dict[int, list[int]] = {}
        self.checked: dict[int, int] = {}
        self.times: dict[int, np.ndarray] = {}
        self.used: dict[int, int] = {}
        self.groups: dict[int, list[tuple[int, int]]] = {}
        self.created = 0

    accepting_of = _SessionGroups.accepting_of

    def place(self, signature: str, seq: int, us: int) -> int:
        number = self.index.number(signature)
        best = None
        for leader in self.accepting_of(number):
            n = self.used.get(leader, 0)
            if n == 0:
                continue
            near = np.abs(self.times[leader][:n] - us) <= self.window
            at = int(near.argmax())
            if near[at]:
                rank, _ = self.groups[leader][at]
                if best is None or rank < best[0]:
                    best = (rank, leader, at)
        if best is None:
            self._create(number, seq, us)
            return seq
        _, leader, at = best
        if us > self.times[leader][at]:
            self.times[leader][at] = us
        return self.groups[leader][at][1]

    def _create(self, number: int, seq: int, us: int) -> None:
        n = self.used.get(number, 0)
        times = self.times.get(number)
        if times is None:
            times = self.times[number] = np.zeros(4, dtype=np.int64)
        elif n == len(times):
            times = self.times[number] = np.concatenate([times, np.zeros_like(times)])
        times[n] = us
        self.used[number] = n + 1
        self.groups.setdefault(number, []).append((self.created, seq))
        self.created += 1


def _group_rows(threshold: float, window: int):
    key = [*_STREAM_KEY, "part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, groups = None, None
        for batch in batches:
            rows, ids = list(zip(batch["signature"].tolist(), batch["seq"].tolist(), batch["us"].tolist())), []
            for k, start, stop in _runs(batch, key):
                if k != current:
                    current, groups = k, _RowGroups(threshold, window)
                ids += [groups.place(*row) for row in rows[start:stop]]
            if ids:
                yield batch[["seq", "id", "src_key", "dest_key", "stamp"]].assign(group_seq=ids)

    return run


# --- the operator ------------------------------------------------------------------------


@dataclass(frozen=True)
class Dedup:
    """``groups``: one row per group. ``cell_groups`` and ``row_groups`` lead from an alert to
    its group: by cell where a session decided, by row where rows did."""

    groups: DataFrame
    cell_groups: DataFrame
    row_groups: DataFrame | None
    rows: DataFrame
    alerts: DataFrame
    cfg: TriageConfig

    def members(self) -> DataFrame:
        """(group_seq, seq, id) of every alert, whole however large a group is."""
        rows = self.rows.select("seq", "id", *UNIT, "signature", "cell")
        placed = rows.join(self.cell_groups, [*UNIT, "signature", "cell"]).select("group_seq", "seq", "id")
        if self.row_groups is not None:
            placed = placed.unionByName(self.row_groups.select("group_seq", "seq", "id"))
        return placed

    def related_ids(self) -> DataFrame:
        """(group_seq, part, related_ids): each group's ids in order, cut into parts of bounded
        size. A group within ``member_part_rows`` sequence numbers is one part."""
        part = F.floor(F.col("seq") / self.cfg.member_part_rows)
        ids = F.array_sort(F.collect_list(F.struct("seq", "id")))
        return (
            self.members()
            .filter("id is not null")
            .groupBy("group_seq", part.alias("part"))
            .agg(F.transform(ids, lambda x: x["id"]).alias("related_ids"))
        )

    def representatives(self) -> DataFrame:
        """The first alert of each group with its count and first/last seen.

        The groups are written first: where they are few their size shows, and the alerts need no shuffle to meet them."""
        stats = staged(
            self.groups.select(F.col("group_seq").alias("seq"), "bucket_seq", "occurrence_count", "first_seen", "last_seen")
        )
        kept = [c for c in self.alerts.columns if c not in [*stats.columns, "ts_us", "ts_zone"] or c == "seq"]
        return self.alerts.select(*kept).join(stats, "seq")


def _decided(cells: DataFrame, cfg: TriageConfig) -> tuple[DataFrame, DataFrame | None]:
    """(sessions with their group, signatures with a part of an island whose rows have to decide or None)."""
    todo = cells.agg(
        F.count_if(~F.col("alone")).alias("mixed"), F.count_if(F.col("alone") & F.col("unsure")).alias("unsure")
    ).first()
    signature_key = [*_STREAM_KEY, "signature"]
    alone = cells.filter("alone")
    # A signature on its own: a group is a session, or the rows decide.
    decided = alone.select(*signature_key, "session", F.col("session").alias("group_seq")).distinct()
    doubtful = None
    if todo.unsure:
        doubtful = (
            alone.filter("unsure").select(*signature_key).distinct().withColumn("part", F.xxhash64("signature"))
        )
    if todo.mixed:
        order = "start" if cfg.dedup_order == "time" else "session"
        looped = staged(
            _sessions(cells.filter("not alone"))
            .repartition(*[F.col(c) for c in _STREAM_KEY])
            .sortWithinPartitions(*_STREAM_KEY, order, "session")
            .mapInPandas(_group_sessions(cfg.dedup_fuzzy_threshold, cfg.window_micros), _SESSION_OUT)
        )
        decided = decided.unionByName(looped.filter("part is null").select(*signature_key, "session", "group_seq"))
        mixed = looped.filter("part is not null").select(*signature_key, "part")
        if not mixed.isEmpty():
            doubtful = mixed if doubtful is None else doubtful.unionByName(mixed)
    return decided, doubtful


def dedup(alerts: DataFrame, cfg: TriageConfig, fuzzy: bool = True) -> Dedup:
    """Group repeated alerts; ``seq`` must be unique.

    ``fuzzy=False`` merges equal signatures only. Alerts that come with ``ts_us`` and ``ts_zone``
    are read several times as they are (a written table is meant); others are parsed once first.
    """
    rows = _in_blocks(_narrow(_written(alerts, cfg), cfg), cfg, fuzzy)

    def placed(cells: DataFrame) -> DataFrame:
        cells = _session_cells(cells, cfg)
        # Without similarity every signature is on its own.
        return staged(cells if fuzzy else cells.withColumn("alone", F.lit(True)))

    cells = placed(_cells(rows, cfg))
    decided, doubtful = _decided(cells, cfg)
    if doubtful is not None and cfg.dedup_order != "time":
        # Bounds leave doubts in these islands: measure how late their rows are.
        coarse = staged(doubtful.select(*_STREAM_KEY).distinct())
        own = cells.join(coarse, _STREAM_KEY, "left_semi").select(*UNIT, "cell").distinct()
        measured = placed(_measured_cells(rows.join(own, [*UNIT, "cell"], "left_semi"), cfg))
        again, doubtful = _decided(measured, cfg)
        decided = decided.join(coarse, _STREAM_KEY, "left_anti").unionByName(again)
        cells = cells.join(coarse, _STREAM_KEY, "left_anti").unionByName(measured)
    signature_key = [*_STREAM_KEY, "signature"]

    row_groups = None
    if doubtful is not None:
        decided = decided.join(doubtful.select(*signature_key), signature_key, "left_anti")
        threshold = cfg.dedup_fuzzy_threshold if fuzzy else 2.0
        doubtful_cells = cells.join(doubtful, signature_key).select(
            *UNIT, "signature", "cell", "island", "part"
        )
        row_groups = staged(
            rows.select("seq", "id", *UNIT, "signature", "cell", "us", "stamp")
            .join(doubtful_cells, [*UNIT, "signature", "cell"])
            .select("seq", "id", *_STREAM_KEY, "part", "signature", "us", "stamp")
            .repartition(*[F.col(c) for c in [*_STREAM_KEY, "part"]])
            .sortWithinPartitions(*_STREAM_KEY, "part", "seq")
            .mapInPandas(
                _group_rows(threshold, cfg.window_micros),
                "seq bigint, id string, src_key string, dest_key string, stamp string, group_seq bigint",
            )
        )

    cell_groups = cells.join(decided.select("session", "group_seq"), "session")
    partial = cell_groups.groupBy("group_seq", "src_key", "dest_key").agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    if row_groups is not None:
        partial = partial.unionByName(
            row_groups.groupBy("group_seq", "src_key", "dest_key").agg(
                F.count("*").alias("n"), F.min("stamp").alias("first_seen"), F.max("stamp").alias("last_seen")
            )
        )
    # Address pairs rank by their first alert.
    first_of_pair = partial.groupBy("src_key", "dest_key").agg(F.min("group_seq").alias("bucket_seq"))
    groups = partial.join(first_of_pair, ["src_key", "dest_key"]).select(
        "group_seq", "bucket_seq", F.col("n").cast("int").alias("occurrence_count"), "first_seen", "last_seen"
    )
    return Dedup(
        groups=groups,
        cell_groups=cell_groups.select(*UNIT, "signature", "cell", "group_seq"),
        row_groups=row_groups,
        rows=rows,
        alerts=alerts,
        cfg=cfg,
    )


def without_dedup(alerts: DataFrame) -> DataFrame:
    """Every alert by itself, in input order."""
    return (
        alerts.drop("occurrence_count", "bucket_seq")
        .withColumn("occurrence_count", F.lit(1))
        .withColumn("bucket_seq", F.col("seq"))
    )


def match_signatures(pairs: DataFrame, cfg: TriageConfig) -> DataFrame:
    """(group_signature, signature) of the distinct pairs with their ``ratio`` and whether they ``match``.

    Equal ones have ratio 1. Of the others only those that the candidate join over distinct
    signatures brings together can match; they alone are rated, the rest has no ratio.
    """
    key = ["group_signature", "signature"]
    distinct = pairs.select(*key).distinct()
    unequal = distinct.filter("group_signature <> signature")
    texts = unequal.select("signature").union(unequal.select("group_signature")).distinct()
    met = candidates(texts, cfg.dedup_fuzzy_threshold)
    met = met.toDF(*key).union(met.select("b", "a").toDF(*key))
    rated = unequal.join(met, key).withColumn("ratio", signature_ratio("group_signature", "signature"))
    ratio = F.when(F.col("group_signature") == F.col("signature"), F.lit(1.0)).otherwise(F.col("ratio"))
    rated = distinct.join(rated, key, "left").withColumn("ratio", ratio)
    return rated.withColumn("match", F.coalesce(F.col("ratio") >= cfg.dedup_fuzzy_threshold, F.lit(False)))
