"""Periodic runs of words: stretches that repeat a short passage over and over, found and collapsed to one copy.

A run is a stretch of consecutive words with smallest period q and a length of at least max(6, 4 * q) that no
neighbouring word extends with that period.

Its search is a suffix automaton over the words, whose links form a tree. Words are appended one by one: the path
from the state of the new prefix to the root is recoloured with the new end, by an access in a link-cut structure
(splay trees over the paths of one colour). Each old segment on that path says where the suffixes up to its length
ended last. If that end is no farther back than the segment is long, the stretch is a square with that distance as
smallest period; it is extended to both sides to a run, once for each run. An append meets few segments
(amortised logarithmic), so a text of n words takes about n log n steps whatever it repeats.

Before that, numpy takes out of a whole batch what can't lie in a run: in a run of period q every pair of neighbouring words has
the same pair at distance q, so a stretch whose pairs have their next equal pair farther away than a quarter of its length is cut there. Pairs
are compared by hash, which can only keep too much. Runs lie in what is left, wholly: the result is the same as
that of the search over all words.

A document is the unit of work and is never cut; nothing is shuffled. Null text has no words: no runs, hashes of
the empty string. A null doc_id is carried through. Repeated rows are judged each. Other columns are ignored. No
documents: no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.encoder import blocks
from alertloom.llm.shingles import mixed

#: A run has so many words at least, and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Rounds of cutting; more would only spare the search some words.
ROUNDS = 8

_FAR = np.int64(1) << 40

RESULT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long, "
    "runs array<struct<start:long,length:long,period:long>>"
)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_links(words: list) -> tuple[list[int], list[int], list[int]]:
    """Of the suffix automaton: each state's link, the length of its longest string, and the state of each prefix. State 0 is the root."""
    onward, link, length, tips, last = [{}], [-1], [0], [], 0
    for word in words:
        state = len(link)
        onward.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in onward[p]:
            onward[p][word] = state
            p = link[p]
        if p >= 0:
            q = onward[p][word]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(link)
                onward.append(onward[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and onward[p].get(word) == q:
                    onward[p][word] = copy
                    p = link[p]
                link[q] = link[state] = copy
        tips.append(state)
        last = state
    return link, length, tips


class Paths:
    """The tree of suffix links, cut into paths of one colour. A path is a splay tree in the order of depth, whose root
    holds the colour and points to the node above the path."""

    def __init__(self, link: list[int]):
        self.up = link[:]
        self.left = [-1] * len(link)
        self.right = [-1] * len(link)
        self.colour = [-1] * len(link)

    def _rotate(self, x: int, p: int) -> None:
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b >= 0:
            up[b] = p
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[p] = x
        up[x] = g

    def _splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                if (left[g] == p) == (left[p] == x):
                    self._rotate(p, g)
                    self._rotate(x, p)
                else:
                    self._rotate(x, p)
                    self._rotate(x, g)
                colour[x] = colour[g]
            else:
                self._rotate(x, p)
                colour[x] = colour[p]

    def recolour(self, tip: int, colour: int) -> list[tuple[int, int]]:
        """Gives the path from a state to the root one colour: (old colour, deepest state) of each segment it had."""
        met, below, x = [], -1, tip
        while True:
            self._splay(x)
            if self.colour[x] >= 0:
                met.append((self.colour[x], x))
            # what hangs deeper than this path keeps its colour as a path of its own
            if (deeper := self.right[x]) >= 0:
                self.colour[deeper] = self.colour[x]
            self.right[x] = below
            if self.up[x] < 0:
                self.colour[x] = colour
                return met
            below, x = x, self.up[x]


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs, ascending."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    link, length, tips = suffix_links(words)
    paths = Paths(link)
    ends: dict[int, int] = {}  # of the last run of each period
    found = []
    for end, tip in enumerate(tips):
        for before, state in paths.recolour(tip, end):
            q = end - before
            if q > length[state] or ends.get(q, -1) >= end:
                continue
            first, last = end - 2 * q + 1, end
            while first > 0 and words[first - 1] == words[first - 1 + q]:
                first -= 1
            while last + 1 < n and words[last + 1] == words[last + 1 - q]:
                last += 1
            ends[q] = last
            if last - first + 1 >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((first, last - first + 1, q))
    return sorted(found)


def _stretches(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the stretches that may hold runs; they never cross documents. ids number the words of all documents."""
    n = len(ids)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if n < LEAST_WORDS:
        return none
    sizes = np.diff(bounds)
    # the pair at each word; its key holds the document, its lower bits the place
    key = ids.astype(np.uint64)
    key[:-1] += (key[1:] + np.uint64(1)) << np.uint64(32)
    place_bits = np.uint64(int(n).bit_length())
    key = mixed(mixed(key) + np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) * np.uint64(0x9E3779B97F4A7C15))
    key = (key >> place_bits << place_bits) | np.arange(n, dtype=np.uint64)
    key.sort()
    at = (key & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    same = (key[1:] >> place_bits) == (key[:-1] >> place_bits)
    gaps = np.where(same, at[1:] - at[:-1], _FAR)
    near = np.full(n, _FAR)
    near[at[:-1]] = gaps
    near[at[1:]] = np.minimum(near[at[1:]], gaps)
    near[bounds[1:][sizes > 0] - 1] = _FAR  # a document's last word begins no pair
    alive = np.flatnonzero(LEAST_PERIODS * near <= np.repeat(sizes, sizes))
    for _ in range(ROUNDS):
        if not len(alive):
            return none
        starts = np.concatenate(([0], np.flatnonzero(np.diff(alive) > 1) + 1))
        counts = np.diff(np.append(starts, len(alive)))
        wide = np.repeat(counts + 1, counts)
        keep = (LEAST_PERIODS * near[alive] <= wide) & (wide >= LEAST_WORDS)
        if keep.all():
            break
        alive = alive[keep]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(alive) > 1) + 1)) if len(alive) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(alive)))
    return alive[starts], alive[starts] + counts + 1


def altered(n: int, key: int) -> np.ndarray | None:
    """Which original word stands at each place of a text that is made periodic from a place on: the planted cases of the query."""
    if key % 10 or not n:
        return None
    g = key // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _found(batch: pa.RecordBatch, plant: bool) -> pa.RecordBatch:
    doc_ids = batch.column("doc_id").to_pylist()
    lists = pc.ascii_split_whitespace(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    real = pc.binary_length(words).to_numpy() > 0
    take = np.flatnonzero(real)
    bounds = np.concatenate(([0], np.cumsum(real)))[offsets - offsets[0]]
    if plant:
        for k, doc_id in enumerate(doc_ids):
            if doc_id is not None:
                place = altered(int(bounds[k + 1] - bounds[k]), zlib.crc32(str(doc_id).encode()))
                if place is not None:
                    take[bounds[k] : bounds[k + 1]] = take[bounds[k] : bounds[k + 1]][place]
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)[take] if len(take) else np.empty(0, np.int32)
    runs: list[list] = [[] for _ in doc_ids]
    first, end = _stretches(ids, bounds)
    owner = np.searchsorted(bounds, first, "right") - 1
    kept = np.ones(len(take), bool)
    for a, b, k in zip(first.tolist(), end.tolist(), owner.tolist()):
        for start, length, period in runs_of(ids[a:b].tolist()):
            runs[k].append((a - int(bounds[k]) + start, length, period))
            kept[a + start + period : a + start + length] = False
    # a run of another stretch may begin in front of the last one's
    for own in runs:
        own.sort(key=lambda r: (r[0], r[2]))
    left = np.concatenate(([0], np.cumsum(kept)))[bounds]
    lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.take(pa.array(take[kept])))
    texts = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = memoryview(texts.buffers()[2]) if texts.buffers()[2] is not None else memoryview(b"")
    collapsed = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    longest = [max(own, key=lambda r: (r[1], -r[0], -r[2])) if own else (None, None, None) for own in runs]
    listed = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest() for own in runs]
    n_words = np.diff(bounds)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(map(len, runs), pa.int64()),
            *(pa.array([r[j] for r in longest], pa.int64()) for j in range(3)),
            pa.array([None if r[0] is None else 1000 * r[1] // r[2] for r in longest], pa.int64()),
            pa.array(listed, pa.string()),
            pa.array(collapsed, pa.string()),
            pa.array(n_words),
            pa.array(n_words - np.diff(left)),
            pa.array([[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs], _RUNS),
        ],
        ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_dropped", "runs"],
    )


def periodic_runs(docs: DataFrame, *, plant: bool = False) -> DataFrame:
    """One row per document: its runs, the longest one, and checksums of the runs and of the text without their repeats.
    plant makes a tenth of the texts periodic first, by doc_id, so that results can be checked."""

    def run(batches):
        for batch in blocks(batches):
            yield _found(batch, plant)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True).drop("runs", "n_words", "n_dropped")
