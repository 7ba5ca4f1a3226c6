"""Repeated passages: paragraph MinHash banding, and exact runs of shorter units below it.

A text is cut into units at every line end and sentence end and, between these, before words chosen by their content: where
the hash of two words is the least within REACH words on both sides. Such units have REACH + 1 words at least, about 9
on average, and are the same wherever a passage stands, but for the words at its edges.

Paragraphs are runs of units up to a line end or sentence end; a sentence ends a paragraph by its own last characters' hash,
once the paragraph has MIN_WORDS words. Paragraphs are sets of distinct five-word shingles. Equal texts (A-Z in lower case) are one
class; classes are banded: BANDS keys of ROWS minwise values each, which find a pair at the threshold of 0.8 with probability
1 - (1 - 0.8^2)^6 = 0.998. Classes that collide are brought together with their texts and confirmed by exact Jaccard
similarity; crowded bands are dealt into blocks with hubs, and strays meet the rest in cells (see chosen_path).
Components of confirmed links are clusters: the first paragraph of each (least doc_id, then place) stays, the others
are removed. Paragraphs of fewer than MIN_WORDS words are never removed.

What then remains is compared by spans: for every unit, the shortest runs of units of MIN_WORDS words that begin and that end
with it. Spans of the same words (A-Z in lower case, by a 128-bit hash) are one; the first outside removed paragraphs
stays, those behind it are removed. Adjoining spans together
are the whole of a repeated passage from its first cut to its last, and the first place of every unit stays.

Of both, only what some other place may share is written and shuffled as rows. Texts are read once, in blocks, and kept as their units'
hashes; from these, each block deals the hashes of its spans, paragraphs and bands to buckets, and is told which of them occur twice anywhere.

Null or empty text: no units. A document is a doc_id with a text: rows equal in both are one and stay or lose the same
units, rows with one doc_id and different texts are documents of their own, ordered by a hash of the text. A null doc_id
counts as the least. Other columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.chosen_path import LEAF, NO_ID, SKETCH, confirmed, groups_of, stray_groups, unsettled
from alertloom.llm.components import components
from alertloom.llm.encoder import blocks
from alertloom.llm.shingles import digest, factors, mixed, rolled, shingle_sets, sketches, word_hashes
from alertloom.llm.store import saved

SHINGLE = 5
PERCENT = 80
MIN_WORDS = 10
MOST_WORDS = 60
BANDS, ROWS = 6, 2

#: Hashes that a bucket gets, about.
BUCKET = 1 << 21
#: Words on both sides among which a cut between words has the least hash.
REACH = 4

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = [np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)]
#: Tells the hashes of paragraphs from those of spans of the same words.
_WHOLE = np.int64(0x2545F4914F6CDD1D)
_END = re.compile(rb"[.!?][\"')\]]*[ \t]+|\n+")


def _units(texts: list[bytes], hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of each unit, first word of each paragraph (both in all texts' words), each text's first unit, and the
    byte in its text at which a unit or paragraph with that first word begins."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    words = np.flatnonzero(~white & np.concatenate(([True], white[:-1]))) if len(data) else np.empty(0, np.int64)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = words - np.repeat(offsets[:-1], np.diff(bounds))
    n = len(words)
    first = np.zeros(n + 1, bool)  # of a line, sentence or text
    first[bounds] = True
    large = first.copy()  # of a paragraph
    for k, text in enumerate(texts):
        low, high = bounds[k], bounds[k + 1]
        if low == high:
            continue
        at[low] = 0
        matches = list(_END.finditer(text))
        own = words[low:high] - offsets[k]
        begin, begin_byte = low, 0
        for m, word in zip(matches, low + np.searchsorted(own, [m.end() for m in matches])):
            if low < word < high:
                first[word] = True
                at[word] = m.end()
                if word - begin >= MIN_WORDS:
                    line = text[m.start()] == 10
                    if line or word - begin >= MOST_WORDS or zlib.crc32(text[max(begin_byte, m.start() - 8) : m.start()]) & 1:
                        large[word] = True
                        begin, begin_byte = word, m.end()
    starts = np.flatnonzero(first)
    part = np.cumsum(first[:n]) - 1
    index = np.arange(n)
    free = (index - starts[part] > REACH) & (starts[part + 1] - index > REACH) if n else np.empty(0, bool)
    marks = np.full(n + 2 * REACH, np.iinfo(np.uint64).max, np.uint64)
    if n:
        marks[REACH : REACH + n][free] = mixed(hashes * _PAIR + np.append(hashes[1:], hashes[:1]))[free]
    middle = marks[REACH : REACH + n]
    for k in range(1, REACH + 1):
        free = free & (middle < marks[REACH - k : REACH - k + n]) & (middle <= marks[REACH + k : REACH + k + n])
    first[:n] |= free
    starts = np.flatnonzero(first)
    for k in np.flatnonzero(np.diff(starts) > MOST_WORDS):
        first[np.arange(starts[k] + MOST_WORDS // 2, starts[k + 1] - REACH, MOST_WORDS // 2)] = True
    units = np.flatnonzero(first[:n])
    return units, np.flatnonzero(large[:n]), np.searchsorted(units, bounds), at


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(pa.array(texts, pa.large_binary()).cast(pa.large_string()))


def _ends(starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The byte at which each of these ends: where the next one of its text begins, or at the text's end."""
    out = sizes[owner]
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    out[inner] = at[starts[inner + 1]]
    return out


def cuts(text: bytes) -> list[tuple[int, int]]:
    """Begin and end of each unit, in bytes; together they cover the text."""
    units, _, _, at = _units([text], *_words([text]))
    begins = [int(x) for x in at[units]] or [0] * bool(text)
    return list(zip(begins, [*begins[1:], len(text)]))


def _powers(factor: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, factor, np.uint64))))


def _inverse(factor: np.uint64) -> np.uint64:
    return np.uint64(pow(int(factor), -1, 1 << 64))


def _totals(values: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))


def _sums(hashes: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Two sums of each unit's words, weighted by their places in it; edges: the units' first words, then the end."""
    n, out = len(hashes), []
    for factor in _FACTORS:
        total = _totals(mixed(hashes ^ factor) * _powers(factor, n)[:-1])
        out.append((np.diff(total[edges]) * _powers(_inverse(factor), n)[edges[:-1]]).view(np.int64))
    return out


def _keys(sums: list[np.ndarray], edges: np.ndarray, runs: list[tuple[np.ndarray, np.ndarray]]) -> list[list[np.ndarray]]:
    """Two hashes of the words of runs of units (first, last), from the units' sums."""
    out = [[] for _ in runs]
    for factor, own in zip(_FACTORS, sums):
        n = int(edges[-1])
        total, down = _totals(own.view(np.uint64) * _powers(factor, n)[edges[:-1]]), _powers(_inverse(factor), n)
        for (a, b), keys in zip(runs, out):
            x, y = edges[a], edges[b + 1]
            keys.append(mixed((total[b + 1] - total[a]) * down[x] + (y - x).astype(np.uint64)).view(np.int64))
    return out


def _spans(edges: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last unit of the spans of MIN_WORDS words or more; firsts: each text's first unit, then the end."""
    n = len(edges) - 1
    index = np.arange(n)
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    low, high = firsts[:-1][owner], firsts[1:][owner] - 1
    last = np.searchsorted(edges, edges[:-1] + MIN_WORDS) - 1
    begin = np.searchsorted(edges, edges[1:] - MIN_WORDS, side="right") - 1
    onward, back = last <= high, begin >= low
    pairs = np.unique(np.concatenate((index[onward], begin[back])) * (n + 1) + np.concatenate((last[onward], index[back])))
    return pairs // (n + 1), pairs % (n + 1)


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """The bands of sets, in which a shingle may stand twice."""
    marks = sketches(sets, BANDS * ROWS).astype(np.uint64).reshape(len(sets), BANDS, ROWS)
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64) * factors(1, 7)[0]
    for k in range(ROWS):
        mixed = (mixed ^ marks[:, :, k]) * factors(ROWS, 9)[k]
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


_UNITS = "id binary, block long, n_bytes long, ends array<int>, words array<int>, x array<long>, y array<long>, first array<int>, last array<int>, bands array<long>"
_PARAGRAPHS = "paragraphs array<struct<begin:int,end:int,key:binary,bands:array<long>>>"
_SPANS = "spans array<struct<x:long,y:long,begin:int,end:int>>"


def _list(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """The values as lists of n rows; owner: each value's row, ascending."""
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32), values)


def read_units(docs: DataFrame) -> DataFrame:
    """id, n_bytes, where the units end, their words and sums, and the paragraphs of at least MIN_WORDS words, by first and last unit, with their bands."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, most_bytes=4 << 20):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            lengths, rows = np.array([len(t) for t in texts], np.int64), len(texts)
            hashes, bounds = _words(texts)
            units, large, firsts, at = _units(texts, hashes, bounds)
            owner, edges = np.repeat(np.arange(rows), np.diff(firsts)), np.append(units, len(hashes))
            whole = np.flatnonzero((lengths > 0) & (np.diff(bounds) == 0))  # white space only: one unit
            places = np.searchsorted(owner, whole)
            put = lambda own, more: np.insert(own, places, more)
            every = put(owner, whole)
            parts = [
                put(_ends(units, lengths, owner, at), lengths[whole]).astype(np.int32), put(np.diff(edges), 0).astype(np.int32),
                *[put(x, 0) for x in _sums(hashes, edges)],
            ]
            own, begins = np.searchsorted(bounds, large, side="right") - 1, np.append(large, len(hashes))
            long = np.flatnonzero(np.diff(begins) >= MIN_WORDS)
            held, shingles = own[long], rolled(hashes, SHINGLE)
            bands = _bands([shingles[a : b - SHINGLE + 1] for a, b in zip(begins[long], begins[long + 1])]).ravel() if len(long) else np.empty(0, np.int64)
            first, last = np.searchsorted(units, begins[long]) - firsts[held], np.searchsorted(edges, begins[long + 1]) - 1 - firsts[held]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(np.full(rows, block)), pa.array(lengths), *[_list(every, rows, pa.array(x)) for x in parts],
                    *[_list(held, rows, pa.array(x.astype(np.int32))) for x in (first, last)], _list(np.repeat(held, BANDS), rows, pa.array(bands)),
                ],
                [c.split()[0] for c in _UNITS.split(", ")],
            )
            block += 1

    return docs.mapInArrow(run, _UNITS)


class _Block:
    """Spans and paragraphs of some rows of read_units()."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        flat = lambda c: np.array(pc.list_flatten(table.column(c)))
        sizes = lambda c: np.asarray(pc.list_value_length(table.column(c))).astype(np.int64)
        n_units, n_held, rows = sizes("ends"), sizes("first"), np.arange(table.num_rows)
        firsts, edges = np.cumsum(np.append(0, n_units)), np.cumsum(np.append(0, flat("words").astype(np.int64)))
        owner, self.held = np.repeat(rows, n_units), np.repeat(rows, n_held)
        self.ends = flat("ends")
        self.begins = np.append(np.int32(0), self.ends)[:-1]
        self.begins[firsts[:-1][n_units > 0]] = 0
        self.span = _spans(edges, firsts)
        self.paragraph = tuple(firsts[self.held] + flat(c) for c in ("first", "last"))
        self.span_keys, self.keys = _keys([flat("x"), flat("y")], edges, [self.span, self.paragraph])
        self.owner = owner[self.span[0]]
        self.bands = flat("bands").reshape(-1, BANDS)

    def hashes(self) -> np.ndarray:
        return np.concatenate((self.span_keys[0], self.keys[0] ^ _WHOLE, self.bands.ravel()))

    def places(self, runs: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> list[np.ndarray]:
        return [self.begins[runs[0][at]], self.ends[runs[1][at]]]


def _repeated(held: DataFrame) -> DataFrame:
    """block and, of the hashes of its spans, paragraphs and bands, those found twice or more in all blocks."""
    n = held.agg(F.sum(2 * F.size("ends") + (BANDS + 1) * F.size("first"))).first()[0] or 0
    n_buckets = n // BUCKET + 1

    def deal(batches):
        for batch in batches:
            number = batch.column("block").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [len(number)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a < b:
                    values, times = np.unique(_Block(batch.slice(a, b - a)).hashes().view(np.uint64), return_counts=True)
                    values = np.repeat(values, np.minimum(times, 2))
                    edges = np.searchsorted((values >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32), np.arange(n_buckets + 1))
                    parts = [(k, values[x:y].tobytes()) for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if x < y]
                    if parts:
                        buckets, own = zip(*parts)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(parts), number[a])), pa.array(buckets, pa.int64()), pa.array(own, pa.binary())], ["block", "bucket", "hashes"]
                        )

    def find(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        values, times = np.unique(np.concatenate(lists), return_counts=True)
        twice = [np.unique(x[times[np.searchsorted(values, x)] > 1]).tobytes() for x in lists]
        return pa.table({"block": table["block"], "hashes": pa.array(twice, pa.binary())})

    dealt = held.drop("id", "n_bytes").mapInArrow(deal, "block long, bucket long, hashes binary")
    return dealt.groupBy("bucket").applyInArrow(find, "block long, hashes binary")


def paragraphs(docs: DataFrame) -> DataFrame:
    """id, n_bytes, where the units end, of every row, and those of its spans and paragraphs that may have their like elsewhere."""
    held = saved(read_units(docs))
    kind = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        block, n = _Block(table), table.num_rows
        twice = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x, np.int64) for x in replies["hashes"].to_pylist()]])
        at = np.flatnonzero(np.isin(block.span_keys[0], twice))
        parts = [*[k[at] for k in block.span_keys], *block.places(block.span, at)]
        spans = _list(block.owner[at], n, pa.StructArray.from_arrays([*map(pa.array, parts)], ["x", "y", "begin", "end"]))
        at = np.flatnonzero(np.isin(block.keys[0] ^ _WHOLE, twice) | np.isin(block.bands, twice).any(axis=1))
        keys = pa.array([k.tobytes() for k in np.stack([k[at] for k in block.keys], axis=1)], pa.binary())
        bands = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * BANDS, pa.array(block.bands[at].ravel()))
        own = pa.StructArray.from_arrays([*map(pa.array, block.places(block.paragraph, at)), keys, bands], fields=list(kind))
        return pa.table([table["id"], table["n_bytes"], table["ends"], spans, _list(block.held[at], n, own)], ["id", "n_bytes", "ends", "spans", "paragraphs"])

    told = saved(_repeated(held))
    out = f"id binary, n_bytes long, ends array<int>, {_SPANS}, {_PARAGRAPHS}"
    return held.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, out)


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """id, key, n, sketch and text of the paragraphs at these places (uid, id, begin, end)."""
    wanted = places.groupBy("id").agg(F.collect_list(F.struct("uid", "begin", "end")).alias("own"))

    def run(batches):
        for batch in blocks(batches, most_bytes=4 << 20):
            rows = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist()):
                data = (text or "").encode()
                rows += [(w["uid"], data[w["begin"] : w["end"]].decode(errors="ignore")) for w in own]
            uid, part = zip(*rows)
            part = pa.array(part, pa.large_string())
            sets = shingle_sets(*word_hashes(part), SHINGLE)
            marks = sketches(sets, SKETCH).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid, pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([m.tobytes() for m in marks], pa.binary()), part.cast(pa.string()),
                ],
                ["id", "key", "n", "sketch", "text"],
            )

    found = docs.join(wanted, "id").select("text", "own").mapInArrow(run, "id long, key binary, n long, sketch binary, text string")
    return found.dropDuplicates(["id"])  # a repeated row gives its paragraphs again


def clusters(docs: DataFrame, held: DataFrame) -> DataFrame:
    """key and cluster of each class that occurs twice or is linked; held: from paragraphs()."""
    flat = held.select("id", F.explode("paragraphs").alias("p")).select("id", "p.*")
    first = F.min(F.struct("id", "begin", "end")).alias("f")
    classes = saved(flat.groupBy("key").agg(first, F.first("bands").alias("bands"), F.count("*").alias("times")).withColumn("uid", F.xxhash64("key")))
    banded = classes.select("uid", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    nodes = saved(banded.join(shared, "band").select(F.col("band").alias("node"), F.col("uid").alias("id")))
    met = nodes.select(F.col("id").alias("uid")).distinct()
    places = classes.join(met, "uid").select("uid", "f.id", "f.begin", "f.end")
    texts = saved(_texts(docs, places))
    marks, texts = texts.drop("text"), texts.select("id", "text")
    rows = unsettled(nodes, None)
    links = saved(confirmed(groups_of(rows), marks, texts, None, SHINGLE, PERCENT))
    found = saved(components(links))
    crowded = rows.where(F.col("size") > LEAF).select("node", "id")
    if not crowded.isEmpty():
        rest = unsettled(crowded, found)
        more = saved(confirmed(stray_groups(rest), marks, texts, found, SHINGLE, PERCENT))
        if not more.isEmpty():
            found = saved(components(links.unionByName(more)))
    label = F.coalesce("component", "uid").alias("cluster")
    named = classes.join(found, classes["uid"] == found["vertex"], "left").where("times > 1 OR component IS NOT NULL")
    return named.select("key", label, F.struct("f.id", "f.begin").alias("f"))


_PLACES = "array<struct<begin:int,end:int>>"


def repeated_spans(held: DataFrame, gone: DataFrame) -> DataFrame:
    """id and the places of spans found before, at a place that touches no removed paragraph (gone: id, places)."""
    names = ["x", "y", "begin", "end"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = lambda c: pc.list_flatten(batch.column(c))
            owner = lambda c: np.array(pc.list_parent_indices(batch.column(c))).astype(np.int64) << 32
            spans, at = flat("spans"), owner("spans")
            begins, ends = (np.sort(owner("places") + np.array(flat("places").field(c))) for c in ("begin", "end"))
            inside = np.searchsorted(ends, at + np.array(spans.field("begin")), side="right") != np.searchsorted(begins, at + np.array(spans.field("end")))
            ids = batch.column("id").take(pc.list_parent_indices(batch.column("spans")))
            yield pa.RecordBatch.from_arrays([ids, *[spans.field(c) for c in names], pa.array(~inside)], ["id", *names, "free"])

    spans = held.select("id", "spans").where(F.size("spans") > 0).join(gone, "id", "left").select("id", "spans", "places")
    left = saved(spans.mapInArrow(run, "id binary, x long, y long, begin int, end int, free boolean"))
    firsts = left.where("free").groupBy("x", "y").agg(F.min(F.struct("id", "begin")).alias("first"))
    later = left.join(firsts, ["x", "y"]).where("first.id < id OR first.id = id AND first.begin < begin")
    return later.groupBy("id").agg(F.collect_set(F.struct("begin", "end")).alias("more"))


def _identity() -> Column:
    """16 bytes that order as (doc_id, hash of the text)."""
    high = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).bitwiseXOR(F.lit(NO_ID))
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (high, F.xxhash64("text"))]))


def _doc_id(identity: bytes) -> int | None:
    value = int.from_bytes(identity[:8]) + NO_ID
    return None if value == NO_ID else value


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_paragraphs (units), n_removed (bytes), n_spans and the removed units (bytes) of every row."""
    docs = docs.select(_identity().alias("id"), "text")
    held = saved(paragraphs(docs))
    named = saved(clusters(docs, held))
    firsts = named.groupBy("cluster").agg(F.min("f").alias("first"))
    named = named.join(firsts, "cluster").select("key", "first")
    flat = held.select("id", F.explode("paragraphs").alias("p")).select("id", "p.begin", "p.end", "p.key")
    gone = flat.join(named, "key").where("first.id <> id OR first.begin <> begin")
    gone = saved(gone.groupBy("id").agg(F.collect_set(F.struct("begin", "end")).alias("places")))
    more = saved(repeated_spans(held, gone))
    whole = held.select("id", "n_bytes", "ends").join(gone, "id", "left").join(more, "id", "left")

    def run(batches):
        for batch in batches:
            flat = lambda c: pc.list_flatten(batch.column(c))
            owner = lambda c: np.array(pc.list_parent_indices(batch.column(c))).astype(np.int64)
            rows, own, ends = batch.num_rows, owner("ends"), np.array(flat("ends"))
            begins = np.append(np.int32(0), ends)[:-1]
            begins[np.flatnonzero(np.diff(own, prepend=-1))] = 0
            steps = np.zeros(len(ends) + 1, np.int64)
            for c in ("places", "more"):  # all of them begin and end with a unit
                at, places = owner(c) << 32, flat(c)
                np.add.at(steps, np.searchsorted((own << 32) + begins, at + np.array(places.field("begin"))), 1)
                np.add.at(steps, np.searchsorted((own << 32) + ends, at + np.array(places.field("end"))) + 1, -1)
            at = np.flatnonzero(np.cumsum(steps)[:-1])
            count = np.bincount(own[at], minlength=rows).astype(np.int64)
            total = np.bincount(own[at], (ends - begins)[at], rows).astype(np.int64)
            spans = _list(own[at], rows, pa.StructArray.from_arrays([pa.array(begins[at]), pa.array(ends[at])], ["begin", "end"]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(map(_doc_id, batch.column("id").to_pylist()), pa.int64()), batch.column("n_bytes"), pc.list_value_length(batch.column("ends")).cast(pa.int64()),
                    pa.array(total), pa.array(count), spans,
                ],
                ["doc_id", "n_bytes", "n_paragraphs", "n_removed", "n_spans", "spans"],
            )

    return whole.mapInArrow(run, f"doc_id long, n_bytes long, n_paragraphs long, n_removed long, n_spans long, spans {_PLACES}")


def op10_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
