"""Substring dedup by suffix arrays: every byte covered by a repeated string of 50 bytes goes, first copies stay.

Equal 50-byte strings have equal minimizers (the least hash among their 20-byte parts), so text is cut into runs of
consecutive 50-byte windows with one minimizer, and runs are dealt to shards by it: each shard can be sorted alone.

1. Documents are written as a table bucketed by block, so that no later step moves texts again.
2. Each block lists its minimizers once, in 32 bits and a bucket number. Those listed by one document alone end
   there: their windows can't repeat. (Two that share a number only cause needless work, never a wrong result.)
3. Runs of the others go to their shards, with their places. A shard's equal runs are one string with its least
   doc_id; the strings are sorted by external induced sorting (see induced) with common prefixes. Suffixes with 50
   bytes in common are neighbours; each such group has a least doc_id, and its windows in greater ones are removed.
4. The spans return to their blocks, are united there, and the text that is left is hashed.

Null or empty text: no bytes, nothing removed. A null doc_id is the least. Rows with equal doc_id don't remove from
each other. Other columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.induced import suffix_array
from alertloom.llm.shingles import factors, mixed
from alertloom.llm.store import saved, shared_folder

WINDOW = 50
PART = 20
BLOCK_TEXT = 8 << 20
#: Bytes of text hashed at a time.
CACHED = 1 << 17
#: Windows of a run at most; with the last window's length it fits a byte.
LONGEST_RUN = 200
NO_ID = -(1 << 63)

_BYTE = factors(256, 5)
_STEP = int(factors(1, 6)[0])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_STEP, n, 1 << 64))


def minimizers(data: np.ndarray) -> np.ndarray:
    """For each window of a text its least part's hash."""
    if len(data) < WINDOW:
        return np.empty(0, np.uint64)
    h1 = _BYTE[data]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    part = mixed(h16[:-4] * _power(4) + h4[16:])
    width = WINDOW - PART + 1
    low, size = part, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(part) - width + 1], low[width - size :])


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, text, begin and end (in bytes, with the last window's whole length) of each run.

    Texts are taken together in pieces that fit a processor's cache."""
    out, at = [], 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (not size or size + len(texts[upto]) <= CACHED):
            size += len(texts[upto])
            upto += 1
        some = texts[at:upto]
        sizes = np.array([len(t) for t in some], np.int64)
        ends = np.cumsum(sizes)
        keys = minimizers(np.frombuffer(b"".join(some), np.uint8))
        if len(keys):
            # windows that reach into the next text are none
            outside = np.zeros(len(keys) + WINDOW, np.int64)
            np.add.at(outside, np.maximum(ends[:-1] - WINDOW + 1, 0), 1)
            np.add.at(outside, ends[:-1], -1)
            inside = np.cumsum(outside[: len(keys)]) == 0
            same = inside[1:] & inside[:-1] & (keys[1:] == keys[:-1])
            first = inside & np.concatenate(([True], ~same))
            last = inside & np.concatenate((~same, [True]))
            a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
            pieces = -(-(b - a) // LONGEST_RUN)
            if (pieces > 1).any():
                # the same part over and over: cut, so that lengths stay small
                a = np.repeat(a, pieces) + LONGEST_RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                b = np.minimum(np.repeat(b, pieces), a + LONGEST_RUN)
            owner = np.searchsorted(ends, a, "right")
            begin = a - (ends - sizes)[owner]
            out.append((keys[a], owner + at, begin, begin + (b - a) + WINDOW - 1))
        at = upto
    if not out:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _texts(table: pa.Table) -> list[bytes]:
    return [(t or "").encode() for t in table["text"].to_pylist()]


def _numbered(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket and 32 bits of a minimizer in one number."""
    return ((keys >> np.uint64(34)) % np.uint64(n)) << np.uint64(32) | (keys & np.uint64(0xFFFFFFFF))


def _listed(blocks: DataFrame, n: int) -> DataFrame:
    """bucket, block, numbers: minimizers of each block, those of two documents of it doubled."""

    def run(key, table):
        keys, owner, _, _ = runs_of(_texts(table))
        numbers = _numbered(keys, n)
        order = np.argsort(numbers, kind="stable")
        numbers, owner = numbers[order], owner[order]
        # once for each text that has it
        new = np.concatenate(([True], (numbers[1:] != numbers[:-1]) | (owner[1:] != owner[:-1]))) if len(numbers) else np.zeros(0, bool)
        numbers, times = np.unique(numbers[new], return_counts=True)
        numbers = np.repeat(numbers, np.minimum(times, 2))
        bucket = (numbers >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(n + 1))
        some = [k for k in range(n) if cuts[k] < cuts[k + 1]]
        parts = [numbers[cuts[k] : cuts[k + 1]].astype(np.uint32).tobytes() for k in some]
        block = key[0].as_py()
        return pa.table({"bucket": pa.array(some, pa.int32()), "b": pa.array([block] * len(some), pa.int32()), "numbers": pa.array(parts, pa.binary())})

    return blocks.groupBy("b").applyInArrow(run, "bucket int, b int, numbers binary")


def _repeated(listed: DataFrame) -> DataFrame:
    """b, bucket, numbers: of each block's minimizers those that stand in two documents."""

    def run(key, table):
        parts = [np.frombuffer(x, np.uint32) for x in table["numbers"].to_pylist()]
        whole = np.sort(np.concatenate(parts))
        twice = np.unique(whole[1:][whole[1:] == whole[:-1]])
        out = []
        for part in parts:
            part = np.unique(part)
            at = np.minimum(np.searchsorted(twice, part), max(len(twice) - 1, 0))
            out.append(part[twice[at] == part].tobytes() if len(twice) else b"")
        return pa.table({"b": table["b"].cast(pa.int32()), "bucket": table["bucket"].cast(pa.int32()), "numbers": pa.array(out, pa.binary())})

    return listed.groupBy("bucket").applyInArrow(run, "b int, bucket int, numbers binary")


def _cut(blocks: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
    """shard, block, and the runs dealt to the shard: lengths, row ids, doc_ids, begins, and their bytes."""

    def run(key, table, lists):
        if not table.num_rows or not lists.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "runs": pa.array([], pa.binary())})
        wanted = np.sort(
            np.concatenate([np.uint64(k << 32) | np.frombuffer(x, np.uint32).astype(np.uint64) for k, x in zip(lists["bucket"].to_pylist(), lists["numbers"].to_pylist())])
        )
        texts = _texts(table)
        keys, owner, begin, end = runs_of(texts)
        numbers = _numbered(keys, n)
        at = np.minimum(np.searchsorted(wanted, numbers), max(len(wanted) - 1, 0))
        ok = wanted[at] == numbers if len(wanted) else np.zeros(len(numbers), bool)
        # the shard follows the number, so runs of a minimizer stay together
        shard = (mixed(numbers[ok]) % np.uint64(n)).astype(np.int64)
        owner, begin, end = owner[ok], begin[ok], end[ok]
        rid = table["rid"].to_numpy()
        doc = table["doc_id"].to_numpy()
        order = np.argsort(shard, kind="stable")
        shard, owner, begin, end = shard[order], owner[order], begin[order], end[order]
        cuts = np.searchsorted(shard, np.arange(n + 1))
        rows, pack = [], zstandard.ZstdCompressor(level=1)
        for k in range(n):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                parts = b"".join(texts[o][x:y] for o, x, y in zip(owner[a:b].tolist(), begin[a:b].tolist(), end[a:b].tolist()))
                head = [(end - begin)[a:b].astype(np.uint8), rid[owner[a:b]], doc[owner[a:b]], begin[a:b].astype(np.int32)]
                rows.append((k, int(b - a), pack.compress(b"".join(x.tobytes() for x in head) + parts)))
        block = key[0].as_py()
        return pa.table({
            "shard": pa.array([r[0] for r in rows], pa.int32()), "b": pa.array([block] * len(rows), pa.int32()),
            "n": pa.array([r[1] for r in rows], pa.int64()), "runs": pa.array([r[2] for r in rows], pa.binary()),
        })

    return blocks.groupBy("b").cogroup(repeated.groupBy("b")).applyInArrow(run, "shard int, b int, n long, runs binary")


def repeated_windows(strings: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the joined strings the least doc_id that has its window, and where strings begin.

    docs: each string's least doc_id. Places without a whole window get the greatest number.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join(strings) + b"\0\0", np.uint8).astype(np.int64) + 2
    text[starts + sizes] = 1  # separators
    text[-1] = 0
    order, prefixes = suffix_array(text, WINDOW)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    whole = np.arange(len(owner)) + WINDOW <= (starts + sizes)[owner]
    group = np.cumsum(prefixes < WINDOW)
    real = order < len(owner)
    order, group = order[real], group[real]
    real = whole[order]
    order, group = order[real], group[real]
    least = np.full(len(owner), np.iinfo(np.int64).max)
    if len(order):
        firsts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
        low = np.minimum.reduceat(docs[owner[order]], firsts)
        least[order] = np.repeat(low, np.diff(np.append(firsts, len(order))))
    return least, starts


_SPANS = "b int, rids binary, begins binary, ends binary"


def _sorted(runs: DataFrame) -> DataFrame:
    """Spans to remove, by block."""

    def run(key, table):
        unpack = zstandard.ZstdDecompressor()
        sizes, rids, docs, begins, blocks, strings = [], [], [], [], [], []
        for block, n, blob in zip(table["b"].to_pylist(), table["n"].to_pylist(), table["runs"].to_pylist()):
            data = unpack.decompress(blob)
            size = np.frombuffer(data, np.uint8, n).astype(np.int64)
            rids.append(np.frombuffer(data, np.int64, n, n))
            docs.append(np.frombuffer(data, np.int64, n, 9 * n))
            begins.append(np.frombuffer(data, np.int32, n, 17 * n))
            ends = 21 * n + np.cumsum(size)
            strings += [data[a:b] for a, b in zip(ends - size, ends)]
            sizes.append(size)
            blocks.append(np.full(n, block))
        sizes, rids, docs, begins, blocks = map(np.concatenate, (sizes, rids, docs, begins, blocks))
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
        least_doc = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least_doc, which, docs)
        least, starts = repeated_windows(list(number), least_doc)
        # of a later document every window of the string goes, of the first one those that an earlier one has
        late = docs > least_doc[which]
        out = [(blocks[late], rids[late], begins[late], begins[late] + sizes[late])]
        own = np.repeat(least_doc, np.diff(np.append(starts, len(least))))
        gone = np.concatenate(([False], least < own, [False]))
        a, b = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(~gone[1:] & gone[:-1])
        if len(a):
            of = np.searchsorted(starts, a, "right") - 1
            first = np.flatnonzero(~late)
            first = first[np.argsort(which[first], kind="stable")]
            lows, highs = np.searchsorted(which[first], of), np.searchsorted(which[first], of, "right")
            times = highs - lows
            rows = first[np.repeat(lows - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            from_, to = np.repeat(a - starts[of], times), np.repeat(b - starts[of], times) + WINDOW - 1
            out.append((blocks[rows], rids[rows], begins[rows] + from_, begins[rows] + to))
        block, rid, begin, end = [np.concatenate(x) for x in zip(*out)]
        order = np.argsort(block, kind="stable")
        block, rid, begin, end = block[order], rid[order], begin[order].astype(np.int32), end[order].astype(np.int32)
        names, cuts = np.unique(block, return_index=True)
        cuts = np.append(cuts, len(block))
        part = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
        return pa.table({"b": pa.array(names, pa.int32()), "rids": part(rid), "begins": part(begin), "ends": part(end)})

    return runs.groupBy("shard").applyInArrow(run, _SPANS)


def united(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans without overlap or touch."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], begins[1:] > ends[:-1]))
    at = np.flatnonzero(new)
    return list(zip(begins[at].tolist(), np.append(ends[at[1:] - 1], ends[-1]).tolist()))


def _applied(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    def run(key, table, found):
        many = [np.concatenate([np.empty(0, t), *[np.frombuffer(x, t) for x in found[c].to_pylist()]]) for c, t in (("rids", np.int64), ("begins", np.int32), ("ends", np.int32))]
        order = np.argsort(many[0], kind="stable")
        rids, begins, ends = [x[order] for x in many]
        rows = []
        for rid, doc_id, text in zip(table["rid"].to_pylist(), table["doc_id"].to_pylist(), table["text"].to_pylist()):
            data = (text or "").encode()
            a, b = np.searchsorted(rids, rid), np.searchsorted(rids, rid, "right")
            own = united(begins[a:b], ends[a:b]) if a < b else []
            left, at = hashlib.sha256(), 0
            for x, y in own:
                left.update(data[at:x])
                at = y
            left.update(data[at:])
            rows.append((doc_id if doc_id != NO_ID else None, len(data), sum(y - x for x, y in own), len(own), left.hexdigest(), own))
        spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64()] * 4 + [pa.string(), spans]
        columns = list(zip(*rows)) if rows else [()] * 6
        columns[5] = [[{"begin": x, "end": y} for x, y in own] for own in columns[5]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>"
    return blocks.groupBy("b").cogroup(spans.groupBy("b")).applyInArrow(run, schema)


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: counts, hash of what is left, and the removed spans in bytes."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4, size // BLOCK_TEXT)
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("b", F.pmod("rid", F.lit(n)).cast("int"))
    name = f"llm_blocks_{uuid.uuid4().hex}"
    writer = docs.repartition(n, "b").write.option("path", shared_folder(spark)).option("compression", "zstd")
    writer.bucketBy(n, "b").format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    repeated = saved(_repeated(_listed(blocks, n)))
    spans = saved(_sorted(_cut(blocks, repeated, n)))
    return _applied(blocks, spans)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
