"""Harmonic packing of documents into sequences of a fixed capacity.

A class k holds pieces of length in (capacity/(k+1), capacity/k]; a bin of class k is closed when it has
exactly k pieces, whatever comes in other classes and at other workers, so no shuffle is needed. Documents
are cut so that pieces sit at the upper end of their class: first whole capacities, then capacity/2,
capacity/4, ... down to `min_piece`; the rest is a piece of a class so narrow that its bins are nearly full.
At the end of a partition each class has at most one open bin. Their pieces are laid one after another into
further sequences, cut where a sequence is full, and the very last one is cut into powers of two, which need
no padding. A worker keeps only open bins: a few sequences, whatever the input.

Null or empty text: the end id alone. Null doc_id: packed like others, doc_id stays null. Repeated rows are
packed each. Columns other than doc_id and text are ignored. No rows: no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from alertloom.llm.encoder import blocks, encoder, tokenizer_path

CAPACITY = 2048
MIN_PIECE = 64
END_ID = 1
#: Sequences of one partition are numbered from partition << SHIFT.
SHIFT = 33

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(length: int, capacity: int, min_piece: int) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (length // capacity)
    rest, size = length % capacity, capacity // 2
    while size >= min_piece:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class _Packer:
    """Open bins by class; a piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, capacity: int, min_piece: int, first_id: int):
        self.capacity, self.min_piece, self.next_id = capacity, min_piece, first_id
        self.open: dict[int, list] = {}

    def close(self, pieces: list) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, doc_tokens, ids in pieces:
            out.append((doc_id, start, len(ids), doc_tokens, self.next_id, offset, ids))
            offset += len(ids)
        self.next_id += 1
        return out

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        out, start = [], 0
        for size in cut(len(ids), self.capacity, self.min_piece):
            kind = self.capacity // size
            held = self.open.setdefault(kind, [])
            # a copy, so that an open bin doesn't keep the batch that its ids are from
            held.append((doc_id, start, len(ids), ids[start : start + size].copy()))
            start += size
            if len(held) == kind:
                out += self.close(self.open.pop(kind))
        return out

    def finish(self) -> list[tuple]:
        left = [p for kind in sorted(self.open) for p in self.open[kind]]
        total, out = sum(len(p[3]) for p in left), []
        while total:
            room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= room
            taken = []
            while room:
                doc_id, start, doc_tokens, ids = left.pop(0)
                if len(ids) > room:
                    left.insert(0, (doc_id, start + room, doc_tokens, ids[room:]))
                    ids = ids[:room]
                taken.append((doc_id, start, doc_tokens, ids))
                room -= len(ids)
            out += self.close(taken)
        self.open = {}
        return out


def pack(
    docs: DataFrame,
    path: str,
    *,
    style: str = "bytes",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    min_piece: int = MIN_PIECE,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece, with the piece's ids if asked for; capacity is a power of two."""
    if capacity & (capacity - 1) or not 0 < min_piece <= capacity:
        raise ValueError("capacity must be a power of two and min_piece within it")

    def run(batches):
        from pyspark import TaskContext

        code = encoder(path, style)
        packer = _Packer(capacity, min_piece, TaskContext.get().partitionId() << SHIFT)

        def rows(pieces):
            columns = list(zip(*pieces)) if pieces else [()] * 7
            doc_id, start, length, doc_tokens, sequence, offset, ids = columns
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            out = [doc_id, start, length, crc, doc_tokens, sequence, offset]
            arrays = [pa.array(c, pa.int64()) for c in out]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in blocks(batches, most_bytes=2 << 20):
            ids, bounds = code.batch(batch.column("text"))
            done = []
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                done += packer.add(doc_id, own)
            if done:
                yield rows(done)
        yield rows(packer.finish())

    return docs.select("doc_id", "text").mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


def op6_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)
