"""Token ids in Arrow files of fixed-size lists.

Documents are dealt out by doc_id ranges; each range becomes one shard of two Arrow IPC files:

* `sequences-<shard>.arrow`: record batches of two columns, `ids` (fixed-size list of `length` unsigned
  integers, 16 bits where the vocabulary allows) and `mask` (fixed-size list of `length` booleans, false on the
  padding behind the shard's last id). Every row has equal size, so row r of a memory-mapped file is at a known
  place and is read without copying or decoding: see `Sequences`.
* `documents-<shard>.arrow`: doc_id, start (ids of the shard's earlier documents) and n_tokens, ascending.

A shard is written under a name of its attempt and then moved, so a lost or repeated task leaves whole files.
Files go through Arrow's file systems, so the folder may be in any store that these know.

Null or empty text: the end id alone. Rows with a null doc_id come first. Repeated rows are written each.
Columns other than doc_id and text are ignored. No rows: no shards.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401  loads pa.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.encoder import blocks, encoder, tokenizer_path
from alertloom.llm.store import shared_folder

LENGTH = 2048
END_ID = 2
#: Rows of a record batch.
BATCH_ROWS = 256
#: Bytes of text that a shard should hold, before compression.
SHARD_TEXT = 24 << 20

MANIFEST = "shard int, first_id long, n_docs long, n_tokens long, sequences string, documents string"


class _Writer:
    """Cuts a stream of ids into rows of fixed length; holds one record batch at most."""

    def __init__(self, sink, length: int, dtype):
        self.length, self.dtype, self.held, self.size, self.total = length, dtype, [], 0, 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.size += len(ids)
        self.total += len(ids)
        full = BATCH_ROWS * self.length
        if self.size >= full:
            ids = np.concatenate(self.held)
            for n in range(full, len(ids) + 1, full):
                self._rows(ids[n - full : n], full)
            self.held, self.size = [ids[len(ids) // full * full :].copy()], len(ids) % full

    def _rows(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.size:
            ids = np.concatenate(self.held)
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
            padded[: len(ids)] = ids
            self._rows(padded, len(ids))
        self.out.close()


class Sequences:
    """Random access to a shard's rows; of a local file the rows are views of the mapped file."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.reader.get_batch(k)
        ids = rows.column(0).flatten().to_numpy().reshape(-1, self.length)
        return ids, rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.length)

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of row r: all batches but the last have BATCH_ROWS rows."""
        ids, mask = self.batch(r // BATCH_ROWS)
        return ids[r % BATCH_ROWS], mask[r % BATCH_ROWS]

    def stream(self):
        """The real ids, batch by batch."""
        for k in range(self.reader.num_record_batches):
            ids, mask = self.batch(k)
            yield ids.reshape(-1)[: int(mask.sum())]


def write(
    docs: DataFrame, folder: str, path: str, *, style: str = "words", end_id: int = END_ID, length: int = LENGTH,
    shards: int | None = None,
) -> DataFrame:
    """Writes the shards and returns their list: shard, ids before it, counts, file names; in doc_id order."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, size // SHARD_TEXT)

    def run(batches):
        from pyspark import TaskContext

        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        code = encoder(path, style)
        dtype = np.uint16 if len(code.border) <= 1 << 16 else np.uint32
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        names = [f"sequences-{shard:06d}.arrow", f"documents-{shard:06d}.arrow"]
        parts = [f"{base}/.{attempt}-{name}" for name in names]
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = 0
        with fs.open_output_stream(parts[0]) as one, fs.open_output_stream(parts[1]) as two:
            sequences, documents = _Writer(one, length, dtype), pa.ipc.new_file(two, index)
            for batch in blocks(batches):
                ids, bounds = code.batch(batch.column("text"))
                sizes = np.diff(bounds) + 1
                starts = sequences.total + np.cumsum(sizes) - sizes
                documents.write_batch(
                    pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(sizes)], schema=index)
                )
                sequences.add(np.insert(ids, bounds[1:], np.uint32(end_id)))
                n_docs += batch.num_rows
            sequences.close()
            documents.close()
        for part, name in zip(parts, names):
            if n_docs:
                fs.move(part, f"{base}/{name}")
            else:
                fs.delete_file(part)
        if n_docs:
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "first_id": pa.array([0]), "n_docs": [n_docs], "n_tokens": [sequences.total]}
                | {k: [f"{folder}/{n}"] for k, n in zip(("sequences", "documents"), names)}
            )

    # Text parts of a range come in doc_id order; equal ids (null among them) in the order of their texts.
    spread = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = spread.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    listed = sorted(ordered.mapInArrow(run, MANIFEST).collect())  # one row per shard
    before, rows = 0, []
    for row in listed:
        rows.append((row.shard, before, *row[2:]))
        before += row.n_tokens
    return spark.createDataFrame(rows, MANIFEST)


def read(manifest: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """Documents out of the files: doc_id, start over all shards, n_tokens, ids_crc32 and the ids if asked for."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, place = pa.fs.FileSystem.from_uri(row["documents"])
                with fs.open_input_file(place) as source:
                    listed = pa.ipc.open_file(source).read_all()
                sizes = listed.column("n_tokens").to_numpy()
                ends = np.cumsum(sizes)
                held, at, k = np.empty(0, np.uint32), 0, 0
                for some in Sequences(row["sequences"]).stream():
                    held = np.concatenate((held, some.astype(np.uint32)))
                    last = int(np.searchsorted(ends, at + len(held), "right"))
                    if last == k:
                        continue
                    cuts = np.concatenate(([at], ends[k:last])) - at
                    ids = [held[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                    columns = {
                        "doc_id": listed.column("doc_id").slice(k, last - k).combine_chunks(),
                        "start": pa.array(row["first_id"] + ends[k:last] - sizes[k:last]),
                        "n_tokens": pa.array(sizes[k:last]),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)
                    held, at, k = held[cuts[-1] :], int(ends[last - 1]), last

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    # One shard after another in a task of its own.
    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "shard").mapInArrow(run, schema)


def op4_arrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    return read(write(docs, folder, tokenizer_path("word_bpe_49k.json")), with_ids=False)
