"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised byte by byte: A-Z in lower case, every ASCII character that is no letter or digit a blank,
all else as it is. An item's patterns are its windows of 13 words (all its words, if fewer), each between two
blanks. A document's words, joined by single blanks, are scanned once; the places of matches are turned
into word numbers, and these into offsets of the text as it came.

The benchmark is the stated query set. It is read in blocks of a bounded size, chosen by hash of the item, with
one automaton for each; nothing else leaves the executors. A benchmark within one block, the usual case, is one
automaton and one scan; with more blocks a document's hits are united.

Null text or text without words: no words, no hits. Items without words match nothing; the ids of items are
compared as strings, and an item with a null id is ignored. Repeated documents are judged each, repeated items count once
for each distinct id. Other columns are ignored. No documents: no rows. No benchmark: no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.encoder import blocks

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Bytes of item text in one automaton.
BLOCK_BYTES = 4 << 20

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_WORD = np.array([c != 0x20 for c in _FOLD])

RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<begin:long,end:long>>"
)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    own = words(text)
    return {b" ".join(own[k : k + size]) for k in range(max(1, len(own) - size + 1))} if own else set()


def automaton(items: list[tuple[str, str]], size: int = WINDOW):
    """Over (item, text); the value of a pattern is its word count and the items that have it."""
    import ahocorasick

    found: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows(text, size):
            found.setdefault(window, set()).add(item)
    out = ahocorasick.Automaton()
    for window, owners in found.items():
        # one character for each byte
        out.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(sorted(owners))))
    out.make_automaton()
    return out


def scan(own: list[bytes], search) -> tuple[np.ndarray, set[str]]:
    """Numbers of the words hit, ascending, and the items."""
    if not len(search):
        return np.empty(0, np.int64), set()
    line = f" {b' '.join(own).decode('latin-1')} "
    ends, sizes, items = [], [], set()
    for end, (size, owners) in search.iter(line):
        ends.append(end)
        sizes.append(size)
        items.update(owners)
    if not ends:
        return np.empty(0, np.int64), items
    # a word ends before the blank behind it
    blanks = np.cumsum([len(w) + 1 for w in own])
    last = np.searchsorted(blanks, ends)
    cover = np.zeros(len(own) + 1, np.int64)
    np.add.at(cover, last - np.array(sizes) + 1, 1)
    np.add.at(cover, last + 1, -1)
    return np.flatnonzero(np.cumsum(cover[:-1]) > 0), items


def offsets(text: str, hit: np.ndarray) -> list[dict]:
    """Spans of the text, in characters, that runs of hit words cover."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], _WORD[raw], [False]))
    begins, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    place = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters before each byte
    return [{"begin": int(place[begins[r[0]]]), "end": int(place[ends[r[-1]]])} for r in runs]


def _scanned(docs: DataFrame, searches: list) -> DataFrame:
    """With the words and items found by all of these automata."""

    def run(batches):
        for batch in blocks(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own, hit, items = words(text), np.empty(0, np.int64), set()
                for search in searches:
                    more, found = scan(own, search.value)
                    hit, items = np.union1d(hit, more), items | found
                names = sorted(items)
                sha = hashlib.sha256(",".join(names).encode()).hexdigest()
                n = len(hit)
                spans = offsets(text, hit) if n else []
                rows.append((doc_id, len(own), n, len(names), sha, n > 0 and SHARE * n >= len(own), names, spans))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.list_(pa.string())]
            kinds.append(pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def automata(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast automata; the driver holds one block of items at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    out = []
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        out.append(spark.sparkContext.broadcast(automaton([tuple(r) for r in own.toLocalIterator()])))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: counts, the items found, and spans of the original text in characters."""
    return _scanned(docs, automata(benchmark, block_bytes))


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    searches = automata(benchmark, block_bytes)

    def run(batches):
        for batch in blocks(batches):
            clean = []
            for text in batch.column("text").to_pylist():
                own = words(text)
                hit = np.unique(np.concatenate([np.empty(0, np.int64), *[scan(own, s.value)[0] for s in searches]]))
                clean.append(not len(hit) or SHARE * len(hit) < len(own))
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).drop("items", "spans")
