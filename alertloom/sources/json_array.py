"""Large JSON arrays of objects, read by many tasks.

The file is cut at every ``}``, which Spark's text reader does for splits of any size. An element of
the array can only end at such a place: where no string is open and one bracket is. What a piece does to
that state depends on the state before it only by whether a string is open, so

1. every split is summed up for both cases (one row per split),
2. these rows are put in sequence per file, which gives each split the state it begins with,
3. every split puts its pieces together to elements; only what hangs over its ends is put
   together with the neighbours' afterwards.

Texts of elements are not parsed here, but what stands between them is checked: anything that is
not an array of objects fails the query. Spark's readers skip files without a byte, and so does this one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from alertloom.functions.settle import settle
from alertloom.sources.ingest import ROW_BITS, first_splits, split_bytes

NOT_AN_ARRAY = "input must be a JSON array of alerts"
NOT_OBJECTS = "every element of the array must be an alert object"

_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_ELEMENT = r"(?s)\A[ \t\r\n]*([\[,])[ \t\r\n]*(\{.*\})\z"
_END = r"\A[ \t\r\n]*\][ \t\r\n]*\}\z"
_EMPTY = r"\A[ \t\r\n]*\[[ \t\r\n]*\][ \t\r\n]*\}\z"


def after(piece: str, in_string: bool) -> tuple[bool, int]:
    """Whether a string is open behind the piece, and the brackets it opens less those it closes."""
    if in_string:
        rest = _REST_OF_STRING.match(piece)
        if rest is None:
            return True, 0
        piece = piece[rest.end() :]
    bare = _STRING.sub("", piece)
    quote = bare.find('"')
    if quote >= 0:
        bare = bare[:quote]
    return quote >= 0, bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def _pieces(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[tuple]:
    """(file, start, values of the extra columns, piece) row by row."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "start", *extra, "value")]
        for file, start, *own, value in zip(*columns):
            yield file, start, own, value + "}"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split: the state behind it and the depth it adds, if it begins outside and inside a string."""

    def row(at, tracks):
        (a, x), (b, y) = tracks
        return pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "open0": a, "depth0": x, "open1": b, "depth1": y}])

    at, tracks = None, []
    for file, start, _, piece in _pieces(batches, []):
        if (file, start) != at:
            if at:
                yield row(at, tracks)
            at, tracks = (file, start), [(False, 0), (True, 0)]
        moved = [after(piece, is_open) for is_open, _ in tracks]
        tracks = [(is_open, depth + more) for (_, depth), (is_open, more) in zip(tracks, moved)]
    if at:
        yield row(at, tracks)


def _in_sequence(table: pa.Table) -> pa.Table:
    """The state each split of a file begins with."""
    rows = sorted(table.to_pylist(), key=lambda r: r["start"])
    in_string, depth, out = False, 0, []
    for r in rows:
        out.append({"file": r["file"], "start": r["start"], "in_string": in_string, "depth": depth})
        k = int(in_string)
        in_string, depth = r[f"open{k}"], depth + r[f"depth{k}"]
    # behind the last bracket stands the brace that every piece gets
    if in_string or depth != -1:
        raise ValueError(NOT_AN_ARRAY)
    return pa.Table.from_pylist(out)


_PARTS = "file string, start bigint, number bigint, part int, text string"
# Of an element that one split holds; of one that goes on behind the split; of one begun before it.
WHOLE, BEGUN, GOING_ON, ENDED = 0, 1, 2, 3


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held, in_string, depth, number, inside, out = None, [], False, 0, 0, False, []

    def flushed():
        nonlocal out
        rows, out = out, []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()])],
            ["file", "start", "number", "part", "text"],
        )

    for file, start, (opened, level), piece in _pieces(batches, ["in_string", "depth"]):
        if (file, start) != at:
            if held:
                out.append((*at, number, GOING_ON if inside else BEGUN, "".join(held)))
            at, held, number, in_string, depth = (file, start), [], 0, opened, level
            inside = in_string or depth != 1
            inside = inside and (start > 0)
        held.append(piece)
        in_string, more = after(piece, in_string)
        depth += more
        if depth == 1 and not in_string:
            out.append((file, start, number, ENDED if inside else WHOLE, "".join(held)))
            held, inside, number = [], False, number + 1
            if len(out) >= 2000:
                yield flushed()
    if held:
        out.append((*at, number, GOING_ON if inside else BEGUN, "".join(held)))
    if out:
        yield flushed()


def _checked(text: Column, first: Column) -> Column:
    """An element without what stands before it; null for the array's end, which is none."""
    lead = F.regexp_extract(text, _ELEMENT, 1)
    return (
        F.when(F.when(first, text.rlike(_EMPTY)).otherwise(text.rlike(_END)), F.lit(None))
        .when(lead == F.when(first, F.lit("[")).otherwise(F.lit(",")), F.regexp_extract(text, _ELEMENT, 2))
        .when(first & ~text.rlike(r"\A[ \t\r\n]*\["), F.raise_error(F.lit(NOT_AN_ARRAY)).cast("string"))
        .otherwise(F.raise_error(F.lit(NOT_OBJECTS)).cast("string"))
    )


def read_array_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(seq, file, record): the text of every element of the files' arrays, ``seq`` in order of (file, position)."""
    unit = split_bytes(spark)
    files = first_splits(spark, paths, unit)
    pieces = spark.read.option("lineSep", "}").text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    sums = pieces.mapInArrow(_sums, "file string, start bigint, open0 boolean, depth0 bigint, open1 boolean, depth1 bigint")
    states = sums.groupBy("file").applyInArrow(_in_sequence, "file string, start bigint, in_string boolean, depth bigint")
    # A row of about 100 bytes per split; first_splits() has checked how many there can be.
    placed = pieces.join(F.broadcast(states), ["file", "start"]).mapInArrow(_elements, _PARTS)
    whole = placed.where(F.col("part") == WHOLE).select("file", "start", "number", "text")
    hanging = placed.where(F.col("part") != WHOLE)
    # An element that crosses splits: the piece that begins it and those up to the next beginning.
    in_order = Window.partitionBy("file").orderBy("start", (F.col("part") == BEGUN).cast("int"))
    run = F.count_if(F.col("part") == BEGUN).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    joined = hanging.withColumn("run", run).groupBy("file", "run").agg(
        F.min(F.struct("start", "number")).alias("at"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("texts")
    )
    joined = joined.select("file", "at.start", "at.number", F.array_join(F.transform("texts", lambda t: t["text"]), "").alias("text"))
    rows = whole.unionByName(joined).join(F.broadcast(files), "file")
    first = (F.col("start") == 0) & (F.col("number") == 0)
    seq = F.shiftleft(F.col("first_split") + F.floor(F.col("start") / unit), ROW_BITS).bitwiseOR(F.col("number"))
    elements = rows.select(seq.alias("seq"), "file", _checked(F.col("text"), first).alias("record"))
    return settle(elements, ["record"]).where("record is not null")
