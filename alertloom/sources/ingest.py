"""Raw log files to one row per record, in input order.

Order matters to dedup, so every record carries ``seq``, a bigint that grows with
(file, position in file).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from alertloom.functions.text import is_blank, lines, strip

FILE_STRIDE = 1 << 32
# Bits of a line's place in its task, below the number of its split.
ROW_BITS = 33
# A line scan names its files by a broadcast table of about 100 bytes each. Spark's own listing of
# them, which the driver holds anyway, is larger.
MOST_FILES = 2_000_000


def _file_numbers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, file_no) in name order. Lists files without reading their content."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"))
    return files.select(
        "file", (F.row_number().over(Window.orderBy("file")) - 1).cast("bigint").alias("file_no")
    )


def read_blobs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per whole file: (file, file_no, blob). A file must fit in a task."""
    blobs = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("blob")
    )
    return blobs.join(_file_numbers(spark, paths), "file").select("file", "file_no", "blob")


def split_bytes(spark: SparkSession) -> int:
    """What every file split but a file's last is at least long, by the reader's settings."""
    conf = spark._jsparkSession.sessionState().conf()
    return max(1, min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()))


def first_splits(spark: SparkSession, paths: str | list[str], unit: int) -> DataFrame:
    """(file, first_split): numbers of splits so far, in name order, if each were ``unit`` bytes."""
    files = spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("file"), (F.floor(F.col("length") / unit) + 1).alias("splits")
    )
    size = files.agg(F.count("*").alias("files"), F.sum("splits").alias("splits")).first()
    if size.files > MOST_FILES or (size.splits or 0) >> (63 - ROW_BITS):
        raise ValueError(f"{size.files} files in {size.splits} splits are too many for one scan; merge small files first")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("splits").over(before), F.lit(0)).alias("first_split"))


def _row_in_task() -> Column:
    """Grows with the rows of a task, hence with those of each file split."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per non-blank line of splittable logs: (seq, file, record).

    A line's ``seq`` is the number of its file split, then its place among the rows its task reads: a
    task reads a split from front to back. Splits are numbered from the files' lengths and
    where they start, so the text is read once and never moved. Numbers grow with (file, position), with gaps.
    They stay the same as long as the reader's split settings and the number of cores do.
    """
    unit = split_bytes(spark)
    text = spark.read.text(paths).select(
        F.col("value").alias("record"),
        F.col("_metadata.file_path").alias("file"),
        F.floor(F.col("_metadata.file_block_start") / unit).alias("split"),
        _row_in_task().alias("row"),
    )
    seq = F.shiftleft(F.col("first_split") + F.col("split"), ROW_BITS).bitwiseOR(F.col("row"))
    return (
        text.join(F.broadcast(first_splits(spark, paths, unit)), "file")
        .select(seq.alias("seq"), "file", strip(F.col("record")).alias("record"))
        .filter(~is_blank(F.col("record")))
    )


def _with_row_in_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``row``, counted anew for each file split; a task reads its splits one after another."""
    current, rows = None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        files = batch.column("file").dictionary_encode()
        codes, starts = files.indices.to_numpy(zero_copy_only=False), batch.column("start").to_numpy(zero_copy_only=False)
        change = (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])
        begins = np.concatenate(([0], np.flatnonzero(change) + 1))
        row = np.arange(batch.num_rows) - np.repeat(begins, np.diff(np.append(begins, batch.num_rows)))
        if (files.dictionary[int(codes[0])].as_py(), int(starts[0])) == current:
            row[: begins[1] if len(begins) > 1 else None] += rows
        current, rows = (files.dictionary[int(codes[-1])].as_py(), int(starts[-1])), int(row[-1]) + 1
        yield batch.append_column("row", pa.array(row, pa.int64()))


def stream_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files as they arrive. A stream has no order of files, so ``seq`` is a hash of the
    line's place (file, split, row): equal lines stay apart, and a repeated batch gives the same numbers."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    placed = lines.mapInArrow(_with_row_in_split, "value string, file string, start bigint, row bigint")
    rows = placed.select(F.xxhash64("file", "start", "row").alias("seq"), "file", strip(F.col("value")).alias("record"))
    return rows.filter(~is_blank(F.col("record")))


def reject_empty(blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs with content, rejects): an input without any text is an error row."""
    blank = is_blank(F.col("blob"))
    rejects = blobs.filter(blank).select(
        "file", F.lit("empty_input").alias("reject"), F.coalesce("blob", F.lit("")).alias("raw")
    )
    return blobs.filter(~blank), rejects


def _as_json_document(blob: Column) -> Column:
    """The whole blob as one JSON value's text, or null when it is not exactly one value."""
    # The blob's own hash stands behind it, where only a blob that is one value lets the parser find it.
    mark = F.sha2(blob, 256)
    wrapped = F.from_json(F.concat(F.lit("["), blob, F.lit(',"'), mark, F.lit('"]')), "array<string>")
    return F.when((F.size(wrapped) == 2) & (F.get(wrapped, F.lit(1)) == mark), F.get(wrapped, F.lit(0)))


def _json_elements(document: Column) -> Column:
    return F.when(
        F.ltrim(document).startswith("["), F.from_json(document, "array<string>")
    ).otherwise(F.array(document))


def _seq(position: str = "pos") -> Column:
    return F.col("file_no") * F.lit(FILE_STRIDE) + F.col(position)


def json_records(blobs: DataFrame) -> DataFrame:
    """Blobs that are one JSON value: one row per alert, an array giving one per element."""
    document = _as_json_document(F.col("blob"))
    return (
        blobs.withColumn("document", document)
        .filter(F.col("document").isNotNull())
        .select("file", "file_no", F.posexplode(_json_elements(F.col("document"))).alias("pos", "record"))
        .select(_seq().alias("seq"), "file", "record")
    )


def line_records(blobs: DataFrame) -> DataFrame:
    """Blobs as text: one row per trimmed, non-blank line."""
    return (
        blobs.select("file", "file_no", F.posexplode(lines(F.col("blob"))).alias("pos", "line"))
        .select(_seq().alias("seq"), "file", strip(F.col("line")).alias("record"))
        .filter(F.length("record") > 0)
    )


def line_kind(record: Column) -> Column:
    return F.when(record.startswith("CEF:"), F.lit("cef")).otherwise(F.lit("syslog"))


def route_blobs(blobs: DataFrame) -> DataFrame:
    """(seq, file, kind, record): a blob is JSON as a whole or a list of CEF/syslog lines."""
    document = F.col("document")
    records = F.when(document.isNotNull(), _json_elements(document)).otherwise(lines(F.col("blob")))
    return (
        blobs.withColumn("document", _as_json_document(F.col("blob")))
        .select(
            "file",
            "file_no",
            document.isNotNull().alias("is_json"),
            F.posexplode(records).alias("pos", "text"),
        )
        .withColumn("record", F.when(F.col("is_json"), F.col("text")).otherwise(strip(F.col("text"))))
        # A null JSON element is still a record (a bad one); a blank line is none.
        .filter(F.col("is_json") | (F.length("record") > 0))
        .select(
            _seq().alias("seq"),
            "file",
            F.when(F.col("is_json"), F.lit("json")).otherwise(line_kind(F.col("record"))).alias("kind"),
            "record",
        )
    )


def route_lines(line_rows: DataFrame, jsonl: bool = False) -> DataFrame:
    """Kind per line of a splittable log. ``jsonl`` also takes lines that are JSON objects."""
    record = F.col("record")
    kind = line_kind(record)
    if jsonl:
        is_object = record.startswith("{") & _as_json_document(record).isNotNull()
        kind = F.when(is_object, F.lit("json")).otherwise(kind)
    return line_rows.withColumn("kind", kind)


def read_records(spark: SparkSession, paths: str | list[str], mode: str = "auto") -> DataFrame:
    """(seq, file, kind, record).

    auto   whole-file detection: JSON document, else CEF/syslog lines
    lines  splittable logs, CEF/syslog per line
    jsonl  splittable logs, JSON objects or CEF/syslog per line
    """
    if mode == "auto":
        return route_blobs(reject_empty(read_blobs(spark, paths))[0])
    if mode in ("lines", "jsonl"):
        return route_lines(read_log_lines(spark, paths), jsonl=mode == "jsonl")
    raise ValueError(f"unknown mode: {mode}")
