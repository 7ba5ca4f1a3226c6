"""Sharding in the order of a Hilbert curve, with DataFrame functions only.

Every document is a point of a grid: several metadata columns, each quantised to `bits` bits. Its place on the
Hilbert curve through the grid is computed in integer expressions (Skilling's transposition: undo the
excess work from the top bit down, then Gray code). Rows are sorted by that place, and the order is cut into runs
of counts that differ by one at most (law `rows`), so that a shard covers a compact part of every dimension
and a filter on any of them skips most shards.

The sort is a range partitioning by (place, hash of the text, doc_id), so a place that holds a third of all rows is
still dealt out evenly; equal texts of equal metadata are neighbours. Only keys are moved, never texts.

Null text: size 1, checksum 0. Null metadata take the lowest cell. Rows with a null doc_id sort first
among equals, repeated rows follow one another. Other columns are ignored. No rows: no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.store import saved

SHARDS = 8
BITS = 6


def _bit(x: Column, q: int) -> Column:
    return F.shiftright(x, q).bitwiseAND(F.lit(1)) == 1


def _undone(k: int, q: int, n: int):
    """Undoes the work of bit q in coordinate k: turns the low bits of the first, or swaps them with the k-th's."""
    low = F.lit((1 << q) - 1).cast("long")

    def step(x):
        swap = x[0].bitwiseXOR(x[k]).bitwiseAND(low)
        first = F.when(_bit(x[k], q), x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap))
        own = F.when(_bit(x[k], q), x[k]).otherwise(x[k].bitwiseXOR(swap))
        return F.array(*[first if i == 0 else own if i == k else x[i] for i in range(n)])

    return step


def curve_index(cells: list[Column], bits: int) -> Column:
    """Place on the curve of a point with these coordinates, each of so many bits."""
    n = len(cells)
    if n * bits > 62:
        raise ValueError("coordinates do not fit into a long")
    point = F.array(*[c.cast("long") for c in cells])
    for q in range(bits - 1, 0, -1):
        for k in range(n):
            # the point is an argument of the lambda, so that it is computed once in each step
            point = F.transform(F.array(point), _undone(k, q, n))[0]

    def gray(x):
        out = [x[0]]
        for k in range(1, n):
            out.append(out[-1].bitwiseXOR(x[k]))
        return F.array(*out)

    def unwind(x):
        turn = F.lit(0).cast("long")
        for q in range(bits - 1, 0, -1):
            turn = F.when(_bit(x[n - 1], q), turn.bitwiseXOR(F.lit((1 << q) - 1))).otherwise(turn)
        return F.transform(x, lambda y: y.bitwiseXOR(turn))

    def woven(x):
        out = F.lit(0).cast("long")
        for q in range(bits):
            for k in range(n):
                out = out.bitwiseOR(F.shiftleft(F.shiftright(x[k], q).bitwiseAND(F.lit(1)).cast("long"), q * n + n - 1 - k))
        return out

    for last in (gray, unwind, woven):
        point = F.transform(F.array(point), last)[0]
    return point


def quantised_log(value: Column, bits: int) -> Column:
    """Size classes: a quarter of an octave each."""
    return F.least(F.floor(4 * F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)) + 1)), F.lit((1 << bits) - 1))


def quantised_name(value: Column, bits: int) -> Column:
    """Names by hash; equal names share a cell. Null: 0."""
    return F.when(value.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(value), F.lit((1 << bits) - 1)) + 1)


def shard(docs: DataFrame, cells: list[Column], *, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index of each document."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))
    keys = docs.select(
        F.col("doc_id").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
        curve_index(cells, bits).alias("curve_index"), F.xxhash64("text").alias("text_hash"),
    )
    order = [F.col("curve_index"), F.col("text_hash"), F.col("doc_id").asc_nulls_first()]
    laid = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written, so that every later read sees the same partitions: the number holds partition and place in it.
    laid = saved(laid.withColumn("at", F.monotonically_increasing_id()))
    counts = laid.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    listed = sorted((r.part, r.n) for r in counts.collect())  # one row per partition
    spark, total, before = docs.sparkSession, 0, []
    for part, n in listed:
        before.append((part, total))
        total += n
    before = spark.createDataFrame(before, "part long, before long")
    ranked = laid.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    own = F.expr(f"rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("rank", rank).withColumn("shard", own).withColumn("slot", F.col("rank") - first).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve_index",
    )


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cells = [quantised_log(F.col("n_chars"), BITS), quantised_name(F.col("lang"), BITS), quantised_name(F.col("source"), BITS)]
    return shard(docs, cells)
