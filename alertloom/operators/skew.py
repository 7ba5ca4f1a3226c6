"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom.config import TriageConfig

# Keys a sketch follows; any key with more than one row in so many is among them.
SKETCHED = 1024


def hot_keys(rows: DataFrame, keys: list[str], cfg: TriageConfig) -> DataFrame | None:
    """(key): hashes of the keys with ``hot_key_rows`` rows or more, null if there are none.

    A sketch of frequent items, gathered per task and merged: a fixed size however many keys there
    are. It may name a key too many, which costs a few copies, and it misses none that owns more than a
    ``SKETCHED``-th of all rows.
    """
    hashed = rows.select(F.xxhash64(*keys).alias("key"))
    top = F.expr(f"approx_top_k(key, {SKETCHED // 2}, {SKETCHED})")
    found = hashed.agg(top.alias("top")).first().top or []
    hot = [(t["item"],) for t in found if t["item"] is not None and t["count"] >= cfg.hot_key_rows]
    return rows.sparkSession.createDataFrame(hot, "key bigint") if hot else None


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], cfg: TriageConfig, how: str = "left"
) -> DataFrame:
    """Join many rows to a table by key. The result is that of a plain join.

    Rows of hot keys are dealt out over ``join_salts`` tasks, and only these keys' table rows are
    copied for them. Where the table is small, Spark broadcasts it by its size and nothing is dealt.
    """
    if rows.isStreaming or cfg.join_salts <= 1:
        return rows.join(lookup, keys, how)
    hot = hot_keys(rows, keys, cfg)
    if hot is None:
        return rows.join(lookup, keys, how)

    def marked(df: DataFrame, salt: Column) -> DataFrame:
        df = df.withColumn("_key", F.xxhash64(*keys))
        found = df.join(F.broadcast(hot.select(F.col("key").alias("_key"), F.lit(True).alias("_hot"))), "_key", "left")
        return found.withColumn("_salt", F.when(F.coalesce("_hot", F.lit(False)), salt)).drop("_key", "_hot")

    # The salt is a hash of the whole row: a retried task gives the same one.
    salted = marked(rows, F.pmod(F.xxhash64(*_hashable(rows)), F.lit(cfg.join_salts)).cast("int"))
    salted = salted.withColumn("_salt", F.coalesce("_salt", F.lit(0)))
    copies = marked(lookup, F.lit(cfg.join_salts - 1))
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salt", F.lit(0)))))
    return salted.join(copies, keys + ["_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[str]:
    """Columns to salt by: the row's sequence number if it has one, else all flat columns."""
    if "seq" in df.columns:
        return ["seq"]
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
