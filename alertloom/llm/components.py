"""Connected components of a table of links, by alternating large and small stars.

Each round joins every vertex with its least neighbour, once for the larger and once for the smaller neighbours,
until the links form stars around each component's least vertex. Rounds are few (about the logarithm of the longest
chain), hubs are split by skew joins, and each round's links are written. Nothing but two sums goes to the driver.
After any number of rounds the links connect the same vertices as before, so rounds may stop early and go on later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.store import saved


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _round(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    # now every link goes from a vertex to a smaller one
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def stars(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """Links a, b with a > b that connect the same vertices, after so many rounds; by default as stars around the least ones."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if rounds is not None:
        for _ in range(rounds):
            links = saved(_round(links))
        return links
    links = saved(links.distinct())
    state = _state(links)
    while state[0]:
        links = saved(_round(links))
        before, state = state, _state(links)
        if before == state:
            break
    return links


def labels(links: DataFrame) -> DataFrame:
    """vertex, component (the least vertex it is linked to, or itself) of links a > b; of stars, the component's least vertex."""
    pair = lambda v: F.struct(F.col(v).alias("vertex"), F.col("b").alias("component"))
    ends = links.select(F.explode(F.array(pair("a"), pair("b"))).alias("p")).select("p.*")
    return ends.groupBy("vertex").agg(F.min("component").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """vertex, component (least vertex reachable), for vertices with a link; links are columns a, b (long)."""
    return labels(stars(links))
