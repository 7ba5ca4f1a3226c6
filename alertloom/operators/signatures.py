"""Which signatures can meet in one group: links between similar ones and the blocks they form.

Similarity is difflib's ratio of the lower-cased texts, 2 * M / (la + lb), where M characters match in order. So M is at most
the longest common subsequence, and a ratio of t leaves at most la - M deletions and lb - M insertions. A deletion
destroys at most two of a text's neighbouring character pairs, an insertion one. Texts that match therefore share at least

    (la + 1) - 2 * (la - M) - (lb - M)  =  1 + 3 * M - la - lb        with M = ceil(t * (la + lb) / 2)

pairs, the borders counted as characters. Where a low threshold makes that worthless, single characters take the place of pairs: M of them
are shared. With all tokens in one order, rarest first, two such texts share a token among their first
n - least + 1. Only texts that share one of these are compared; everything is a join over distinct signatures, and no pair that
matches is lost.

Signatures that are linked, in any direction and over any number of steps, form a block. Groups never hold signatures of two blocks,
so blocks are grouped apart from each other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.config import TriageConfig
from alertloom.functions.similarity import SignatureIndex
from alertloom.operators.materialize import staged

_TOKENS = "signature string, length int, least int, tokens array<string>"


def partner_lengths(length: int, threshold: float) -> range:
    """Lengths of texts that can reach the threshold with one of this length."""
    if length == 0:
        return range(0, 1)
    return range(math.ceil(length * threshold / (2 - threshold) - 1e-9), math.floor(length * (2 - threshold) / threshold + 1e-9) + 1)


def _matched(la: int, lb: int, threshold: float) -> int:
    """The least M; a hair less, so that rounding in the ratio loses nothing."""
    return math.ceil(threshold * (la + lb) / 2 - 1e-9)


def shared_pairs(la: int, lb: int, threshold: float) -> int:
    return 1 + 3 * _matched(la, lb, threshold) - la - lb


def least_shared(length: int, threshold: float, size: int) -> int:
    """Tokens (pairs or single characters) that a text of this length shares with any match."""
    bound = shared_pairs if size == 2 else _matched
    return min((bound(length, n, threshold) for n in partner_lengths(length, threshold)), default=1)


def token_size(threshold: float) -> int:
    """2 if pairs say something for texts of any length: their bound grows with the length from the shortest on."""
    return 2 if threshold > 0.8 and all(least_shared(n, threshold, 2) > 0 for n in range(1, 200)) else 1


def _tokens(text: str, size: int) -> list[str]:
    """The text's tokens, the k-th occurrence of one told from the others."""
    if size == 2:
        text = f"\x02{text}\x03"
        parts = [text[k : k + 2] for k in range(len(text) - 1)]
    else:
        parts = list(text)
    seen: Counter = Counter()
    out = []
    for p in parts:
        seen[p] += 1
        out.append(f"{p}{seen[p]}")
    return out


def tokens(signatures: DataFrame, threshold: float) -> DataFrame:
    size = token_size(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("signature").to_pylist()
            lower = [t.lower() for t in texts]
            least = {n: least_shared(n, threshold, size) for n in {len(t) for t in lower}}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in lower], pa.int32()),
                    pa.array([least[len(t)] for t in lower], pa.int32()),
                    pa.array([_tokens(t, size) for t in lower], pa.list_(pa.string())),
                ],
                ["signature", "length", "least", "tokens"],
            )

    return signatures.select("signature").mapInArrow(run, _TOKENS)


def candidates(signatures: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b of all distinct signatures that may match in either direction, and some more."""
    hashed = F.transform("tokens", lambda t: F.xxhash64(t))
    described = tokens(signatures, threshold).withColumn("tokens", hashed)
    each = described.select("signature", "length", "least", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("texts"))
    # rarest first; a token of one text alone leads to nobody but takes its place in the order
    ranked = each.join(common, "token").groupBy("signature", "n", "least").agg(F.array_sort(F.collect_list(F.struct("texts", "token"))).alias("order"))
    first = F.slice("order", 1, F.greatest(F.col("n") - F.col("least") + 1, F.lit(0)))
    leading = ranked.select("signature", F.explode(first).alias("t")).where("t.texts > 1").select("signature", F.col("t.token").alias("token"))
    leading = staged(leading.join(described.select("signature", "length", "tokens"), "signature"))
    one = leading.select("token", F.col("signature").alias("a"), F.col("length").alias("la"), F.col("tokens").alias("ta"))
    other = leading.select("token", F.col("signature").alias("b"), F.col("length").alias("lb"), F.col("tokens").alias("tb"))
    la, lb = F.col("la"), F.col("lb")
    matched = F.ceil(F.lit(threshold) * (la + lb) / 2 - 1e-9)
    shared = 1 + 3 * matched - la - lb if token_size(threshold) == 2 else matched
    # hashes that agree by chance only add to what two texts share
    enough = (F.least("la", "lb") >= matched) & (F.size(F.array_intersect("ta", "tb")) >= shared)
    return one.join(other, "token").where((F.col("a") < F.col("b")) & enough).select("a", "b").distinct()


def links(signatures: DataFrame, threshold: float) -> DataFrame:
    """(group_signature, signature): the first, as a group's, accepts the second; equal ones are left out."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                index = SignatureIndex(threshold)
                index.number(a), index.number(b)
                found += [(a, b)] if 0 in index.matching(1) else []
                found += [(b, a)] if 1 in index.matching(0) else []
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.string()) for j in (0, 1)], ["group_signature", "signature"])

    return candidates(signatures, threshold).mapInArrow(confirm, "group_signature string, signature string")


def blocks(signatures: DataFrame, cfg: TriageConfig) -> DataFrame | None:
    """(signature, block) of the signatures that have a link, the block named by its least member; null if there are none.

    Labels spread along links and then jump to their label's label, so the number of rounds is about the logarithm of
    the longest chain.
    """
    one_way = links(signatures, cfg.dedup_fuzzy_threshold)
    edges = staged(one_way.union(one_way.select("signature", "group_signature")).toDF("v", "w").distinct())
    labels = edges.groupBy("v").agg(F.least("v", F.min("w")).alias("label"))
    while True:
        near = edges.join(labels.toDF("w", "nearest"), "w").groupBy("v").agg(F.min("nearest").alias("nearest"))
        lower = labels.join(near, "v").select("v", F.least("label", "nearest").alias("label"), F.col("label").alias("before"))
        jumped = lower.join(labels.toDF("label", "further"), "label")
        found = staged(jumped.select("v", F.least("label", "further").alias("label"), "before"))
        labels = found.select("v", "label")
        state = found.agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("before")).alias("moved")).first()
        if not state.n:
            return None
        if not state.moved:
            return labels.toDF("signature", "block")
