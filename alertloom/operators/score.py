"""Threat-intelligence confidence, priority score, tier and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom.config import TriageConfig
from alertloom.functions.settle import settle
from alertloom.operators.attack import TECHNIQUE_LIST
from alertloom.operators.skew import lookup_join

TIERS = ["P1", "P2", "P3", "P4"]


def _by_name(value: Column, points: dict[str, int]) -> Column:
    chain = F
    for name, n in points.items():
        chain = chain.when(value == name, F.lit(n))
    return chain.otherwise(F.lit(0))


def consensus(results: Column, malicious: Column, suspicious: Column) -> Column:
    return (
        F.when((malicious == 0) & (suspicious == 0), F.lit("unknown"))
        .when(malicious == results, F.lit("strong"))
        .when((malicious >= 2) & (malicious > suspicious), F.lit("strong"))
        .otherwise(F.lit("mixed"))
    )


def _confidence_struct(n: Column, malicious: Column, suspicious: Column, providers: Column) -> Column:
    share = F.when(n > 0, F.bround((malicious + suspicious) / n, 3)).otherwise(F.lit(0.0))
    return F.struct(
        n.cast("int").alias("result_count"),
        F.size(providers).alias("provider_count"),
        providers.alias("providers"),
        malicious.cast("int").alias("malicious_count"),
        suspicious.cast("int").alias("suspicious_count"),
        consensus(n, malicious, suspicious).alias("consensus"),
        share.cast("double").alias("confidence"),
    )


def confidence_table(results: DataFrame, cfg: TriageConfig) -> DataFrame:
    """(seq, enrichment_confidence, intel_points) from the long table of attached reputations.

    Counts combine before the shuffle, so the verdict rows themselves do not travel.
    """
    verdict = F.col("verdict")
    providers = F.array_sort(F.array_distinct(F.flatten("provider_sets")))
    counts = results.groupBy("seq").agg(
        F.count("*").alias("n"),
        F.count_if(verdict == "malicious").alias("malicious"),
        F.count_if(verdict == "suspicious").alias("suspicious"),
        F.collect_set("providers_used").alias("provider_sets"),
        F.sum(_by_name(verdict, cfg.verdict_boost)).alias("boost"),
    )
    return counts.select(
        "seq",
        _confidence_struct(F.col("n"), F.col("malicious"), F.col("suspicious"), providers).alias(
            "enrichment_confidence"
        ),
        (F.col("boost") * cfg.enrichment_boost_multiplier).alias("intel_points"),
    )


def enrichment_results(enrichment: Column) -> Column:
    """All reputations inside a nested enrichment, as an array."""

    def values(slot: str) -> Column:
        return F.coalesce(F.map_values(enrichment[slot]), F.array())

    single = F.filter(F.array(enrichment["src_ip"], enrichment["dest_ip"]), lambda r: r.isNotNull())
    parts = F.concat(
        F.coalesce(single, F.array()), values("ips"), values("domains"), values("hashes")
    )
    return F.transform(
        F.filter(parts, lambda r: r["verdict"].isNotNull()),
        lambda r: F.struct(r["verdict"].alias("verdict"), r["providers_used"].alias("providers_used")),
    )


def with_nested_confidence(alerts: DataFrame, cfg: TriageConfig) -> DataFrame:
    """Confidence and points of alerts that carry a nested enrichment: row-local, no shuffle."""
    df = alerts.withColumn("_results", enrichment_results(F.col("enrichment")))
    results = F.col("_results")

    def number(verdict: str) -> Column:
        return F.size(F.filter(results, lambda r: r["verdict"] == verdict))

    providers = F.array_sort(
        F.array_distinct(
            F.flatten(F.transform(results, lambda r: F.coalesce(r["providers_used"], F.array())))
        )
    )
    boost = F.aggregate(
        results, F.lit(0), lambda acc, r: acc + _by_name(r["verdict"], cfg.verdict_boost)
    )
    return df.withColumns(
        {
            "enrichment_confidence": _confidence_struct(
                F.size(results), number("malicious"), number("suspicious"), providers
            ),
            "intel_points": boost * cfg.enrichment_boost_multiplier,
        }
    ).drop("_results")


def no_confidence() -> dict[str, Column]:
    """The columns of an alert nothing is known about."""
    zero = F.lit(0)
    return {
        "enrichment_confidence": _confidence_struct(zero, zero, zero, F.array().cast("array<string>")),
        "intel_points": zero,
    }


def with_long_confidence(alerts: DataFrame, results: DataFrame, cfg: TriageConfig) -> DataFrame:
    """The same columns from the long table; alerts without indicators get the empty confidence."""
    joined = alerts.join(confidence_table(results, cfg), "seq", "left")
    return joined.withColumns({name: F.coalesce(name, empty) for name, empty in no_confidence().items()})


def with_asset_points(alerts: DataFrame, assets: DataFrame | None, cfg: TriageConfig) -> DataFrame:
    """Adds ``asset_points``: weights of source address, target address and sensor, summed."""
    if assets is None:
        return alerts.withColumn("asset_points", F.lit(0))
    fields = F.array(*[F.col(f) for f in ("src_ip", "dest_ip", "source")])
    # An asset named twice counts twice.
    named = alerts.select("seq", F.explode(F.filter(fields, lambda f: f.isNotNull() & (f != ""))).alias("asset"))
    points = lookup_join(named, assets.select("asset", "weight"), ["asset"], cfg, how="inner").groupBy("seq").agg(
        F.sum("weight").alias("asset_points")
    )
    return alerts.join(points, "seq", "left").withColumn("asset_points", F.coalesce("asset_points", F.lit(0)).cast("int"))


def priority_score(cfg: TriageConfig) -> Column:
    """0..100 from severity, repeats, verdicts, consensus, technique match and assets."""
    repeats = F.coalesce("occurrence_count", F.lit(1))
    score = (
        F.coalesce("severity", F.lit(5)) * cfg.severity_weight
        + F.when(repeats > 1, F.least(F.lit(cfg.repeat_cap), (repeats - 1) * cfg.repeat_points)).otherwise(0)
        + F.col("intel_points")
        + _by_name(F.col("enrichment_confidence.consensus"), cfg.consensus_bonus)
        + F.when(F.size(F.coalesce("mitre", F.array())) > 0, cfg.mitre_match_bonus).otherwise(0)
        + F.col("asset_points")
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def priority_tier(score: Column, cfg: TriageConfig) -> Column:
    return (
        F.when(score >= cfg.tier_p1, F.lit("P1"))
        .when(score >= cfg.tier_p2, F.lit("P2"))
        .when(score >= cfg.tier_p3, F.lit("P3"))
        .otherwise(F.lit("P4"))
    )


def threat_intelligence() -> Column:
    c = F.col("enrichment_confidence")
    verdict = (
        F.when(c["malicious_count"] > 0, F.lit("malicious"))
        .when(c["suspicious_count"] > 0, F.lit("suspicious"))
        .otherwise(F.lit("unknown"))
    )
    kept = ["confidence", "consensus", "result_count", "provider_count", "providers"]
    return F.struct(verdict.alias("verdict"), *[c[k].alias(k) for k in kept])


def score_alerts(alerts: DataFrame, assets: DataFrame | None, cfg: TriageConfig) -> DataFrame:
    """Score, tier and roll-up for alerts that already carry confidence columns."""
    if "mitre" not in alerts.columns:
        alerts = alerts.withColumn("mitre", F.array().cast(TECHNIQUE_LIST))
    scored = with_asset_points(alerts, assets, cfg).withColumn("priority_score", priority_score(cfg))
    return (
        settle(scored, ["priority_score"])
        .withColumn("priority_tier", priority_tier(F.col("priority_score"), cfg))
        .withColumn("threat_intelligence", threat_intelligence())
        .drop("intel_points", "asset_points")
    )


def order_keys() -> list[Column]:
    """Highest score first; ties in the order in which address pairs, then groups, came up."""
    return [F.desc("priority_score"), F.asc("bucket_seq"), F.asc("seq")]


def in_priority_order(triaged: DataFrame) -> DataFrame:
    return triaged.orderBy(*order_keys())
