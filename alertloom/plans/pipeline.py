"""Raw logs, or normalised alerts, to ranked incidents."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom.config import TriageConfig
from alertloom.operators import attack, intel, report, score
from alertloom.operators.dedup import dedup, staged_with_time, without_dedup
from alertloom.operators.ioc import ioc_table, with_extraction
from alertloom.operators.materialize import staged
from alertloom.operators.normalize import normalize
from alertloom.operators.validate import project_alert, require_valid, with_reason
from alertloom.sources.alerts import read_alert_array
from alertloom.sources.assets import read_assets
from alertloom.sources.attack_bundle import load_index
from alertloom.sources.ingest import read_blobs, read_records, reject_empty
from alertloom.schemas import PARSED


@dataclass(frozen=True)
class TriageResult:
    """``triaged``: one row per group. ``members``: which alerts each group holds (null without
    dedup). ``summary``: ordered lines. ``rejected``: rows that did not become alerts.
    ``lookups``: indicators nobody has a fresh reputation for."""

    triaged: DataFrame
    summary: DataFrame
    members: DataFrame | None
    rejected: DataFrame | None
    lookups: DataFrame | None


def score_first(
    first: DataFrame, cfg: TriageConfig, assets: DataFrame | None, results: DataFrame | None
) -> DataFrame:
    """Score and tier groups' first alerts. Verdicts come from ``results`` (the long table of
    attached reputations) or, without it, from a nested ``enrichment`` column."""
    if results is not None:
        rated = score.with_long_confidence(first, results, cfg)
    elif "enrichment" in first.columns:
        rated = score.with_nested_confidence(first, cfg)
    else:
        rated = first.withColumns(score.no_confidence())
    return score.score_alerts(rated, assets, cfg)


def run(
    parsed: DataFrame,
    cfg: TriageConfig,
    *,
    assets: DataFrame | None = None,
    reputations: DataFrame | None = None,
    as_of: dt.datetime | Column | None = None,
    index: DataFrame | None = None,
    nested: bool = False,
    validate: bool = True,
    strict: bool = False,
) -> TriageResult:
    """Normalised records to ranked incidents. ``validate=False`` takes bad records as they are,
    ``strict`` fails on the first.

    Groups form before tagging and enrichment: neither changes what dedup reads, and only a
    group's first alert is tagged, enriched and scored. So both run on the survivors.

    Records are parsed once and written with their times. Grouping reads the narrow columns of that
    table; whole alerts are read again only where they lead a group.
    """
    if strict:
        parsed = require_valid(parsed)
    checked = with_reason(parsed) if validate else parsed.withColumn("reason", F.lit(None).cast("string"))
    checked = staged_with_time(checked, cfg)
    alerts = checked.filter("reason is null").select("seq", *[f.name for f in PARSED.fields], "ts_us", "ts_zone")
    rejected = checked.filter("reason is not null").drop("ts_us", "ts_zone")

    grouped = dedup(alerts, cfg)
    # Read by every output below.
    first = staged(attack.tag(grouped.representatives(), cfg, index))
    iocs = staged(ioc_table(first))
    if reputations is None:
        known = intel.no_reputations(parsed.sparkSession)
    else:
        known = intel.fresh(reputations, as_of, cfg) if as_of is not None else intel.latest(reputations)
    results = intel.attach(iocs, known, cfg)
    if nested:
        first = intel.nest(with_extraction(first), results)
    triaged = score_first(first, cfg, assets, results)
    return TriageResult(
        triaged=triaged,
        summary=report.summary_lines(triaged),
        members=grouped.members(),
        rejected=rejected,
        lookups=intel.lookup_requests(iocs, known),
    )


def analyze(
    spark: SparkSession,
    paths: str | list[str],
    cfg: TriageConfig | None = None,
    *,
    mode: str = "auto",
    assets_path: str | None = None,
    bundle_path: str | None = None,
    bundle_as_of: float | None = None,
    reputations: DataFrame | None = None,
    as_of: dt.datetime | Column | None = None,
    nested: bool = False,
    validate: bool = True,
    strict: bool = False,
) -> TriageResult:
    """Log files to ranked incidents."""
    cfg = cfg or TriageConfig()
    result = run(
        normalize(read_records(spark, paths, mode)),
        cfg,
        assets=read_assets(spark, assets_path) if assets_path else None,
        reputations=reputations,
        as_of=as_of,
        index=load_index(spark, bundle_path, bundle_as_of, cfg),
        nested=nested,
        validate=validate,
        strict=strict,
    )
    if mode != "auto":
        return result
    empty = reject_empty(read_blobs(spark, paths))[1]
    rejected = result.rejected.unionByName(
        empty.withColumnRenamed("reject", "reason"), allowMissingColumns=True
    )
    return TriageResult(result.triaged, result.summary, result.members, rejected, result.lookups)


def triage_only(
    alerts: DataFrame,
    cfg: TriageConfig,
    *,
    assets: DataFrame | None = None,
    reputations: DataFrame | None = None,
    as_of: dt.datetime | Column | None = None,
    use_dedup: bool = True,
) -> TriageResult:
    """Already normalised alerts, neither validated nor tagged. With ``reputations`` they are
    enriched first, else whatever enrichment they carry counts."""
    ready = alerts.withColumn("severity", F.coalesce("severity", F.lit(5))).withColumn(
        "signature", F.coalesce("signature", F.lit(""))
    )
    grouped = dedup(ready, cfg) if use_dedup else None
    first = grouped.representatives() if grouped else without_dedup(ready)
    results = lookups = None
    if reputations is not None:
        known = intel.fresh(reputations, as_of, cfg) if as_of is not None else intel.latest(reputations)
        iocs = staged(ioc_table(first))
        results = intel.attach(iocs, known, cfg)
        lookups = intel.lookup_requests(iocs, known)
    triaged = score_first(first, cfg, assets, results)
    return TriageResult(
        triaged=triaged,
        summary=report.summary_lines(triaged),
        members=grouped.members() if grouped else None,
        rejected=None,
        lookups=lookups,
    )


def triage_file(spark: SparkSession, path: str, cfg: TriageConfig | None = None, **options) -> TriageResult:
    return triage_only(project_alert(read_alert_array(spark, path)), cfg or TriageConfig(), **options)
