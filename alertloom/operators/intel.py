"""Threat intelligence: fuse provider reports, keep them fresh, attach them to alerts.

Reports arrive as a table (PROVIDER_REPORT); nothing here talks to a network.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from alertloom.config import TriageConfig
from alertloom.functions.indicators import hash_type
from alertloom.functions.net import is_private_ip
from alertloom.operators.ioc import distinct_iocs
from alertloom.operators.skew import lookup_join
from alertloom.schemas import REPUTATION

# Providers per indicator type, in reporting order.
PROVIDERS = {
    "ip": ["abuseipdb", "virustotal", "otx"],
    "domain": ["virustotal", "otx"],
    "hash": ["virustotal"],
}

NOTE_PRIVATE = "private address, not looked up"
NOTE_NO_REPORT = "no provider report"
NOTE_BAD_HASH = "not an md5, sha1 or sha256 value"

_REPORT_FIELDS = [
    "error", "abuse_confidence_score", "total_reports", "country", "is_tor", "stats", "pulse_count",
    "names", "type_description",
]
_STRUCTS = ["abuseipdb", "virustotal", "otx"]
REPUTATION_COLUMNS = [f.name for f in REPUTATION.fields if f.name != "ioc"]


def _malicious_votes(stats: Column) -> Column:
    return F.coalesce(stats["malicious"], F.lit(0))


def provider_score(provider: str, report: Column, cfg: TriageConfig) -> Column:
    """A provider's report on the 0..100 scale; null where there is no report or it failed."""
    ok = report["error"].isNull()
    if provider == "abuseipdb":
        score = F.when(ok, F.coalesce(report["abuse_confidence_score"], F.lit(0)))
    elif provider == "virustotal":
        score = F.when(ok, F.least(F.lit(100), _malicious_votes(report["stats"]) * cfg.vt_vote_weight))
    else:
        points = F.least(F.lit(100), F.coalesce(report["pulse_count"], F.lit(0)) * cfg.otx_pulse_weight)
        # A failed pulse lookup counts as zero pulses.
        score = F.when(ok, points)
        if cfg.otx_error_scores_zero:
            score = score.otherwise(F.lit(0))
    return F.when(report.isNotNull(), score.cast("double"))


def verdict_of(score: Column, cfg: TriageConfig) -> Column:
    return (
        F.when(score >= cfg.verdict_malicious, F.lit("malicious"))
        .when(score >= cfg.verdict_suspicious, F.lit("suspicious"))
        .when(score.isNotNull(), F.lit("clean"))
        .otherwise(F.lit("unknown"))
    )


def score_reports(reports: DataFrame, cfg: TriageConfig) -> DataFrame:
    """Adds ``score`` to each provider report."""
    report = F.struct(*_REPORT_FIELDS)
    chain = F
    for provider in _STRUCTS:
        chain = chain.when(F.col("provider") == provider, provider_score(provider, report, cfg))
    return reports.withColumn("score", chain)


def _latest_per_provider(reports: DataFrame) -> DataFrame:
    """One row per indicator with a column per provider: its latest report, or null."""
    rates_type = F.lit(False)
    for ioc_type, providers in PROVIDERS.items():
        rates_type = rates_type | ((F.col("ioc_type") == ioc_type) & F.col("provider").isin(providers))
    order = F.struct(
        F.coalesce("fetched_at", F.lit(dt.datetime(1970, 1, 1))), "abuse_confidence_score", "pulse_count", "error"
    )
    report = F.struct(*_REPORT_FIELDS)

    def latest_of(provider: str) -> Column:
        mine = F.col("provider") == provider
        return F.max_by(F.when(mine, report), F.when(mine, order)).alias(provider)

    return (
        reports.filter(rates_type)
        .groupBy("ioc_type", "ioc")
        .agg(F.max("fetched_at").alias("fetched_at"), *[latest_of(p) for p in _STRUCTS])
    )


def fuse(reports: DataFrame, cfg: TriageConfig) -> DataFrame:
    """One reputation per indicator, all types in one aggregation.

    Addresses and domains get the mean of the provider scores, their verdict by its unrounded
    value; file hashes the share of malicious votes, their verdict by the number of votes.
    """
    is_hash = F.col("ioc_type") == "hash"
    kind = hash_type(F.col("ioc"))
    df = _latest_per_provider(reports).withColumn(
        "type", F.when(is_hash, F.concat(F.lit("hash:"), F.coalesce(kind, F.lit("unknown")))).otherwise(F.col("ioc_type"))
    )
    bad_hash = F.col("type") == "hash:unknown"
    df = df.withColumn("virustotal", F.when(~bad_hash, F.col("virustotal")))

    vt = F.col("virustotal")
    votes = _malicious_votes(vt["stats"])
    cast = F.aggregate(
        F.coalesce(F.map_values(vt["stats"]), F.array().cast("array<int>")), F.lit(0), lambda acc, x: acc + x
    )
    voted = vt.isNotNull() & vt["error"].isNull()
    by_votes = (
        F.when(~voted, F.lit("unknown"))
        .when(votes >= cfg.hash_malicious_vendors, F.lit("malicious"))
        .when(votes >= cfg.hash_suspicious_vendors, F.lit("suspicious"))
        .otherwise(F.lit("clean"))
    )
    share = F.when(voted, F.bround(100 * votes / F.when(cast == 0, 1).otherwise(cast), 1))

    scores = F.array_compact(F.array(*[provider_score(p, F.col(p), cfg) for p in _STRUCTS]))
    total = F.aggregate("scores", F.lit(0.0), lambda acc, x: acc + x)
    df = (
        df.withColumn("scores", scores)
        .withColumn("mean", F.when(F.size("scores") > 0, total / F.size("scores")))
        .withColumn("score", F.when(is_hash, share).otherwise(F.bround("mean", 1)))
        .withColumn("verdict", F.when(is_hash, by_votes).otherwise(verdict_of(F.col("mean"), cfg)))
        .withColumn(
            "providers_used", F.array_compact(F.array(*[F.when(F.col(p).isNotNull(), F.lit(p)) for p in _STRUCTS]))
        )
    )

    def detail(provider: str) -> Column:
        target = REPUTATION[provider].dataType
        fields = {f.name: F.col(provider)[f.name] for f in target.fields}
        if "names" in fields:
            fields["names"] = F.slice(fields["names"], 1, 5)
        struct = F.struct(*[value.alias(name) for name, value in fields.items()])
        return F.when(F.col(provider).isNotNull(), struct).cast(target).alias(provider)

    note = F.when(bad_hash, F.lit(NOTE_BAD_HASH)).when(F.size("providers_used") == 0, F.lit(NOTE_NO_REPORT))
    return df.select(
        "ioc_type", "ioc", "fetched_at", "type", "providers_used", "verdict", "score", note.alias("note"),
        *[detail(p) for p in _STRUCTS], F.lit(False).alias("cached"),
    )


def fuse_ip(reports: DataFrame, cfg: TriageConfig) -> DataFrame:
    return fuse(reports.filter("ioc_type = 'ip'"), cfg)


def fuse_domain(reports: DataFrame, cfg: TriageConfig) -> DataFrame:
    return fuse(reports.filter("ioc_type = 'domain'"), cfg)


def fuse_hash(reports: DataFrame, cfg: TriageConfig) -> DataFrame:
    return fuse(reports.filter("ioc_type = 'hash'"), cfg)


def no_reputations(spark: SparkSession) -> DataFrame:
    fields = [f for f in REPUTATION.fields if f.name != "ioc"]
    key = [T.StructField("ioc_type", T.StringType()), T.StructField("ioc", T.StringType())]
    when = [T.StructField("fetched_at", T.TimestampType())]
    return spark.createDataFrame([], T.StructType(key + when + fields))


# --- freshness ---------------------------------------------------------------------------


def latest(reputations: DataFrame) -> DataFrame:
    """One row per indicator: the newest, and of equally new ones the one with the greatest hash of the whole row."""
    row = F.struct(*reputations.columns)
    newest = F.max_by(row, F.struct("fetched_at", F.xxhash64(F.to_json(row)))).alias("row")
    return reputations.groupBy("ioc_type", "ioc").agg(newest).select("row.*")


def fresh(reputations: DataFrame, as_of: dt.datetime | Column, cfg: TriageConfig) -> DataFrame:
    """Latest reputation per indicator that has not expired at ``as_of``; marked as reused.

    The age test comes first: it prunes the scan and cannot change which row is the latest.
    """
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    alive = now < F.col("fetched_at") + F.expr(f"interval {cfg.reputation_ttl_seconds} seconds")
    return latest(reputations.filter(alive)).withColumn("cached", F.lit(True))


def answered() -> Column:
    """At least one provider gave an answer, or none was asked."""
    any_answer = F.lit(False)
    for p in _STRUCTS:
        any_answer = any_answer | (F.col(p).isNotNull() & F.col(p)["error"].isNull())
    return (F.size("providers_used") == 0) | any_answer


def upsert(reputations: DataFrame, new: DataFrame) -> DataFrame:
    """The table after taking in new results; results made of errors only are not kept."""
    return latest(reputations.unionByName(new.filter(answered())))


def write_snapshot(reputations: DataFrame, path: str) -> None:
    """A new snapshot directory; older ones stay readable for running jobs."""
    reputations.write.mode("errorifexists").parquet(path)


def lookup_requests(iocs: DataFrame, fresh_reputations: DataFrame) -> DataFrame:
    """Indicators to be looked up: distinct, not private, without a fresh reputation."""
    wanted = distinct_iocs(iocs).filter(~((F.col("ioc_type") == "ip") & is_private_ip(F.col("ioc"))))
    return wanted.join(fresh_reputations.select("ioc_type", "ioc"), ["ioc_type", "ioc"], "left_anti")


# --- attach ------------------------------------------------------------------------------


def attach(iocs: DataFrame, reputations: DataFrame, cfg: TriageConfig) -> DataFrame:
    """The long indicator table with reputation columns; ``reputations`` has one row per indicator.

    Private addresses never meet the table, so a stray row for one is ignored.
    """
    private = (F.col("ioc_type") == "ip") & is_private_ip(F.col("ioc"))
    lookup = reputations.filter(~private).select(
        "ioc_type", "ioc", F.struct(*REPUTATION_COLUMNS).alias("rep")
    )
    joined = lookup_join(iocs, lookup, ["ioc_type", "ioc"], cfg).withColumn("private", private)
    kind = F.when(
        F.col("ioc_type") == "hash",
        F.concat(F.lit("hash:"), F.coalesce(hash_type(F.col("ioc")), F.lit("unknown"))),
    ).otherwise(F.col("ioc_type"))
    rep = F.col("rep")
    overrides = {
        "type": F.coalesce(rep["type"], kind),
        "providers_used": F.coalesce(rep["providers_used"], F.array().cast("array<string>")),
        "verdict": F.when(F.col("private"), F.lit("private/internal")).otherwise(
            F.coalesce(rep["verdict"], F.lit("unknown"))
        ),
        "note": F.when(F.col("private"), F.lit(NOTE_PRIVATE))
        .when(rep.isNull(), F.when(kind == "hash:unknown", F.lit(NOTE_BAD_HASH)).otherwise(F.lit(NOTE_NO_REPORT)))
        .otherwise(rep["note"]),
        "cached": F.coalesce(rep["cached"], F.lit(False)),
    }
    return joined.select(
        *iocs.columns, *[overrides.get(c, rep[c]).alias(c) for c in REPUTATION_COLUMNS]
    )


def nest(alerts: DataFrame, results: DataFrame) -> DataFrame:
    """Adds ``enrichment``: per-slot reputations of each alert, all null where it has none."""
    rep = F.struct("ioc", *REPUTATION_COLUMNS).cast(REPUTATION)

    def of_slot(slot: str) -> Column:
        return F.max_by(F.when(F.col("slot") == slot, rep), F.when(F.col("slot") == slot, F.col("pos")))

    def map_of(slot: str) -> Column:
        entry = F.when(F.col("slot") == slot, F.struct(F.col("ioc").alias("key"), rep.alias("value")))
        entries = F.collect_list(entry)
        return F.when(F.size(entries) > 0, F.map_from_entries(entries))

    per_alert = results.groupBy("seq").agg(
        F.struct(
            of_slot("src_ip").alias("src_ip"),
            of_slot("dest_ip").alias("dest_ip"),
            map_of("ips").alias("ips"),
            map_of("domains").alias("domains"),
            map_of("hashes").alias("hashes"),
        ).alias("enrichment")
    )
    return alerts.drop("enrichment").join(per_alert, "seq", "left")
