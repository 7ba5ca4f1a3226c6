"""Named queries over the driver tables, one or more per operator. Outputs are flat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom import fixtures as fx
from alertloom.config import TriageConfig
from alertloom.functions import indicators, net
from alertloom.functions.cef import unescape, with_extension
from alertloom.functions.severity import severity
from alertloom.functions.timestamps import within_window
from alertloom.operators import attack, intel, report, score, validate
from alertloom.operators.dedup import (
    dedup,
    gap_islands,
    match_signatures,
    with_event_time,
    without_dedup,
)
from alertloom.operators.ioc import distinct_iocs, ioc_table, with_extraction
from alertloom.operators.normalize import (
    JSON_KEYS,
    normalize,
    normalize_cef,
    normalize_json,
    normalize_syslog,
    pick,
)
from alertloom.plans import pipeline
from alertloom.sources import alerts as alert_files
from alertloom.sources import assets as asset_files
from alertloom.sources import attack_bundle, ingest
from alertloom.streaming import jobs

CFG = TriageConfig()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PARSED_OUT = ["seq", "id", "timestamp", "source", "signature", "severity", "src_ip", "dest_ip", "user", "message"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _joined(name: str, alias: str | None = None):
    return F.array_join(name, ",").alias(alias or name)


def _technique_ids():
    return F.array_join(F.transform("mitre", lambda m: m["technique_id"]), ",")


# --- sources ------------------------------------------------------------------------------


@query
def scan_files(spark, sf):
    path = fx.write_files(fx.blobs(spark, sf), fx.scratch_path(spark))
    blobs = ingest.read_blobs(spark, path)
    return blobs.select(
        F.col("file_no").cast("bigint").alias("file_no"), F.md5(F.trim(F.rtrim(F.regexp_replace("blob", r"\s+\z", "")))).alias("digest")
    )


@query
def scan_lines(spark, sf):
    path = fx.write_files(fx.blobs(spark, sf, "lines"), fx.scratch_path(spark))
    rows = ingest.route_lines(ingest.read_log_lines(spark, path))
    return rows.select(F.row_number().over(_by("file", "seq")).alias("line_no"), "kind", "record")


def _by(partition: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(partition).orderBy(order)


@query
def explode_json(spark, sf):
    return ingest.json_records(fx.blobs(spark, sf, "json")).select("seq", "record")


@query
def split_lines(spark, sf):
    return ingest.line_records(fx.blobs(spark, sf, "lines")).select("seq", "record")


@query
def route_records(spark, sf):
    return ingest.route_blobs(fx.blobs(spark, sf)).select("seq", "kind", "record")


@query
def load_assets(spark, sf):
    return asset_files.assets_from_text(fx.asset_texts(spark, sf))


def _bundle_path(spark, sf):
    path = fx.scratch_path(spark)
    fx.attack_objects(spark, sf).select(
        F.to_json(F.struct(F.lit(1000.0).alias("fetched_at"), F.struct(F.array(F.struct("*")).alias("objects")).alias("bundle"))).alias("value")
    ).write.text(path)
    return path


@query
def load_attack_bundle(spark, sf):
    # One bundle per line here; a published one is a single multi-line file.
    from alertloom.schemas import STIX_FILE

    lines = spark.read.schema(STIX_FILE).json(_bundle_path(spark, sf))
    fresh = attack_bundle.live_objects(lines, 1000.0 + CFG.attack_bundle_ttl_seconds - 1, CFG)
    stale = attack_bundle.live_objects(lines, 1000.0 + CFG.attack_bundle_ttl_seconds, CFG)
    return fresh.unionByName(stale).select("type", "name", _joined("x_mitre_aliases", "aliases"))


@query
def read_alert_array(spark, sf):
    path = fx.write_files(_normalised_blobs(spark, sf), fx.scratch_path(spark))
    rows = alert_files.read_alert_array(spark, path)
    return rows.select("id", "timestamp", "source", "signature", "severity", "src_ip", "dest_ip", "user", "message", "occurrence_count")


def _normalised_blobs(spark, sf):
    elements = F.array_sort(F.collect_list(F.struct("seq", F.to_json(F.struct(F.col("*"))).alias("j"))))
    return (
        fx.alerts(spark, sf)
        .groupBy(F.expr(f"seq div {fx.BLOB_RECORDS}").alias("file_no"))
        .agg(F.concat(F.lit("["), F.array_join(F.transform(elements, lambda x: x["j"]), ","), F.lit("]")).alias("blob"))
        .select(F.format_string("f%06d", "file_no").alias("file"), "blob")
    )


@query
def reject_empty(spark, sf):
    blobs = fx.records(spark, sf, "cef").select(
        F.concat(F.lit("f"), F.col("seq")).alias("file"),
        F.when(F.col("seq") % 7 == 0, F.lit(" \n\t ")).otherwise(F.col("record")).alias("blob"),
    )
    return ingest.reject_empty(blobs)[1].select("file", "reject")


@query
def write_results(spark, sf):
    path = fx.scratch_path(spark)
    alert_files.write_results(_triaged(spark, sf).select("id", "priority_score", "priority_tier"), path, "parquet")
    return spark.read.parquet(path).select("id", "priority_score", F.col("priority_tier").cast("string").alias("priority_tier"))


# --- normalisation -------------------------------------------------------------------------


@query
def json_alerts(spark, sf):
    return normalize_json(fx.records(spark, sf, "json")).select(*PARSED_OUT)


@query
def json_pick(spark, sf):
    js = fx.alerts(spark, sf).select(
        "seq",
        F.struct(
            F.when(F.col("seq") % 2 == 0, F.lit("")).otherwise(F.col("signature")).alias("signature"),
            F.when(F.col("seq") % 3 == 0, F.col("source")).alias("rule"),
            F.lit(None).cast("string").alias("rule_name"),
            F.when(F.col("seq") % 5 == 0, F.col("user")).alias("sig"),
            F.lit("").alias("category"),
        ).alias("js"),
    )
    return js.select("seq", pick(F.col("js"), JSON_KEYS["signature"], F.lit("unspecified")).alias("signature"))


@query
def cef_alerts(spark, sf):
    return normalize_cef(fx.records(spark, sf, "cef")).select(*PARSED_OUT)


@query
def cef_extension(spark, sf):
    ext = F.expr("concat('junk src=', src_ip, ' msg=', message, ' a = b  dup=1 cs1.label=x dup=', seq, '  ')")
    parsed = with_extension(fx.alerts(spark, sf).select("seq", ext.alias("ext")), F.col("ext"), "m")
    return parsed.select("seq", *[F.col("m")[k].alias(k.replace(".", "_")) for k in ("src", "msg", "dup", "cs1.label")], F.size("m").alias("n_keys"))


@query
def cef_unescape(spark, sf):
    escaped = F.expr(r"concat('p\\=C:\\\\', user, '\\n', seq, '\\x')")
    return fx.alerts(spark, sf).select("seq", F.replace(unescape(escaped), F.lit("\n"), F.lit("<NL>")).alias("value"))


@query
def syslog_alerts(spark, sf):
    return normalize_syslog(
        fx.records(spark, sf, "syslog").withColumn(
            "record", F.when(F.col("seq") % 4 == 0, F.concat(F.lit("oops "), F.substring_index("record", "]: ", -1))).otherwise(F.col("record"))
        )
    ).select(*PARSED_OUT)


@query
def severity_levels(spark, sf):
    words = "array('Informational','info',' LOW ','medium','moderate','High','critical','severe','junk','-4','7.9','12','1e1','')"
    return fx.alerts(spark, sf).select("seq", severity(F.expr(f"element_at({words}, cast(1 + seq % 14 as int))")).alias("severity"))


@query
def address_backfill(spark, sf):
    text = "concat('first ', if(seq % 3 = 0, 'v', ''), src_ip, ' then ', dest_ip, if(seq % 2 = 0, '', ' and 999.1.1.1'))"
    rows = fx.alerts(spark, sf).selectExpr(
        "seq", f"""concat('{{"message":"', {text}, '"', if(seq % 5 = 0, ',"srcip":"8.8.8.8"', ''), '}}') as record"""
    )
    return normalize_json(rows).select("seq", "src_ip", "dest_ip")


@query
def generated_ids(spark, sf):
    return normalize_syslog(fx.records(spark, sf, "syslog")).select("seq", "id", "raw")


@query
def mixed_alerts(spark, sf):
    return normalize(fx.mixed_records(spark, sf)).select(*PARSED_OUT)


@query
def files_to_alerts(spark, sf):
    path = fx.write_files(fx.blobs(spark, sf), fx.scratch_path(spark))
    parsed = normalize(ingest.read_records(spark, path))
    return parsed.select("id", "timestamp", "severity", "src_ip", "dest_ip", "user", "message")


# --- validation ----------------------------------------------------------------------------


def _dirty(spark, sf):
    return (
        fx.alerts(spark, sf)
        .withColumn("id", F.when(F.col("seq") % 11 == 0, F.lit("")).otherwise(F.col("id")))
        .withColumn("signature", F.when(F.col("seq") % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("signature")))
        .withColumn("severity", F.when(F.col("seq") % 17 == 0, F.lit(15)).otherwise(F.col("severity")))
        .withColumn("src_ip", F.when(F.col("seq") % 19 == 0, F.lit("999.1.1.1")).when(F.col("seq") % 5 == 0, F.lit("")).otherwise(F.col("src_ip")))
        .withColumn("dest_ip", F.when(F.col("seq") % 23 == 0, F.lit("fe80::1::2")).when(F.col("seq") % 6 == 0, F.lit("2001:db8::7")).otherwise(F.col("dest_ip")))
        .withColumn("message", F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(F.col("message")))
    )


@query
def valid_alerts(spark, sf):
    return validate.valid_alerts(_dirty(spark, sf)).select("seq", "id", "signature", "severity", "src_ip", "dest_ip")


@query
def quarantine(spark, sf):
    return validate.quarantine(_dirty(spark, sf)).select("seq", "reason")


@query
def strict_validation(spark, sf):
    return validate.require_valid(fx.alerts(spark, sf)).select("seq", "id")


@query
def address_validity(spark, sf):
    text = """case seq % 8 when 0 then src_ip when 1 then '01.2.3.' || seq % 300 when 2 then '1.2.3.' || seq % 300
              when 3 then '::' || seq when 4 then seq % 10 || ':2:3:4:5:6:7:8' when 5 then '1::2::' || seq % 10
              when 6 then '::ffff:1.2.3.' || seq % 300 else 'fe80::1%eth' || seq % 3 end"""
    rows = fx.alerts(spark, sf).selectExpr("seq", f"{text} as ip")
    return rows.select("seq", "ip", net.is_ip(F.col("ip")).cast("int").alias("valid"))


@query
def alert_projection(spark, sf):
    partial = fx.alerts(spark, sf).select("seq", "id", "signature", "severity", F.lit("x").alias("vendor_field"))
    out = validate.project_alert(partial)
    return out.select("seq", "id", "signature", "severity", "source", "raw", "occurrence_count", F.size("mitre").alias("n_mitre"), F.size("related_ids").alias("n_related"))


@query
def quality_metrics(spark, sf):
    return validate.quality_metrics(_dirty(spark, sf))


# --- techniques ----------------------------------------------------------------------------


@query
def keyword_rule_hits(spark, sf):
    """Keywords by number of alerts that contain them: each alert is tested against the fixed list in its own row."""
    texts = fx.alerts(spark, sf).select(F.lower(attack.haystack()).alias("t"))
    every = [(tid, keyword) for keywords, tid, _, _ in attack.KEYWORD_RULES for keyword in keywords]
    rules = F.array(*[F.struct(F.lit(tid).alias("technique_id"), F.lit(k).alias("keyword")) for tid, k in every])
    found = F.filter(rules, lambda r: F.contains(F.col("t"), r.keyword))
    hits = texts.select(F.explode(found).alias("r")).select("r.*")
    return hits.groupBy("technique_id", "keyword").agg(F.count("*").alias("alerts"))


@query
def techniques(spark, sf):
    rows = fx.alerts(spark, sf).withColumn("mitre", attack.map_technique(F.col("signature")))
    return rows.select("seq", _technique_ids().alias("techniques"))


@query
def tagged_alerts(spark, sf):
    rows = attack.tag_with_rules(fx.alerts(spark, sf))
    return rows.select("seq", _technique_ids().alias("techniques"), F.size("mitre").alias("n"), "mitre_source")


@query
def technique_words(spark, sf):
    return attack.technique_index(fx.attack_objects(spark, sf))


@query
def index_tagged_alerts(spark, sf):
    rows = attack.tag(fx.site_alerts(spark, sf), CFG, attack.technique_index(fx.attack_objects(spark, sf)))
    return rows.select("seq", _technique_ids().alias("techniques"), "mitre_source")


@query
def index_fallback(spark, sf):
    index = attack_bundle.load_index(spark, fx.scratch_path(spark), 0.0, CFG)
    return attack.tag(fx.alerts(spark, sf), CFG, index).select("seq", "mitre_source", F.size("mitre").alias("n"))


# --- indicators ----------------------------------------------------------------------------


@query
def text_addresses(spark, sf):
    return fx.texts(spark, sf).select("key", _array_text(indicators.ips(F.col("text")), "ips"))


def _array_text(array, alias):
    return F.array_join(array, ",").alias(alias)


@query
def text_hashes(spark, sf):
    return fx.texts(spark, sf).select("key", _array_text(indicators.hashes(F.col("text")), "hashes"))


@query
def text_domains(spark, sf):
    return fx.texts(spark, sf).select("key", F.explode(indicators.domains(F.col("text"))).alias("domain"))


@query
def alert_domains(spark, sf):
    text = F.concat("message", F.lit(" WWW.Example.org/"), F.col("source"), F.lit(" mail a@b.example"))
    return fx.alerts(spark, sf).select("seq", _array_text(indicators.domains(text), "domains"))


@query
def ioc_extraction(spark, sf):
    rows = with_extraction(fx.alerts(spark, sf).withColumn("raw", F.col("dest_ip")))
    e = F.col("ioc_extraction")
    return rows.select("seq", *[_array_text(e[k], k) for k in ("ips", "domains", "hashes")])


@query
def alert_indicators(spark, sf):
    return ioc_table(fx.alerts(spark, sf)).select("seq", "slot", "ioc_type", "ioc", "pos")


@query
def distinct_indicators(spark, sf):
    return distinct_iocs(ioc_table(fx.alerts(spark, sf)))


@query
def hash_kinds(spark, sf):
    value = F.expr("""case seq % 4 when 0 then ' ' || md5(id) when 1 then sha1(id) when 2 then upper(sha2(id, 256)) else md5(id) || '0' end""")
    return fx.alerts(spark, sf).select("seq", F.coalesce(indicators.hash_type(value), F.lit("none")).alias("kind"))


@query
def private_addresses(spark, sf):
    ip = F.expr("concat(element_at(array('10','172','192','127','11'), cast(1 + seq % 5 as int)), '.', if(seq % 5 = 2, 167 + seq % 3, 14 + seq % 20), '.1.', seq % 260)")
    return fx.alerts(spark, sf).select("seq", net.is_private_ip(ip).cast("int").alias("private"))


# --- intel ---------------------------------------------------------------------------------


@query
def provider_scores(spark, sf):
    return intel.score_reports(fx.provider_reports(spark, sf), CFG).select("ioc_type", "ioc", "provider", "score")


def _flat_reputation(df):
    return df.select("ioc_type", "ioc", "type", _joined("providers_used", "providers"), "verdict", "score")


@query
def verdicts(spark, sf):
    return table_scores(spark, sf).select("seq", "score", intel.verdict_of(F.col("score"), CFG).alias("verdict"))


def table_scores(spark, sf):
    return fx.table(spark, sf, "events").selectExpr("event_id as seq", "if(event_id % 9 = 0, null, cast(event_id % 101 as double)) as score")


@query
def ip_reputations(spark, sf):
    return _flat_reputation(intel.fuse_ip(fx.provider_reports(spark, sf), CFG))


@query
def domain_reputations(spark, sf):
    return _flat_reputation(intel.fuse_domain(fx.provider_reports(spark, sf), CFG))


@query
def hash_reputations(spark, sf):
    fused = intel.fuse_hash(fx.provider_reports(spark, sf), CFG)
    names = F.coalesce(F.array_join(F.col("virustotal.names"), ","), F.lit("")).alias("names")
    return fused.select("ioc", "type", "verdict", "score", names)


def _reputations(spark, sf):
    return intel.fuse(fx.provider_reports(spark, sf), CFG)


def _attached(spark, sf):
    return intel.attach(ioc_table(fx.alerts(spark, sf)), _reputations(spark, sf), CFG)


@query
def private_short_circuit(spark, sf):
    rows = _attached(spark, sf).filter("slot = 'src_ip'")
    return rows.select("seq", "ioc", (F.col("verdict") == "private/internal").cast("int").alias("private"), F.size("providers_used").alias("n_providers"))


@query
def unknown_reputations(spark, sf):
    rows = _attached(spark, sf).filter("verdict = 'unknown'")
    return rows.groupBy("ioc_type", "ioc").agg(F.count("*").alias("alerts"), F.max(F.col("note").isNotNull().cast("int")).alias("no_report"))


@query
def attached_reputations(spark, sf):
    return _attached(spark, sf).select("seq", "slot", "ioc", "verdict", "score", _joined("providers_used", "providers"))


@query
def nested_enrichment(spark, sf):
    rows = fx.alerts(spark, sf)
    e = F.col("enrichment")
    nested = intel.nest(rows, _attached(spark, sf))
    return nested.select(
        "seq",
        e["src_ip"]["verdict"].alias("src_verdict"),
        e["dest_ip"]["verdict"].alias("dest_verdict"),
        F.element_at(e["domains"], F.expr("concat('host-', split(source, '-')[1] * 0 + substring(user, 5) % 40, '.corp.example')"))["verdict"].alias("domain_verdict"),
        F.size(e["hashes"]).alias("n_hashes"),
    )


@query
def fresh_reputations(spark, sf):
    return intel.fresh(_reputations(spark, sf), fx.as_of(), CFG).select("ioc_type", "ioc", F.col("cached").cast("int").alias("cached"))


@query
def reputation_upsert(spark, sf):
    old = _reputations(spark, sf).filter("ioc_type <> 'domain'").withColumn("verdict", F.lit("old")).withColumn("fetched_at", F.lit("2024-01-31 00:10:00").cast("timestamp"))
    return intel.upsert(old, _reputations(spark, sf)).select("ioc_type", "ioc", "verdict")


@query
def lookup_requests(spark, sf):
    fresh = intel.fresh(_reputations(spark, sf), fx.as_of(), CFG)
    return intel.lookup_requests(ioc_table(fx.alerts(spark, sf)), fresh)


# --- dedup ---------------------------------------------------------------------------------


@query
def event_times(spark, sf):
    rows = fx.alerts(spark, sf)
    shaped = rows.withColumn(
        "timestamp",
        F.expr(
            """case seq % 6 when 0 then timestamp when 1 then replace(substring(timestamp, 1, 19), 'T', ' ')
               when 2 then concat(substring(timestamp, 1, 19), '+02:00') when 3 then substring(timestamp, 1, 10)
               when 4 then '' else concat('at ', seq, ' o clock, never') end"""
        ),
    )
    return with_event_time(shaped, CFG).select("seq", "ts_us", "ts_zone")


@query
def window_test(spark, sf):
    rows = with_event_time(fx.alerts(spark, sf), CFG)
    a, zone = F.col("ts_us"), F.col("ts_zone")
    other = F.when(F.col("seq") % 7 == 0, F.lit(None)).otherwise(a + (F.col("seq") % 5 - 2) * 1_800_000_000)
    other_zone = F.when(F.col("seq") % 7 == 0, 0).when(F.col("seq") % 4 == 0, 1).otherwise(zone)
    return rows.select("seq", within_window(a, zone, other, other_zone, CFG).cast("int").alias("within"))


@query
def gap_islands_by_pair(spark, sf):
    return gap_islands(fx.alerts(spark, sf), CFG).select("seq", "src_ip", "dest_ip", "island")


@query
def dedup_exact(spark, sf):
    return dedup(fx.alerts(spark, sf), CFG, fuzzy=False).groups


@query
def dedup_fuzzy(spark, sf):
    return dedup(fx.alerts(spark, sf), CFG).groups


@query
def dedup_unordered(spark, sf):
    """Alerts taken in an order that has little to do with time."""
    shuffled = fx.alerts(spark, sf).withColumn("seq", F.expr("(seq % 7) * 1000000000 + seq"))
    return dedup(shuffled, CFG).members().select("group_seq", "seq")


@query
def dedup_mixed_times(spark, sf):
    """Times with and without a zone, missing ones, and pairs of which one address is missing."""
    rows = fx.alerts(spark, sf).withColumns(
        {
            "timestamp": F.expr("case seq % 6 when 3 then substring(timestamp, 1, 26) when 4 then null else timestamp end"),
            "dest_ip": F.expr("if(seq % 5 = 0, null, dest_ip)"),
        }
    )
    return dedup(rows, CFG).groups


@query
def dedup_many_signatures(spark, sf):
    """One address pair, and a signature of its own for every twentieth user and rule."""
    rows = fx.alerts(spark, sf).withColumns(
        {
            "signature": F.expr("concat(md5(concat(cast(substring(user, 5) as int) % 20, '-', signature)), if(seq % 2 = 0, '!', '?'))"),
            "src_ip": F.lit("10.0.0.1"),
            "dest_ip": F.lit(None).cast("string"),
        }
    )
    return dedup(rows, CFG).groups


@query
def dedup_time_order(spark, sf):
    shuffled = fx.alerts(spark, sf).withColumn("seq", F.expr("(seq % 7) * 1000000000 + seq"))
    groups = dedup(shuffled, TriageConfig(dedup_order="time")).groups
    return groups.select("group_seq", "occurrence_count", "first_seen", "last_seen")


@query
def dedup_without_addresses(spark, sf):
    """One address pair for all alerts, without addresses."""
    bare = fx.alerts(spark, sf).withColumn("src_ip", F.lit(None).cast("string")).withColumn("dest_ip", F.lit(None).cast("string"))
    return dedup(bare, CFG).groups


@query
def dedup_members(spark, sf):
    return dedup(fx.alerts(spark, sf), CFG).members()


@query
def related_ids(spark, sf):
    cfg = TriageConfig(member_part_rows=1 << 40)
    return dedup(fx.alerts(spark, sf), cfg).related_ids().select("group_seq", _joined("related_ids"))


@query
def signature_matches(spark, sf):
    result = dedup(fx.alerts(spark, sf), CFG)
    rows = fx.alerts(spark, sf).select("seq", "signature")
    leaders = rows.select(F.col("seq").alias("group_seq"), F.col("signature").alias("group_signature"))
    pairs = result.members().select("group_seq", "seq").join(rows, "seq").join(leaders, "group_seq")
    return match_signatures(pairs, CFG).select("group_signature", "signature", F.round("ratio", 6).alias("ratio"), F.col("match").cast("int").alias("match"))


@query
def representatives(spark, sf):
    rows = dedup(fx.alerts(spark, sf), CFG).representatives()
    return rows.select("seq", "id", "signature", "severity", "src_ip", "dest_ip", "occurrence_count", "first_seen", "last_seen", "bucket_seq")


@query
def no_dedup(spark, sf):
    return without_dedup(fx.alerts(spark, sf)).select("seq", "occurrence_count")


# --- scoring -------------------------------------------------------------------------------


@query
def enrichment_verdicts(spark, sf):
    nested = intel.nest(fx.alerts(spark, sf).select("seq"), _attached(spark, sf))
    return nested.select("seq", F.explode(score.enrichment_results(F.col("enrichment"))).alias("r")).groupBy("seq").agg(
        F.count("*").alias("results"), F.count_if(F.col("r.verdict") == "malicious").alias("malicious")
    )


@query
def confidence(spark, sf):
    rows = score.confidence_table(_attached(spark, sf), CFG)
    c = F.col("enrichment_confidence")
    return rows.select(
        "seq", c["result_count"].alias("result_count"), c["provider_count"].alias("provider_count"),
        F.array_join(c["providers"], ",").alias("providers"), c["malicious_count"].alias("malicious_count"),
        c["suspicious_count"].alias("suspicious_count"), c["consensus"].alias("consensus"),
        c["confidence"].alias("confidence"), F.col("intel_points").cast("bigint").alias("intel_points"),
    )


@query
def asset_points(spark, sf):
    return score.with_asset_points(fx.alerts(spark, sf), fx.assets(spark, sf), CFG).select("seq", "asset_points")


def _scored(spark, sf):
    tagged = attack.tag_with_rules(without_dedup(fx.alerts(spark, sf)))
    rated = score.with_long_confidence(tagged, _attached(spark, sf), CFG)
    return score.score_alerts(rated, fx.assets(spark, sf), CFG)


@query
def scores(spark, sf):
    return _scored(spark, sf).select("seq", "priority_score")


@query
def tiers(spark, sf):
    return _scored(spark, sf).select("seq", "priority_tier")


@query
def threat_intelligence(spark, sf):
    t = F.col("threat_intelligence")
    return _scored(spark, sf).select("seq", t["verdict"].alias("verdict"), t["consensus"].alias("consensus"), t["confidence"].alias("confidence"))


def _run(spark, sf, records=None, **options):
    parsed = normalize_json(fx.records(spark, sf, "json")) if records is None else records
    return pipeline.run(parsed, CFG, assets=fx.assets(spark, sf), reputations=_reputations(spark, sf), **options)


def _triaged(spark, sf):
    return _run(spark, sf).triaged


@query
def priority_order(spark, sf):
    """Rank by the triage order within each tier."""
    from pyspark.sql import Window

    per_tier = Window.partitionBy("priority_tier").orderBy(*score.order_keys())
    return _triaged(spark, sf).select("id", "priority_tier", F.row_number().over(per_tier).alias("rank"))


TRIAGE_OUT = ["id", "priority_score", "priority_tier", "occurrence_count", "first_seen", "last_seen"]


@query
def full_triage(spark, sf):
    return _triaged(spark, sf).select(*TRIAGE_OUT, _technique_ids().alias("techniques"), F.col("threat_intelligence.verdict").alias("verdict"))


@query
def fresh_triage(spark, sf):
    """With reputations that have to be fresh."""
    return _run(spark, sf, as_of=fx.as_of()).triaged.select(*TRIAGE_OUT)


@query
def triage_given_alerts(spark, sf):
    """Alerts as they are: no validation, no tagging, reputations on request."""
    given = fx.alerts(spark, sf).withColumn("severity", F.when(F.col("seq") % 10 > 0, F.col("severity")))
    result = pipeline.triage_only(given, CFG, assets=fx.assets(spark, sf), reputations=_reputations(spark, sf))
    return result.triaged.select(*TRIAGE_OUT)


@query
def analyze_files(spark, sf):
    path = fx.write_files(fx.blobs(spark, sf), fx.scratch_path(spark))
    result = pipeline.analyze(spark, path, CFG, reputations=_reputations(spark, sf))
    return result.triaged.select("id", "signature", "priority_score", "priority_tier", "occurrence_count")


@query
def jsonl_alerts(spark, sf):
    """One JSON object per line, in splittable files."""
    path = fx.scratch_path(spark)
    fx.records(spark, sf, "json").select(F.format_string("f%04d", F.expr("seq div 2000")).alias("file"), "record").write.partitionBy("file").text(path)
    parsed = normalize(ingest.read_records(spark, path, "jsonl"))
    own = ["id", "timestamp", "source", "signature", "severity", "src_ip", "dest_ip", "user", "message"]
    return parsed.groupBy(*own).agg(F.count_distinct("seq").alias("n_seq"))


@query
def pipeline_rejects(spark, sf):
    """What the whole run turns away."""
    return pipeline.run(_dirty(spark, sf), CFG).rejected.select("seq", "reason")


@query
def pipeline_members(spark, sf):
    return _run(spark, sf).members


@query
def pipeline_lookups(spark, sf):
    """Indicators of the groups' first alerts that nobody has a fresh reputation for."""
    return _run(spark, sf, as_of=fx.as_of()).lookups


@query
def unvalidated_triage(spark, sf):
    """Without validation bad alerts are grouped and scored like others."""
    groups = pipeline.run(_dirty(spark, sf), CFG, validate=False)
    return groups.members.groupBy().agg(F.count("*").alias("alerts")).withColumn("rejected", F.lit(groups.rejected.count()))


# --- reports -------------------------------------------------------------------------------


@query
def tier_counts(spark, sf):
    return report.tier_counts(_triaged(spark, sf))


@query
def top_incident(spark, sf):
    return report.top_incident(_triaged(spark, sf))


@query
def summary_lines(spark, sf):
    lines = report.summary_lines(_triaged(spark, sf))
    return lines.select("section", F.replace("line", F.lit("\n"), F.lit("")).alias("line"))


@query
def summary_ranked(spark, sf):
    """Every line of the summary with its number."""
    lines = report.ranked_lines(report.summary_lines(_triaged(spark, sf)))
    return lines.select("line_no", "section", F.replace("line", F.lit("\n"), F.lit("")).alias("line"))


@query
def summary_text(spark, sf):
    text = report.summary_text(report.summary_lines(_triaged(spark, sf)), part_lines=50)
    return text.select("part", F.length("summary").alias("n_chars"), F.size(F.split("summary", "\n")).alias("n_lines"))


@query
def empty_summary(spark, sf):
    nothing = _triaged(spark, sf).filter("priority_score > 100")
    return report.summary_text(report.summary_lines(nothing)).select("summary")


@query
def compact_top(spark, sf):
    rows = report.compact_top(_run(spark, sf, nested=True).triaged)
    j = lambda k: F.get_json_object("compact", f"$.{k}")
    return rows.select("rank", j("id").alias("id"), j("priority_score").cast("int").alias("priority_score"), j("enrichment_verdicts.dest_ip").alias("dest_verdict"), F.length(j("message")).alias("n_message"))


@query
def triage_listing(spark, sf):
    return report.triage_listing(_triaged(spark, sf))


# --- streams -------------------------------------------------------------------------------


@query
def stream_normalize(spark, sf):
    """Numbers and ids are hashes of places: all different, equal ones for no two lines."""
    path = fx.write_files(fx.blobs(spark, sf, "lines"), fx.scratch_path(spark))
    rows = jobs.batch_of(jobs.normalized_stream(jobs.read_lines(spark, path)), fx.scratch_path(spark))
    keyed = rows.groupBy("timestamp", "source", "severity", "src_ip", "dest_ip", "message").agg(
        F.count_distinct("seq").alias("n_seq"), F.count_distinct("id").alias("n_id")
    )
    return keyed


@query
def stream_dedup_exact(spark, sf):
    stream = jobs.exact_dedup_stream(jobs.read_alerts(spark, _alert_files(spark, sf)), CFG, delay="10 minutes")
    groups = jobs.all_groups(stream, fx.scratch_path(spark))
    return groups.select("group_seq", "src_ip", "dest_ip", "signature", "occurrence_count", "first_seen", "last_seen")


@query
def stream_dedup_fuzzy(spark, sf):
    stream = jobs.fuzzy_dedup_stream(jobs.read_alerts(spark, _alert_files(spark, sf)), CFG, delay="10 minutes")
    groups = jobs.all_groups(stream, fx.scratch_path(spark))
    return groups.select("group_seq", "occurrence_count", "first_seen", "last_seen")


@query
def stream_reputation_join(spark, sf):
    path = _alert_files(spark, sf)
    snapshot, folder = fx.scratch_path(spark), fx.scratch_path(spark)
    intel.write_snapshot(_reputations(spark, sf), snapshot)
    jobs.enrich_stream(jobs.read_alerts(spark, path), snapshot, CFG, folder, as_of=fx.as_of()).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("seq", "slot", "ioc", "verdict", "score")


def _alert_files(spark, sf):
    path = fx.scratch_path(spark)
    fx.alerts(spark, sf).repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(path)
    return path
