import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from alertloom.config import TriageConfig
from alertloom.functions.indicators import extract_iocs, hash_type
from alertloom.operators import intel, report, score
from alertloom.operators.attack import map_technique, match_index, tag, technique_index
from alertloom.operators.ioc import distinct_iocs, ioc_table
from alertloom.plans.pipeline import analyze, triage_file, triage_only
from alertloom.schemas import PROVIDER_REPORT
from alertloom.sources.alerts import write_results, write_summary
from alertloom.sources.assets import read_assets
from alertloom.sources.attack_bundle import load_index, read_bundle

CFG = TriageConfig()
NOW = dt.datetime(2026, 1, 1, 12)

BATCH = [
    {
        "timestamp": "2025-01-01T10:00:00Z", "src_ip": "10.0.0.12", "dest_ip": "192.168.1.20",
        "signature": "Suspicious PowerShell Execution", "severity": 8,
        "message": "Encoded PowerShell command executed on endpoint",
    },
    {
        "timestamp": "2025-01-01T10:05:00Z", "src_ip": "192.168.1.5", "dest_ip": "10.0.0.20",
        "signature": "Port Scan Detected", "severity": 4,
        "message": "Multiple connection attempts across destination ports",
    },
    {
        "timestamp": "2025-01-01T10:10:00Z", "src_ip": "203.0.113.5", "dest_ip": "10.0.0.12",
        "signature": "SSH Brute Force Login Attempt", "severity": 9,
        "message": "Multiple failed SSH login attempts for admin account",
    },
]


def ids(rows):
    return [(r.signature, r.priority_score, r.priority_tier, [m.technique_id for m in r.mitre]) for r in rows]


def text_of(result):
    return report.summary_text(result.summary).first().summary


def test_json_batch_end_to_end(spark, tmp_path):
    (tmp_path / "alerts.json").write_text(json.dumps(BATCH))
    result = analyze(spark, str(tmp_path / "alerts.json"), CFG, nested=True)
    ranked = score.in_priority_order(result.triaged).collect()
    assert ids(ranked) == [
        ("SSH Brute Force Login Attempt", 59, "P2", ["T1110"]),
        ("Suspicious PowerShell Execution", 48, "P3", []),
        ("Port Scan Detected", 29, "P4", ["T1046"]),
    ]
    assert ranked[0].enrichment.dest_ip.verdict == "private/internal"
    assert ranked[0].enrichment.src_ip.verdict == "unknown"
    assert ranked[0].threat_intelligence.result_count == 2
    assert text_of(result) == (
        "Incident batch: 3 alerts after dedup.\n\n1 P2 (high) alert(s):\n"
        "  - [59] SSH Brute Force Login Attempt src=203.0.113.5 dest=10.0.0.12\n" + report.CLOSING_NOTE
    )
    assert [tuple(r) for r in report.tier_counts(result.triaged).collect()] == [
        ("P1", 0), ("P2", 1), ("P3", 1), ("P4", 1), ("total", 3),
    ]
    assert report.top_incident(result.triaged).first().mitre_attack == "T1110 — Brute Force"
    compact = [json.loads(r.compact) for r in report.compact_top(result.triaged, 2).orderBy("rank").collect()]
    assert [c["priority_score"] for c in compact] == [59, 48]
    assert compact[0]["enrichment_verdicts"] == {"src_ip": "unknown", "dest_ip": "private/internal"}
    listing = report.triage_listing(result.triaged).collect()
    assert tuple(listing[0]) == ("P2", "59", "SSH Brute Force Login Attempt", "203.0.113.5", "10.0.0.12")
    assert [tuple(r) for r in result.lookups.collect()] == [("ip", "203.0.113.5")]
    assert result.rejected.count() == 0 and result.members.count() == 3
    write_results(result.triaged, str(tmp_path / "out"))
    write_summary(report.summary_text(result.summary), str(tmp_path / "summary"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {r.priority_tier for r in back.select("priority_tier").collect()} == {"P2", "P3", "P4"}


def test_cef_lines_end_to_end(spark, tmp_path):
    (tmp_path / "in.log").write_text(
        "CEF:0|PaloAlto|NGFW|10.1|1001|Brute Force Login Attempt|8|src=203.0.113.5 dst=10.0.0.12 duser=admin msg=Multiple failed SSH logins\n"
        "    CEF:0|PaloAlto|NGFW|10.1|1002|Possible C2 Beacon|7|src=10.0.0.12 dst=198.51.100.9 msg=Periodic beacon to external host\n"
        "CEF:0|bad\n"
    )
    (tmp_path / "assets.json").write_text('{"10.0.0.12": 15}')
    result = analyze(spark, str(tmp_path / "in.log"), CFG, mode="lines", assets_path=str(tmp_path / "assets.json"))
    ranked = score.in_priority_order(result.triaged).collect()
    assert ids(ranked) == [
        ("1001:Brute Force Login Attempt", 68, "P2", ["T1110"]),
        ("1002:Possible C2 Beacon", 62, "P2", ["T1071"]),
    ]
    assert [r.reason for r in result.rejected.collect()] == ["not_cef"]


def test_empty_input(spark, tmp_path):
    (tmp_path / "in.json").write_text(" \n")
    result = analyze(spark, str(tmp_path / "in.json"), CFG)
    assert text_of(result) == report.EMPTY_BATCH
    assert [r.reason for r in result.rejected.collect()] == ["empty_input"]
    assert {r.tier: r.alerts for r in report.tier_counts(result.triaged).collect()}["total"] == 0


def test_triage_file(spark, tmp_path):
    alerts = [
        {"id": "a", "signature": "S", "severity": 10, "src_ip": "1.1.1.1", "timestamp": "2026-01-01T10:00:00"},
        {"id": "b", "signature": "S", "severity": 1, "src_ip": "1.1.1.1", "timestamp": "2026-01-01T10:30:00"},
        {"id": "c", "src_ip": "2.2.2.2"},
        {"id": "d", "signature": "T", "enrichment": {"src_ip": {"ioc": "x", "verdict": "malicious", "providers_used": ["otx"]}}},
    ]
    (tmp_path / "a.json").write_text(json.dumps(alerts))
    result = triage_file(spark, str(tmp_path / "a.json"), CFG)
    got = {r.id: (r.priority_score, r.occurrence_count) for r in result.triaged.collect()}
    assert got == {"a": (63, 2), "c": (30, 1), "d": (30 + 8 + 6, 1)}
    alone = triage_file(spark, str(tmp_path / "a.json"), CFG, use_dedup=False)
    assert {r.id: r.priority_score for r in alone.triaged.collect()} == {"a": 60, "b": 6, "c": 30, "d": 44}
    assert "threat_intelligence" in result.triaged.columns
    (tmp_path / "o.json").write_text('{"id": "a"}')
    with pytest.raises(Exception, match="must be a JSON array"):
        triage_file(spark, str(tmp_path / "o.json"), CFG)


# --- scoring ------------------------------------------------------------------------------


def rep(verdict, providers=("virustotal",)):
    return {"ioc": "x", "verdict": verdict, "providers_used": list(providers)}


def scored(spark, assets=None, **fields):
    from alertloom.schemas import ALERT
    from pyspark.sql import types as T

    row = {"seq": 0, "severity": 5, "occurrence_count": 1, **fields}
    schema = T.StructType([T.StructField("seq", T.LongType()), *ALERT.fields])
    text = spark.createDataFrame([(json.dumps(row),)], "j string")
    alert = text.select(F.from_json("j", schema).alias("a")).select("a.*").withColumn("bucket_seq", F.lit(0))
    table = spark.createDataFrame(assets, "asset string, weight int") if assets else None
    return score.score_alerts(score.with_nested_confidence(alert, CFG), table, CFG).first()


def test_score_cases(spark):
    assert scored(spark, severity=10).priority_score == 60
    base = scored(spark, src_ip="10.0.0.5").priority_score
    assert scored(spark, [("10.0.0.5", 15)], src_ip="10.0.0.5").priority_score == base + 15
    # The same asset on both ends counts twice.
    assert scored(spark, [("h", 7)], src_ip="h", dest_ip="h", source="h").priority_score == base + 21
    top = scored(
        spark, [("1.1.1.1", 50)], severity=10, occurrence_count=20, src_ip="1.1.1.1",
        enrichment={"src_ip": rep("malicious"), "dest_ip": rep("malicious")}, mitre=[{"technique_id": "T1110"}],
    )
    assert (top.priority_score, top.priority_tier) == (100, "P1")
    nested = scored(spark, enrichment={"domains": {"d": rep("malicious")}, "hashes": {"h": rep("malicious")}})
    assert nested.priority_score == base + 4 * 2 * 2 + 6
    assert scored(spark, severity=0, src_ip="a", assets=[("a", -5)]).priority_score == 0
    assert scored(spark, occurrence_count=4).priority_score == base + 9
    assert scored(spark, occurrence_count=9).priority_score == base + 20


def test_confidence(spark):
    def confidence(**slots):
        return scored(spark, enrichment=slots).enrichment_confidence

    c = confidence(src_ip=rep("malicious", ["b"]), dest_ip=rep("malicious", ["a"]), domains={"d": rep("suspicious", ["a"])})
    assert (c.consensus, c.result_count, c.malicious_count, c.suspicious_count) == ("strong", 3, 2, 1)
    assert (c.providers, c.provider_count, c.confidence) == (["a", "b"], 2, 1.0)
    c = confidence(src_ip=rep("unknown", []), dest_ip=rep("private/internal", []))
    assert (c.result_count, c.consensus, c.confidence) == (2, "unknown", 0.0)
    c = confidence(src_ip=rep("malicious"), dest_ip=rep("clean"), ips={"i": rep("clean")})
    assert (c.consensus, c.confidence) == ("mixed", 0.333)
    c = confidence()
    assert (c.result_count, c.provider_count, c.consensus, c.confidence) == (0, 0, "unknown", 0.0)


# --- techniques ---------------------------------------------------------------------------


def test_keyword_rules(spark):
    texts = ["Brute-force? BRUTE FORCE via nmap", "abc2def", None, "nothing", "Exfiltration and C2 callback"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [[m.technique_id for m in r.m] for r in df.select("i", map_technique(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [["T1110", "T1046"], ["T1071"], [], [], ["T1071", "T1041"]]


STIX = {
    "type": "bundle",
    "objects": [
        {"type": "attack-pattern", "name": "Brute Force", "x_mitre_aliases": ["Password Guessing"],
         "external_references": [{"source_name": "x", "external_id": "no"}, {"source_name": "mitre-attack"},
                                 {"source_name": "mitre-attack", "external_id": "T1110"}],
         "kill_chain_phases": [{"kill_chain_name": "other", "phase_name": "no"},
                               {"kill_chain_name": "mitre-attack", "phase_name": "credential-access"}]},
        {"type": "attack-pattern", "name": "Password Spraying",
         "external_references": [{"source_name": "mitre-attack", "external_id": "T1110.003"}]},
        {"type": "attack-pattern", "name": "Revoked Password", "revoked": True,
         "external_references": [{"source_name": "mitre-attack", "external_id": "T1"}]},
        {"type": "attack-pattern", "name": "Old Password", "x_mitre_deprecated": True,
         "external_references": [{"source_name": "mitre-attack", "external_id": "T2"}]},
        {"type": "attack-pattern", "name": "Nameless", "external_references": []},
        {"type": "malware", "name": "Password Stealer",
         "external_references": [{"source_name": "mitre-attack", "external_id": "S1"}]},
    ],
}


def test_technique_index(spark, tmp_path):
    (tmp_path / "bare.json").write_text(json.dumps(STIX))
    (tmp_path / "wrapped.json").write_text(json.dumps({"fetched_at": 1000.0, "bundle": STIX}))
    bare, wrapped = str(tmp_path / "bare.json"), str(tmp_path / "wrapped.json")
    assert read_bundle(spark, bare, None, CFG).count() == 6
    ttl = CFG.attack_bundle_ttl_seconds
    assert load_index(spark, wrapped, 1000.0 + ttl, CFG) is None
    assert load_index(spark, str(tmp_path / "absent.json"), 0.0, CFG) is None
    index = load_index(spark, wrapped, 999.0 + ttl, CFG)
    words = {(r.word, r.technique_id, r.tactic) for r in index.collect()}
    assert words == {
        ("brute", "T1110", "Credential Access"), ("force", "T1110", "Credential Access"),
        ("password", "T1110", "Credential Access"), ("guessing", "T1110", "Credential Access"),
        ("password", "T1110.003", "Unknown"), ("spraying", "T1110.003", "Unknown"),
    }
    alerts = spark.createDataFrame(
        [(0, "PASSWORD reset", "x"), (1, "brute force", None), (2, "none", "here")],
        "seq bigint, signature string, message string",
    )
    tagged = {r.seq: ([m.technique_id for m in r.mitre], r.mitre_source) for r in tag(alerts, CFG, index).collect()}
    assert tagged == {0: (["T1110", "T1110.003"], "stix"), 1: (["T1110"], "stix"), 2: ([], "stix")}
    tagged = {r.seq: ([m.technique_id for m in r.mitre], r.mitre_source) for r in tag(alerts, CFG).collect()}
    assert tagged[1] == (["T1110"], "heuristic") and tagged[0][0] == []
    small = match_index(alerts, index, TriageConfig(hot_key_rows=1))
    assert small.count() == 2
    assert technique_index(read_bundle(spark, bare, None, CFG)).count() == 6


# --- indicators ---------------------------------------------------------------------------

SHA = "0123456789abcdef" * 4


def test_extraction(spark):
    cases = {
        f"Connect evil-example.com {SHA.upper()}": ([], ["evil-example.com"], [SHA]),
        "src=192.168.1.10 contacting Example.com example.COM": (["192.168.1.10"], ["example.com"], []),
        "ends 1.2.3.4. and v1.2.3.4 and 5.6.7.8,5.6.7.8 256.1.1.1": (["5.6.7.8"], [], []),
        "é1.2.3.4 x": ([], [], []),
        "john.doe@mail.example.org file.exe": ([], ["john.doe", "example.org", "file.exe"], []),
        f"{SHA}0 {'f' * 32} {'e' * 40} {'f' * 32}": ([], [], ["e" * 40, "f" * 32]),
        "": ([], [], []),
        None: ([], [], []),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    rows = df.select("i", extract_iocs(F.col("t")).alias("e")).orderBy("i").collect()
    got = [(r.e.ips, r.e.domains, r.e.hashes) for r in rows]
    want = list(cases.values())
    # The part after "@mail." reads as a domain; the address itself does not.
    assert got[:4] == want[:4] and got[5:] == want[5:]
    assert got[4][1] == ["john.doe", "example.org", "file.exe"]
    kinds = {"f" * 32: "md5", " " + "A" * 40 + " ": "sha1", SHA: "sha256", "g" * 32: None, "f" * 33: None}
    df = spark.createDataFrame(list(enumerate(kinds)), "i int, t string")
    assert [r.k for r in df.select("i", hash_type(F.col("t")).alias("k")).orderBy("i").collect()] == list(kinds.values())


def test_ioc_table(spark):
    alerts = spark.createDataFrame(
        [(0, "1.1.1.1", "1.1.1.1", "to 1.1.1.1 and 2.2.2.2 at a.com", f"{SHA} 3.3.3.3"), (1, None, "", None, None)],
        "seq bigint, src_ip string, dest_ip string, message string, raw string",
    )
    got = [(r.slot, r.ioc_type, r.ioc, r.pos) for r in ioc_table(alerts).collect()]
    assert got == [
        ("src_ip", "ip", "1.1.1.1", 0), ("dest_ip", "ip", "1.1.1.1", 0), ("ips", "ip", "2.2.2.2", 0),
        ("ips", "ip", "3.3.3.3", 1), ("domains", "domain", "a.com", 0), ("hashes", "hash", SHA, 0),
    ]
    assert distinct_iocs(ioc_table(alerts)).count() == 5


# --- reputations --------------------------------------------------------------------------


def reports(spark, rows):
    names = PROVIDER_REPORT.names
    full = [tuple({"fetched_at": NOW, **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, PROVIDER_REPORT)


def r(ioc_type, ioc, provider, **kw):
    return {"ioc_type": ioc_type, "ioc": ioc, "provider": provider, **kw}


def test_fuse(spark):
    df = reports(
        spark,
        [
            r("ip", "1.1.1.1", "otx", pulse_count=30),
            r("ip", "1.1.1.1", "abuseipdb", abuse_confidence_score=10),
            r("ip", "1.1.1.1", "virustotal", stats={"malicious": 2, "harmless": 60}),
            r("ip", "2.2.2.2", "abuseipdb", error="HTTP 500"),
            r("ip", "2.2.2.2", "virustotal", stats={"malicious": 9}),
            r("ip", "2.2.2.2", "otx", error="HTTP 429"),
            r("ip", "3.3.3.3", "abuseipdb", error="down"),
            r("ip", "3.3.3.3", "abuseipdb", abuse_confidence_score=20, fetched_at=NOW - dt.timedelta(hours=1)),
            r("domain", "a.com", "virustotal", stats={"malicious": 1}),
            r("domain", "a.com", "abuseipdb", abuse_confidence_score=100),
            r("hash", SHA, "virustotal", stats={"malicious": 3, "undetected": 45}, names=list("abcdefg"), type_description="exe"),
            r("hash", "f" * 32, "virustotal", stats={}),
            r("hash", "e" * 40, "virustotal", error="x"),
            r("hash", "nope", "virustotal", stats={"malicious": 5}),
        ],
    )
    got = {x.ioc: x for x in intel.fuse(df, CFG).collect()}
    assert (got["1.1.1.1"].score, got["1.1.1.1"].verdict) == (50.0, "malicious")
    assert got["1.1.1.1"].providers_used == ["abuseipdb", "virustotal", "otx"]
    # A failed pulse lookup counts as zero, the other failure does not count.
    assert (got["2.2.2.2"].score, got["2.2.2.2"].verdict) == (50.0, "malicious")
    assert (got["3.3.3.3"].score, got["3.3.3.3"].verdict, got["3.3.3.3"].providers_used) == (None, "unknown", ["abuseipdb"])
    assert (got["a.com"].score, got["a.com"].verdict, got["a.com"].providers_used) == (20.0, "suspicious", ["virustotal"])
    assert (got[SHA].score, got[SHA].verdict, got[SHA].type) == (6.2, "malicious", "hash:sha256")
    assert got[SHA].virustotal.names == list("abcde")
    assert (got["f" * 32].score, got["f" * 32].verdict) == (0.0, "clean")
    assert (got["e" * 40].score, got["e" * 40].verdict) == (None, "unknown")
    assert (got["nope"].type, got["nope"].verdict, got["nope"].providers_used) == ("hash:unknown", "unknown", [])
    # Errors only: not kept. Any answer, a zero-scored one included, needs at least one provider.
    kept = {x.ioc for x in intel.upsert(intel.no_reputations(spark), intel.fuse(df, CFG)).collect()}
    assert kept == set(got) - {"3.3.3.3", "e" * 40}


def test_freshness(spark):
    ttl = dt.timedelta(seconds=CFG.reputation_ttl_seconds)
    df = reports(
        spark,
        [
            r("domain", "old.com", "virustotal", fetched_at=NOW - ttl),
            r("domain", "new.com", "virustotal", fetched_at=NOW - ttl + dt.timedelta(microseconds=1)),
            r("domain", "two.com", "virustotal", fetched_at=NOW - ttl * 2, stats={"malicious": 9}),
        ],
    )
    table = intel.fuse(df, CFG)
    newer = intel.fuse(reports(spark, [r("domain", "two.com", "virustotal")]), CFG)
    table = intel.upsert(table, newer)
    fresh = {x.ioc: (x.cached, x.verdict) for x in intel.fresh(table, NOW, CFG).collect()}
    assert fresh == {"new.com": (True, "clean"), "two.com": (True, "clean")}
    iocs = spark.createDataFrame(
        [("domain", d) for d in ("old.com", "new.com", "x.com", "x.com")] + [("ip", "10.1.1.1"), ("ip", "8.8.8.8")],
        "ioc_type string, ioc string",
    )
    wanted = {x.ioc for x in intel.lookup_requests(iocs, intel.fresh(table, NOW, CFG)).collect()}
    assert wanted == {"old.com", "x.com", "8.8.8.8"}


def test_attach_and_nest(spark):
    alerts = spark.createDataFrame(
        [(0, "10.0.0.1", "8.8.8.8", "see a.com and 9.9.9.9", ""), (1, None, None, "quiet", "")],
        "seq bigint, src_ip string, dest_ip string, message string, raw string",
    )
    table = intel.fuse(
        reports(
            spark,
            [
                r("ip", "8.8.8.8", "abuseipdb", abuse_confidence_score=90),
                r("ip", "10.0.0.1", "abuseipdb", abuse_confidence_score=90),
                r("domain", "a.com", "virustotal", stats={"malicious": 1}),
            ],
        ),
        CFG,
    )
    results = intel.attach(ioc_table(alerts), table, CFG)
    got = {x.ioc: (x.verdict, x.note) for x in results.collect()}
    assert got == {
        "10.0.0.1": ("private/internal", intel.NOTE_PRIVATE),
        "8.8.8.8": ("malicious", None),
        "9.9.9.9": ("unknown", intel.NOTE_NO_REPORT),
        "a.com": ("suspicious", None),
    }
    nested = {x.seq: x.enrichment for x in intel.nest(alerts, results).collect()}
    assert nested[1] is None
    assert nested[0].src_ip.verdict == "private/internal" and nested[0].dest_ip.score == 90.0
    assert list(nested[0].ips) == ["9.9.9.9"] and nested[0].hashes is None
    # The long table and the nested form give the same confidence.
    a = score.with_long_confidence(alerts, results, CFG).orderBy("seq").collect()
    b = score.with_nested_confidence(intel.nest(alerts, results), CFG).orderBy("seq").collect()
    assert [(x.enrichment_confidence, x.intel_points) for x in a] == [(x.enrichment_confidence, x.intel_points) for x in b]
    assert a[0].enrichment_confidence.result_count == 4 and a[0].intel_points == 12


def test_assets(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"10.0.0.1": 5, "web": 3}')
    (tmp_path / "b.json").write_text("[1]")
    assert {tuple(x) for x in read_assets(spark, str(tmp_path / "a.json")).collect()} == {("10.0.0.1", 5), ("web", 3)}
    with pytest.raises(Exception, match="JSON object"):
        read_assets(spark, str(tmp_path / "b.json")).collect()
    alerts = spark.createDataFrame([(0, "10.0.0.1", None, "web")], "seq bigint, src_ip string, dest_ip string, source string")
    table = read_assets(spark, str(tmp_path / "a.json"))
    for cfg in (CFG, TriageConfig(hot_key_rows=1)):
        assert score.with_asset_points(alerts, table, cfg).first().asset_points == 8


def test_triage_only_with_reputations(spark):
    alerts = spark.createDataFrame(
        [(0, "a", "S", 5, "8.8.8.8", "2026-01-01T00:00:00"), (1, "b", "S", 5, "8.8.8.8", "2026-01-01T00:30:00")],
        "seq bigint, id string, signature string, severity int, src_ip string, timestamp string",
    ).selectExpr("*", "null as dest_ip", "'' as message", "'' as raw", "'x' as source", "array() as mitre")
    table = intel.fuse(reports(spark, [r("ip", "8.8.8.8", "abuseipdb", abuse_confidence_score=90)]), CFG)
    result = triage_only(alerts, CFG, reputations=table, as_of=NOW)
    row = result.triaged.first()
    assert (row.priority_score, row.occurrence_count) == (30 + 3 + 8 + 6, 2)
    assert result.lookups.count() == 0
