"""ATT&CK technique tagging: keyword rules, or words of a technique catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom.config import TriageConfig
from alertloom.functions.settle import settle
from alertloom.operators.skew import lookup_join
from alertloom.schemas import TECHNIQUE

# Keywords, technique id, technique, tactic.
KEYWORD_RULES = [
    (["brute force", "bruteforce", "password spray", "credential stuffing"],
     "T1110", "Brute Force", "Credential Access"),
    (["mimikatz", "lsass dump", "credential dump"],
     "T1003", "OS Credential Dumping", "Credential Access"),
    (["powershell -enc", "powershell encoded", "encodedcommand"],
     "T1059.001", "PowerShell", "Execution"),
    (["scheduled task", "schtasks", "cron job added"],
     "T1053", "Scheduled Task/Job", "Persistence"),
    (["new admin account", "account created", "user added to administrators"],
     "T1136", "Create Account", "Persistence"),
    (["disable defender", "disable antivirus", "amsi bypass", "edr kill"],
     "T1562.001", "Disable or Modify Tools", "Defense Evasion"),
    (["beacon", "c2", "command and control", "callback"],
     "T1071", "Application Layer Protocol", "Command and Control"),
    (["dns tunneling", "dns exfiltration"],
     "T1071.004", "DNS", "Command and Control"),
    (["port scan", "nmap", "network scan"],
     "T1046", "Network Service Discovery", "Discovery"),
    (["phishing", "malicious attachment", "suspicious email link"],
     "T1566", "Phishing", "Initial Access"),
    (["exploit public-facing", "cve-", "rce attempt", "sqli", "sql injection"],
     "T1190", "Exploit Public-Facing Application", "Initial Access"),
    (["lateral movement", "psexec", "wmiexec", "remote service creation"],
     "T1021", "Remote Services", "Lateral Movement"),
    (["data staged", "archive collected", "rar of exfil"],
     "T1074", "Data Staged", "Collection"),
    (["exfiltration", "data transfer to external", "large outbound upload"],
     "T1041", "Exfiltration Over C2 Channel", "Exfiltration"),
    (["ransomware", "file encrypted", "ransom note"],
     "T1486", "Data Encrypted for Impact", "Impact"),
    (["impossible travel", "geo anomaly login"],
     "T1078", "Valid Accounts", "Defense Evasion"),
    (["malware detected", "trojan", "backdoor"],
     "T1204", "User Execution", "Execution"),
]

TECHNIQUE_LIST = f"array<{TECHNIQUE.simpleString()}>"

# Fixed value: an indexable word.
WORD_PATTERN = r"[a-z0-9]{4,}"


def keyword_rules(spark: SparkSession) -> DataFrame:
    """One row per keyword."""
    rows = [
        (no, keyword, tid, technique, tactic)
        for no, (keywords, tid, technique, tactic) in enumerate(KEYWORD_RULES)
        for keyword in keywords
    ]
    return spark.createDataFrame(
        rows, "rule_no int, keyword string, technique_id string, technique string, tactic string"
    )


def map_technique(text: Column) -> Column:
    """All techniques with a keyword inside the text, in rule order. No join, no shuffle."""
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def rule(keywords, tid, technique, tactic):
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(lowered, F.lit(keyword))
        match = F.struct(
            F.lit(tid).alias("technique_id"), F.lit(technique).alias("technique"), F.lit(tactic).alias("tactic")
        )
        return F.when(hit, match)

    return F.array_compact(F.array(*[rule(*r) for r in KEYWORD_RULES])).cast(TECHNIQUE_LIST)


def haystack() -> Column:
    return F.concat(F.coalesce("signature", F.lit("")), F.lit(" "), F.coalesce("message", F.lit("")))


def tag_with_rules(alerts: DataFrame) -> DataFrame:
    """Adds ``mitre`` (empty where nothing matches) and ``mitre_source``."""
    tagged = settle(alerts.withColumn("mitre", map_technique(haystack())), ["mitre"])
    return tagged.withColumn("mitre_source", F.lit("heuristic"))


def technique_index(objects: DataFrame) -> DataFrame:
    """(word, technique_id, technique, tactic) from ATT&CK objects (one row each)."""
    live = objects.filter(
        (F.col("type") == "attack-pattern")
        & ~F.coalesce("revoked", F.lit(False))
        & ~F.coalesce("x_mitre_deprecated", F.lit(False))
    )
    first_id = F.get(
        F.filter(
            F.coalesce("external_references", F.array()),
            lambda r: (r["source_name"] == "mitre-attack") & r["external_id"].isNotNull(),
        ),
        F.lit(0),
    )["external_id"]
    first_phase = F.get(
        F.filter(
            F.coalesce("kill_chain_phases", F.array()), lambda p: p["kill_chain_name"] == "mitre-attack"
        ),
        F.lit(0),
    )["phase_name"]
    names = F.concat(
        F.array(F.coalesce("name", F.lit(""))),
        F.coalesce("x_mitre_aliases", F.array().cast("array<string>")),
    )
    words = F.regexp_extract_all(F.lower(F.array_join(names, " ")), F.lit(WORD_PATTERN), F.lit(0))
    return (
        live.withColumn("technique_id", first_id)
        .filter("technique_id is not null and technique_id <> ''")
        .select(
            F.explode(F.array_distinct(words)).alias("word"),
            "technique_id",
            F.coalesce("name", "technique_id").alias("technique"),
            F.coalesce(F.initcap(F.replace(first_phase, F.lit("-"), F.lit(" "))), F.lit("Unknown")).alias("tactic"),
        )
        .distinct()
    )


def match_index(alerts: DataFrame, index: DataFrame, cfg: TriageConfig) -> DataFrame:
    """(seq, mitre): one entry per technique sharing a word with the alert, by technique id.

    Words are made distinct inside the row before the explode, and only words found in the index
    reach the last shuffles. Words that very many alerts share are dealt out.
    """
    words = alerts.select(
        "seq",
        F.explode(
            F.array_distinct(F.regexp_extract_all(F.lower(haystack()), F.lit(WORD_PATTERN), F.lit(0)))
        ).alias("word"),
    )
    hits = lookup_join(words, index, ["word"], cfg, how="inner")
    # One entry per technique id even where two catalogue objects share it.
    per_technique = hits.groupBy("seq", "technique_id").agg(
        F.min(F.struct("technique", "tactic")).alias("t")
    )
    return per_technique.groupBy("seq").agg(
        F.array_sort(
            F.collect_list(F.struct("technique_id", F.col("t.technique"), F.col("t.tactic")))
        ).cast(TECHNIQUE_LIST).alias("mitre")
    )


def tag_with_index(alerts: DataFrame, index: DataFrame, cfg: TriageConfig) -> DataFrame:
    matched = match_index(alerts, index, cfg)
    return (
        alerts.join(matched, "seq", "left")
        .withColumn("mitre", F.coalesce("mitre", F.array().cast(TECHNIQUE_LIST)))
        .withColumn("mitre_source", F.lit("stix"))
    )


def tag(alerts: DataFrame, cfg: TriageConfig, index: DataFrame | None = None) -> DataFrame:
    """Catalogue words when an index is at hand, keyword rules when there is none."""
    return tag_with_rules(alerts) if index is None else tag_with_index(alerts, index, cfg)
