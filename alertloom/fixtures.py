"""Alert batches, log text and provider reports derived from the driver tables by expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.operators.materialize import ensure_checkpoint_dir

BLOB_RECORDS = 500
#: Spark numbers the files that a task writes into a folder with three digits; their order is that of their names up to 1000.
FOLDER_FILES = 100
AS_OF = "2024-01-31 01:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table is a single file and would be a single task."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= tasks else df.repartition(tasks, key)


def scratch_path(spark: SparkSession) -> str:
    """A fresh folder below the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """One alert per event: public and private addresses, hosts, hashes, two spellings of one rule.
    A third of all alerts concern one address pair."""
    return spread(table(spark, sf, "events"), "event_id").selectExpr(
        "event_id as seq",
        "cast(event_id as string) as id",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") as timestamp",
        "concat('sensor-', user_id % 5) as source",
        """case event_type
             when 'error' then if(event_id % 2 = 0, 'SSH Brute-Force Login Attempt', 'SSH Brute Force Login Attempt')
             when 'click' then 'Port Scan Detected'
             when 'view' then 'Possible C2 Beacon'
             when 'purchase' then 'Large Outbound Upload'
             else 'New Admin Account' end as signature""",
        "cast(least(10, floor(value / 10)) as int) as severity",
        """if(event_id % 3 = 0, '10.0.0.7', concat(if(user_id % 5 = 0, '198.51.100.', '10.0.0.'), user_id % 250)) as src_ip""",
        "concat('203.0.113.', if(event_id % 3 = 0, 7, event_id % 32)) as dest_ip",
        "concat('user', user_id) as user",
        """concat('seen via host-', user_id % 40, '.corp.example for 192.0.2.', event_id % 200,
                  ' file ', md5(cast(event_id % 300 as string))) as message""",
        "'' as raw",
    )


def alert_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The alerts as pieces for log text."""
    return alerts(spark, sf).drop("raw")


JSON_TEXT = """concat('{"alert_id":"', id, '","time":"', timestamp, '","product":"', source, '","rule":"',
    signature, '","sev":', severity, ',"source_ip":"', src_ip, '","dstip":"', dest_ip, '","username":"', user,
    '","msg":"', message, '"}')"""
CEF_TEXT = """concat('CEF:0|Acme|', source, '|1.0|', seq % 7, '|', signature, '|', severity, '|externalId=', id,
    ' rt=', timestamp, ' src=', src_ip, ' dst=', dest_ip, ' duser=', user, ' msg=', message)"""
SYSLOG_TEXT = """concat('Jan ', 1 + seq % 28, ' 10:', lpad(cast(seq % 60 as string), 2, '0'), ':00 ', source,
    ' proc-', seq % 9, '[', seq, ']: from ', src_ip, ' to ', dest_ip, ' ', message)"""


def records(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """(seq, record) in one log format."""
    text = {"json": JSON_TEXT, "cef": CEF_TEXT, "syslog": SYSLOG_TEXT}[kind]
    return alert_fields(spark, sf).selectExpr("seq", f"{text} as record")


def mixed_records(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, kind, record) with the format changing from alert to alert."""
    kind = "case seq % 3 when 0 then 'json' when 1 then 'cef' else 'syslog' end"
    text = f"case seq % 3 when 0 then {JSON_TEXT} when 1 then {CEF_TEXT} else {SYSLOG_TEXT} end"
    return alert_fields(spark, sf).selectExpr("seq", f"{kind} as kind", f"{text} as record")


def blobs(spark: SparkSession, sf: str, kinds: str = "mixed") -> DataFrame:
    """(file, file_no, blob): files of BLOB_RECORDS alerts each; JSON arrays, or lines with blank
    lines and indentation between them."""
    number = F.expr(f"seq div {BLOB_RECORDS}")
    pick = {"json": "0", "lines": "1 + file_no % 2", "mixed": "file_no % 3"}[kinds]
    texts = alert_fields(spark, sf).withColumn("file_no", number).selectExpr(
        "file_no",
        "seq",
        f"case {pick} when 0 then {JSON_TEXT} when 1 then {CEF_TEXT} else {SYSLOG_TEXT} end as text",
    )
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    parts = F.transform(ordered, lambda x: x["text"])
    is_json = F.expr(pick) == 0
    return texts.groupBy("file_no").agg(parts.alias("parts")).select(
        F.format_string("f%06d", "file_no").alias("file"),
        "file_no",
        F.when(is_json, F.concat(F.lit(" ["), F.array_join("parts", ",\n "), F.lit("]\n")))
        .otherwise(F.concat(F.lit("\n  "), F.array_join("parts", "\r\n\t\n  ")))
        .alias("blob"),
    )


def write_files(blobs: DataFrame, path: str) -> str:
    """One text file per blob, in the order of their names. FOLDER_FILES of them share a folder: listing takes a task per folder."""
    folder = F.format_string("d%09d", F.floor(F.substring("file", 2, 18).cast("bigint") / FOLDER_FILES))
    placed = blobs.select(folder.alias("folder"), "file", "blob").repartition("folder").sortWithinPartitions("folder", "file")
    placed.select("folder", "blob").write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)
    return path


def _iocs(spark: SparkSession, sf: str) -> DataFrame:
    """(ioc_type, ioc, n): every indicator of the alerts with a number to derive reports from."""
    events = table(spark, sf, "events")
    return (
        events.selectExpr(
            """inline(array(
                named_struct('ioc_type', 'ip', 'ioc', concat('198.51.100.', user_id % 250), 'n', user_id % 250),
                named_struct('ioc_type', 'ip', 'ioc', concat('203.0.113.', event_id % 32), 'n', event_id % 32),
                named_struct('ioc_type', 'ip', 'ioc', concat('192.0.2.', event_id % 200), 'n', event_id % 200),
                named_struct('ioc_type', 'domain', 'ioc', concat('host-', user_id % 40, '.corp.example'), 'n', user_id % 40),
                named_struct('ioc_type', 'hash', 'ioc', md5(cast(event_id % 300 as string)), 'n', event_id % 300)))"""
        )
    ).distinct()


def provider_reports(spark: SparkSession, sf: str) -> DataFrame:
    """PROVIDER_REPORT rows, some of them failures, some indicators without any."""
    return (
        _iocs(spark, sf)
        .withColumn("provider", F.explode(F.array(F.lit("abuseipdb"), F.lit("virustotal"), F.lit("otx"))))
        .filter(
            """case provider when 'abuseipdb' then ioc_type = 'ip' and n % 4 <> 3
                             when 'virustotal' then n % 5 <> 4
                             else ioc_type <> 'hash' and n % 3 <> 2 end"""
        )
        .selectExpr(
            "ioc_type",
            "ioc",
            "provider",
            "if(n % 2 = 0, timestamp'2024-01-31 00:00:00', timestamp'2024-01-31 00:30:00') as fetched_at",
            """case when provider = 'abuseipdb' and n % 11 = 0 then 'HTTP 500'
                    when provider = 'virustotal' and n % 13 = 0 then 'HTTP 503'
                    when provider = 'otx' and n % 17 = 0 then 'HTTP 429' end as error""",
            "if(provider = 'abuseipdb', cast((n * 37) % 101 as int), null) as abuse_confidence_score",
            "if(provider = 'abuseipdb', cast(n as int), null) as total_reports",
            "if(provider = 'abuseipdb', 'NL', null) as country",
            "if(provider = 'abuseipdb', n % 2 = 0, null) as is_tor",
            """if(provider = 'virustotal',
                  map('malicious', cast((n * 7) % 8 as int), 'harmless', 60), null) as stats""",
            "if(provider = 'otx', cast((n * 5) % 14 as int), null) as pulse_count",
            "if(ioc_type = 'hash', transform(sequence(1, 7), i -> concat('name', n, '-', i)), null) as names",
            "if(ioc_type = 'hash', 'exe', null) as type_description",
        )
    )


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def assets(spark: SparkSession, sf: str) -> DataFrame:
    """(asset, weight): some users' addresses, some targets, some sensors."""
    return (
        table(spark, sf, "events")
        .selectExpr(
            """inline(array(
                named_struct('asset', concat('10.0.0.', user_id % 250), 'weight', cast(user_id % 250 % 20 as int)),
                named_struct('asset', concat('203.0.113.', event_id % 32), 'weight', cast(event_id % 32 % 6 as int)),
                named_struct('asset', concat('sensor-', user_id % 5), 'weight', cast(user_id % 5 as int))))"""
        )
        .filter("weight % 2 = 1")
        .distinct()
    )


def asset_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON object per customer row."""
    return table(spark, sf, "customer").selectExpr(
        """concat('{"', c_name, '": ', c_nationkey, ', "seg-', c_custkey, '":', c_custkey % 9, '}') as text"""
    )


def attack_objects(spark: SparkSession, sf: str) -> DataFrame:
    """ATT&CK-like objects, one per supplier."""
    return table(spark, sf, "supplier").selectExpr(
        "if(s_suppkey % 13 = 5, 'malware', 'attack-pattern') as type",
        "s_name as name",
        "s_suppkey % 7 = 0 as revoked",
        "if(s_suppkey % 11 = 0, true, null) as x_mitre_deprecated",
        "array(concat('Site', lpad(cast(s_suppkey as string), 4, '0')), concat('zone', s_nationkey, ' relay')) as x_mitre_aliases",
        """array(named_struct('source_name', 'capec', 'external_id', 'C1'),
                 named_struct('source_name', 'mitre-attack', 'external_id', concat('T', s_suppkey))) as external_references""",
        """array(named_struct('kill_chain_name', if(s_nationkey % 5 = 0, 'other', 'mitre-attack'),
                              'phase_name', if(s_nationkey % 2 = 0, 'credential-access', 'lateral-movement-' || s_nationkey))) as kill_chain_phases""",
    )


def site_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts whose message names sites of the catalogue."""
    return alerts(spark, sf).withColumn(
        "message",
        F.expr("concat('from SITE', lpad(cast(seq % 500 as string), 4, '0'), ' to site', lpad(cast(seq % 70 as string), 4, '0'))"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(key, text) of documents, pages and conversations."""
    return (
        spread(table(spark, sf, "documents"), "doc_id").selectExpr("concat('d', doc_id) as key", "text")
        .unionByName(table(spark, sf, "pages").selectExpr("concat('p', page_id) as key", "concat(url, '\n', html) as text"))
        .unionByName(table(spark, sf, "conversations").selectExpr("concat('c', conv_id, '-', turn) as key", "text"))
    )
