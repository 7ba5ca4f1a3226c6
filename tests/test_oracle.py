"""Every query with an SQL counterpart gives the same rows on the small tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

# Each is checked by the driver at a larger scale; here a spread over all operators.
NAMES = [
    "route_records", "files_to_alerts", "cef_alerts", "syslog_alerts", "cef_extension", "quarantine", "address_validity",
    "tagged_alerts", "index_tagged_alerts", "text_addresses", "text_hashes", "alert_indicators", "hash_reputations",
    "ip_reputations", "reputation_upsert", "lookup_requests", "attached_reputations", "event_times", "gap_islands_by_pair",
    "dedup_fuzzy", "dedup_without_addresses", "related_ids", "confidence", "fresh_triage", "triage_given_alerts",
    "dedup_unordered", "dedup_mixed_times", "dedup_many_signatures", "jsonl_alerts", "pipeline_rejects", "pipeline_members",
    "pipeline_lookups", "unvalidated_triage", "asset_points", "full_triage", "summary_ranked", "summary_text", "signature_matches", "analyze_files",
    "empty_summary", "summary_lines", "read_alert_array", "stream_normalize", "stream_dedup_exact", "stream_dedup_fuzzy", "stream_reputation_join",
]


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return round(value, 6) if isinstance(value, float) else value


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(NAMES) <= set(oracles)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf}/{file}'")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert columns == sorted(names)
    assert ordered(got) == ordered(want)
