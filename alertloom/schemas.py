"""Fixed output schemas."""

from __future__ import annotations

from pyspark.sql import types as T

TECHNIQUE = T.StructType(
    [
        T.StructField("technique_id", T.StringType()),
        T.StructField("technique", T.StringType()),
        T.StructField("tactic", T.StringType()),
    ]
)

REPUTATION = T.StructType(
    [
        T.StructField("ioc", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("providers_used", T.ArrayType(T.StringType())),
        T.StructField("verdict", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("note", T.StringType()),
        T.StructField(
            "abuseipdb",
            T.StructType(
                [
                    T.StructField("abuse_confidence_score", T.IntegerType()),
                    T.StructField("total_reports", T.IntegerType()),
                    T.StructField("country", T.StringType()),
                    T.StructField("is_tor", T.BooleanType()),
                    T.StructField("error", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "virustotal",
            T.StructType(
                [
                    T.StructField("stats", T.MapType(T.StringType(), T.IntegerType())),
                    T.StructField("names", T.ArrayType(T.StringType())),
                    T.StructField("type_description", T.StringType()),
                    T.StructField("error", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "otx",
            T.StructType(
                [
                    T.StructField("pulse_count", T.IntegerType()),
                    T.StructField("error", T.StringType()),
                ]
            ),
        ),
        T.StructField("cached", T.BooleanType()),
    ]
)

ENRICHMENT = T.StructType(
    [
        T.StructField("src_ip", REPUTATION),
        T.StructField("dest_ip", REPUTATION),
        T.StructField("ips", T.MapType(T.StringType(), REPUTATION)),
        T.StructField("domains", T.MapType(T.StringType(), REPUTATION)),
        T.StructField("hashes", T.MapType(T.StringType(), REPUTATION)),
    ]
)

IOCS = T.StructType(
    [
        T.StructField("ips", T.ArrayType(T.StringType())),
        T.StructField("domains", T.ArrayType(T.StringType())),
        T.StructField("hashes", T.ArrayType(T.StringType())),
    ]
)

# What the parsers produce.
PARSED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

# The full alert record: PARSED plus what later stages fill in.
ALERT = T.StructType(
    PARSED.fields
    + [
        T.StructField("mitre", T.ArrayType(TECHNIQUE)),
        T.StructField("mitre_source", T.StringType()),
        T.StructField("enrichment", ENRICHMENT),
        T.StructField("occurrence_count", T.IntegerType()),
        T.StructField("first_seen", T.StringType()),
        T.StructField("last_seen", T.StringType()),
        T.StructField("related_ids", T.ArrayType(T.StringType())),
        T.StructField("priority_score", T.IntegerType()),
        T.StructField("priority_tier", T.StringType()),
    ]
)

# One provider's reply about one indicator.
PROVIDER_REPORT = T.StructType(
    [
        T.StructField("ioc_type", T.StringType()),
        T.StructField("ioc", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("error", T.StringType()),
        T.StructField("abuse_confidence_score", T.IntegerType()),
        T.StructField("total_reports", T.IntegerType()),
        T.StructField("country", T.StringType()),
        T.StructField("is_tor", T.BooleanType()),
        T.StructField("stats", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("pulse_count", T.IntegerType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("type_description", T.StringType()),
    ]
)

# Objects of an ATT&CK STIX bundle, as far as they are read.
STIX_OBJECT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("revoked", T.BooleanType()),
        T.StructField("x_mitre_deprecated", T.BooleanType()),
        T.StructField("x_mitre_aliases", T.ArrayType(T.StringType())),
        T.StructField(
            "external_references",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("source_name", T.StringType()),
                        T.StructField("external_id", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "kill_chain_phases",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kill_chain_name", T.StringType()),
                        T.StructField("phase_name", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

STIX_FILE = T.StructType(
    [
        T.StructField("fetched_at", T.DoubleType()),
        T.StructField("bundle", T.StructType([T.StructField("objects", T.ArrayType(STIX_OBJECT))])),
        T.StructField("objects", T.ArrayType(STIX_OBJECT)),
    ]
)
