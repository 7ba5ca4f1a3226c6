"""Indicators of an alert: the extraction column and the long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom.functions.indicators import extract_iocs
from alertloom.functions.text import empty_to_null


def alert_text() -> Column:
    return F.concat(F.coalesce("message", F.lit("")), F.lit("\n"), F.coalesce("raw", F.lit("")))


def with_extraction(alerts: DataFrame) -> DataFrame:
    """Adds ``ioc_extraction``: struct of ips, domains and hashes in message and raw text."""
    return alerts.withColumn("ioc_extraction", extract_iocs(alert_text()))


def ioc_table(alerts: DataFrame) -> DataFrame:
    """(seq, slot, ioc_type, ioc, pos): source and target address, then other addresses,
    domains and hashes found in the text."""
    df = alerts if "ioc_extraction" in alerts.columns else with_extraction(alerts)
    df = df.select(
        "seq",
        empty_to_null(F.col("src_ip")).alias("src_ip"),
        empty_to_null(F.col("dest_ip")).alias("dest_ip"),
        "ioc_extraction",
    )
    explicit = F.array("src_ip", "dest_ip")
    found = F.col("ioc_extraction")

    def entries(values: Column, slot: str, ioc_type: str) -> Column:
        return F.transform(
            values,
            lambda v, i: F.struct(
                F.lit(slot).alias("slot"), F.lit(ioc_type).alias("ioc_type"), v.alias("ioc"), i.alias("pos")
            ),
        )

    rows = F.concat(
        entries(F.array_compact(F.array("src_ip")), "src_ip", "ip"),
        entries(F.array_compact(F.array("dest_ip")), "dest_ip", "ip"),
        entries(F.array_except(found["ips"], explicit), "ips", "ip"),
        entries(found["domains"], "domains", "domain"),
        entries(found["hashes"], "hashes", "hash"),
    )
    return df.select("seq", F.explode(rows).alias("e")).select("seq", "e.*")


def distinct_iocs(iocs: DataFrame) -> DataFrame:
    """(ioc_type, ioc) once per batch."""
    return iocs.select("ioc_type", "ioc").distinct()
