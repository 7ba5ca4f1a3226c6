"""Indicator extraction from free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from alertloom.functions.text import DIGIT, WORD, strip

# The indicator patterns. A first test of what follows spares looking back where nothing can begin.
_OCTET = rf"(?:25[0-5]|2[0-4]{DIGIT}|1?{DIGIT}?{DIGIT})"
IP = rf"(?={DIGIT})(?<![{WORD}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![{WORD}.])"
DOMAIN = (
    rf"(?<![@{WORD}-])(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+"
    rf"[a-zA-Z]{{2,63}}(?![{WORD}-])"
)
HASH = (
    r"(?=[a-fA-F0-9]{32})(?<![a-fA-F0-9])(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})(?![a-fA-F0-9])"
)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def ips(text: Column) -> Column:
    """Distinct IPv4 addresses in order of appearance."""
    return F.array_distinct(_all(text, IP))


def domains(text: Column) -> Column:
    """Distinct lower-cased domain names in order of appearance."""
    return F.array_distinct(F.transform(_all(text, DOMAIN), F.lower))


def hashes(text: Column) -> Column:
    """Distinct lower-cased MD5, SHA-1 and SHA-256 values, sorted."""
    return F.array_sort(F.array_distinct(F.transform(_all(text, HASH), F.lower)))


def extract_iocs(text: Column) -> Column:
    return F.struct(
        ips(text).alias("ips"), domains(text).alias("domains"), hashes(text).alias("hashes")
    )


def hash_type(value: Column) -> Column:
    """md5, sha1 or sha256 by length; null when the value is none of them."""
    hex_text = strip(value)
    return F.when(
        hex_text.rlike(r"\A[a-fA-F0-9]+\z"),
        F.when(F.length(hex_text) == 32, F.lit("md5"))
        .when(F.length(hex_text) == 40, F.lit("sha1"))
        .when(F.length(hex_text) == 64, F.lit("sha256")),
    )
