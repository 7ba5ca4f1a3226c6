"""IP address checks in plain expressions (no Python on the row path)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"\A{OCTET}(?:\.{OCTET}){{3}}\z"
HEXTETS = r"(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)"


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    """Eight hextets, or fewer around one "::"; dotted-quad tail and "%scope" allowed."""
    address = F.regexp_extract(ip, r"\A([^%]+)(?:%[^%]+)?\z", 1)
    # A dotted-quad tail stands for two hextets.
    quad_tail = rf"(?<=:){OCTET}(?:\.{OCTET}){{3}}\z"
    plain = F.regexp_replace(address, quad_tail, "0:0")
    groups = F.size(F.regexp_extract_all(plain, F.lit(r"[0-9a-fA-F]+"), F.lit(0)))
    full = plain.rlike(rf"\A{HEXTETS}\z") & (groups == 8)
    short = plain.rlike(rf"\A{HEXTETS}?::{HEXTETS}?\z") & (groups <= 7)
    return F.coalesce(full | short, F.lit(False))


def is_ip(ip: Column) -> Column:
    return F.when(F.contains(ip, F.lit(":")), is_ipv6(ip)).otherwise(is_ipv4(ip))


def is_private_ip(ip: Column) -> Column:
    """RFC 1918 only: 10/8, 172.16/12, 192.168/16. Anything else, IPv6 included, is false."""
    rfc1918 = (
        ip.rlike(r"\A10\.")
        | ip.rlike(r"\A172\.(?:1[6-9]|2[0-9]|3[01])\.")
        | ip.rlike(r"\A192\.168\.")
    )
    return F.coalesce(is_ipv4(ip) & rfc1918, F.lit(False))
