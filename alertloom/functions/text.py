"""Text helpers: trimming, line splitting, address patterns.

Character classes are spelled out because Java's short forms are ASCII-only while the
alert formats are defined over Unicode: a word character is any letter or number or "_".
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode character classes.
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"

# Any dotted quad standing alone, range not checked. The first test only spares the second one where no digit is.
LOOSE_IP = rf"(?={DIGIT})(?<![{WORD}])(?:{DIGIT}{{1,3}}\.){{3}}{DIGIT}{{1,3}}(?![{WORD}])"


def strip(text: Column) -> Column:
    # Few texts have anything to cut off, and the pattern tries every place of a text.
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(rf"[{SPACE}]"), F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")).otherwise(text)


def rstrip(text: Column) -> Column:
    last = F.substring(text, -1, 1)
    return F.when(last.rlike(rf"[{SPACE}]"), F.regexp_replace(text, rf"[{SPACE}]+\z", "")).otherwise(text)


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(rf"[^{SPACE}]")


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK, -1)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def loose_ips(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LOOSE_IP), F.lit(0))
