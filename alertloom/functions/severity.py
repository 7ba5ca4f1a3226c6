"""Severity normalisation to 0..10."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from alertloom.functions.text import strip

# Severity words.
SEVERITY_WORDS = {
    "informational": 1,
    "info": 1,
    "low": 3,
    "medium": 5,
    "moderate": 5,
    "high": 8,
    "critical": 10,
    "severe": 10,
}
DEFAULT_SEVERITY = 5

_DIGITS = r"[0-9](?:_?[0-9])*"
_NUMBER = rf"\A[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?\z"
_INFINITY = r"\A[+-]?(?:inf|infinity)\z"


def severity(text: Column) -> Column:
    """Words by table, numbers truncated and clamped, anything else the default.

    Null for an infinite number: such a record is rejected, not defaulted.
    """
    word = F.lower(strip(text))
    number = F.when(word.rlike(_NUMBER), F.replace(word, F.lit("_"), F.lit("")).try_cast("double"))
    infinite = word.rlike(_INFINITY) | F.coalesce(F.abs(number) == float("inf"), F.lit(False))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(10.0), number)).cast("int")
    chain = F.when(word.isNull() | infinite, F.lit(None).cast("int"))
    for name, level in SEVERITY_WORDS.items():
        chain = chain.when(word == name, F.lit(level))
    return chain.when(number.isNotNull(), clamped).otherwise(F.lit(DEFAULT_SEVERITY))
