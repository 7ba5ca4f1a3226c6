"""CEF extension parsing as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom.functions.text import SPACE, WORD, rstrip

# Fixed value: a key at the start or after white space, directly followed by "=". The white space is part of the match (the value
# before it loses its trailing white space anyway).
KEY = rf"(?:^|[{SPACE}])([A-Za-z][{WORD}.]*)="


def unescape(value: Column) -> Column:
    r"""Undo \= , \\ and \n; any other escape stays as written."""
    # Cutting at each \\ first leaves pieces in which a backslash can only start \= or \n.
    pieces = F.transform(
        F.split(value, r"\\\\", -1),
        lambda p: F.replace(F.replace(p, F.lit("\\="), F.lit("=")), F.lit("\\n"), F.lit("\n")),
    )
    return F.array_join(pieces, "\\")


def with_extension(df: DataFrame, extension: Column, name: str) -> DataFrame:
    """Adds the extension as map<string,string>; a repeated key keeps its last value.

    Keys and values become columns first, so that each pattern runs once per row.
    """
    text = F.coalesce(extension, F.lit(""))
    keys, values = F.col("_keys"), F.col("_values")
    plain = F.transform(
        # The text between two keys is the first one's value; before the first key is no value.
        F.slice(F.split(text, KEY, -1), F.lit(2), F.size(keys)),
        lambda v: F.when(F.contains(v, F.lit("\\")), unescape(rstrip(v))).otherwise(rstrip(v)),
    )
    last_only = F.filter(
        F.arrays_zip(keys, values, F.sequence(F.lit(1), F.size(keys)).alias("_at")),
        lambda e: e["_at"] == F.size(keys) + 1 - F.array_position(F.reverse(keys), e["_keys"]).cast("int"),
    )
    return (
        df.withColumn("_keys", F.regexp_extract_all(text, F.lit(KEY), F.lit(1)))
        .withColumn("_values", plain)
        .withColumn(
            name,
            F.when(extension.isNull(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
            .when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values))
            .otherwise(F.map_from_entries(F.transform(last_only, lambda e: F.struct(e["_keys"], e["_values"])))),
        )
        .drop("_keys", "_values")
    )
