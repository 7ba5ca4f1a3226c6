"""Keeping computed columns computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def settle(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows, with the named columns fixed at this point of the plan.

    A filter on a parsed column would otherwise be pushed below the parsing with the whole
    parsing expression written into it again, once per mention. A one-element generator stops
    that; it stays inside the generated code and moves no data.
    """
    others = [c for c in df.columns if c not in columns]
    settled = df.select(*others, F.inline(F.array(F.struct(*columns))))
    return settled.select(*df.columns)
