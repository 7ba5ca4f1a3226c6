"""Mixed-format timestamp text to epoch microseconds plus a zone class.

ISO and classic syslog shapes are parsed by built-in expressions. Whatever else the text may
be goes to dateutil in Arrow batches; rows already parsed send only nulls there.
"""

from __future__ import annotations

import datetime as dt
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from alertloom.config import TriageConfig

# Zone classes. Times of different classes are never comparable.
NO_TIME, NAIVE, AWARE = 0, 1, 2
SHAPE = "_shape"

# Shapes the built-in parser reads by itself.
_ISO = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?"
    r"(?:Z|[+-](?:0[0-9]|1[0-3]):[0-5][0-9])?)?\z"
)
_SYSLOG = r"\A(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +[0-9]{1,2} +[0-9]{2}:[0-9]{2}:[0-9]{2}\z"


def _dateutil_parser(reference_year: int):
    default = dt.datetime(reference_year, 1, 1)
    epoch = dt.datetime(1970, 1, 1)

    def parse_one(text: str) -> tuple[int | None, int]:
        from dateutil import parser

        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                value = parser.parse(text, default=default)
            if value.tzinfo is not None and value.utcoffset() is not None:
                zone, value = AWARE, (value - value.utcoffset()).replace(tzinfo=None)
            else:
                zone, value = NAIVE, value.replace(tzinfo=None)
        except (ValueError, OverflowError):
            return None, NO_TIME
        return (value - epoch) // dt.timedelta(microseconds=1), zone

    @F.pandas_udf("struct<us:bigint,zone:int>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        us = np.zeros(len(texts), dtype=np.int64)
        zone = np.zeros(len(texts), dtype=np.int32)
        present = texts.notna().to_numpy()
        if present.any():
            known = {t: parse_one(t) for t in texts[present].unique()}
            for i in np.flatnonzero(present):
                micros, zone[i] = known[texts.iat[i]]
                us[i] = 0 if micros is None else micros
        return pd.DataFrame({"us": pd.arrays.IntegerArray(us, zone == NO_TIME), "zone": zone})

    return parse


def parse_timestamp(df: DataFrame, text: str, cfg: TriageConfig) -> DataFrame:
    """Adds ``ts_us`` (UTC micros; times without a zone read as UTC; null when there is no
    usable time) and ``ts_zone``. Done in steps so that each pattern runs once per row."""
    parsed = parse_built_in(df, text, cfg)
    return (parse_rest(parsed, text, cfg) if cfg.lenient_timestamps else parsed).drop(SHAPE)


def parse_built_in(df: DataFrame, text: str, cfg: TriageConfig) -> DataFrame:
    """The same without dateutil, and the text's shape: "other" where only dateutil may read it."""
    stamp = F.col(text)
    # Year 0 does not exist for the lenient parser, so not for the built-in one either.
    is_iso = stamp.rlike(_ISO) & ~stamp.startswith("0000")
    zoned = (F.length(stamp) > 10) & (
        stamp.endswith("Z") | F.substring(stamp, -6, 1).isin("+", "-")
    )
    shape = (
        F.when(is_iso, F.when(zoned, F.lit("zoned")).when(F.length(stamp) == 10, F.lit("date")).otherwise(F.lit("plain")))
        .when(stamp.rlike(_SYSLOG), F.lit("syslog"))
        .when(F.length(stamp) > 0, F.lit("other"))
    )
    suffix = F.when(F.col("_shape") == "zoned", F.lit("")).when(F.col("_shape") == "date", F.lit("T00:00:00Z")).otherwise(
        F.lit("Z")
    )
    with_year = F.concat(F.lit(f"{cfg.reference_year:04d} "), F.regexp_replace(stamp, " +", " "), F.lit(" Z"))
    instant = F.when(
        F.col("_shape") == "syslog", F.try_to_timestamp(with_year, F.lit("yyyy MMM d HH:mm:ss X"))
    ).when(F.col("_shape") != "other", F.concat(stamp, suffix).try_cast("timestamp"))
    zone = F.when(F.col("ts_us").isNull(), NO_TIME).when(F.col("_shape") == "zoned", AWARE).otherwise(NAIVE)
    return (
        df.withColumn(SHAPE, shape)
        .withColumn("ts_us", F.unix_micros(instant))
        .withColumn("ts_zone", zone.cast("int"))
    )


def parse_rest(parsed: DataFrame, text: str, cfg: TriageConfig) -> DataFrame:
    """Rows of ``parse_built_in`` with the times of other shapes."""
    other = F.col(SHAPE) == "other"
    lenient = _dateutil_parser(cfg.reference_year)(F.when(other, F.col(text)))
    return (
        parsed.withColumn("_t", lenient)
        .withColumn("ts_us", F.coalesce("ts_us", F.col("_t.us")))
        .withColumn("ts_zone", F.when(other, F.col("_t.zone")).otherwise(F.col("ts_zone")))
        .drop("_t")
    )


def within_window(a_us: Column, a_zone: Column, b_us: Column, b_zone: Column, cfg: TriageConfig) -> Column:
    """Both without a time, or of one zone class and at most the window apart (inclusive)."""
    neither = a_us.isNull() & b_us.isNull()
    close = (a_zone == b_zone) & (F.abs(a_us - b_us) <= cfg.window_micros)
    return neither | F.coalesce(close, F.lit(False))
