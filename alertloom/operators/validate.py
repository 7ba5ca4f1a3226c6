"""Alert validation: keep, quarantine, or fail on the first bad row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql import types as T

from alertloom.functions.net import is_ip
from alertloom.functions.text import empty_to_null
from alertloom.schemas import ALERT


def _bad_ip(ip: Column) -> Column:
    return (F.coalesce(ip, F.lit("")) != "") & ~is_ip(ip)


def invalid_reason(columns: list[str]) -> Column:
    """Null for a valid alert, else why it is not. A parser's own ``reject`` comes first."""
    reason = F.col("reject") if "reject" in columns else F.lit(None).cast("string")
    rules = (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.lit("id_empty"))
        .when(F.coalesce(F.col("signature"), F.lit("")) == "", F.lit("signature_empty"))
        .when(~F.coalesce(F.col("severity").between(0, 10), F.lit(False)), F.lit("severity_out_of_range"))
        .when(_bad_ip(F.col("src_ip")), F.lit("src_ip_invalid"))
        .when(_bad_ip(F.col("dest_ip")), F.lit("dest_ip_invalid"))
    )
    return F.coalesce(reason, rules)


def with_reason(alerts: DataFrame) -> DataFrame:
    """``reason`` per row; an empty address becomes null."""
    return (
        alerts.withColumn("reason", invalid_reason(alerts.columns))
        .withColumn("src_ip", empty_to_null(F.col("src_ip")))
        .withColumn("dest_ip", empty_to_null(F.col("dest_ip")))
        .drop("reject")
    )


def valid_alerts(alerts: DataFrame) -> DataFrame:
    return with_reason(alerts).filter("reason is null").drop("reason")


def quarantine(alerts: DataFrame) -> DataFrame:
    return with_reason(alerts).filter("reason is not null")


def require_valid(alerts: DataFrame) -> DataFrame:
    """Strict mode: the query fails on the first invalid alert."""
    checked = with_reason(alerts)
    failed = F.raise_error(F.concat(F.lit("invalid alert: "), F.col("reason")))
    # The filter reads the check, so no plan can prune it away.
    return checked.filter(
        F.when(F.col("reason").isNotNull(), failed.cast("boolean")).otherwise(F.lit(True))
    ).drop("reason")


def project_alert(df: DataFrame) -> DataFrame:
    """The alert record's columns in order: unknown ones dropped, absent ones by default."""
    defaults = {"source": "unknown", "raw": "", "occurrence_count": 1}
    columns = []
    for f in ALERT.fields:
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            value = F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType))
        elif isinstance(f.dataType, T.ArrayType):
            value = F.coalesce(value, F.array().cast(f.dataType))
        columns.append(value.alias(f.name))
    return df.select(*[c for c in ("seq",) if c in df.columns], *columns)


def quality_metrics(parsed: DataFrame) -> DataFrame:
    """One row: parsed, valid, dropped, valid alerts without a message."""
    checked = with_reason(parsed)
    valid = F.col("reason").isNull()
    return checked.agg(
        F.count("*").alias("parsed"),
        F.count_if(valid).alias("valid"),
        F.count_if(~valid).alias("dropped"),
        F.count_if(valid & (F.coalesce("message", F.lit("")) == "")).alias("empty_messages"),
    )


def observe_quality(checked: DataFrame, name: str = "alert_quality") -> tuple[DataFrame, Observation]:
    """The same counts gathered while another job runs; read them from the observation after it."""
    valid = F.col("reason").isNull()
    observation = Observation(name)
    observed = checked.observe(
        observation,
        F.count(F.lit(1)).alias("parsed"),
        F.count_if(valid).alias("valid"),
        F.count_if(~valid).alias("dropped"),
        F.count_if(valid & (F.coalesce("message", F.lit("")) == "")).alias("empty_messages"),
    )
    return observed, observation
