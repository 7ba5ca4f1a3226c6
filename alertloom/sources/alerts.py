"""Already normalised alerts in, triage results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.operators.validate import project_alert
from alertloom.schemas import ALERT
from alertloom.sources.json_array import read_array_elements


def read_alert_array(spark: SparkSession, path: str) -> DataFrame:
    """Files that are JSON arrays of alerts, in order; a large one is read by many tasks. Anything but an array of
    objects whose fields fit fails the query."""
    parsed = F.from_json("record", ALERT, {"mode": "FAILFAST"})
    alerts = read_array_elements(spark, path).select("seq", parsed.alias("a"))
    return project_alert(alerts.select("seq", "a.*"))


def write_results(triaged: DataFrame, path: str, fmt: str = "json") -> None:
    """One directory per priority tier."""
    triaged.write.mode("errorifexists").partitionBy("priority_tier").format(fmt).save(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("errorifexists").json(path)
