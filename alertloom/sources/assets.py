"""Asset weights from a JSON object {address or host: weight}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    return assets_from_text(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


def assets_from_text(texts: DataFrame) -> DataFrame:
    """(asset, weight) from a ``text`` column. Text that is no JSON object fails the query."""
    weights = F.when(F.ltrim("text").startswith("{"), F.from_json("text", "map<string,int>"))
    checked = F.coalesce(
        weights,
        F.raise_error(F.lit("expected a JSON object of {ip_or_host: weight}")).cast("map<string,int>"),
    )
    return texts.select(F.explode(checked).alias("asset", "weight"))
