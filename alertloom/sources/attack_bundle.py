"""ATT&CK STIX bundles from file storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from alertloom.config import TriageConfig
from alertloom.schemas import STIX_FILE


def read_bundle(spark: SparkSession, path: str, as_of: float | None, cfg: TriageConfig) -> DataFrame:
    """One row per object. Takes a bare bundle, or one wrapped with the time it was fetched;
    a wrapped bundle as old as the age limit at ``as_of`` (epoch seconds) gives no rows."""
    return live_objects(spark.read.schema(STIX_FILE).json(path, multiLine=True), as_of, cfg)


def live_objects(bundles: DataFrame, as_of: float | None, cfg: TriageConfig) -> DataFrame:
    """The objects of STIX_FILE rows that are not too old."""
    if as_of is not None:
        age = F.lit(as_of) - F.coalesce("fetched_at", F.lit(0.0))
        bare = F.col("objects").isNotNull()
        bundles = bundles.filter(bare | (age < cfg.attack_bundle_ttl_seconds))
    return bundles.select(F.explode(F.coalesce("bundle.objects", "objects")).alias("o")).select("o.*")


def load_index(spark: SparkSession, path: str | None, as_of: float | None, cfg: TriageConfig) -> DataFrame | None:
    """The word index, or None when the bundle is missing, unreadable or too old."""
    from alertloom.operators.attack import technique_index

    if path is None:
        return None
    try:
        objects = read_bundle(spark, path, as_of, cfg)
        if objects.isEmpty():
            return None
    except AnalysisException:
        return None
    return technique_index(objects)
