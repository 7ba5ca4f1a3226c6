"""Cutting lineage with reliable checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="alertloom-checkpoint-")
    sc.setCheckpointDir(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Computed once, written to the checkpoint folder: survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """Computed once and written as Parquet to the checkpoint folder. Later reads take only the columns they need."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
