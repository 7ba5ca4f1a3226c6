"""The folder that driver and executors share, and tables written there to cut lineage.

A written table survives lost executors: later stages read it again instead of recomputing what made it.
Everything of one session lies below one folder named after the application, to be removed when it ends.
What a written table was shuffled from is not needed again, so its shuffle files are deleted once it is written.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; a local session without that setting gets its own."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set(SETTING, root)
    if "://" not in root:
        # the file system that Spark itself takes for such a name, local or not
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        root = re.sub("^file:/(?!/)", "file:///", root)
    return f"{root}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run within leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def saved(df: DataFrame) -> DataFrame:
    """The same rows, computed once and written as Parquet."""
    spark = df.sparkSession
    path = shared_folder(spark)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, column: str, name: str | None = None) -> str:
    """Name of a new table, or of the given one with these rows added, written so that grouping by the column needs no further shuffle."""
    writer = df.repartition(n, column).write.option("compression", "zstd").bucketBy(n, column).format("parquet")
    if name is None:
        name = f"llm_{column}_{uuid.uuid4().hex}"
        writer = writer.option("path", shared_folder(df.sparkSession))
    with shuffles_dropped(df.sparkSession):
        writer.mode("append").saveAsTable(name)
    return name
