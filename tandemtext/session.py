"""Where a job may cut its lineage.

Executors come and go, so intermediate results are only ever kept in the folder that all of them share: the one the
cluster names in ``spark.checkpoint.dir``.  Where that setting is missing (tests on a single JVM) a folder is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a machine-local folder is only made for a ``local`` master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
            _dropped_at_end(spark, context.getCheckpointDir())
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tandemtext-")
        context.setCheckpointDir(folder)
        _dropped_at_end(spark, f"file://{folder}")
    return context.getCheckpointDir()


def _dropped_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete what is at ``path`` when the session's JVM ends; results that hang on it live no longer."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted at the end of the session."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _dropped_at_end(spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage; partitions and the order of rows inside them stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it again; for results that are used more than once."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
