"""Where operators keep what they reread: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (as in tests), one of our own, set once a session."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="vellum-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/vellum-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove the tables that `written` has left for this application, once its results are stored elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, independent of any executor."""
    path = f"{_own(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
