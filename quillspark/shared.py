"""Tables in the folder that the driver and all executors share: computed once, without lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local master may name none: it gets a temporary folder.

    On a cluster a machine's own folder would be read by nobody else, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillspark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    return observed(df, tag)[0]


def observed(df: DataFrame, tag: str, *figures: Column) -> tuple[DataFrame, dict]:
    """df as a Parquet table in the shared folder, and aggregates over its rows that the same job has gathered."""
    spark, path, schema = df.sparkSession, new_path(df.sparkSession, tag), df.schema
    seen = Observation() if figures else None
    (df.observe(seen, *figures) if figures else df).write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out, seen.get if figures else {}


def swept(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nobody holds any more: Spark deletes them when the driver collects its garbage, which a job of many rounds may not do for long."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(*tables: DataFrame | None) -> None:
    """Delete the files of tables from written() that nothing will read again."""
    for df in tables:
        if df is not None and hasattr(df, "written_to"):
            deleted(df.sparkSession, df.written_to)
