"""Versioned Parquet snapshots: ``root/v=<n>``, complete once Spark wrote its _SUCCESS mark.

A version is written whole and never changed while it is read: readers take the newest
complete one, a writer makes the next. Writing the same version again replaces it, which
makes a replayed batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from listwright.schemas import ACTIVITY


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """The numbers n of the folders ``root/<prefix><n>``."""
    at, fs = _folder(spark, root)
    if not fs.exists(at):
        return []
    names = [entry.getPath().getName() for entry in fs.listStatus(at)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions, oldest first."""
    at, fs = _folder(spark, root)
    mark = lambda v: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v={v}/_SUCCESS")
    return [v for v in folders(spark, root, "v=") if fs.exists(mark(v))]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that newer ones stand for."""
    at, fs = _folder(spark, path)
    fs.delete(at, True)


def purge(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove all complete versions but the newest ``keep``; two let a replayed batch read what it read before."""
    for v in versions(spark, root)[:-keep]:
        remove(spark, f"{root}/v={v}")


def read_latest(
    spark: SparkSession, root: str, schema: T.StructType, before: int | None = None
) -> DataFrame:
    """The newest complete version (older than ``before``), or an empty frame."""
    usable = [v for v in versions(spark, root) if before is None or v < before]
    if not usable:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/v={usable[-1]}")


def read_range(
    spark: SparkSession, root: str, schema: T.StructType, after: int, upto: int | None = None
) -> DataFrame:
    """All complete versions in (after, upto] together; for folders whose versions are deltas."""
    wanted = [v for v in versions(spark, root) if v > after and (upto is None or v <= upto)]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{root}/v={v}" for v in wanted))


def read_history(
    spark: SparkSession, root: str, schema: T.StructType, after: int = -1, upto: int | None = None
) -> DataFrame:
    """The rows of all complete versions in (after, upto], each with its ``version``."""
    wanted = [v for v in versions(spark, root) if v > after and (upto is None or v <= upto)]
    if not wanted:
        return spark.createDataFrame([], schema).withColumn("version", F.lit(None).cast("long"))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("v", T.LongType())])).option("basePath", root)
    return rows.parquet(*(f"{root}/v={v}" for v in wanted)).withColumnRenamed("v", "version")


def write_version(df: DataFrame, root: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/v={version}")


def write_activity(df: DataFrame, path: str, run: str) -> None:
    """Add a run's rows to the log; writing the same run again replaces its rows."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}")


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log, or an empty frame before the first run."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], ACTIVITY)
    return spark.read.schema(ACTIVITY).parquet(path).select(*ACTIVITY.fieldNames())
