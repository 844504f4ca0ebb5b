"""Small helpers that the operators of this package share: written stages and Arrow passes."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

from listwright.session import prepare, work_dir

BATCH_BYTES = "16m"
_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors once per session, so that tasks can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_listwright_sent", False) or not os.path.isdir(_PACKAGE):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="listwright-"), "listwright_sources.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    out.write(at, os.path.relpath(at, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    sc._listwright_sent = True


def shipped(df: DataFrame) -> DataFrame:
    """The frame itself, for a pass in Python whose function uses this package.

    Batches are bounded in bytes too, as ten thousand whole texts can be any size.
    """
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and go on from the files.

    What follows reads only the columns it needs, and a lost executor costs a reread, not a
    second computation. Like any checkpoint, the files stay until the folder is emptied.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, by Spark's own reader, whatever store holds it."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
