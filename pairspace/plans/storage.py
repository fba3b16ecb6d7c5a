"""Shared scratch storage: where plans are cut and where text exports go.

A cluster names a shared folder in ``spark.checkpoint.dir``; everything that
must outlive an executor is written there. Only a local master, which has no
other machine to lose, may fall back to a temporary folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None

# Spark deletes the shuffle files of a query as soon as it ends
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """Folder named by the session, or a local one for a local master."""
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    # local-cluster has executors of its own, which do not share the folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="pairspace-")
    return _local_root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used before."""
    return f"{shared_root(spark).rstrip('/')}/pairspace/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind.

    Otherwise Spark deletes them once the driver's garbage collection finds that their plan is gone. A driver with little to
    do hardly collects, so that a chain of stored tables keeps the files of all of its steps on disk at once.
    """
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner
    the real size of the data, so that it broadcasts only what is small. What
    was shuffled to compute it is deleted.
    """
    path = fresh_path(df.sparkSession, label)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """:func:`materialise` dealt out by ``key``, so that joins by it do not shuffle the stored rows again.

    A table of the session's catalog in as many buckets as the session shuffles into; its files lie in the shared folder like the others.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_released(spark):
        # one task for each bucket, so that each is one file
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
