"""Shared scratch tables.

Plans read some intermediate tables several times.  They are written once as
Parquet under the folder the cluster names in ``spark.checkpoint.dir``: a lost
executor then re-reads files instead of replaying the whole lineage, values
that come from order-dependent sketches cannot change between two uses, and the
planner sees the true size of each table, so it broadcasts one only when it is
below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def workspace_dir(spark: SparkSession) -> str:
    """Folder for scratch tables of this application.

    It lies below the folder that ``spark.checkpoint.dir`` names, or that
    ``SparkContext.setCheckpointDir`` was given; without either there is none.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{shared.rstrip('/')}/factorloom/{spark.conf.get('spark.app.id')}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{workspace_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Let Spark remove the shuffle files of each query inside as soon as it has ended.

    Otherwise they stay until the driver happens to collect its garbage, and the disk holds those of
    all steps so far.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    # the written table is all that is read again
    with _shuffles_removed(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, label: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder in ``buckets`` hash buckets of ``keys``, one file each.

    Joins and aggregates on exactly these keys then read the table without a shuffle; other uses read
    it like any other.  The buckets are known to the session's catalog, under a name of its own.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with _shuffles_removed(spark):
        # the same hash deals rows to tasks and to buckets, so a task writes one file
        (
            df.repartition(buckets, *keys)
            .write.bucketBy(buckets, *keys)
            .sortBy(*keys)
            .option("path", path)
            .saveAsTable(name)
        )
    return spark.table(name)
