"""Session helpers shared by every module: table reading and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, read lazily so that pruning reaches the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lets Spark remove the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Checkpoint `df` to the shared folder of the cluster and go on from there.

    The folder is the one named in spark.checkpoint.dir; only where none is set and all runs on
    one machine (tests, a laptop) is one made. What led to an eager checkpoint is not read again,
    so its shuffle files go once it is written: rounds of many cuts do not add up on the disks.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", "") and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    if not eager:
        return df.checkpoint(eager)
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a query of its own: the setting is read when it is made
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application.

    It is for sessions that were started without it on the Python path; Spark serves the
    archive to all machines.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "attesta"), "zip", os.path.dirname(root), os.path.basename(root))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
