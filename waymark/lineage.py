"""Cutting lineage with reliable checkpoints, and sizing of shuffles."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` names it on a cluster. Only in local mode, and where neither that
    setting nor an earlier ``setCheckpointDir`` exists, a temporary folder is made, which goes with the process;
    elsewhere executors would not see it, so its lack is an error. On a cluster
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes checkpoints that are no longer used.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="waymark-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, for what is written and read again."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's shuffle partitions, used to size range partitionings."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new attribute ids, so that a frame can be cogrouped with one it shares lineage with."""
    return df.select(*[df[c].alias(c) for c in df.columns])
