"""Cutting the lineage of iterations, so that plans don't grow with the rounds and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a folder of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="sievecraft-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed into the checkpoint folder of the session."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the checkpoint folder, deleted when it is left: what is read from it must be cut before."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    yield path
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
