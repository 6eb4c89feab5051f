"""Shared storage for intermediate tables.

Iterative operators and skew-safe windows write narrow intermediate tables. They
go to the folder named by ``spark.checkpoint.dir``, which every executor can
read, so a lost executor only costs the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    path = context.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tessella-")
    context.setCheckpointDir(path)
    return path


#: Folder of the innermost open ``scratch`` block of this thread.
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Delete at the end of the block what its operators have staged.

    Results must be read or written out inside the block, since they may read staged tables. Threads have blocks of
    their own: what one stages is not deleted by the block of another.
    """
    folder = f"{shared_dir(spark)}/tessella/scope-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, inside the open ``scratch`` block if there is one."""
    base = _scope.get() or f"{shared_dir(spark)}/tessella"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def many(df: DataFrame) -> DataFrame:
    """Mark a table whose rows were multiplied, so that no join broadcasts it.

    The planner takes exploded rows for as few as the rows they came from, and would send them through the driver.
    """
    return df.hint("merge")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
