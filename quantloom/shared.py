"""Tables in the folder that the driver and all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that
is unset, a session in one process (tests, a laptop) uses a folder under
/tmp/checkpoints; on a cluster it is an error, as a machine's own folder would
lose what other machines wrote.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK = "/tmp/checkpoints/quantloom"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI without a slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or _FALLBACK).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark._jsc is not None and not spark._jsc.sc().isStopped():
            _delete(spark, path)
    except Exception:  # the JVM may already be gone; the cluster's own cleaner takes what is left
        return


_roots: set[str] = set()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path of this application in the shared folder."""
    root = f"{shared_dir(spark)}/quantloom-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_delete_at_exit, spark, root)
    path = f"{root}/{label}-{uuid.uuid4().hex[:12]}"
    for made in _open:
        made.append(path)
    return path


_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Drops the tables made inside the block when it ends, but for paths that the block takes out of the list it is given."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for path in made:
            _delete(spark, path)


def stage_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    _delete(spark, path)


def bound_arrow_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Keep Arrow batches small, so that very long texts cannot fill a Python worker.

    All operators ask for the same bound, since a plan that runs later takes
    what is set then; a session that has set fewer rows itself keeps them.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
