"""Tables that cut a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from verilake.sources.files import local_path

_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session's driver and executors share.

    It is the checkpoint folder the cluster names in ``spark.checkpoint.dir``.
    Only on local[n], where driver and executors are one process, a temporary one
    is taken if none is named; elsewhere that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a reread and not a rerun.
    The table stays until the scope that it was written in ends (``released``),
    or as long as the shared folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files that led here
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are deleted at the end: write what is made of them before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing will read again."""
    if path.startswith("file:") and os.path.isdir(own := local_path(path)) and not os.path.islink(own):
        _removed(own)  # Hadoop holds all entries of a folder
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _removed(folder: str) -> None:
    """Delete a folder as its entries are read: it is not held, however many there are."""
    for _ in range(10):  # a mounted folder may pass over entries while others go
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    _removed(e.path)
                else:
                    with contextlib.suppress(FileNotFoundError):
                        os.unlink(e.path)
        with contextlib.suppress(OSError):
            os.rmdir(folder)
            return
