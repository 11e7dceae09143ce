"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@functools.cache
def _trim() -> Callable[[int], int]:
    """The C library's call that gives freed memory back to the system; none that does nothing elsewhere."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, and at the end of a task its memory goes back to the system.

    Workers live on from task to task and stage to stage, and would hold what the
    largest one took beside the executor's heap.
    """

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return freed
