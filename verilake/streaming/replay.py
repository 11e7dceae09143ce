"""History through the streaming operators: a table comes in lots, and a stream that is started anew takes each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.sources.scratch import delete, scratch_path

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def held(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings for the streams started inside."""
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def rocksdb(spark: SparkSession):
    """The state store that the operators with state of their own need, for the streams started inside."""
    return held(spark, ROCKSDB)


def lots(rows: DataFrame, by: str, n: int) -> list[DataFrame]:
    """The rows in n lots of about the same size, in the order of a column; nulls come first.

    The limits are approximate percentiles, one row. A lot is a filter on the
    column, which reaches the scan.
    """
    limits = rows.agg(F.percentile_approx(by, [i / n for i in range(1, n)], 1000)).first()[0] if n > 1 else None
    limits = sorted(set(limits or []))
    column, found = F.col(by), []
    for low, high in zip([None, *limits], [*limits, None], strict=True):
        above = F.lit(True) if low is None else column > F.lit(low)
        below = F.lit(True) if high is None else column <= F.lit(high)
        kept = above & below
        found.append(rows.filter(kept | column.isNull() if low is None else kept))
    return found


def append(lot: DataFrame, path: str) -> None:
    lot.write.mode("append").parquet(path)


def append_lines(lot: DataFrame, path: str) -> None:
    """A lot of texts in a column ``value``."""
    lot.select("value").write.mode("append").text(path)


def replay(
    rows: DataFrame, by: str, operator: Callable[[DataFrame], DataFrame], n: int = 2, mode: str = "append",
    put: Callable[[DataFrame, str], None] = append, opened: Callable[[SparkSession, str], DataFrame] | None = None, conf: dict[str, str] | None = None,
) -> DataFrame:
    """What a streaming operator gives on a table that arrives in n lots, in the order of ``by``.

    Each lot is put into a folder and taken by a stream that is started for it on
    the checkpoint of the one before and ends when all is taken. ``put`` writes a
    lot and ``opened`` reads the folder as a stream; tables of Parquet files if
    not given; ``conf`` holds while the streams run. mode is append or complete. Rows that a watermark has not passed at
    the end are not given. The folder and the state go at the end, the result stays
    in the shared folder as a scratch table does. An empty table gives no rows.
    """
    spark = rows.sparkSession
    if opened is None:
        opened = lambda spark, path: spark.readStream.schema(rows.schema).parquet(path)
    given = scratch_path(spark, "given")

    def start(stream: DataFrame, checkpoint: str):
        writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if mode == "append":
            return writer.outputMode(mode).format("parquet").start(given)
        return writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(given)).start()

    kind = _taken(rows, by, n, put, lambda path: operator(opened(spark, path)), start, conf)
    return spark.read.schema(kind).parquet(given)


def replay_into(rows: DataFrame, by: str, merge: Callable[[DataFrame, int], None], n: int = 2) -> None:
    """As ``replay``, into what a function for foreachBatch maintains."""
    spark = rows.sparkSession
    start = lambda stream, checkpoint: stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
    _taken(rows, by, n, append, lambda path: spark.readStream.schema(rows.schema).parquet(path), start)


def _taken(rows, by, n, put, made, start, conf=None):
    """Put the lots and run a stream after each; the schema of what it gives."""
    spark = rows.sparkSession
    folder, checkpoint = scratch_path(spark, "lots"), scratch_path(spark, "checkpoint")
    with held(spark, ROCKSDB | (conf or {})):
        for lot in lots(rows, by, n):
            put(lot, folder)
            stream = made(folder)
            running = start(stream, checkpoint)
            try:
                running.awaitTermination()
            finally:
                running.stop()
    for path in (folder, checkpoint):
        delete(spark, path)
    return stream.schema
