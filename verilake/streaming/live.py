"""The event operators on streams.

Times are events' own; a stream has a watermark of ten minutes, and what comes
later is dropped by operators that keep state.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from verilake.operators import events as batch
from verilake.operators import outcomes, savings
from verilake.sources import versioned, watched
from verilake.sources.listing import any_case
from verilake.sources.scratch import scratch_path

LATE = "10 minutes"


def watermarked(events: DataFrame, late: str = LATE) -> DataFrame:
    """With the watermark on ts, which must be a TIMESTAMP and is made one."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def read_events(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The decoded events of a folder of JSON lines that keeps growing."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return batch.decode(lines)[0]


#: Settings for a stream by Spark's own source of very many small files whose content is not read. Spark lists a batch's
#: files again with up to 10,000 tasks, and then gives a task 32 files, each of which makes a file of the result.
MANY_FILES = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "100", "spark.sql.files.openCostInBytes": "65536"}
_PATTERN = frozenset("*?[]{}\\")


def catalog(spark: SparkSession, root: str, extension: str = "flac", max_files: int = 100_000, looks: str | None = None) -> DataFrame:
    """path, name, size of files as they appear under a folder; content is not read.

    Files of no bytes when they are first seen are passed over; ``listing.scan`` finds
    them. A folder that is mounted on driver and executors is looked at by
    ``sources.watched``: the driver holds no file, paths that were given already are
    state on the executors (take the RocksDB state store for many files), and a batch
    takes all that is there. ``looks`` is a mounted folder for the names of a
    batch, of one stream only, best beside its checkpoint: with it a batch that is run
    again after a failure takes the same names, without it (a scratch folder) what is there then.

    A store, a pattern or a single file goes by Spark's file source, which keeps every
    path on the driver; there a batch takes ``max_files`` at most. Of many files start
    that stream with the settings of ``MANY_FILES``.
    """
    at = _mounted(spark, root)
    if at is not None and os.path.isdir(at) and not _PATTERN & {*root, *extension}:
        lists = _mounted(spark, looks or scratch_path(spark, "looks"))
        if lists is not None:
            return _appearing(spark, {"root": at, "extension": extension, "looks": lists, "own": looks is None})
    schema = StructType.fromDDL("path string, modificationTime timestamp, length long, content binary")
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", any_case(extension)).option("maxFilesPerTrigger", max_files).load(root)
    return _named(files.withColumnRenamed("length", "size"))


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The plain path of what Spark takes for a local one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(at).toUri().getPath() if store.getUri().getScheme() == "file" else None


def _appearing(spark: SparkSession, options: dict) -> DataFrame:
    spark.dataSource.register(watched.FilesAppearing)
    files = spark.readStream.format(watched.FilesAppearing.name()).options(**options).load()
    return _named(files.dropDuplicates(["path"]).filter("size > 0"))


def _named(files: DataFrame) -> DataFrame:
    return files.select("path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("name"), "size")


def counters(attempts: DataFrame) -> DataFrame:
    """Live counters of each run, for update or complete mode."""
    return outcomes.count(attempts)


def worker_state(events: DataFrame) -> DataFrame:
    """Live state of each worker, for update or complete mode."""
    return batch.worker_state(events)


def closed_runs(events: DataFrame, key: str, gap: str = "1500 milliseconds") -> DataFrame:
    """Spans of activity, each given out once its pause is over by the watermark; append mode."""
    spans = watermarked(events).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return spans.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def coalesced_progress(events: DataFrame, every: str = "100 milliseconds") -> DataFrame:
    """The last percentage of each worker in each span of time; append mode."""
    rows = watermarked(events.filter(F.col("type") == "workerProgress"))
    last = rows.groupBy("worker", F.window("ts", every).alias("w")).agg(F.max_by("percent", F.struct("ts", "seq")).alias("percent"))
    return last.select("worker", F.col("w.start").alias("start"), "percent")


def heartbeat(attempts: DataFrame, every: str = "10 seconds") -> DataFrame:
    """What was done in each span of time, by run; append mode. ``running_totals`` adds it up."""
    rows = watermarked(attempts).groupBy("run_id", F.window("ts", every).alias("w"))
    ok = F.col("status").isin(*outcomes.SUCCESS)
    sums = rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("saved"))), F.lit(0)).alias("saved"))
    return sums.select("run_id", F.col("w.start").alias("start"), "n", "failed", "saved")


class _Retries(StatefulProcessor):
    """Counts a file's tries; a failure is RETRY until the last one if it makes sense, after a success they count from 1 again."""

    def __init__(self, max_attempts: int, ttl_ms: int | None):
        self.max_attempts, self.ttl_ms = max_attempts, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tries = handle.getValueState("tries", "n int", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        before = self.tries.get()  # None, if there is none: asked once
        n = before = before[0] if before else 0
        for r in sorted(rows, key=lambda r: r.seq):
            n += 1
            again = r.status == "FAIL" and n < self.max_attempts and r.retryable
            yield Row(run_id=key[0], file=key[1], seq=r.seq, attempt=n, decision="RETRY" if again else r.status)
            if r.status in outcomes.SUCCESS:
                n = 0
        if n:
            self.tries.update((n,))
        elif before:
            self.tries.clear()

    def close(self) -> None:
        pass


def retries(attempts: DataFrame, max_attempts: int, ttl_ms: int | None = None) -> DataFrame:
    """The decision on each try as it comes, as ``outcomes.decide`` makes it, with ``retryable`` if there is such a column; append mode.

    Needs the RocksDB state store. State of a file is dropped ttl_ms after its last try, if given.
    """
    retryable = F.coalesce("retryable", F.lit(False)) if "retryable" in attempts.columns else F.lit(True)
    rows = attempts.select("run_id", "file", "seq", "status", retryable.alias("retryable"))
    return rows.groupBy("run_id", "file").transformWithState(_Retries(max_attempts, ttl_ms), "run_id string, file string, seq long, attempt int, decision string", "Append", "none")


class _IdleRuns(StatefulProcessor):
    """Holds which workers of a run are busy, and the span of activity that is open.

    A span closes when ``gap_ms`` have passed since the run's last event with no
    worker busy: by the next event that comes later, or by the watermark.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.busy = handle.getMapState("busy", "worker long", "busy boolean")
        self.span = handle.getValueState("span", "start timestamp, last timestamp, n long, busy int, timer long")

    def _given(self, key, start, last, n):
        return (*key, start.floor("us"), last.floor("us"), n)

    def handleInputRows(self, key, rows, timerValues):
        found = pd.concat(list(rows)).sort_values(["ts", "seq"])
        start, last, n, busy, timer = self.span.get() if self.span.exists() else (None, None, 0, 0, 0)
        start, last = (None if x is None else pd.Timestamp(x) for x in (start, last))
        out, gap = [], pd.Timedelta(milliseconds=self.gap_ms)
        was, now = {}, {}
        for r in found.itertuples():
            at = pd.Timestamp(r.ts)
            if n and not busy and at >= last + gap:
                out.append(self._given(key, start, last, n))
                start, n = None, 0
            start, last, n = at if start is None else start, at if last is None or n == 0 else max(last, at), n + 1
            if r.worker not in was:
                was[r.worker] = now[r.worker] = self.busy.containsKey((r.worker,))
            busy += int(r.busy) - int(now[r.worker])
            now[r.worker] = bool(r.busy)
        for worker in now:  # the state is asked and told once for each worker, not for each event
            if now[worker] and not was[worker]:
                self.busy.updateValue((worker,), (True,))
            elif was[worker] and not now[worker]:
                self.busy.removeKey((worker,))
        if timer:
            self.handle.deleteTimer(timer)
        # a busy run waits for no time, only for its workers
        timer = 0 if busy else int((last + gap).timestamp() * 1000)
        if timer:
            self.handle.registerTimer(timer)
        self.span.update((start.to_pydatetime(), last.to_pydatetime(), n, busy, timer))
        yield self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        start, last, n, busy, _ = self.span.get()
        self.span.clear()
        yield self._table([self._given(key, pd.Timestamp(start), pd.Timestamp(last), n)])

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["run_id", "start", "end", "n"]).astype({"start": "datetime64[us]", "end": "datetime64[us]", "n": "int64"})

    def close(self) -> None:
        pass


def idle_runs(events: DataFrame, gap_ms: int = 1500, late: str = "0 seconds") -> DataFrame:
    """run_id, start, end (the last event), n of each span of a run that is over: all its workers have gone idle and ``gap_ms`` have passed; append mode.

    As ``events.closed_runs``. events has run_id, worker, seq, ts and type. A run's
    events come in the order of time, up to ``late``, by which spans close later.
    Needs the RocksDB state store. State of a run is dropped when its span closes.
    """
    rows = watermarked(events, late).select("run_id", "worker", "seq", "ts", batch.is_busy().alias("busy"))
    return rows.groupBy("run_id").transformWithStateInPandas(_IdleRuns(gap_ms), "run_id string, start timestamp, end timestamp, n long", "Append", "EventTime")


class _Changes(StatefulProcessor):
    """Holds a worker's last percentage."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "percent int", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        found = pd.concat(list(rows)).sort_values("seq")
        before = self.last.get()[0] if self.last.exists() else 0
        changed = found[found["percent"] != found["percent"].shift(fill_value=before)]
        self.last.update((int(found["percent"].iloc[-1]),))
        yield changed[["worker", "seq", "percent"]]

    def close(self) -> None:
        pass


def changed_progress(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """worker, seq, percent of the progress events that differ from the worker's one before, as ``events.progress_changes``; append mode.

    Events without a percentage are not compared. Needs the RocksDB state store.
    State of a worker is dropped ttl_ms after its last event, if given.
    """
    rows = events.filter((F.col("type") == "workerProgress") & F.col("percent").isNotNull()).select("worker", "seq", "percent")
    return rows.groupBy("worker").transformWithStateInPandas(_Changes(ttl_ms), "worker long, seq long, percent int", "Append", "ProcessingTime" if ttl_ms else "None")


class _Totals(StatefulProcessor):
    """Holds what a run has done so far: three numbers."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", "n long, failed long, saved long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        found = pd.concat(list(rows)).sort_values("start")
        so_far = self.so_far.get() if self.so_far.exists() else (0, 0, 0)
        for c, before in zip(("n", "failed", "saved"), so_far, strict=True):
            found[f"total_{c}"] = found[c].cumsum() + before
        self.so_far.update(tuple(int(found[f"total_{c}"].iloc[-1]) for c in ("n", "failed", "saved")))
        yield found[["run_id", "start", "n", "failed", "saved", "total_n", "total_failed", "total_saved"]]

    def close(self) -> None:
        pass


def running_totals(beats: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The beats of ``heartbeat`` and at each what its run has done so far; append mode.

    Beats of a run come in order, as the watermark passes them. What is kept are
    three numbers for each run, in the state store; no table is written again. Needs
    the RocksDB state store. State of a run is dropped ttl_ms after its last beat, if given.
    """
    kind = "run_id string, start timestamp, n long, failed long, saved long, total_n long, total_failed long, total_saved long"
    return beats.groupBy("run_id").transformWithStateInPandas(_Totals(ttl_ms), kind, "Append", "ProcessingTime" if ttl_ms else "None")


#: Small tables are merged by hash buckets of the run; a batch writes those that its runs are in.
BUCKETS = 1024


def kept(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table that ``keep_top`` or ``keep_recent`` maintains; None before the first."""
    found = versioned.read(spark, path)
    return None if found is None else found.drop("bucket")


def _merged(path: str, rows: DataFrame, keep: Callable[[DataFrame], DataFrame], keep_seconds: float) -> None:
    """Merge rows into the table at ``path``: the buckets of their runs are written anew and put in force at once.

    A merge that stops anywhere leaves the version before it in force, and running
    it again gives the same rows. Versions out of force for ``keep_seconds`` go.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int"))
    old = versioned.read(spark, path, only=rows.select("bucket"))
    both = rows if old is None else rows.unionByName(old)
    versioned.replace(spark, path, keep(both.dropDuplicates(["run_id", "seq"])).repartition("bucket"), "bucket")
    versioned.vacuum(spark, path, keep_seconds)


def keep_top(path: str, k: int = 3, keep_seconds: float = 3600) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the k best events of each run, in a table that each batch merges into.

    A batch that is run again changes nothing, since events are told apart by seq.
    """

    def merge(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            _merged(path, savings._saved(rows), lambda both: savings.top_by_run(both, k).drop("rank"), keep_seconds)

    return merge


def keep_recent(path: str, n: int = 25, keep_seconds: float = 3600) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the last n events of each run."""
    by_run = Window.partitionBy("run_id").orderBy(F.desc("seq"))

    def merge(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            _merged(path, rows, lambda both: both.withColumn("_n", F.row_number().over(by_run)).filter(F.col("_n") <= n).drop("_n"), keep_seconds)

    return merge
