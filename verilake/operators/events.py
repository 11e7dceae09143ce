"""The event stream of workers, in its batch form.

Events have worker, seq (unique, in order of time), ts, type and, by type, file,
percent, stage, phase and hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verilake.operators.catalog import dealt, running, with_previous, with_running

EVENT_SCHEMA = "type string, worker long, seq long, ts timestamp, file string, percent int, ratio string, stage string, phase string, hash string, status string"
TYPES = ("workerStarted", "workerProgress", "workerStageChanged", "workerIdle", "hashComputed", "fileCompleted", "filesAdded", "runComplete")

#: What a worker in a state adds to the files done; a converting one adds its percentage.
WEIGHTS = {"hashing-output": 1.0, "artwork": 1.0, "finalizing": 1.0, "hashing-source": 0.05, "idle": 0.0}


def decode(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of JSON texts; a stage may be a word or {"hashing": "source"}."""
    parsed = lines.withColumn("e", F.from_json(F.col(column), EVENT_SCHEMA))
    known = F.coalesce(F.col("e.type").isin(*TYPES), F.lit(False))
    inner = F.get_json_object(F.col("stage"), "$.hashing")
    events = parsed.filter(known).select("e.*").withColumn("stage", F.when(inner.isNotNull(), F.concat(F.lit("hashing-"), inner)).otherwise(F.col("stage")))
    return events, parsed.filter(~known).select(column)


def with_file(events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """worker, seq, type, what to carry and current_file of every event: the file of its worker's last start; an idle worker has none.

    Starts and idle marks are counted along each worker's events, by ranges of
    them; an event takes the file of the mark that has its count. Events before
    the first mark meet none, and need no join.
    """
    marks = F.col("type").isin("workerStarted", "workerIdle")
    rows = running(events, "worker", ["seq"], carry=["type", "file", *carry], _mark=F.when(marks, 1)).drop("nth")
    files = rows.filter(marks).select("worker", "_mark", F.when(F.col("type") == "workerStarted", F.col("file")).alias("current_file"))
    shown = ["worker", "seq", "type", *carry]
    met = rows.filter("_mark > 0").join(files, ["worker", "_mark"], "left").select(*shown, "current_file")
    return met.unionByName(rows.filter("_mark = 0").select(*shown, F.lit(None).cast(events.schema["file"].dataType).alias("current_file")))


def progress_changes(events: DataFrame) -> DataFrame:
    """worker, seq, percent of the progress events whose percentage differs from the worker's one before, which is 0 at first."""
    own = events.filter((F.col("type") == "workerProgress") & F.col("percent").isNotNull()).select("worker", "seq", "percent")
    rows = with_previous(dealt(own, "worker", ["seq"]), "worker", F.col("percent"), "_before")
    return rows.filter(F.col("percent") != F.coalesce("_before", F.lit(0))).select("worker", "seq", "percent")


def hash_pairs(events: DataFrame) -> DataFrame:
    """worker, job (from 1), source_hash, output_hash: the hashes of each file a worker took up."""
    own = events.filter((F.col("type") == "workerStarted") | F.col("hash").isNotNull())  # nothing else has a part in it
    jobs = running(own, "worker", ["seq"], carry=["phase", "hash"], job=F.when(F.col("type") == "workerStarted", 1))
    of = lambda phase: F.max(F.when(F.col("phase") == phase, F.col("hash")))
    return jobs.filter((F.col("job") > 0) & F.col("hash").isNotNull()).groupBy("worker", "job").agg(of("source").alias("source_hash"), of("output").alias("output_hash"))


def worker_state(events: DataFrame) -> DataFrame:
    """The last state of each worker; one shuffle, no sort."""
    state = F.when(F.col("type").isin("workerIdle", "fileCompleted"), "idle").when(F.col("type") == "workerStageChanged", F.coalesce("stage", F.lit("converting"))).otherwise("converting")
    last = F.max_by(F.struct(state.alias("state"), F.coalesce("percent", F.lit(0)).alias("percent")), "seq").alias("last")
    return events.groupBy("worker").agg(last).select("worker", "last.*")


def histogram(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("n"))


def live_progress(states: DataFrame, processed: int, total: int) -> DataFrame:
    """Percent of all files done, busy workers counted in part, at most 100."""
    weight = F.col("percent") / 100.0
    for state, w in WEIGHTS.items():
        weight = F.when(F.col("state") == state, w).otherwise(weight)
    return states.agg(F.least(F.lit(100.0), F.round((F.lit(processed) + F.coalesce(F.sum(weight), F.lit(0.0))) * 100.0 / max(total, 1), 4)).alias("pct"))


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """key, session (from 1), start, end, n: spans of activity of each key that are parted by a pause of ``gap`` or more.

    Times are handed over from range to range of a key's events, and so are the
    sessions so far, so that a key of any length is many tasks' work.
    """
    rows = with_previous(dealt(events.select(key, "ts", "seq"), key, ["ts", "seq"]), key, F.col("ts"), "_before")
    opens = F.col("_before").isNull() | (F.col("ts") >= F.col("_before") + F.expr(f"INTERVAL {gap}"))
    counted = with_running(rows, key, session=F.when(opens, 1))
    return counted.groupBy(key, "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


def is_busy():
    """Whether an event leaves its worker at work."""
    return ~F.col("type").isin("workerIdle", "fileCompleted")


def closed_runs(events: DataFrame, gap: str, until=None) -> DataFrame:
    """run_id, start, end, n of each span of a run that is over: no worker was busy, and for ``gap`` nothing came.

    events has run_id, worker, seq, ts and type. A pause with a busy worker ends no
    span. The last span of a run is over if its workers are idle and ``until`` (a
    time up to which everything has come; the table's last event, if not given) is
    ``gap`` past it. By ranges of a run's and of a worker's events, as ``sessions``.
    """
    order = ["ts", "seq"]
    of_worker = dealt(events.select("run_id", "worker", *order, is_busy().cast("long").alias("busy")), ["run_id", "worker"], order)
    changes = with_previous(of_worker, ["run_id", "worker"], F.col("busy"), "was")
    of_run = dealt(changes.select("run_id", *order, (F.col("busy") - F.coalesce("was", F.lit(0))).alias("change")), "run_id", order)
    rows = with_previous(with_running(of_run, "run_id", busy=F.col("change")), "run_id", F.struct("ts", "busy"), "_before")
    opens = F.col("_before").isNull() | ((F.col("_before.busy") == 0) & (F.col("ts") >= F.col("_before.ts") + F.expr(f"INTERVAL {gap}")))
    spans = with_running(rows, "run_id", session=F.when(opens, 1)).groupBy("run_id", "session")
    found = spans.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.max_by("busy", F.struct("ts", "seq")).alias("busy"))
    last = Window.partitionBy("run_id").orderBy(F.desc("session"))  # rows are spans here
    now = found.agg(F.max("end").alias("now")) if until is None else events.sparkSession.range(1).select(F.lit(until).cast("timestamp").alias("now"))
    ended = found.withColumn("latest", F.row_number().over(last) == 1).join(F.broadcast(now))  # one row
    over = ~F.col("latest") | ((F.col("busy") == 0) & (F.col("now") >= F.col("end") + F.expr(f"INTERVAL {gap}")))
    return ended.filter(over).select("run_id", "start", "end", "n")


def closed_sessions(sessions_of: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Sessions that may close: the pause is over and no worker of the key is busy."""
    busy = states.filter(F.col("state") != "idle").select(key).distinct()
    return sessions_of.join(busy, key, "left_anti")
