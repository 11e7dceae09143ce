"""Attempts, retries and final outcomes.

An attempt has run_id, file, seq (unique, in order of time), status, before,
after, saved, art and blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verilake.operators.catalog import running

SUCCESS = ("OK", "WARN")


def savings(before: Column, after: Column) -> tuple[Column, Column]:
    """(bytes saved, percent of before): both may be negative, the percentage is 0 for nothing."""
    saved = before - after
    return saved, F.when(before > 0, saved * 100.0 / F.nullif(before, F.lit(0))).otherwise(0.0)


def numbered(attempts: DataFrame) -> DataFrame:
    """With each file's tries counted within its run, from 1 at the first and after every success."""
    of_file = Window.partitionBy("run_id", "file")
    before = of_file.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = attempts.withColumn("_won", F.coalesce(F.count_if(F.col("status").isin(*SUCCESS)).over(before), F.lit(0)))
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy("run_id", "file", "_won").orderBy("seq"))).drop("_won")


def decide(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """What follows each try: RETRY after a failure while tries are left and it makes sense, else its status."""
    again = (F.col("status") == "FAIL") & (F.col("attempt") < max_attempts)
    if "retryable" in attempts.columns:
        again &= F.col("retryable")
    return numbered(attempts).withColumn("decision", F.when(again, "RETRY").otherwise(F.col("status")))


def settle(attempts: DataFrame) -> DataFrame:
    """The last try of each file in its run, and how many there were; one shuffle, no sort."""
    last = F.max_by(F.struct("status", "before", "after", "saved", "art", "blocks"), "seq").alias("last")
    return attempts.groupBy("run_id", "file").agg(F.count("*").alias("attempts"), F.max("seq").alias("seq"), last).select("run_id", "file", "seq", "attempts", "last.*")


def _counters() -> list[Column]:
    ok, warn, success = F.col("status") == "OK", F.col("status") == "WARN", F.col("status").isin(*SUCCESS)
    of = lambda c, name: F.coalesce(F.sum(F.when(success, F.col(c))), F.lit(0)).alias(name)
    return [
        F.count_if(F.col("status") != "RETRY").alias("processed"), F.count_if(success).alias("successful"), F.count_if(ok).alias("ok"), F.count_if(warn).alias("warned"),
        F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"), F.count_if(F.col("status") == "RETRY").alias("retried"),
        of("before", "original_bytes"), of("after", "new_bytes"), of("saved", "saved_bytes"), of("art", "artwork_saved"),
        F.count_if(success & (F.col("blocks") > 0)).alias("artwork_files"), of("blocks", "artwork_blocks"),
    ]


def count(attempts: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Counters of each run, over tries or, for settled rows, over files. WARN counts as a success."""
    return attempts.groupBy(*keys).agg(*_counters())


def attempt_stats(attempts: DataFrame) -> DataFrame:
    return numbered(attempts).groupBy("attempt").agg(F.count("*").alias("n_files"))


def recent(events: DataFrame, n: int) -> DataFrame:
    """The last n events of each run; the window keeps n of a run before the shuffle."""
    return events.withColumn("nth", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq")))).filter(F.col("nth") <= n)


def running_progress(events: DataFrame, every: int) -> DataFrame:
    """run_id, seq, done, saved_so_far: events done and bytes saved at every n-th event of a run and at its last; a run may be of any length."""
    rows = running(events, "run_id", ["seq"], saved_so_far=F.col("saved")).withColumnRenamed("nth", "done")
    last = rows.groupBy("run_id").agg(F.max("done").alias("_last"))
    return rows.join(last, "run_id").filter((F.col("done") % every == 0) | (F.col("done") == F.col("_last"))).drop("_last")


def event_order(key: str, descending: bool) -> list[Column]:
    """An event table's order: by time, file, audio, art, pct, verify or status, then newest first."""
    by = {
        "time": lambda: F.col("seq"), "file": lambda: F.lower("file"), "audio": lambda: F.col("saved"), "art": lambda: F.col("art"), "pct": lambda: F.col("pct"),
        "verify": lambda: F.lower(F.coalesce("verification", "detail", F.lit(""))), "status": lambda: F.col("status"),
    }[key]()
    return [by.desc() if descending else by.asc(), F.desc("seq")]


def event_sort(events: DataFrame, key: str, descending: bool, limit: int | None = None) -> DataFrame:
    """Events in the order of a key, newest first among equals; the limit comes after the order."""
    rows = events.orderBy(*event_order(key, descending))
    return rows if limit is None else rows.limit(limit)
