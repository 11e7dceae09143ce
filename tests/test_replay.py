"""Lots of a table, and streams that are started anew for each."""

import os

import pytest
from pyspark.sql import functions as F

from verilake.operators import outcomes
from verilake.plans import fixtures as fx
from verilake.sources import scratch
from verilake.streaming import live
from verilake.streaming.replay import append, lots, replay, replay_into, rocksdb


def seqs(df):
    return sorted((r["seq"] is not None, r["seq"] or 0) for r in df.collect())


@pytest.mark.parametrize("n", [1, 2, 5])
def test_lots_hold_every_row_once_and_in_order(spark, n):
    rows = spark.createDataFrame([(x,) for x in [None, None, 3, 3, 3, 3, 9, 1, 2, 70, 5]], "seq long")
    found = [seqs(x) for x in lots(rows, "seq", n)]
    assert sorted(sum(found, [])) == seqs(rows)
    filled = [x for x in found if x]
    assert all(a[-1] <= b[0] and a[-1] != b[0] for a, b in zip(filled, filled[1:], strict=False))  # equal values stay together
    assert found[0][:2] == [(False, 0), (False, 0)]


def test_lots_of_nothing(spark):
    none = spark.createDataFrame([], "seq long")
    assert [x.count() for x in lots(none, "seq", 3)] == [0]
    all_null = spark.createDataFrame([(None,), (None,)], "seq long")
    assert sum(x.count() for x in lots(all_null, "seq", 3)) == 2


def test_a_lot_is_a_filter_of_the_scan(spark, sf):
    second = lots(fx.attempts(spark, sf), "seq", 2)[1]
    assert "GreaterThan(event_id" in second._jdf.queryExecution().executedPlan().toString()


def test_a_stream_goes_on_where_the_one_before_stopped(spark):
    """The tries of a file are counted over lots, and each row is decided once."""
    rows = spark.createDataFrame([("r", f"f{i % 2}", i, "FAIL") for i in range(12)], "run_id string, file string, seq long, status string")
    want = sorted(map(tuple, outcomes.decide(rows, 4).select("run_id", "file", "seq", "attempt", "decision").collect()))
    for n in (1, 4):
        found = replay(rows, "seq", lambda stream: live.retries(stream, 4), n)
        assert sorted(map(tuple, found.collect())) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "run_id string, file string, seq long, status string")
    assert replay(none, "seq", lambda stream: live.retries(stream, 4)).count() == 0
    merged = []
    replay_into(none, "seq", lambda batch, _: merged.append(batch.count()))
    assert sum(merged) == 0


def test_nothing_is_left_but_the_result(spark):
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rows = spark.range(20).select(F.col("id").alias("seq"), (F.col("id") % 3).alias("worker"))
    before = set(os.listdir(scratch.shared_dir(spark).removeprefix("file:")))
    found = replay(rows, "seq", lambda stream: stream.groupBy("worker").agg(F.count("*").alias("n")), mode="complete")
    assert sorted(r["n"] for r in found.collect()) == [6, 7, 7]
    left = set(os.listdir(scratch.shared_dir(spark).removeprefix("file:"))) - before
    assert len(left) == 1 and next(iter(left)).startswith("given-")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == store


def test_what_fails_is_told_and_the_setting_is_put_back(spark):
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rows = spark.range(3).select(F.col("id").alias("seq"))
    with pytest.raises(Exception, match="(?i)no more"):
        replay(rows, "seq", lambda stream: stream.select(F.raise_error(F.lit("no more")).cast("string").alias("x")))
    with pytest.raises(ValueError), rocksdb(spark):
        raise ValueError
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == store


def test_lots_may_be_put_another_way(spark):
    """A lot of files that are written by tasks, found by a stream of a folder."""
    rows = spark.createDataFrame([(f"/lib/r{i % 2}/{i}.flac", i, bytes(i)) for i in range(1, 7)], "path string, size int, content binary")
    found = replay(rows, "size", lambda stream: stream.select("name", "size"), put=fx.write_files, opened=live.catalog)
    assert sorted(map(tuple, found.collect())) == [(f"{i}.flac", i) for i in range(1, 7)]
    one = scratch.scratch_path(spark, "once")
    append(rows.select("path"), one)
    append(rows.select("path"), one)
    assert spark.read.parquet(one).count() == 12


def _stages(spark):
    """Each stage so far and how many tasks it had."""
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {found.apply(i).stageId(): found.apply(i).numTasks() for i in range(found.size())}


def test_many_small_files_are_no_task_each(spark):
    """What a lot's files are listed with are tasks of many files; the settings end with the streams."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, known = spark.conf.get(name), set(_stages(spark))
    rows = spark.range(1, 301).select(F.format_string("/lib/r%d/%d.flac", F.col("id") % 3, "id").alias("path"), F.col("id").alias("size"), F.lit(b"x").alias("content"))
    found = replay(rows, "size", lambda stream: stream.select("name", "size"), put=fx.write_files, opened=live.catalog, conf=live.MANY_FILES)
    assert sorted(map(tuple, found.collect())) == sorted((f"{i}.flac", 1) for i in range(1, 301))
    assert max(n for i, n in _stages(spark).items() if i not in known) <= 100
    assert spark.conf.get(name) == before
