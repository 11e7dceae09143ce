"""A stream gives what the batch operator gives, however the input is split."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from verilake.operators import events, outcomes, savings
from verilake.plans import fixtures as fx
from verilake.sources import versioned
from verilake.streaming import live

ATTEMPT = "run_id string, file string, seq long, ts timestamp, status string, before long, after long, saved long, art long, blocks long"


def run(stream, mode, name, spark):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


@pytest.fixture(scope="module")
def split_attempts(spark, sf, tmp_path_factory):
    rows = fx.attempts(spark, sf).select(*[c.split()[0] for c in ATTEMPT.split(", ")])
    path = str(tmp_path_factory.mktemp("attempts"))
    top = rows.agg(F.max("seq")).first()[0] + 1
    for i in range(5):  # one file after the other: a stream takes them in this order
        rows.filter((F.col("seq") * 5 / top).cast("int") == i).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return rows, path


def stream_of(spark, path, files=1):
    return spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", files).parquet(path)


@pytest.mark.parametrize("files", [1, 3])
def test_counters(spark, split_attempts, files):
    rows, path = split_attempts
    found = run(live.counters(stream_of(spark, path, files)), "complete", f"counters{files}", spark)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, outcomes.count(rows).collect()))


def test_retries(spark, split_attempts):
    rows, path = split_attempts
    found = run(live.retries(stream_of(spark, path), 3), "append", "retries", spark)
    want = outcomes.decide(rows, 3).select("run_id", "file", "seq", "attempt", "decision")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_top_and_recent(spark, split_attempts, tmp_path):
    rows, path = split_attempts
    for name, sink in (("top", live.keep_top(str(tmp_path / "top"))), ("recent", live.keep_recent(str(tmp_path / "recent")))):
        q = stream_of(spark, path).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
        q.processAllAvailable()
        q.stop()
    key = lambda df: sorted((r["run_id"], r["seq"]) for r in df.collect())
    assert key(live.kept(spark, str(tmp_path / "top"))) == key(savings.top_by_run(rows, 3))
    assert key(live.kept(spark, str(tmp_path / "recent"))) == key(outcomes.recent(rows, 25))
    live.keep_top(str(tmp_path / "top"))(rows, 0)  # a batch that is run again
    assert key(live.kept(spark, str(tmp_path / "top"))) == key(savings.top_by_run(rows, 3))


@pytest.mark.parametrize("step", ["write_rows", "prepare", "switch", "vacuum"])
def test_a_merge_that_stops_loses_nothing(spark, split_attempts, tmp_path, monkeypatch, step):
    rows, _ = split_attempts
    path, key = str(tmp_path / "top"), lambda df: sorted((r["run_id"], r["seq"]) for r in df.collect())
    assert live.kept(spark, path) is None
    half = rows.filter("seq % 2 = 0")
    live.keep_top(path)(half, 0)

    def stop(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versioned, step, stop)
        with pytest.raises(RuntimeError):
            live.keep_top(path)(rows, 1)
    assert key(live.kept(spark, path)) == key(savings.top_by_run(rows if step == "vacuum" else half, 3))
    live.keep_top(path)(rows, 1)
    assert key(live.kept(spark, path)) == key(savings.top_by_run(rows, 3))


def test_a_batch_writes_the_buckets_of_its_runs_alone(spark, tmp_path):
    path = str(tmp_path / "top")
    rows = lambda lo, hi, seq: spark.range(lo, hi).select(F.concat(F.lit("run-"), "id").alias("run_id"), F.concat(F.lit("f"), "id").alias("file"), (F.col("id") + seq).alias("seq"), F.lit("OK").alias("status"), F.lit(9).cast("long").alias("before"), F.lit(4).cast("long").alias("after"), F.lit(5).cast("long").alias("saved"))
    live.keep_top(path)(rows(0, 100_000, 0), 0)
    live.keep_top(path)(rows(70, 80, 1_000_000), 1)
    files = [len(list((tmp_path / "top/data" / f"publication={r['publication']}").glob("bucket=*/*.parquet"))) for r in versioned.manifest(spark, path).select("publication").distinct().collect()]
    assert sorted(files)[0] <= 10 and len(files) == 2 and sorted(files)[1] == live.BUCKETS
    found = live.kept(spark, path)
    assert found.count() == 100_010 and found.filter("run_id = 'run-75'").count() == 2
    live.keep_top(path)(rows(0, 0, 0), 2)  # a batch of nothing
    assert versioned.versions(spark, path) == [0, 1]


def test_old_versions_go_by_age(spark, tmp_path):
    path = str(tmp_path / "recent")
    row = lambda i: spark.createDataFrame([("r", "f", i, None, "OK", 1, 1, 0, 0, 0)], ATTEMPT)
    for i in range(4):
        live.keep_recent(path)(row(i), i)
    slow = versioned.read(spark, path, 0)
    assert versioned.versions(spark, path) == [0, 1, 2, 3] and slow.count() == 1  # a slow reader keeps its version
    live.keep_recent(path, keep_seconds=-60)(row(4), 4)
    assert versioned.versions(spark, path) == [4] and sorted(r["seq"] for r in live.kept(spark, path).collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("files", [1, 4])
def test_fatal_failures_are_not_tried_again(spark, tmp_path, files):
    """Batch and stream decide alike on errors that no further try helps."""
    said = ["FAIL", "FAIL", "OK", "FAIL", "FAIL", "FAIL", "FAIL"]
    fatal = [False, True, False, True, None, False, False]
    rows = spark.createDataFrame([("r", "f", i, None, x, 1, 1, 0, 0, 0, None if k is None else not k) for i, (x, k) in enumerate(zip(said, fatal, strict=True))], ATTEMPT + ", retryable boolean")
    want = [(r["seq"], r["attempt"], r["decision"]) for r in outcomes.decide(rows, 3).orderBy("seq").collect()]
    assert [d for *_, d in want] == ["RETRY", "FAIL", "OK", "FAIL", "FAIL", "FAIL", "FAIL"]
    for i in range(7):
        rows.filter(F.col("seq") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "one"))
        time.sleep(0.02)
    stream = spark.readStream.schema(ATTEMPT + ", retryable boolean").option("maxFilesPerTrigger", files).parquet(str(tmp_path / "one"))
    found = run(live.retries(stream, 3), "append", f"fatal{files}", spark)
    assert [(r["seq"], r["attempt"], r["decision"]) for r in found.orderBy("seq").collect()] == want


def test_a_success_clears_the_tries(spark, tmp_path):
    row = lambda i, status: ("r", "f", i, None, status, 1, 1, 0, 0, 0)
    said = ["FAIL", "FAIL", "OK", "FAIL", "FAIL", "FAIL", "FAIL", "WARN", "SKIPPED", "FAIL"]
    want = [(1, "RETRY"), (2, "RETRY"), (3, "OK"), (1, "RETRY"), (2, "RETRY"), (3, "FAIL"), (4, "FAIL"), (5, "WARN"), (1, "SKIPPED"), (2, "RETRY")]
    rows = spark.createDataFrame([row(i, x) for i, x in enumerate(said)], ATTEMPT)
    assert [(r["attempt"], r["decision"]) for r in outcomes.decide(rows, 3).orderBy("seq").collect()] == want
    for i in range(10):
        rows.filter(F.col("seq") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "one"))
        time.sleep(0.02)
    found = run(live.retries(stream_of(spark, str(tmp_path / "one")), 3), "append", "cleared", spark)
    assert [(r["attempt"], r["decision"]) for r in found.orderBy("seq").collect()] == want


def test_decoded_events_and_worker_state(spark, sf, tmp_path):
    rows = fx.pipeline(spark, sf)
    lines = rows.select("seq", F.to_json(F.struct(*rows.columns)).alias("value")).repartitionByRange(3, "seq").select("value")
    lines.write.mode("overwrite").text(str(tmp_path / "events"))
    stream = live.read_events(spark, str(tmp_path / "events"), 1)
    found = run(live.worker_state(stream), "complete", "workers", spark)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, events.worker_state(rows).collect()))


def timed(spark, tmp_path, groups):
    """A stream of JSON files, one after the other: the file source goes by the times of the files."""
    path = tmp_path / "timed"
    path.mkdir()
    for i, rows in enumerate(groups):
        (path / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(path / f"{i}.json", (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))
    return spark.readStream.schema("worker long, seq long, ts timestamp, type string, percent int, run_id string, status string, saved long").option("maxFilesPerTrigger", 1).json(str(path))


def event(seq, ts, **more):
    return {"worker": 1, "seq": seq, "ts": f"2026-01-01T00:{ts}Z", "type": "workerProgress", "percent": seq, "run_id": "r", "status": "OK", "saved": 10} | more


def test_runs_close_after_the_pause(spark, tmp_path):
    stream = timed(spark, tmp_path, [[event(1, "00:00"), event(2, "00:01"), event(3, "00:05")], [event(4, "30:00")], [event(5, "30:01")]])
    found = run(live.closed_runs(stream, "worker"), "append", "closed", spark).orderBy("start").collect()
    assert [r["n"] for r in found] == [2, 1]  # the last one waits for the watermark


def test_progress_and_heartbeat(spark, tmp_path):
    rows = [event(1, "00:00.010"), event(3, "00:00.090"), event(2, "00:00.050"), event(4, "00:00.150"), event(9, "00:25.000", status="FAIL")]
    random.Random(2).shuffle(rows)
    stream = timed(spark, tmp_path, [rows, [event(10, "40:00")], [event(11, "40:01")]])
    found = run(live.coalesced_progress(stream), "append", "progress", spark).orderBy("start").collect()
    assert [r["percent"] for r in found] == [3, 4, 9]
    beats = run(live.heartbeat(stream), "append", "beats", spark).orderBy("start").collect()
    assert [(r["n"], r["failed"], r["saved"]) for r in beats] == [(4, 0, 40), (1, 1, 0)]
    totals = run(live.running_totals(live.heartbeat(stream)), "append", "totals", spark).orderBy("start").collect()
    assert [(r["total_n"], r["total_failed"], r["total_saved"]) for r in totals] == [(4, 0, 40), (5, 1, 40)]


def split(rows, n):
    size = -(-len(rows) // n)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def clock(ms):
    return f"{ms // 60000:02}:{ms // 1000 % 60:02}.{ms % 1000:03}"


def worked(seed=3, n=120):
    """Events of two runs of three workers with pauses around a second and a half, most of them while a worker is busy."""
    r, at, rows = random.Random(seed), 0, []
    for seq in range(n):
        at += r.choice([50, 200, 700, 1400, 1500, 1600, 4000])
        kind = r.choice(["workerStarted", "workerProgress", "fileCompleted", "workerIdle", "workerIdle", "fileCompleted"])
        rows.append(event(seq, clock(at), worker=r.randrange(3), type=kind, run_id=r.choice(["a", "a", "b"])))
    return rows, at


@pytest.mark.parametrize("files", [1, 3, 10])
def test_runs_close_when_all_workers_are_idle(spark, tmp_path, files):
    """However the events are split, the spans of the batch operator."""
    rows, at = worked()
    own = spark.createDataFrame([(x["run_id"], x["worker"], x["seq"], x["ts"], x["type"]) for x in rows], "run_id string, worker long, seq long, t string, type string").withColumn("ts", F.to_timestamp("t"))
    want = sorted((r["run_id"], r["start"], r["end"], r["n"]) for r in events.closed_runs(own, "1500 MILLISECONDS", "2026-01-01 00:59:00").collect())
    assert len(want) > 5 and sum(n for *_, n in want) <= len(rows)
    last = event(999, "59:00", run_id="end", worker=9, type="workerIdle")
    stream = timed(spark, tmp_path, [*split(rows, files), [last], [last | {"seq": 1000}]])
    found = run(live.idle_runs(stream), "append", f"idle{files}", spark).filter("run_id <> 'end'").collect()
    assert sorted((r["run_id"], r["start"], r["end"], r["n"]) for r in found) == want


def test_a_paused_run_with_a_busy_worker_stays_open(spark, tmp_path):
    e = lambda seq, at, worker, kind: event(seq, at, worker=worker, type=kind)
    rows = [e(1, "00:00", 1, "workerStarted"), e(2, "00:01", 2, "workerStarted"), e(3, "00:02", 2, "fileCompleted"), e(4, "05:00", 1, "fileCompleted"), e(5, "05:01.400", 2, "workerIdle"), e(6, "05:03", 1, "workerStarted")]
    tick = lambda seq, at: event(seq, at, run_id="other", worker=7, type="workerIdle")
    stream = timed(spark, tmp_path, [[rows[0], rows[1], rows[2]], [tick(90, "04:00")], [rows[3], rows[4]], [rows[5]], [tick(91, "50:00")], [tick(92, "51:00")]])
    found = run(live.idle_runs(stream), "append", "paused", spark).filter("run_id = 'r'").collect()
    assert [(r["n"], r["end"].minute, r["end"].second) for r in found] == [(5, 5, 1)]  # one span over four minutes; the next is still busy


@pytest.mark.parametrize("files", [1, 3, 10])
def test_progress_that_changes(spark, tmp_path, files):
    r = random.Random(4)
    rows = [event(i, clock(100 * i), worker=r.randrange(3), percent=r.choice([0, 0, 10, 10, 20]), type=r.choice(["workerProgress"] * 4 + ["workerIdle"])) for i in range(200)]
    own = spark.createDataFrame([(x["worker"], x["seq"], x["type"], x["percent"]) for x in rows], "worker long, seq long, type string, percent int")
    want = sorted(map(tuple, events.progress_changes(own).collect()))
    found = run(live.changed_progress(timed(spark, tmp_path, split(rows, files))), "append", f"changes{files}", spark)
    assert sorted(map(tuple, found.collect())) == want and 0 < len(want) < 150


@pytest.mark.parametrize("files", [1, 3, 10])
def test_totals_in_the_state(spark, tmp_path, files):
    """Beats and what was done by each, for any split; nothing but three numbers of a run is kept."""
    r = random.Random(5)
    rows = [event(i, clock(3000 * i), run_id=r.choice("ab"), status=r.choice(["OK", "FAIL"]), saved=i) for i in range(150)]
    stream = timed(spark, tmp_path, [*split(rows, files), [event(998, "58:00", run_id="end")], [event(999, "59:00", run_id="end")]])
    found = run(live.running_totals(live.heartbeat(stream)), "append", f"so_far{files}", spark).filter("run_id <> 'end'").collect()
    for run_id in "ab":
        own = sorted((x for x in found if x["run_id"] == run_id), key=lambda x: x["start"])
        n = failed = saved = 0
        for x in own:
            n, failed, saved = n + x["n"], failed + x["failed"], saved + x["saved"]
            assert (x["total_n"], x["total_failed"], x["total_saved"]) == (n, failed, saved)
        mine = [x for x in rows if x["run_id"] == run_id]
        assert (n, failed, saved) == (len(mine), sum(x["status"] == "FAIL" for x in mine), sum(x["saved"] for x in mine if x["status"] == "OK"))


def test_files_that_appear(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.flac").write_bytes(b"1")
    q = live.catalog(spark, str(root)).writeStream.format("memory").queryName("appear").start()
    q.processAllAvailable()
    (root / "B.FLAC").write_bytes(b"22")
    (root / "c.txt").write_bytes(b"3")
    q.processAllAvailable()
    q.stop()
    assert sorted((r["name"], r["size"]) for r in spark.table("appear").collect()) == [("B.FLAC", 2), ("a.flac", 1)]


def test_state_of_a_file_is_asked_once():
    """a file's rows come as rows, and its state is asked once and touched no more than it must be."""
    from pyspark.sql import Row

    class State:
        def __init__(self, value):
            self.value, self.calls = value, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.calls.append("clear")
            self.value = None

    def run(before, *tries):
        made = live._Retries(3, None)
        made.tries = State(before)
        out = list(made.handleInputRows(("r", "f"), iter([Row(seq=s, status=x, retryable=y) for s, x, y in tries]), None))
        return [(r.seq, r.attempt, r.decision) for r in out], made.tries.value, made.tries.calls

    assert run(None, (2, "OK", True), (1, "FAIL", True)) == ([(1, 1, "RETRY"), (2, 2, "OK")], None, ["get"])
    assert run((1,), (3, "FAIL", False), (4, "FAIL", True)) == ([(3, 2, "FAIL"), (4, 3, "FAIL")], (3,), ["get", "update"])
    assert run((2,), (5, "WARN", True)) == ([(5, 3, "WARN")], None, ["get", "clear"])
