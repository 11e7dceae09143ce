"""Literal cases and invariants of the table operators."""

import random

import pytest
from pyspark.sql import functions as F

from verilake.operators import catalog, events, outcomes, report, savings, verify
from verilake.plans import fixtures as fx

ATTEMPT = "run_id string, file string, seq long, status string, before long, after long, saved long, art long, blocks long"


def attempt(seq, status, saved=200, file=None, blocks=0, art=0):
    before = 0 if status in ("FAIL", "RETRY") else 1000
    return ("r", file or f"f{seq}", seq, status, before, before - saved if before else 0, saved if before else 0, art, blocks)


def attempts(spark, rows):
    return spark.createDataFrame(rows, ATTEMPT).repartition(3)


def test_counters_of_tries(spark):
    rows = [attempt(1, "OK"), attempt(2, "FAIL"), attempt(3, "RETRY"), attempt(4, "SKIPPED", 0), attempt(5, "WARN", 100), attempt(6, "OK", 50, blocks=2, art=30)]
    c = outcomes.count(attempts(spark, rows)).first()
    assert (c["processed"], c["successful"], c["ok"], c["warned"], c["failed"], c["skipped"], c["retried"]) == (5, 3, 2, 1, 1, 1, 1)
    assert (c["original_bytes"], c["new_bytes"], c["saved_bytes"], c["artwork_files"], c["artwork_blocks"]) == (3000, 2650, 350, 1, 2)


def test_only_a_retry_leaves_processed_at_zero(spark):
    assert outcomes.count(attempts(spark, [attempt(1, "RETRY")])).first()["processed"] == 0


def test_settle_takes_the_last_try(spark):
    rows = [attempt(1, "FAIL", file="a"), attempt(3, "OK", file="a"), attempt(2, "FAIL", file="a"), attempt(4, "FAIL", file="b")]
    found = {r["file"]: (r["status"], r["attempts"]) for r in outcomes.settle(attempts(spark, rows)).collect()}
    assert found == {"a": ("OK", 3), "b": ("FAIL", 1)}


def test_retry_decisions(spark):
    rows = [attempt(i, "FAIL", file="a") for i in range(1, 5)] + [attempt(9, "SKIPPED", file="b")]
    found = [r["decision"] for r in outcomes.decide(attempts(spark, rows), 3).orderBy("seq").collect()]
    assert found == ["RETRY", "RETRY", "FAIL", "FAIL", "SKIPPED"]


def test_top_three_and_ties(spark):
    rows = [attempt(1, "OK", 200), attempt(2, "OK", 600), attempt(3, "WARN", 1000), attempt(4, "OK", 500), attempt(5, "OK", 600), attempt(6, "FAIL")]
    assert [(r["saved"], r["seq"]) for r in savings.top(attempts(spark, rows), 3).orderBy("rank").collect()] == [(1000, 3), (600, 2), (600, 5)]
    assert savings.top_by_run(attempts(spark, rows), 3).count() == 3


def test_ring_of_25(spark):
    found = outcomes.recent(attempts(spark, [attempt(i, "OK") for i in range(30)]), 25).collect()
    assert sorted(r["seq"] for r in found) == list(range(5, 30))


def test_breakdown_adds_up(spark, sf):
    rows = savings.breakdown(outcomes.settle(fx.attempts(spark, sf))).collect()
    assert rows and all(r["audio_saved"] + r["artwork_saved"] + r["padding_saved"] == r["total_saved"] for r in rows if r["total_saved"] > 0)


def test_counters_add_up(spark, sf):
    rows = outcomes.count(outcomes.settle(fx.attempts(spark, sf))).collect()
    assert all(r["ok"] + r["warned"] + r["failed"] + r["skipped"] == r["processed"] for r in rows)


@pytest.mark.parametrize("n", [1, 7, 64])
def test_partitioning_changes_nothing(spark, sf, n):
    rows = fx.attempts(spark, sf)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(outcomes.settle(rows.repartition(n))) == key(outcomes.settle(rows))
    assert key(outcomes.decide(rows.repartition(n), 3)) == key(outcomes.decide(rows, 3))


@pytest.mark.parametrize("key", ["time", "file", "audio", "art", "pct", "verify", "status"])
def test_event_sort_is_total(spark, key):
    rows = [(f"/x/F{i % 3}", i, "OK" if i % 2 else "FAIL", i % 4, i % 5, float(i % 2), None, "d") for i in range(20)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "file string, seq long, status string, saved long, art long, pct double, verification string, detail string").repartition(4)
    for descending in (True, False):
        found = [r["seq"] for r in outcomes.event_sort(df, key, descending, 10).collect()]
        of = {"time": 1, "file": 0, "audio": 3, "art": 4, "pct": 5, "verify": 7, "status": 2}[key]
        by = sorted(rows, key=lambda r: r[1], reverse=True)
        by = sorted(by, key=lambda r: r[of].lower() if isinstance(r[of], str) else r[of], reverse=descending)
        assert found == [r[1] for r in by][:10]


def catalog_df(spark, rows):
    return spark.createDataFrame(rows, "dir string, stem string, ext string, size long").withColumn("name", F.concat_ws(".", "stem", "ext")).withColumn("path", F.concat_ws("/", "dir", "name"))


def test_temps(spark):
    files = catalog_df(spark, [("/a", "track", "flac", 1), ("/a", "track", "tmp", 1), ("/a", "orphan", "tmp", 1), ("/b", "track", "TMP", 1), ("/b", "track", "FLAC", 2)])
    assert sorted(map(tuple, catalog.stale_temps(files).collect())) == [("/a", "track"), ("/b", "track")]
    assert [tuple(r) for r in catalog.orphan_temps(files).collect()] == [("/a", "orphan")]


def test_repeated_paths_and_new_files(spark):
    files = catalog_df(spark, [("/a", "x", "flac", 1), ("/a", "y", "flac", 2)])
    both = catalog.union_roots(files, files.filter("stem = 'x'"))
    assert both.count() == 3 and {(r["path"], r["root_ordinal"]) for r in catalog.dedup(both).collect()} == {("/a/x.flac", 0), ("/a/y.flac", 0)}
    assert [r["stem"] for r in catalog.new_only(files.union(files), files.filter("stem = 'x'")).collect()] == ["y"]


def test_ranks_and_shards(spark):
    rows = [("/d", f"f{i:03}", "flac", (i * 37) % 50) for i in range(200)]
    files = catalog_df(spark, rows).repartition(5)
    found = [(r["size"], r["name"], r["rank"]) for r in catalog.ranked(files, *catalog.work_order(files)).collect()]
    assert [(s, n) for s, n, _ in sorted(found, key=lambda x: x[2])] == sorted(((s, n) for s, n, _ in found), key=lambda x: (-x[0], x[1]))
    assert sorted(r for *_, r in found) == list(range(1, 201))
    loads = [r["bytes"] for r in catalog.shard_loads(catalog.shard_plan(files, 4)).collect()]
    assert max(loads) - min(loads) <= 50
    assert catalog.deal_to_shards(catalog.shard_plan(files, 4), 4).rdd.getNumPartitions() == 4


def test_error_digest(spark):
    paths = spark.createDataFrame([("/b",), ("/a",), ("/a",), ("/c",), ("/d",), ("/e",)], "path string")
    assert [r["line"] for r in catalog.error_digest(paths).orderBy("ordinal").collect()] == ["/a", "/b", "/c", "... plus 2 more"]
    assert catalog.error_digest(paths.limit(0)).count() == 0


def test_digest_depends_on_order(spark):
    pieces = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "b"), (2, 2, "a")], "k int, pos int, t string")
    found = {r["k"]: r["digest"] for r in verify.stream_digest(pieces, "k", "pos", "t").collect()}
    assert found[1] == "187ef4436122d1cc2f40dc2b92f0eba0" and found[1] != found[2]


RUN = "run_id string, total_files long, run_canceled boolean, processed long, successful long, warned long, failed long, skipped long"


@pytest.mark.parametrize(
    ("counters", "want"),
    [
        (("r", 2, False, 2, 2, 0, 0, 0), ["All files processed successfully", "No errors occurred"]),
        (("r", 2, False, 2, 1, 0, 1, 0), ["Some files could not be verified", "There were errors"]),
        (("r", 3, True, 2, 1, 0, 1, 0), ["Processing canceled by user", "There were errors"]),
        (("r", 2, False, 2, 2, 1, 0, 0), ["All files compressed; 1 file(s) could not be written back", "Some compressed files could not be written back to their original location"]),
        (("r", 0, False, 0, 0, 0, 0, 0), [" 0 file(s) processed", "Processing complete", "No errors occurred"]),
    ],
)
def test_status_report(spark, counters, want):
    lines = [r["line"] for r in report.status_report(spark.createDataFrame([counters], RUN)).orderBy("line_no").collect()]
    assert all(w in lines for w in want) and lines[-1] == "End of status report"
    assert [x for x in lines if x in want] == want


def test_outcome(spark):
    rows = spark.createDataFrame([("a", 0, 2), ("b", 2, 0), ("c", 1, 1)], "run_id string, failed long, successful long")
    assert {r["run_id"]: (r["exit_code"], r["label"]) for r in report.outcome(rows).collect()} == {"a": (0, "Complete"), "b": (1, "Failed"), "c": (1, "Complete (with errors)")}


def test_events_of_all_kinds(spark):
    lines = ['{"type":"workerStarted","worker":1,"seq":1,"file":"a"}', '{"type":"workerStageChanged","worker":1,"seq":2,"stage":{"hashing":"source"}}', '{"type":"workerStageChanged","worker":1,"seq":3,"stage":"artwork"}', '{"type":"other"}', "no json"]
    found, bad = events.decode(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r["stage"] for r in found.orderBy("seq").collect()] == [None, "hashing-source", "artwork"]
    assert sorted(r["value"] for r in bad.collect()) == ["no json", '{"type":"other"}']


def test_sessions_close_only_when_idle(spark):
    rows = spark.createDataFrame([(1, i, f"2026-01-01 00:00:{s:02}") for i, s in enumerate((0, 1, 5))] + [(2, 9, "2026-01-01 00:00:00")], "k int, seq int, t string").withColumn("ts", F.to_timestamp("t"))
    found = events.sessions(rows, "k", "2 SECONDS")
    assert sorted((r["k"], r["session"], r["n"]) for r in found.collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
    busy = spark.createDataFrame([(1, "converting"), (2, "idle")], "k int, state string")
    assert {r["k"] for r in events.closed_sessions(found, busy, "k").collect()} == {2}


def test_scratch_tables(spark):
    from types import SimpleNamespace

    from verilake.sources import scratch

    with scratch.released(spark):
        df = scratch.cut(spark.range(5))
        path = df.inputFiles()[0]
        assert df.count() == 5
    with pytest.raises(Exception, match="(?i)not.exist|FILE_NOT_EXIST|FAILED_READ_FILE"):
        spark.read.parquet(path).count()
    far = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(far)


@pytest.mark.parametrize("key", ["a", None])
def test_running_counts_and_sums(spark, key):
    """Over ranges: keys of one row, of many, and a null one, as a window over the whole key gives them."""
    import random

    r = random.Random(6)
    rows = [(r.choice(["a", "b", key, key, key]), i, r.randrange(100)) for i in range(700)] + [(f"k{i}", i, 1) for i in range(50)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, seq long, v long").repartition(7)
    found = {(x["k"], x["seq"]): (x["nth"], x["so_far"]) for x in catalog.running(df, "k", ["seq"], so_far=F.col("v")).collect()}
    want, seen = {}, {}
    for k, i, v in sorted(rows, key=lambda x: x[1]):
        n, total = seen.get(k, (0, 0))
        seen[k] = want[k, i] = (n + 1, total + v)
    assert found == want
    assert catalog.running(df.limit(0), "k", ["seq"]).count() == 0


def test_canonical_paths(spark):
    from verilake.functions.text import canonical_path

    rows = ["/a/b", "/a//b/", "/a/./b", "/a/x/../b", "file:/a/b", "file:///a/b", "FILE:///a/b", "/../a/b", "a/../../b", "S3://Bucket/a/./b", "C:\\x\\..\\a", "", "/", "..", None]
    want = ["/a/b"] * 8 + ["../b", "s3://Bucket/a/b", "C:/a", "", "/", "..", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, p string")
    assert [r["c"] for r in df.select("i", canonical_path(F.col("p")).alias("c")).orderBy("i").collect()] == want


def test_sessions_of_a_hot_key(spark):
    """One user with most of the events lies in several ranges; times and counts are handed over."""
    import random

    r, at, rows = random.Random(7), 0, []
    for i in range(4000):
        at += r.choice([0, 1, 1, 2, 30])
        rows.append((r.choice([1, 1, 1, 1, 2, None]), i, at))
    df = spark.createDataFrame(rows, "k int, seq int, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    found = sorted(((r["k"] or 0, r["session"], r["n"]) for r in events.sessions(df, "k", "30 SECONDS").collect()))
    want, last = {}, {}
    for k, _, t in rows:
        k = k or 0
        n = want.setdefault(k, [])
        if k not in last or t >= last[k] + 30:
            n.append(0)
        n[-1] += 1
        last[k] = t
    assert found == sorted((k, j + 1, n) for k, own in want.items() for j, n in enumerate(own))
    placed = catalog.dealt(df.select("k", "ts", "seq"), "k", ["ts", "seq"])
    assert placed.filter("k = 1").select("_part").distinct().count() > 1
    assert events.sessions(df.limit(0), "k", "30 SECONDS").count() == 0


@pytest.mark.parametrize("value", [lambda i: i % 7, lambda i: None if i % 3 else i])
def test_the_row_before_across_ranges(spark, value):
    rows = [("a" if i % 5 else None, i, value(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, seq int, v int").repartition(3)
    found = {r["seq"]: r["was"] for r in catalog.with_previous(catalog.dealt(df, "k", ["seq"]), "k", F.col("v"), "was").collect()}
    want, last = {}, {}
    for k, i, v in rows:
        want[i] = last.get(k)
        last[k] = v
    assert found == want
    sizes = {(r["k"], r["n"]) for r in catalog.with_total(catalog.dealt(df, "k", ["seq"]), "k", "n").select("k", "n").distinct().collect()}
    assert sizes == {("a", 400), (None, 100)}


def test_digests_of_a_key_of_a_million_pieces(spark):
    """The pieces pass through a task one batch after the other, and through a tree of many tasks."""
    import hashlib

    pieces = spark.range(1_000_000).select(F.lit("k").alias("k"), F.col("id").alias("pos"), F.concat(F.lit("piece "), F.col("id").cast("string")).alias("t")).union(spark.createDataFrame([(None, 1, "x"), (None, 0, None), ("e", 0, "")], "k string, pos long, t string"))
    whole = hashlib.md5(b"".join(b"piece %d" % i for i in range(1_000_000))).hexdigest()
    found = {r["k"]: (r["digest"], r["n_pieces"]) for r in verify.stream_digest(pieces, "k", "pos", "t").collect()}
    assert found == {"k": (whole, 1_000_000), None: (hashlib.md5(b"x").hexdigest(), 2), "e": (hashlib.md5(b"").hexdigest(), 1)}
    h = lambda x: hashlib.sha256(x).hexdigest()
    nodes = [h(b"piece %d" % i) for i in range(1_000_000)]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 1024]).encode()) for i in range(0, len(nodes), 1024)]
    tree = {r["k"]: (r["digest"], r["n_pieces"]) for r in verify.tree_digest(pieces, "k", "pos", "t").collect()}
    assert tree == {"k": (nodes[0], 1_000_000), None: (h((h(b"") + h(b"x")).encode()), 2), "e": (h(b""), 1)}
    assert verify.tree_digest(pieces.limit(0), "k", "pos", "t").count() == 0 and verify.stream_digest(pieces.limit(0), "k", "pos", "t").count() == 0


def test_gaps_in_reports(spark):
    """Each kind of damage to the parts of a report is named, and an undamaged one has none."""
    from verilake.sources import logs

    body = lambda k, n, extra="": f"Part {k} of {n}\r\ntext {k}{extra}"
    import hashlib

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    last = lambda *others: body(3, 3) + "\r\n==== Parts checksum " + h("".join(h(x) for x in others))
    a, b, c = body(1, 3), body(2, 3), last(body(1, 3), body(2, 3))
    reports = {
        "whole": [(0, a, True), (1, b, True), (2, c, True)], "single": [(0, "no number", True)], "altered": [(0, a, True), (1, b, False), (2, c, True)], "no last": [(0, a, True), (1, b, True)],
        "moved": [(1, a, True), (0, b, True), (2, c, True)], "twice": [(0, a, True), (1, a, True), (2, c, True)], "other": [(0, body(1, 3, "!"), True), (1, b, True), (2, c, True)],
    }
    rows = spark.createDataFrame([(r, *x) for r, own in reports.items() for x in own], "report string, part int, body string, valid boolean")
    found = sorted(map(tuple, logs.report_gaps(rows).collect()), key=repr)
    want = [("altered", 1, "altered"), ("no last", 2, "missing"), ("moved", 0, "misplaced"), ("moved", 1, "misplaced"), ("twice", 1, "misplaced"), ("twice", 0, "doubled"), ("twice", 1, "missing"), ("other", None, "foreign")]
    assert found == sorted(want, key=repr)
