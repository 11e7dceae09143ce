"""Readers and writers on files made here."""

import hashlib
import struct
import time

import pytest
from pyspark.sql import functions as F

from verilake.operators import catalog, report
from verilake.sources import blocks, files, listing, logs, publish, versioned


def block(kind, data, last=False):
    return bytes([kind | (0x80 if last else 0)]) + len(data).to_bytes(3, "big") + data


def stream_info(md5=bytes(range(16)), rate=44100, channels=2, bits=16, samples=88200):
    packed = (rate << 44) | ((channels - 1) << 41) | ((bits - 1) << 36) | samples
    return struct.pack(">HH", 4096, 4096) + bytes(6) + packed.to_bytes(8, "big") + md5


def picture(mime=b"image/png", description="Front".encode(), data=b"\x89PNG\r\n\x1a\n1234"):
    return struct.pack(">I", 3) + struct.pack(">I", len(mime)) + mime + struct.pack(">I", len(description)) + description + struct.pack(">IIIII", 500, 400, 24, 0, len(data)) + data


def comment(*items):
    out = struct.pack("<I", 3) + b"lib" + struct.pack("<I", len(items))
    for x in items:
        out += struct.pack("<I", len(x.encode())) + x.encode()
    return out


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    (root / "sub").mkdir()
    full = b"ID3junk" + b"fLaC" + block(0, stream_info()) + block(4, comment("ARTIST=foo", "TITLE=bär", "done_mark=1")) + block(6, picture()) + block(1, bytes(100), True) + b"frames"
    (root / "a.flac").write_bytes(full)
    (root / "sub" / "B.FLAC").write_bytes(b"fLaC" + block(0, stream_info(bytes(16))) + block(6, picture(b"-->", b"two\nlines", b"http://x")) + block(6, picture(), True))
    (root / "c.mp3").write_bytes(b"no")
    (root / "d.flac").write_bytes(b"broken")
    return root


def test_scan_in_any_case(spark, library):
    files = listing.scan(spark, [str(library)])
    assert sorted(r["name"] for r in files.collect()) == ["B.FLAC", "a.flac", "d.flac"]
    again = listing.scan(spark, [str(library), str(library / "a.flac")])
    assert catalog.dedup(again.withColumn("root_ordinal", F.lit(0))).count() == 3
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()


def test_block_inventory(spark, library):
    rows = blocks.inventory(blocks.read(spark, [str(library)]))
    found = {}
    for r in rows.orderBy("path", "block_number").collect():
        found.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["type"], r["length"], r["is_last"], r["truncated"]))
    assert [t for t, *_ in found["a.flac"]] == [0, 4, 6, 1] and found["a.flac"][-1][1:] == (100, True, False)
    assert [t for t, *_ in found["B.FLAC"]] == [0, 6, 6] and "d.flac" not in found
    in_memory = blocks.inventory(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", listing.any_case("flac")).load(str(library)))
    columns = ["block_number", "type", "offset", "length", "is_last", "truncated", "size", "data"]
    assert sorted(map(repr, in_memory.select(columns).collect())) == sorted(map(repr, rows.select(columns).collect()))
    assert blocks.unreadable(spark.createDataFrame([("file:/nowhere/x.flac",), (str(library / "a.flac"),)], "path string")).collect()[0][:2] == ("file:/nowhere/x.flac", "FileNotFoundError")


def test_a_file_of_gigabytes_is_read_by_its_headers(spark, tmp_path):
    """Sparse files, far above what a column can hold: what is read are headers, comments and pictures."""
    (tmp_path / "big").mkdir()
    head = b"fLaC" + block(0, stream_info()) + block(4, comment("A=1")) + block(1, bytes(1 << 20)) + block(6, picture(), True)
    for name, start in (("plain.flac", b""), ("tagged.flac", b"ID3\x04\x00\x00\x00\x10\x00\x00" + bytes(1 << 18))):
        with open(tmp_path / "big" / name, "wb") as f:
            f.write(start + head)
            f.truncate(5 << 29)
    rows = blocks.inventory(blocks.read(spark, [str(tmp_path / "big")])).orderBy("path", "block_number").collect()
    assert [(r["type"], r["size"]) for r in rows] == [(t, 5 << 29) for t in (0, 4, 1, 6)] * 2
    assert {r["prefix_bytes"] for r in blocks.foreign_prefix(blocks.read(spark, [str(tmp_path / "big")])).collect()} == {10 + (1 << 18)}
    assert blocks.pictures(blocks.inventory(blocks.read(spark, [str(tmp_path / "big")]))).count() == 2
    stores = files.Stores()
    source = files.Ranges(lambda: stores.open(str(tmp_path / "big" / "tagged.flac")))
    list(blocks._rows("x", source, blocks.CONTENTS))
    assert source.bytes_read < 1000


def test_broken_and_long_contents_take_no_time(spark, tmp_path):
    """A large picture of many segments, one of fill bytes, a file of zeros behind the marker and one without a marker."""
    seg = lambda kind, n: bytes([0xFF, kind]) + (n + 2).to_bytes(2, "big") + bytes(n)
    body = bytes(32 << 20)
    images = [b"\xff\xd8" + seg(0xE1, 20) * 300 + b"\xff\xda\x00\x02" + body, b"\xff\xd8" + b"\xff" * (32 << 20), b"\xff\xd8" + seg(0xE1, 9) + body]
    began = time.time()
    assert [blocks._segments(memoryview(x)) for x in images] == [300 * 24, None, None]
    contents = [b"fLaC" + bytes(64 << 20), bytes(64 << 20), b"fLaC" + block(0, stream_info()) + b"\x04\xff\xff\xff" + bytes(10)]
    found = [[r[3:9] for r in blocks._rows("x", files.Memory(c), blocks.CONTENTS)] for c in contents]
    assert time.time() - began < 3
    assert found[0] == [(0, 0, 9, 0, False, True)] and found[1][0][0] is None and [r[1] for r in found[2]] == [0, 4] and found[2][1][5]
    assert blocks._texts(memoryview(struct.pack("<II", 0, 1 << 31))) == [] and blocks._texts(memoryview(b"\x01")) == []


def test_stream_facts(spark, library):
    facts = blocks.stream_facts(blocks.inventory(blocks.read(spark, [str(library)])))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in facts.collect()}
    a = rows["a.flac"]
    assert (a["sample_rate"], a["channels"], a["bits"], a["samples"], a["raw_bytes"]) == (44100, 2, 16, 88200, 352800)
    assert a["embedded_md5"] == bytes(range(16)).hex() and rows["B.FLAC"]["embedded_md5"] is None
    assert sum(r["n_missing"] for r in blocks.missing_md5(facts).collect()) == 1


def test_prefix_pictures_padding_comments(spark, library):
    listed = blocks.read(spark, [str(library)])
    assert [(r["path"].rsplit("/", 1)[1], r["prefix_bytes"]) for r in blocks.foreign_prefix(listed).collect()] == [("a.flac", 7)]
    inventory = blocks.inventory(listed)
    found = {(r["path"].rsplit("/", 1)[1], r["block_number"]): r for r in blocks.pictures(inventory).collect()}
    front = found["a.flac", 2]
    assert (front["mime"], front["description"], front["width"], front["height"], front["data_length"], front["image"], front["is_url"], front["unsafe_to_rewrite"]) == ("image/png", "Front", 500, 400, 12, "png", False, False)
    assert found["B.FLAC", 1]["is_url"] and found["B.FLAC", 1]["unsafe_to_rewrite"]
    assert [(r["n"], r["n_files"]) for r in blocks.repeated_pictures(blocks.pictures(inventory)).collect()] == [(2, 2)]
    assert [(r["padding_bytes"], r["padding_blocks"]) for r in blocks.padding(inventory).collect()] == [(104, 1)]
    comments = blocks.comments(inventory)
    assert comments.first()["comments"] == ["ARTIST=foo", "TITLE=bär", "done_mark=1"]
    assert {r["tag"] for r in blocks.tag_counts(comments).collect()} == {"ARTIST", "TITLE", "DONE_MARK"}
    assert tuple(blocks.marker_coverage(comments, "DONE_MARK").first()) == (1, 1)


def test_jpeg_segments(spark):
    seg = lambda kind, n: bytes([0xFF, kind]) + (n + 2).to_bytes(2, "big") + bytes(n)
    good = b"\xff\xd8" + seg(0xE0, 14) + seg(0xE1, 20) + seg(0xFE, 5) + b"\xff\xda\x00\x02data"
    rows = spark.createDataFrame([(0, good), (1, b"\xff\xd8\xff\xd9"), (2, b"nothing"), (3, b"\xff\xd8" + seg(0xE1, 3))], "i int, c binary")
    assert [r["n"] for r in rows.select("i", blocks.strippable_jpeg_bytes(F.col("c")).alias("n")).orderBy("i").collect()] == [24 + 9, 0, None, None]


def test_containers_with_many_parts(spark):
    """More blocks, comments and segments than a usual file has."""
    marks = [f"T{i}={i}" for i in range(1500)]
    many = b"fLaC" + block(0, stream_info()) + b"".join(block(1, bytes(3)) for _ in range(200)) + block(4, comment(*marks)) + block(1, bytes(5), True)
    cut = b"fLaC" + block(0, stream_info()) + block(1, bytes(3))
    rows = spark.createDataFrame([("many", len(many), many), ("cut", len(cut), cut)], "path string, size long, content binary")
    found = blocks.inventory(rows)
    assert {(r["path"], r["truncated"]): r["n"] for r in found.groupBy("path", "truncated").agg(F.count("*").alias("n")).collect()} == {("many", False): 203, ("cut", True): 2}
    assert blocks.comments(found).first()["comments"] == marks
    assert blocks.padding(found.filter("path = 'many'")).first()["padding_bytes"] == 200 * 7 + 9
    seg = lambda kind, n: bytes([0xFF, kind]) + (n + 2).to_bytes(2, "big") + bytes(n)
    jpeg = b"\xff\xd8" + seg(0xE1, 20) * 400 + b"\xff\xda\x00\x02"
    assert spark.createDataFrame([(jpeg,)], "c binary").select(blocks.strippable_jpeg_bytes(F.col("c"))).first()[0] == 400 * 24


def test_a_bad_root_does_not_end_the_scan(spark, library):
    found, errors = listing.scan_with_errors(spark, [str(library / "sub"), str(library / "gone"), str(library / "a.flac")])
    assert sorted(r["name"] for r in found.collect()) == ["B.FLAC", "a.flac"]
    assert [(r["path"], r["error"]) for r in errors.collect()] == [(str(library / "gone"), "PATH_NOT_FOUND")]
    assert [r["line"] for r in catalog.error_digest(errors).collect()] == [str(library / "gone")]
    nothing, errors = listing.scan_with_errors(spark, [str(library / "gone")])
    assert nothing.count() == 0 and errors.count() == 1
    listed = listing.scan(spark, [str(library)])
    assert [r["error"] for r in listing.read_errors(listed, listed.filter("name <> 'd.flac'")).collect()] == ["UNREADABLE"]


def test_links_and_errors_inside_a_root(spark, tmp_path):
    root = tmp_path / "lib"
    (root / "a/b").mkdir(parents=True)
    (root / "a/b/x.flac").write_bytes(b"xx")
    (root / "y.FLAC").write_bytes(b"y")
    (root / "z.txt").write_bytes(b"z")
    (root / "a/x-link.flac").symlink_to(root / "a/b/x.flac")  # a file, a link to it,
    (root / "a/b/up").symlink_to(root / "a")  # a folder that holds itself,
    (root / "other").symlink_to(root / "a/b")  # another way to it,
    (root / "one").symlink_to(root / "two")  # links that lead nowhere
    (root / "two").symlink_to(root / "one")
    (root / "a/gone.flac").symlink_to(root / "nothing")
    files, errors = listing.scan_with_errors(spark, [str(root), str(root / "a")])
    assert sorted((r["path"].removeprefix(f"file:{root}/"), r["size"], r["root_ordinal"]) for r in files.collect()) == [("a/x-link.flac", 2, 0), ("y.FLAC", 1, 0)]
    found = {r["path"].removeprefix("file:").removeprefix(f"{root}/"): r["error"] for r in errors.collect()}
    assert found.pop("one") == found.pop("two") == "ELOOP" and found.pop("a/gone.flac") == "ENOENT"
    assert set(found.values()) == {"ELOOP"} and all(p.endswith("up") for p in found)
    assert listing.scan_with_errors(spark, [])[0].count() == 0


def test_a_deep_tree_is_dealt_to_tasks(spark, tmp_path):
    at = tmp_path
    for k in range(12):
        at = at / f"d{k}"
        at.mkdir()
        for j in range(5):
            (at / f"{j}.flac").write_bytes(b"1" * j)
            (at / f"e{j}").mkdir()
            (at / f"e{j}/in.flac").write_bytes(b"22")
    files, errors = listing.scan_with_errors(spark, [str(tmp_path)])
    assert files.count() == 12 * 10 and errors.count() == 0 and files.agg(F.sum("size")).first()[0] == 12 * (10 + 10)


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = [f"line {i}" + "\r" * (i % 2) for i in range(5000)]
    (tmp_path / "a.log").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.log").write_text("one\n\nthree\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = logs.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    of = lambda name: [r["line"] for r in sorted((r for r in rows if r["file"].endswith(name)), key=lambda r: r["line_no"])]
    assert of("a.log") == [f"line {i}" for i in range(5000)] and of("b.log") == ["one", "", "three"]
    assert sorted(r["line_no"] for r in rows if r["file"].endswith("a.log")) == list(range(5000))


def test_logs(spark, tmp_path):
    (tmp_path / "run.log").write_text("[2026-01-02 03:04:05] [OK] done\nnoise\n[2026-01-02 03:04:06] [WARN] a [b] c\n")
    rows = logs.run_log(logs.read_lines(spark, str(tmp_path / "run.log"))).orderBy("line_no").collect()
    assert [(r["level"], r["message"], r["corrupt"]) for r in rows] == [("SUCCESS", "done", None), (None, None, "noise"), ("WARN", "a [b] c", None)]
    (tmp_path / "pipe.log").write_text("2026-01-02 03:04:05 | SUCCESS | File done | Path: /a/b: c | Saved: 5 | Saved: 6\nbad\n")
    rows = logs.pipe_log(logs.read_lines(spark, str(tmp_path / "pipe.log"))).orderBy("line_no").collect()
    assert (rows[0]["level"], rows[0]["event"], rows[0]["fields"]) == ("SUCCESS", "File done", {"Path": "/a/b: c", "Saved": "6"}) and rows[1]["corrupt"] == "bad"


def test_progress(spark):
    texts = ["x: 5% complete, ratio=0.9\rx: 55% complete, ratio=0.652", "nothing", "999% complete, ratio=1.0", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [tuple(r["p"]) for r in df.select("i", logs.progress(F.col("t")).alias("p")).orderBy("i").collect()] == [(55, "0.652"), (0, None), (100, "1.0"), (0, None)]


def test_picture_listing(spark, tmp_path):
    (tmp_path / "list.txt").write_text(
        "METADATA block #1\n  type: 4 (VORBIS_COMMENT)\nMETADATA block #2\n  type: 6 (PICTURE)\n  MIME type: image/png\n  description: \n  width: 500\n  height: 500\n  depth: 24\n  colors: 0\n  data length: 123456\n"
        "METADATA block #3\n  type: 6 (PICTURE)\n  MIME type: image/jpeg\n  description: Back cover\n  width: 600\n  height: 600\n  depth: 24\n  data length: 78901\n"
    )
    rows = logs.picture_listing(logs.read_lines(spark, str(tmp_path / "list.txt"))).orderBy("block_number").collect()
    assert [(r["block_number"], r["mime"], r["description"], r["width"], r["data_length"]) for r in rows] == [(2, "image/png", "", 500, 123456), (3, "image/jpeg", "Back cover", 600, 78901)]


def test_report_round_trip(spark, tmp_path):
    event = ("r1", "a.flac", 1, "OK", 1000, 900, 100, 10.0, "12:00:00", "1", "MATCH", None, "a" * 32, "a" * 32, "none")
    rows = spark.createDataFrame([event, ("r1", "b.flac", 2, "FAIL", 0, 0, 0, 0.0, "12:00:01", "3", "FAIL|NO_HASH", None, None, None, "gone")], "run_id string, file string, seq long, status string, before long, after long, saved long, pct double, time string, attempt string, verification string, emb string, pre string, out string, detail string")
    runs = spark.createDataFrame([("r1", "/music/album", "1. May 2026, 1:00", "1. May 2026, 2:00", 4, 3, 2, False)], "run_id string, source_folder string, started string, finished string, threads int, max_attempts int, total_files long, run_canceled boolean")
    counters = spark.createDataFrame([("r1", 2, 1, 0, 1, 0)], "run_id string, processed long, successful long, warned long, failed long, skipped long")
    best = spark.createDataFrame([("r1", 1, "a.flac", 100, 10.0)], "run_id string, rank int, file string, saved long, pct double")
    texts = report.texts(runs, rows, counters, best)
    row = texts.first()
    assert row["text"].endswith(f"==== Log checksum {hashlib.sha256(row['body'].encode()).hexdigest()} ====\r\n")
    assert "\r\nalbum\r\n" in row["body"] and "     Audio delta          N/A\r\n" in row["body"]
    assert row["body"].endswith("End of status report\r\n\r\n---- Compression notes\r\n\r\n  1. Saved   100.00 B (10.00%) | a.flac")
    assert "Compression notes" not in report.texts(runs, rows, counters, best.limit(0)).first()["body"]
    publish.write_reports(texts, str(tmp_path / "reports"))
    checked = logs.report_check(logs.read_reports(spark, str(tmp_path / "reports" / "run_id=r1" / "part=0")))
    assert [r["valid"] for r in checked.collect()] == [True]
    files = {r["filename"]: r["fields"] for r in logs.report_files(checked).collect()}
    assert files["a.flac"]["Verification"] == "MATCH" and files["b.flac"]["Reason"] == "gone"
    (tmp_path / "bad.txt").write_text(row["text"].replace("album", "albun"), newline="")
    assert [r["valid"] for r in logs.report_check(logs.read_reports(spark, str(tmp_path / "bad.txt"))).collect()] == [False]


def test_long_reports_come_in_parts(spark):
    rows = spark.range(25).select(F.lit("r").alias("run_id"), F.col("id").alias("seq"), F.lit("OK").alias("status"), F.lit("f").alias("file"), *[F.lit(1).cast("long").alias(c) for c in ("before", "after", "saved")], F.lit(1.0).alias("pct"), *[F.lit("x").alias(c) for c in ("time", "attempt", "verification", "emb", "pre", "out", "detail")])
    assert sorted((r["part"], r["n_files"]) for r in report.report_parts(rows, report.numbered(rows, 10)).collect()) == [(0, 10), (1, 10), (2, 5)]


def test_a_run_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "results")
    one = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int")
    publish.write_runs(one, out)
    publish.write_runs(spark.createDataFrame([("r1", 9)], "run_id string, v int"), out)
    assert sorted((r["run_id"], r["v"]) for r in spark.read.parquet(out).collect()) == [("r1", 9), ("r2", 2)]


def test_failures_are_written_only_if_there_are_any(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "file string")
    assert publish.write_failures(rows, str(tmp_path / "f")) and not publish.write_failures(rows.limit(0), str(tmp_path / "g"))
    assert not (tmp_path / "g").exists()


def published_rows(spark, target, version=None):
    return sorted((r["id"], r["day"], r["v"]) for r in publish.published(spark, target, version).collect())


OLD, NEW = [(1, "x", "old"), (2, "y", "old"), (7, None, "old")], [(1, "x", "new"), (2, "y", "new"), (3, "y", "new"), (4, "z", "new"), (5, "007", "new"), (6, None, "new")]
MOVED = [(1, "x", "new"), (2, "y", "old"), (5, "007", "new"), (6, None, "new")]


def day_rows(spark, rows):
    return spark.createDataFrame(rows, "id int, day string, v string")


@pytest.fixture
def staged(spark, tmp_path):
    before = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    day_rows(spark, NEW).write.partitionBy("day").parquet(str(tmp_path / "staged"))
    verdicts = spark.createDataFrame([(1, True), (2, True), (3, False), (5, True), (5, True), (6, True)], "id int, passed boolean")
    yield lambda target: publish.publish_verified(spark, str(tmp_path / "staged"), target, verdicts, "id", "day")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", before)


def test_publish_only_what_passed(spark, tmp_path, staged):
    target = str(tmp_path / "target")
    assert publish.published(spark, target) is None
    versioned.replace(spark, target, day_rows(spark, OLD), "day")
    for _ in range(2):
        done = {r["day"]: r["published"] for r in staged(target).collect()}
        assert done == {"x": True, "y": False, "z": False, "007": True, None: True}
        assert published_rows(spark, target)[:] == MOVED
    assert published_rows(spark, target, 0) == OLD  # a reader that is on it still sees it
    assert versioned.versions(spark, target) == [0, 1, 2]


@pytest.mark.parametrize("step", ["write_rows", "prepare", "switch", "after"])
def test_a_publication_that_stops_shows_all_or_nothing(spark, tmp_path, staged, monkeypatch, step):
    target = str(tmp_path / "target")
    versioned.replace(spark, target, day_rows(spark, OLD), "day")

    def stop(*a, **b):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if step == "after":
            put = versioned.switch
            m.setattr(versioned, "switch", lambda *a: (put(*a), stop()))
        elif step == "write_rows":  # half of the files are there
            def half(rows, path, partition, write=versioned.write_rows):
                write(rows.limit(1), path, partition)
                stop()

            m.setattr(versioned, step, half)
        else:
            m.setattr(versioned, step, stop)
        with pytest.raises(RuntimeError):
            staged(target)
    assert published_rows(spark, target) == (MOVED if step == "after" else OLD)
    staged(target)
    assert published_rows(spark, target) == MOVED
    assert versioned.vacuum(spark, target, 3600) == []  # nothing is old enough
    gone = versioned.vacuum(spark, target, -60)
    assert gone and published_rows(spark, target) == MOVED and len(versioned.versions(spark, target)) == 1
    assert len(list((tmp_path / "target/data").glob("publication=*"))) == 2 and not list((tmp_path / "target/manifests").glob(".writing*"))


def test_two_writers_of_one_version(spark, tmp_path):
    target = str(tmp_path / "target")
    rows = day_rows(spark, OLD).select("id", "v", "day")
    plans = [versioned.prepare(spark, target, "day", rows, versioned.write_rows(rows, target, "day")) for _ in range(2)]
    versioned.switch(spark, target, *plans[0])
    with pytest.raises(versioned.Overtaken):
        versioned.switch(spark, target, *plans[1])
    assert published_rows(spark, target) == OLD and versioned.versions(spark, target) == [0]


def test_texts_of_reports_are_gone_through_once(spark):
    """what is asked of the parts several times are their numbers and checksums, not their texts."""
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame([("r", i, f"Part {i + 1} of 4\r\nx", i != 2) for i in range(3)], "report string, part int, body string, valid boolean")
    found = logs.report_gaps(rows.withColumn("body", F.udf(counted, "string").asNondeterministic()("body")))
    assert sorted(map(tuple, found.collect())) == [("r", 2, "altered"), ("r", 3, "missing")]
    assert seen.value == 3


def test_lines_of_a_section_are_taken_apart_once(spark):
    """not anew for each line of the section."""
    lines = [f"     {'Label ' + str(i % 3):20} value {i}" for i in range(6)]
    checked = spark.createDataFrame([("f", "\r\n".join(["head", "File", "", "     Filename a", "", *lines, ""]))], "file string, body string")
    files = logs.report_files(checked)
    assert files._jdf.queryExecution().analyzed().toString().count("split(section") == 1
    assert [(r["filename"], r["fields"]) for r in files.collect()] == [("a", {"Label 0": "value 3", "Label 1": "value 4", "Label 2": "value 5"})]


def test_footers_from_the_end(spark):
    """a footer is looked for in the last letters, with what a search of the whole text finds."""
    import re

    foot = "==== Log checksum " + "aB" * 32 + " ===="
    ends = ["\r\n\r\n", "\n\n", "\n\r\n", "\r\n\n", "\r\r\n\r\n", "\n\n\n", "\n", ""]
    texts = [b + e + foot + t for b in ("", "x", "x" * 300, "x\r\n\r\n" + foot + "y") for e in ends for t in ("", "\r\n", " \n" * 150, " ", " x")] + ["", "x" * 90, None]
    got = logs.report_check(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string"))
    whole = re.compile(r"^(.*?)\r?\n\r?\n==== Log checksum ([0-9A-Fa-f]{64}) ====[ \t\n\x0b\f\r]*[\x85  ]?\Z", re.S)
    want = {str(i): None if t is None else (m[1], m[2].lower()) if (m := whole.match(t)) else ("", "") for i, t in enumerate(texts)}
    assert {r["file"]: None if r["body"] is None else (r["body"], r["stated"]) for r in got.collect()} == want
    assert "right(text" in got._jdf.queryExecution().analyzed().toString()


def test_a_folder_is_not_held_whole(tmp_path, monkeypatch):
    """entries are given out while the folder is still being read."""
    import os

    for i in range(5):
        (tmp_path / f"{i}.flac").write_bytes(b"x")
    asked, real = [], os.scandir

    def counted(path):
        for e in real(path):
            asked.append(e.name)
            yield e

    monkeypatch.setattr(files.os, "scandir", counted)
    found = files.entries(files.Stores(), str(tmp_path), str(tmp_path))
    assert next(found).kind == "file" and len(asked) == 1
    assert len(list(found)) == 4
    monkeypatch.undo()
    assert [e.error for e in files.entries(files.Stores(), str(tmp_path / "gone"), str(tmp_path / "gone"))] == ["ENOENT"]
