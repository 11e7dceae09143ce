"""Literal cases of the scalar functions."""

import itertools

import pytest
from pyspark.sql import functions as F

from verilake.functions import classes, text


def values(spark, rows, expression, schema="x string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {schema}").repartition(3)
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_savings_tiers(spark):
    assert values(spark, [20.0, 50.0, 19.9, 10.0, 9.9, 5.0, 4.9, 0.1, 0.0, -1.0], classes.savings_tier, "x double") == ["excellent", "excellent", "good", "good", "fair", "fair", "poor", "poor", "none", "none"]


def test_fine_tiers(spark):
    rows = ["20%", "15%", "10.0%", "6", "3%", "1.01%", "1%", "0.5%", "0%", "-2%", "N/A", "", None]
    want = ["exceptional", "very high", "high", "strong", "moderate", "light", "minimal", "minimal", "unchanged", "larger", "unknown", "unknown", "unknown"]
    assert values(spark, rows, classes.savings_tier_fine) == want


def test_bytes(spark):
    rows = [0, 1, 1023, 1024, 1536, -1536, 1 << 20, 5 << 30]
    assert values(spark, rows, text.format_bytes, "x long") == ["0 B", "1 B", "1023 B", "1.00 KB", "1.50 KB", "-1.50 KB", "1.00 MB", "5.00 GB"]
    assert values(spark, rows, lambda x: text.format_bytes(x, signed=True), "x long")[1] == "+1 B"
    assert values(spark, [0, 1536, -5, 1 << 50], lambda x: text.format_bytes_padded(x, units=6), "x long") == ["   00.00 B", "   01.50 KB", "   00.00 B", "   01.00 PB"]
    assert values(spark, [-1536, 1536], lambda x: text.format_bytes_padded(x, signed=True), "x long") == ["-  01.50 KB", "   01.50 KB"]
    assert values(spark, [10, 1536, 3 << 20], text.format_bytes_short, "x long") == ["10 B", "1.5 KB", "3.0 MB"]
    assert values(spark, [-3, 0, 2048], text.format_bytes_ui, "x long") == ["0 B", "0 B", "2.00 KB"]


def test_elapsed(spark):
    assert values(spark, [0, 59, 3600, 86399, 86400, 90061, -5], text.format_elapsed, "x long") == ["00:00:00", "00:00:59", "01:00:00", "23:59:59", "1d 00:00:00", "1d 01:01:01", "00:00:00"]
    assert values(spark, [59, 3600], text.format_elapsed_short, "x long") == ["00:59", "01:00:00"]


def test_percent_has_no_negative_zero(spark):
    assert values(spark, [-0.001, 0.004, 12.345, -3.5], text.format_percent, "x double") == ["0.00%", "0.00%", "12.35%", "-3.50%"]


def test_report_datetime(spark):
    assert values(spark, [1772683500000], text.report_datetime, "x long") == ["5. March 2026, 4:05"]


def test_names(spark):
    assert values(spark, ["/a/b.flac", "a\\c.flac", "d", ""], text.leaf_name) == ["b.flac", "c.flac", "d", ""]
    assert values(spark, [["/m/album/"], ["C:\\x\\y"], ["/"], ["/a", "/b"]], text.collection_label, "x array<string>") == ["album", "y", "/", "[multifolder] (2 folders)"]
    assert values(spark, ["a/b:c", "  x   y. ", "...", "é" * 3, "z" * 150], text.safe_name) == ["a_b_c", "x y", "job", "___", "z" * 100]


def test_uris(spark):
    rows = ["c://m/document/audio%3A12345", "c://e/primary%3AMusic%2Ftrack.flac", "", "c://x/a%20b+c%ZZ", "c://x/song.FLAC", "c://x/t%C3%A9st"]
    assert values(spark, rows, text.uri_leaf) == ["audio-12345.flac", "track.flac", ".flac", "a-b-c-ZZ.flac", "song.FLAC", "tést.flac"]


def test_snippet(spark):
    assert values(spark, [" a \n\t b ", "", "  ", None, "x" * 500], text.error_snippet) == ["a b", "(none)", "(none)", "(none)", "x" * 400 + "..."]


def test_errors(spark):
    rows = ["Access is denied", "x PERMISSION DENIED y", "readonly volume", "disk full", "", None, classes.FATAL_PHRASES[0]]
    assert values(spark, rows, classes.error_class) == ["permission", "permission", "permission", "other", "none", "none", "corrupt"]
    reason = values(spark, ["", "permission denied", "boom"], lambda x: classes.failure_reason(F.lit(None).cast("string"), F.lit(2), x, F.lit("/a")))
    assert reason == ["encoder exit 2", "Permission denied while converting file | Path: /a | Detail: permission denied", "encoder exit 2"]


def want_verdict(pre, out, emb):
    null = text.NULL_MD5
    if pre and out and pre == out:
        return "MATCH|NEW" if emb in (None, null) else "MATCH"
    if pre is None and out:
        return "MATCH|EMB" if emb not in (None, null) and emb == out else "FAIL|NO_SRC"
    if pre and out:
        return f"FAIL|MISMATCH src={pre[:8]} out={out[:8]}"
    return "FAIL|NO_HASH"


def test_verdict_of_all_combinations(spark):
    a, b, null = "a" * 32, "b" * 32, text.NULL_MD5
    rows = [*itertools.product((None, a, b), (None, a, b), (None, null, a, b))]
    df = spark.createDataFrame(rows, "pre string, out string, emb string")
    found = df.select("*", classes.verdict(F.col("pre"), F.col("out"), F.col("emb")).alias("v")).collect()
    assert all(r["v"] == want_verdict(r["pre"], r["out"], r["emb"]) for r in found) and len(found) == 36


def test_hash_agreement_and_staleness(spark):
    a, b, null = "a" * 32, "b" * 32, text.NULL_MD5
    rows = [(a, a, a), (a, a, b), (a, b, a), (None, b, b), (None, b, a), (None, b, None), (a, None, a), (a, None, b), (a, None, null), (None, None, a), (None, None, None)]
    df = spark.createDataFrame(rows, "pre string, out string, emb string").coalesce(1)
    emb, pre, out = classes.hash_agreement(F.col("pre"), F.col("out"), F.col("emb"))
    found = [tuple(r) for r in df.select(emb, pre, out, classes.embedded_stale(F.col("pre"), F.col("out"), F.col("emb"))).collect()]
    assert found == [
        ("match", "match", "match", False), ("warn", "match", "match", True), ("match", "mismatch", "mismatch", False), ("match", "missing", "match", False), ("warn", "missing", "mismatch", False),
        ("missing", "missing", "warn", False), ("match", "match", "neutral", False), ("warn", "warn", "neutral", False), ("missing", "neutral", "neutral", False), ("neutral", "neutral", "neutral", False), ("missing", "neutral", "neutral", False),
    ]


@pytest.mark.parametrize(("verification", "want"), [("MATCH|NEW", "good"), ("ok", "good"), ("FAIL|NO_SRC", "bad"), ("mismatch x", "bad"), ("some warning", "warning"), ("IO error", "warning"), ("", "other"), (None, "other")])
def test_event_class(spark, verification, want):
    assert values(spark, [verification], classes.event_class) == [want]


def test_image_type(spark):
    rows = [bytes.fromhex("89504E470D0A1A0A00"), bytes.fromhex("FFD8FFE000"), b"GIF89a", b"\x89P"]
    assert values(spark, rows, classes.image_type, "x binary") == ["png", "jpeg", None, None]


def test_marker(spark):
    rows = [["ARTIST=x", "done_mark=1"], ["ARTIST=x"], []]
    assert values(spark, rows, lambda x: classes.has_marker(x, "DONE_MARK"), "x array<string>") == [True, False, False]
