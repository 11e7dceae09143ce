"""Sharding, substring dedup, fingerprints, license scans."""

import hashlib
import random
import re
import textwrap
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import docs_df, documents, prose, shingle_set
from verilake.llm import fingerprints, licenses, sharding, substrings
from verilake.llm.queries import QUERIES


def test_shards_of_near_equal_bytes(spark, sf):
    rows = QUERIES["op5_virtual_slots"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    by_shard = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by_shard.setdefault(r["shard"], []).append(r)
    assert set(by_shard) == set(range(16))
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by_shard.values())
    sizes = [sum(r["size"] for r in own) for own in by_shard.values()]
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes) / 16


def test_shards_of_odd_documents(spark):
    rows = sharding.shard(docs_df(spark), 3).collect()
    assert len(rows) == len(documents()) and {r["size"] for r in rows if r["doc_id"] == 4} == {1}
    assert sharding.shard(docs_df(spark, []), 3).count() == 0


def test_null_and_hot_ids_spread(spark):
    """Rows that share a doc_id, or have none, are shared out as all others; so are equal rows."""
    cases = {
        "null ids": [(None, f"text {k}") for k in range(200)] + [(k, f"text {k}") for k in range(100)], "equal rows": [(1, "same")] * 200 + [(k, f"text {k}") for k in range(100)],
        "nothing": [(None, None)] * 200 + [(k, f"text {k}") for k in range(100)], "one text": [(k, "same text") for k in range(300)],
    }
    for rows in cases.values():
        found = sharding.shard(docs_df(spark, [(i, x, None, None, None) for i, x in rows]), 4).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in found) == sorted((i is None, i or 0, len(x or "") + 1) for i, x in rows)
        sizes = [sum(r["size"] for r in found if r["shard"] == k) for k in range(4)]
        assert max(sizes) - min(sizes) <= 12
        for k in range(4):
            assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(sum(r["shard"] == k for r in found)))


def test_map_versions(spark, tmp_path):
    loads = [(s, 100 + s % 7, 1) for s in range(64)]
    one = sharding.SlotMap.build(loads, 4, 64)
    two = one.rebalance(loads, 5)
    moved = [s for s in range(64) if one.assignment[s] != two.assignment[s]]
    assert all(two.assignment[s] == 4 for s in moved) and 10 <= len(moved) <= 14
    three = two.rebalance(loads, 4)
    assert set(three.assignment) == set(range(4)) and two.rebalance(loads, 5).assignment == two.assignment
    for m in (one, two, two, three):  # one of them twice, as a job that is run again does
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == three and sharding.SlotMap.load(spark, str(tmp_path / "map"), 2) == two


def test_a_stored_map_is_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = docs_df(spark, [(i, "x" * (i % 50), None, None, None) for i in range(2000)])
    first = sharding.shard_by_stored_map(docs, path, 4, 256).collect()
    assert {r["map_version"] for r in first} == {2} and sharding.SlotMap.load(spark, path, 1).version == 1
    more = docs.union(docs_df(spark, [(9000 + i, "y" * 300, None, None, None) for i in range(40)]))
    before = {r["doc_id"]: r["shard"] for r in first}
    second = sharding.shard_by_stored_map(more, path, 4, 256, tolerance=0.02).collect()
    assert {r["map_version"] for r in second} == {3}
    assert sum(before[r["doc_id"]] != r["shard"] for r in second if r["doc_id"] in before) < 400  # few slots move
    sizes = [sum(r["size"] for r in second if r["shard"] == k) for k in range(4)]
    assert max(sizes) <= 1.02 * sum(sizes) / 4


def repeated_windows(texts, n=50):
    seen, again = {}, set()
    for i, t in texts:
        w = (t or "").split(" ")
        for k in range(len(w) - n + 1):
            x = " ".join(w[k : k + n])
            if seen.setdefault(x, i) != i:
                again.add(i)
    return again


def test_every_long_repeat_is_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op6_content_defined_chunks"](spark, sf).collect()
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    hit = {r["doc_id"] for r in rows if r["removed_words"]}
    assert repeated_windows(texts) <= hit
    assert len(rows) == len(texts)


def plain_chunks(raw):
    """Chunks of bytes whose words are all short, as runs of words, by loops."""
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    mixed = []
    for _, stop in words:
        h = sum(int(substrings._GEAR[raw[k]]) << (stop - 1 - k) for k in range(max(0, stop - substrings.GEAR_BYTES), stop)) % 2**32
        mixed.append((h ^ (h >> 16)) * 0x7FEB352D % 2**32)
    runs, at, radius = [], 0, substrings.RADIUS
    for k in range(len(words)):
        if k == len(words) - 1 or mixed[k] == min(mixed[max(0, k - radius) : k + radius + 1]):
            runs.append(words[at : k + 1])
            at = k + 1
    return runs


def plain_cut(texts, min_words):
    """Texts (by ascending id) without the runs of chunks that were seen before."""
    seen, out = set(), []
    for text in texts:
        raw = text.encode()
        kept, at, run = [], 0, []
        for chunk in [*plain_chunks(raw), None]:
            body = raw[chunk[0][0] : chunk[-1][1]] if chunk else None
            if chunk and body in seen:
                run += chunk
                continue
            if len(run) >= min_words:
                kept.append(raw[at : run[0][0]])
                at = run[-1][1]
            run = []
            seen.add(body)
        out.append(b"".join([*kept, raw[at:]]).decode())
    return out


def test_cut_texts_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None and max(map(len, r["text"].encode().split()), default=0) <= substrings.LONG)
    assert len(rows) > 150
    for min_words in (5, substrings.MIN_WORDS):
        found = {r["doc_id"]: r for r in substrings.find_repeats(docs.filter(F.col("doc_id").isin([i for i, _ in rows])), min_words).collect()}
        assert [found[i]["text"] for i, _ in rows] == plain_cut([t for _, t in rows], min_words)
        assert all(sum(p["words"] for p in r["passages"]) == r["removed_words"] for r in found.values())


def test_an_insertion_moves_no_chunk():
    a = prose(11, 400).encode()
    cut = lambda raw: {raw[s:e] for s, e, _ in zip(*(x.tolist() for x in substrings.chunks(raw)), strict=True)}
    b = b"some words put before " + a
    assert len(cut(a) - cut(b)) <= 3
    start, stop, words = substrings.chunks(a)
    assert words.sum() == len(a.split()) and (start[1:] > stop[:-1]).all()
    assert all(len(x) == 0 for x in substrings.chunks(b" \n "))


def test_gear_equals_its_definition():
    import numpy as np

    raw = bytes(range(200)) * 2
    h = substrings.gear(np.frombuffer(raw, np.uint8))
    for i in (0, 5, 31, 32, 250):
        want = 0
        for b in raw[: i + 1]:
            want = (want * 2 + int(substrings._GEAR[b])) % 2**32
        assert h[i] == want


def test_repeats_in_odd_documents(spark):
    docs = docs_df(spark)
    rows = substrings.find_repeats(docs).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 0)}
    assert len(rows) == len(documents())
    assert by_id[1]["text"].strip() == "" and by_id[13]["removed_words"] >= 50 and by_id[12]["removed_words"] == 0 and by_id[12]["shared_words"] >= 50
    assert by_id[4]["text"] is None and by_id[5]["text"] == "" and by_id[11]["removed_words"] == 0
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns and 1 not in {r["doc_id"] for r in out.collect()}
    assert substrings.find_repeats(docs_df(spark, [])).count() == 0


def blank_free(kind, seed, n):
    r = random.Random(seed)
    letters = {"chinese": [chr(0x4E00 + k) for k in range(3000)], "thai": [chr(0x0E01 + k) for k in range(46)], "base64": list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}
    return "".join(r.choice(letters[kind]) for _ in range(n))


@pytest.mark.parametrize("kind", ["chinese", "thai", "base64"])
def test_repeats_without_blanks(spark, kind):
    passage, whole = blank_free(kind, 1, 1500), blank_free(kind, 2, 1500)
    texts = [blank_free(kind, 3, 700) + passage + blank_free(kind, 4, 500), blank_free(kind, 5, 333) + passage + blank_free(kind, 6, 900), whole, whole, blank_free(kind, 7, 2000)]
    docs = docs_df(spark, [(i, t, None, None, len(t)) for i, t in enumerate(texts)])
    by_id = {r["doc_id"]: r for r in substrings.find_repeats(docs).collect()}
    assert [by_id[i]["text"] == texts[i] for i in range(5)] == [True, False, True, False, True]
    assert by_id[3]["text"] == "" and by_id[3]["removed_words"] == by_id[3]["n_words"] == by_id[2]["n_words"]
    assert 1233 <= len(by_id[1]["text"]) <= 1233 + 150 and by_id[1]["text"][:333] == texts[1][:333] and by_id[1]["text"][-900:] == texts[1][-900:]
    assert {r["doc_id"] for r in substrings.without_repeats(docs).collect()} == {0, 1, 2, 4}


def test_pieces_depend_on_what_is_near():
    for raw in (blank_free("chinese", 8, 4000).encode(), blank_free("base64", 8, 4000).encode(), b"=" * 4000, "你好".encode() * 900):
        parts = lambda x: {x[a:b] for a, b, _ in zip(*(c.tolist() for c in substrings.chunks(x)), strict=True)}
        start, stop, words = substrings.chunks(raw)
        assert (start[0], stop[-1]) == (0, len(raw)) and (start[1:] == stop[:-1]).all() and words.sum() == substrings.count_words(raw.decode())
        assert all(x.decode() for x in parts(raw)) and len(parts(raw) - parts("还有什么".encode() + raw)) <= 3


def edited_brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        yield i, t, t[: len(t) - m] + following[:m], following


@pytest.mark.parametrize("per_bucket", [1, 7, 256])
def test_fingerprints_against_brute_force(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", per_bucket)
    own = [r for r in documents() if r[0] is not None or r[1] or per_bucket > 1]  # ties that several windows share have an order of their own
    rows = [(i, t or "") for i, t, *_ in own]
    df = fingerprints.edited_likeness(docs_df(spark, own), k=4096)
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], round(r["near_edited"], 6), round(r["near_next"], 6)) for r in df.collect() if r["n_chars"] < 20_000))
    like = lambda a, b: round(len(a & b) / len(a | b), 6) if a | b else 1.0
    want = sorted((i is None, i or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), like(shingle_set(t.lower(), 5), shingle_set(e.lower(), 5)), like(shingle_set(t.lower(), 5), shingle_set(x.lower(), 5))) for i, t, e, x in edited_brute(rows) if len(t) < 20_000)
    assert found == want


@pytest.mark.parametrize("case", ["ends of long", "outlier", "hot ids", "one id", "nulls", "empty"])
def test_windows_of_documents_in_order(spark, monkeypatch, case):
    """Descending runs of bounded size, each with the text of the first row behind it."""
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 16)
    ids = {
        "ends of long": [-(2**63), -5, -1, 0, 3, 2**62, 2**63 - 1], "outlier": [*range(500), 2**62], "hot ids": [*range(0, 900, 3), *[300] * 200, *[None] * 200, -(2**40)],
        "one id": [7] * 300, "nulls": [None] * 300, "empty": [],
    }[case]
    docs = docs_df(spark, [(i, f"text {k // 2 if case == 'one id' else k}", None, None, None) for k, i in enumerate(ids)])
    buckets, after = {}, {}
    for r in fingerprints._in_order(docs).collect():
        if r["after"]:
            after[r["bucket"]] = r["text"]
        else:
            buckets.setdefault(r["bucket"], []).append((r["doc_id"] is None, -(r["doc_id"] or 0), r["text"]))
    runs = [sorted(buckets[b]) for b in sorted(buckets)]
    assert [x[:2] for run in runs for x in run] == sorted((i is None, -(i or 0)) for i in ids)
    assert set(after) == set(buckets) and [after[b] for b in sorted(after)] == [run[0][2] for run in (runs[1:] + runs[:1])]
    assert max(map(len, runs), default=0) <= 3 * 16  # 16, or what chance deals to a piece of one id
    assert fingerprints.edited_likeness(docs).count() == len(ids)


def test_registered_size_estimates_within_its_error(spark):
    """At k = 128 estimates are off by their standard error, on texts of any length."""
    texts = [prose(40, 15_000), *[prose(40, n) + " " + prose(40 + n, 15_000 - n) for n in (3000, 7500, 12_000)]]
    rows = spark.createDataFrame([(texts[0], t) for t in texts], "a string, b string")
    near = fingerprints.resemblance(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))
    for (a, b), r in zip([(texts[0], t) for t in texts], rows.select("b", near.alias("near")).collect(), strict=True):
        x, y = shingle_set(a.lower(), 5), shingle_set(b.lower(), 5)
        assert abs(r["near"] - len(x & y) / len(x | y)) < 0.18  # four standard errors


def test_sketches_estimate_and_merge(spark):
    a, b = prose(21, 3000), prose(21, 1500) + " " + prose(22, 1500)
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (3, None)], "k int, text string").withColumn("s", fingerprints.sketch(F.col("text"), 256))
    pair = df.filter("k = 1").orderBy("text").agg(F.collect_list("s").alias("x"))
    r = pair.select(fingerprints.resemblance(F.col("x")[0], F.col("x")[1], 256), fingerprints.containment(F.col("x")[0], F.col("x")[1], 256), fingerprints.distinct_shingles(fingerprints.merge(F.col("x")[0], F.col("x")[1], 256), 256)).first()
    x, y = shingle_set(a, 5), shingle_set(b, 5)
    assert abs(r[0] - len(x & y) / len(x | y)) < 0.1 and abs(r[1] - len(x & y) / min(len(x), len(y))) < 0.15 and abs(r[2] / len(x | y) - 1) < 0.2
    merged = {m["k"]: m["s"] for m in fingerprints.merge_by(df, ["k"], "s", 256).collect()}
    want = sorted({h for row in df.filter("k = 1").collect() for h in row["s"]})[:256]
    assert merged[1] == want and 3 not in merged
    assert fingerprints.edited_likeness(docs_df(spark, [])).count() == 0


def test_fingerprints_run_no_python(spark, sf):
    plan = QUERIES["op7_bottom_k"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_equal_texts_have_equal_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.join(QUERIES["op7_bottom_k"](spark, sf), "doc_id").groupBy("text").agg(F.countDistinct("fingerprint").alias("n")).filter("n > 1")
    assert rows.count() == 0


def test_licenses_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = {r["doc_id"]: set(r["licenses"]) for r in QUERIES["op8_window_bands"](spark, sf).collect()}
    for r in docs:
        assert found[r["doc_id"]] == {n for n, t in licenses.TEMPLATES if t.lower() in r["text"].lower()}


def test_edited_and_odd_licenses(spark):
    bsd = licenses.TEMPLATES[4][1]
    known = licenses.Templates.of(list(licenses.TEMPLATES))
    edited = "Intro words here. " + bsd.replace("source and binary", "SOURCE and object") + " and so on"
    assert [f["license"] for f in known.find(edited)] == ["BSD-3-Clause"] and known.find(edited)[0]["containment"] >= 0.8
    assert known.find(prose(5, 300)) == [] and known.find("Licensed under CC BY 4.0.")[0]["license"] == "CC-BY-4.0"
    two = known.find("Released under the MIT License. " + prose(8, 30) + " released under the MIT license!")
    assert [f["license"] for f in two] == ["MIT", "MIT"]
    rows = licenses.scan(docs_df(spark)).collect()
    assert len(rows) == len(documents()) and {r["doc_id"] for r in rows if r["licenses"]} == {20}
    assert licenses.scan(docs_df(spark, [])).count() == 0 and licenses.scan(docs_df(spark), []).filter("n_findings > 0").count() == 0
    with pytest.raises(ValueError):
        licenses.Templates.of([("x", "y z")] * (licenses.MAX_TEMPLATES + 1))


def test_recall_on_edited_license_bodies():
    """Full texts with every 25th word changed, and with lines left out, are found; other prose is not."""
    known = licenses.Templates.of(list(licenses.TEMPLATES))
    bodies = [(name, t) for name, t in licenses.TEMPLATES if len(t.split()) >= 200]
    assert len(bodies) >= 10 and len({n for n, _ in bodies}) >= 10
    hits = tries = 0
    for name, t in bodies:
        words = t.split()
        changed = " ".join("altered" if k % 25 == 7 else w for k, w in enumerate(words))
        shorter = " ".join(w for k, w in enumerate(words) if k % 200 >= 10)
        for text in (changed, shorter, prose(3, 100) + " " + changed + " " + prose(4, 100)):
            tries += 1
            hits += name in {f["license"] for f in known.find(text)}
    assert hits / tries >= 0.95
    assert sum(bool(known.find(prose(k, 400))) for k in range(50)) == 0


GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


def test_real_notices(spark):
    """Notices that the fixture tables do not have, and full texts, in prose and in comments."""
    full = {n: t for n, t in licenses.TABLE[:14]}
    cases = [
        ("Licensed under the MIT License.", "MIT"), ("distributed under the MIT License", "MIT"), (GPL.format(3), "GPL-3.0"), (GPL.format(2), "GPL-2.0"),
        ("\n".join("# " + x for x in textwrap.wrap(GPL.format(2), 60)), "GPL-2.0"), ("Licensed under the GNU General Public License v3.0", "GPL-3.0"), ("Licensed under the GNU General Public License v2.0", "GPL-2.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        *((full[n], n) for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0")),
    ]
    rows = [(k, prose(50 + k, 80) + "\n" + t + "\n" + prose(90 + k, 80), None, None, 1) for k, (t, _) in enumerate(cases)]
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs_df(spark, rows)).collect()}
    assert [(k, n in found[k]) for k, (_, n) in enumerate(cases)] == [(k, True) for k in range(len(cases))]
    assert [found[k] for k in range(9)] == [[n] for _, n in cases[:9]]
