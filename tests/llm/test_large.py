"""Texts of many megabytes and documents above a task's pool; shards against a plain placement."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash

from tests.llm.cases import WORDS, docs_df, documents
from verilake.llm import linedup, merkle, neardup, packing, quality, sharding, substrings


def long_text(seed, n):
    """n words, of many kinds, in lines."""
    r = np.random.default_rng(seed)
    picks, tails, ends = r.integers(0, len(WORDS), n).tolist(), r.integers(0, 40_000, n).tolist(), (r.random(n) < 0.05).tolist()
    return "".join(f"{WORDS[a]}{b}" + ("\n" if e else " ") for a, b, e in zip(picks, tails, ends, strict=True)).strip()


@pytest.fixture(scope="module")
def large(spark):
    a, b = long_text(1, 1_200_000), long_text(2, 300)
    assert len(a) > 11_000_000
    near = a.replace(" ", "  ", 5) + " and one more"
    rows = [(1, a, "en", "s", len(a)), (2, near, "en", "s", len(near)), (3, b, "en", "s", len(b)), (4, b + " " + a[:2000], "en", "s", None)]
    return docs_df(spark, rows, extra=False), rows


def test_near_duplicates(large):
    docs, _ = large
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, shingle=3, num=85, den=100).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_repeated_lines(large):
    docs, rows = large
    found = {r["doc_id"]: r for r in linedup.find_repeated_lines(docs).collect()}
    n_lines = rows[0][1].count("\n") + 1
    assert found[1]["n_lines"] == n_lines and found[1]["removed_lines"] < n_lines / 100  # lines of one or two words repeat
    assert found[2]["removed_lines"] >= n_lines - 1 and found[3]["removed_lines"] == 0


def test_repeated_passages(large):
    docs, _ = large
    found = {r["doc_id"]: r for r in substrings.find_repeats(docs).collect()}
    assert found[1]["removed_words"] == 0 and found[2]["removed_words"] >= 1_199_900 and found[2]["n_words"] == 1_200_003
    assert found[3]["removed_words"] == 0 and found[4]["removed_words"] >= 400


def test_manifest_and_quality(large):
    docs, rows = large
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = {i: hashlib.sha256("".join(map(field, (i, s, lang, n, t))).encode()).digest() for i, t, lang, s, n in rows}
    assert {r["doc_id"]: bytes(r["digest"]) for r in merkle.documents_manifest(docs).collect()} == want
    assert {r["doc_id"]: (r["n_words"], r["kept"]) for r in quality.judged(docs).collect() if r["doc_id"] < 3} == {1: (1_200_000, True), 2: (1_200_003, True)}


@pytest.mark.parametrize("pool", [3000, packing.POOL])
def test_documents_above_a_pool(spark, monkeypatch, pool):
    """A document of more tokens than a task holds back is cut over windows like any other."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "POOL", pool)
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [long_text(3, 20 if pool == 3000 else 1000), long_text(4, 8000 if pool == 3000 else 600_000), "", long_text(5, 700)]
    docs = docs_df(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], extra=False).coalesce(1)
    rows = packing.pack(docs, path).collect()
    ids = {r.doc_id: b"".join(bytes(x["ids"]) for x in sorted((x for x in rows if x["doc_id"] == r.doc_id), key=lambda x: x["start"])) for r in rows}
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    for i, t in enumerate(texts):
        want = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert ids[i] == want and (i != 1 or len(want) // 4 > pool)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096


def spark_hash(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def plain_placement(rows, shards, slots):
    """shard and position of each row, by loops, where no slot is overfull."""
    held = {}
    for i, t in rows:
        held.setdefault(spark_hash(i, t) % slots, []).append((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1))
    owner, load = {s: s % shards for s in range(slots)}, [0] * shards
    for s in sorted(held, key=lambda s: (-sum(x[2] for x in held[s]), s)):
        to = min(range(shards), key=lambda k: (load[k], k))
        owner[s] = to
        load[to] += sum(x[2] for x in held[s])
    out = []
    for k in range(shards):
        own = [x for s in range(slots) if owner[s] == k for x in sorted(held.get(s, []))]
        out += [(*x, k, at) for at, x in enumerate(own)]
    return sorted(out)


def test_shards_equal_a_plain_placement(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t, *_ in documents() if i is not None and i < 15]
    docs = docs_df(spark, [(i, t, None, None, None) for i, t in rows])
    loads = {}
    for i, t in rows:
        loads[spark_hash(i, t) % 4096] = loads.get(spark_hash(i, t) % 4096, 0) + len((t or "").encode()) + 1
    found = sorted((r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in sharding.shard(docs, 2, 4096).collect())
    assert found == plain_placement(rows, 2, 4096)
