"""Packing and BPE against the tokenizers library."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import docs_df, documents, prose
from verilake.llm import bpe, packing
from verilake.llm.queries import QUERIES

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def byte_bpe():
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    return tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))


def odd_texts():
    r = random.Random(1)
    alphabet = " \n\t ab1'sé.😀\x1c 日Σİ"
    fixed = ["", " ", "  ", " a", "a ", "a \n b", "x<|endoftext|>y <|endoftext|>", "\x1c a\x1d b \x85 c", "don't we'll 've", "½ ²x", "👩‍👩‍👧", "՘x \U0001d6a6", "a" * 300 + " " * 40 + "b" * 200]
    return fixed + ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(2000)] + [t or "" for _, t, *_ in documents()]


def test_codec_equals_the_library(byte_bpe, tmp_path, monkeypatch):
    path = public.path("byte_bpe_50k.json")
    words = sorted({w.encode() for t in odd_texts() for w in bpe.WORD.findall(t)})[::3]
    merge = bpe.vocabulary(path).merge
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon((w, merge(w)) for w in words))
    codec = bpe.Codec(path, str(tmp_path / "lexicon"))
    assert all(codec.lexicon.get(w) == merge(w) for w in words) and codec.lexicon.n_words == len(words)
    want = [byte_bpe.encode(t, add_special_tokens=False).ids for t in odd_texts()]
    assert [x.tolist() for x in codec.ids_of(pa.array(odd_texts()))] == want
    monkeypatch.setattr(bpe, "SLICE", 50)
    assert [x.tolist() for x in bpe.Codec(path).ids_of(pa.array([None, *odd_texts()]).slice(1))] == want  # no lexicon, small slices
    for t, ids in zip(odd_texts()[:200], want[:200], strict=True):
        assert codec.encode(t) == ids
        assert codec.decode(ids) == byte_bpe.decode(ids, skip_special_tokens=False)


def test_merges_of_many_words_equal_those_of_one():
    v, r = bpe.vocabulary(public.path("byte_bpe_50k.json")), random.Random(5)
    some = [bytes(r.choice(b"aeinrst lh\xc3\xa9\xf0") for _ in range(r.randrange(1, bpe.LONG + 1))) for _ in range(3000)]
    stop = np.cumsum([len(w) for w in some])
    ids, n = v.merge_all(np.frombuffer(b"".join(some), np.uint8), stop - [len(w) for w in some], stop)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [v.merge(w) for w in some]


def test_most_words_of_texts_come_from_the_lexicon(spark, sf, tmp_path):
    """The transducer is asked first, for every word, and knows those that it was built for."""
    path = public.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = bpe.frequent_words(docs, path)
    merge = bpe.vocabulary(path).merge
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon((w, merge(w)) for w in words))
    codec, texts = bpe.Codec(path, str(tmp_path / "lexicon")), pa.array([r["text"] for r in docs.select("text").collect()])
    asked = 0
    for _, data, edges in bpe.W.slices(texts, bpe.SLICE):
        which, _, start, stop, _ = codec.distinct(data, edges)
        known = codec.lexicon.find(data, start, stop) >= 0
        assert {data[a:b].tobytes() for a, b in zip(start[known], stop[known], strict=True)} <= set(words)
        assert known[which].mean() > 0.5  # of the words of the texts
        asked += len(start)
    list(codec.ids_of(texts))
    assert codec.asked == asked and codec.known > 0


def test_lexicon_shares_suffixes(tmp_path):
    words = [a + b for a in (b"walk", b"talk", b"look") for b in (b"", b"ed", b"ing", b"s")]
    (tmp_path / "x").write_bytes(bpe.compile_lexicon((w, [i]) for i, w in enumerate(words)))
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    assert [lexicon.get(w) for w in words] == [[i] for i in range(len(words))] and lexicon.get(b"walke") is None and lexicon.get(b"") is None
    assert lexicon.n_states <= 16
    (tmp_path / "y").write_bytes(bpe.compile_lexicon([]))
    assert bpe.Lexicon(str(tmp_path / "y")).get(b"a") is None


def test_bpe_query(spark, sf, byte_bpe):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op10_bpe_transducer"](spark, sf).collect():
        ids = byte_bpe.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(byte_bpe.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_documents(spark, byte_bpe):
    path, docs = public.path("byte_bpe_50k.json"), docs_df(spark)
    encoded = bpe.encode_documents(docs, path, bpe.publish_lexicon(spark, bpe.frequent_words(docs, path), path))
    found = sorted(tuple(r["ids"]) for r in encoded.collect())
    assert found == sorted(tuple(byte_bpe.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in documents())
    assert sorted(r["text"] for r in bpe.decode_documents(encoded, path).collect()) == sorted(t or "" for _, t, *_ in documents())
    empty = docs_df(spark, [])
    assert bpe.round_trips(empty, path, bpe.publish_lexicon(spark, bpe.frequent_words(empty, path), path)).count() == 0


def test_word_encoder_equals_the_library(word_bpe, monkeypatch):
    more = ["É È ÀÁ ß ÷x×y Ñandú ÿ", "e\u0301 \u0301 a", "3x14 2026-01-02 a1b2", "IT'S DON'T", "<|ENDOFTEXT|> <|endoftext|>x<|startoftext|>", "A\u00a0B", "ªº µ Ÿ İ", "x" * 500 + "É" * 30]
    texts = odd_texts() + more
    want = [word_bpe.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = packing.WordEncoder(public.path("word_bpe_49k.json"))
    assert [x.tolist() for x in encoder.ids_of(pa.array(texts))] == want
    monkeypatch.setattr(packing, "SLICE", 60)
    monkeypatch.setattr(packing, "MEMO_BYTES", 500)
    assert [x.tolist() for x in encoder.ids_of(pa.array([None, *texts], pa.large_string()))] == [[], *want]


def check_pieces(rows, ids_of):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(ids_of)
    for doc_id, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids_of[doc_id])
            assert r["ids_crc32"] == zlib.crc32(ids_of[doc_id][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids_of[doc_id])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding, sequences


def test_packing_query(spark, sf, word_bpe):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: np.array([*word_bpe.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    padding, sequences = check_pieces(QUERIES["op9_multi_length_packing"](spark, sf).collect(), ids)
    assert padding == 0 and len({r["tier"] for own in sequences.values() for r in own}) >= 4


def test_packing_of_odd_documents(spark, word_bpe):
    rows = [(i, t) for i, (_, t, *_) in enumerate(documents())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = packing.pack(docs, public.path("word_bpe_49k.json")).collect()
    ids = {i: np.array([*word_bpe.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    assert check_pieces(found, ids)[0] == 0
    assert all(r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes() for r in found)
    assert packing.pack(docs_df(spark), public.path("word_bpe_49k.json")).count() > 0
    assert packing.pack(docs_df(spark, []), public.path("word_bpe_49k.json")).count() == 0


def test_step_groups_are_balanced(spark, sf):
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), public.path("word_bpe_49k.json")).groupBy("step_group", "tier").sum("length").collect()
    assert max(r["sum(length)"] for r in rows) == packing.STEP and sum(r["sum(length)"] < packing.STEP for r in rows) <= 14


def test_packer_routes_by_tier():
    packer = packing.Packer((8, 4, 2))
    for owner, n in enumerate((20, 7, 3, 3, 2, 1, 1)):
        packer.add(owner, n)
    windows = list(packer.finish())
    assert sum(t for t, _ in windows) == 37 and all(sum(n for *_, n in p) == t for t, p in windows)
    assert windows[0] == (8, [(0, 0, 8)]) and windows[1] == (8, [(0, 8, 8)])


def test_memory_of_encoding_is_bounded_by_a_slice_of_text():
    """Eight megabytes of text in one batch: what the encoder works with stays a small part of an executor's memory."""
    texts = pa.array([prose(k, 20_000) for k in range(64)])
    encoder = packing.word_encoder(public.path("word_bpe_49k.json"))
    few = [x.tolist() for x in encoder.ids_of(texts.slice(0, 2))]
    tracemalloc.start()
    try:
        ids = encoder.ids_of(texts)
        assert [next(ids).tolist() for _ in few] == few
        assert sum(len(x) for x in ids) > 1_000_000
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()
