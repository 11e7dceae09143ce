"""Quality rules against a plain version; texts that go and texts that stay."""

import base64
import random
import re
from collections import Counter

import pyarrow as pa
import zstandard

from tests.llm.cases import docs_df, documents, prose
from verilake.llm import quality
from verilake.llm.queries import QUERIES


def plain(text):
    """The contract's columns and the verdict, by loops."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        again += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    raw = text.encode()
    ratio = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)
    wrong = 0
    if raw:
        judged = [(len(c), ratio(c), *quality.limits_of(len(c))) for c in [raw[k : k + 4096] for k in range(0, len(raw), 4096)] if len(c) >= 2048 or len(raw) < 2048]
        low, high = quality.limits_of(len(raw))
        size = sum(x[0] for x in judged)
        wrong = not low <= ratio(raw) <= high or sum(n for n, r, a, _ in judged if r < a) > 0.2 * size or sum(n for n, r, _, b in judged if r > b) > 0.2 * size
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered), failed, not failed and not wrong


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def noise(seed, n):
    return base64.b64encode(random.Random(seed).randbytes(n)).decode()


def texts():
    key = lambda k: " ".join(noise(k * 1000 + i, 24) for i in range(200))
    return [
        *[t for _, t, *_ in documents()], "\n\n \n", "a\nb\na\n \n \na ", "é　日本 語 x", prose(1, 49), prose(1, 50), prose(2, 3000), prose(3, 200) + " " + key(1), key(2), "# | <a>" * 20, " ".join(["one two three", prose(4, 60), "one two three"]),
        "\n".join(f"row {i} value {i % 7} unit {i % 3} state ok" for i in range(3000)), prose(5, 4000) + " " + "\n".join(f"row {i // 3} value {i % 3} unit 1 state ok ok" for i in range(900)), "\r\n".join([prose(6, 60)] * 2), "x" * 5000, "日本語のテキスト" * 300,
    ]


def test_equals_brute_force(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts())]
    found = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in quality.judged(docs_df(spark, rows)).collect()}
    assert found == {i: plain(t) for i, t, *_ in rows}


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in QUERIES["op13_compression_bands"](spark, sf).collect()}
    assert found == {r["doc_id"]: plain(r["text"]) for r in docs}
    assert all(x[6] for x in found.values() if not x[5])  # prose of any of the languages stays


def reasons(*found):
    return quality.measures(pa.array(found, pa.string())).column("reason").to_pylist()


def test_verdicts():
    """Prose stays at any length; tables that hardly change, keys and hashes go, also as a stretch of a long text."""
    mixed = lambda k, n: " ".join(prose(k * 100 + j, 12) + f" {k}{j}x" for j in range(n))
    assert reasons(*[mixed(k, 5 * 2**k) for k in range(9)]) == [None] * 9
    keys = " ".join(noise(i, 30) for i in range(400))
    rows = "\n".join(f"value{i} is {i} and next {i + 1} of series{i} a{i}" for i in range(4000))
    assert reasons(keys, mixed(1, 150) + " " + keys, mixed(1, 9000) + " " + keys[:9000], mixed(1, 20) + " " + noise(1, 200)) == ["incompressible", "incompressible", None, None]
    assert reasons("word " * 200, "a b", None, "") == ["base rule"] * 4
    assert quality.measures(pa.array([rows]), limits=((1 << 62, 0.3, 0.9),)).column("reason").to_pylist() == ["repetitive"]


def test_odd_documents(spark):
    docs = docs_df(spark)
    rows = quality.judged(docs).collect()
    assert len(rows) == len(documents()) and sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 0 for r in rows) == 2
    kept = quality.without_poor(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows) > 20
    assert quality.judged(docs_df(spark, [])).count() == 0 and quality.without_poor(docs_df(spark, [])).count() == 0


def test_a_text_of_many_megabytes():
    text = "\n".join(prose(k % 40, 2000) + str(k) for k in range(700))
    assert len(text) > 8_000_000
    out = {c: v[0] for c, v in quality.measures(pa.array([text])).to_pydict().items()}
    assert tuple(out[c] for c in NAMES[:6]) == plain(text)[:6] and out["n_chunks"] == -(-len(text.encode()) // 4096) - (0 < len(text.encode()) % 4096 < 2048)
