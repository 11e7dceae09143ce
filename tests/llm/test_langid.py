import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import docs_df, documents
from verilake.llm import langid
from verilake.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf):
    found = QUERIES["op4_output_codes"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_odd_texts(spark):
    docs = docs_df(spark)
    model = langid.train(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(documents())
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (4, 5, 6, 9))
    assert all(r["lang_pred"] in ("de", "en") for i, r in by_id.items() if i not in (4, 5, 6, 9))
    kept = langid.identified(docs, model)
    assert kept.columns == docs.columns and not {4, 5, 6, 9} & {r["doc_id"] for r in kept.collect()}


def plain_counts(text):
    """Hashed n-grams of letters in lower case with one blank for what lies between them, by loops."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    code = [32, *[ord(c) for c in " ".join(runs)], *([32] if not text[-1:].isalpha() else []), 32]
    if not text[:1].isalpha():
        code = [32, *code[1:]]
    counts = Counter()
    for n in langid.ORDERS:
        for i in range(len(code) - n + 1):
            h = 0
            for j in range(n):
                h = (h * 0x9E3779B1 + code[i + j] * 0x85EBCA6B + j + 1) % 2**32
            counts[((h ^ (h >> 15)) * 0x2C1B3C6D % 2**32) >> 18] += 1
    return counts


def plain_model(rows, n_buckets):
    """Counts by language, codewords as all partitions, weights, margins: straight from the definitions."""
    languages = sorted({lang for _, lang in rows})
    counts = {lang: Counter() for lang in languages}
    for text, lang in rows:
        counts[lang].update(plain_counts(text))
    share = {lang: {b: (c[b] + 0.5) / (sum(c.values()) + 0.5 * n_buckets) for b in range(n_buckets)} for lang, c in counts.items()}
    codes = [(1, *rest) for rest in itertools.product((1, -1), repeat=len(languages) - 1) if -1 in rest]
    bits = []
    for code in codes:
        mean = lambda b, sign, code=code: sum(share[x][b] for x, c in zip(languages, code) if c == sign) / code.count(sign)
        w = [math.log(mean(b, 1)) - math.log(mean(b, -1)) for b in range(n_buckets)]
        margin = [c * sum(share[x][b] * w[b] for b in range(n_buckets)) for x, c in zip(languages, code)]
        scale = max(sum(map(abs, margin)) / len(margin), 1e-6)
        bits.append((code, [x / scale for x in w], max(min(margin), 1e-6)))
    return languages, bits


def plain_decode(model, text):
    languages, bits = model
    counts = plain_counts(text)
    total = sum(reach for *_, reach in bits)
    loss = [0.0] * len(languages)
    for code, w, reach in bits:
        answer = sum(n * w[b] for b, n in counts.items()) / sum(counts.values())
        for k, c in enumerate(code):
            loss[k] += reach / total * math.exp(-min(max(c * answer, -5), 5))
    odds = [math.exp(-langid.SHARPNESS * (x - min(loss))) for x in loss]
    best = odds.index(max(odds))
    return languages[best], odds[best] / sum(odds)


def test_decoding_equals_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120")
    rows = docs.withColumn("out", langid.held_out()).orderBy("doc_id").collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    model = plain_model([(r["text"], r["lang"]) for r in rows if not r["out"] and r["lang"] and any(map(str.isalpha, r["text"] or ""))], langid.BUCKETS)
    found = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert len(model[0]) >= 4
    for r in rows:
        if any(map(str.isalpha, r["text"] or "")):
            lang, score = plain_decode(model, r["text"])
            assert found[r["doc_id"]]["lang_pred"] == lang and abs(found[r["doc_id"]]["score"] - score) < 1e-3


def test_nothing_to_learn_from(spark):
    none = docs_df(spark, [(1, "some text", None, None, 1), (2, "!?", None, None, 2), (3, None, None, None, None)])
    assert {r["doc_id"] for r in langid.identified(none, langid.train(none)).collect()} == {1}  # without a model a letter will do
    assert langid.train(none) is None and langid.identify(none, None).first()["lang_pred"] == "und"
    assert langid.identify(docs_df(spark, []), None).count() == 0
    one = docs_df(spark, [(i, "some text", "en", None, 1) for i in range(9)])
    assert {r["lang_pred"] for r in langid.identify(one, langid.train(one)).collect()} == {"en"}


@pytest.mark.parametrize("n", [2, 4, 7, 12, 60])
def test_codewords_are_apart(n):
    m = langid.codewords(n)
    apart = [(m[i] != m[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= max(1, 0.25 * m.shape[1]) and all(0 < (c > 0).sum() < n for c in m.T)


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = documents()
    docs = docs_df(spark, rows)
    out = {r["doc_id"] for r in docs.filter(langid.held_out()).collect()}
    changed = docs_df(spark, [(i, t, "xx" if i in out else lang, s, n) for i, t, lang, s, n in rows])
    assert langid.train(changed).languages == langid.train(docs).languages == ("de", "en")
