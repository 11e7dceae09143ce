"""The Merkle manifest against a plain tree, and proofs that hold or do not."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ascii_lower, docs_df, documents
from tests.oracle import connect, spark_rows, sql_rows
from verilake.llm import merkle
from verilake.llm.queries import ORACLES, QUERIES


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(digests, fan_out=8):
    """(root, the siblings of each leaf level by level, the slot of each leaf level by level)."""
    proofs, slots = [[] for _ in digests], [[] for _ in digests]
    under = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        for k, leaves in enumerate(under):
            run = k // fan_out * fan_out
            for i in leaves:
                proofs[i].append([d for j, d in enumerate(digests[run : run + fan_out]) if run + j != k])
                slots[i].append(k - run)
        digests = [h("".join(digests[k : k + fan_out])) for k in range(0, len(digests), fan_out)]
        under = [[i for own in under[k : k + fan_out] for i in own] for k in range(0, len(under), fan_out)]
    return digests[0], proofs, slots


def plain_manifest(rows):
    """What the query returns, for (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for i, t, lang, source, n in rows:
        tampered = ascii_lower(t) if t is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else t
        trees.setdefault(lang, []).append((i is not None, i or 0, leaf((i, source, lang, n, t)), leaf((i, source, lang, n, tampered))))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort()
    low = {lang: plain_tree([x[2] for x in own]) for lang, own in trees.items()}
    root, high, high_slots = plain_tree([low[lang][0] for lang in order])
    out = []
    for nth, lang in enumerate(order):
        subroot, proofs, slots = low[lang]
        for k, (known, i, own, fold) in enumerate(trees[lang]):
            path, at = proofs[k] + high[nth], slots[k] + high_slots[nth]
            for siblings, slot in zip(path, at, strict=True):
                fold = h("".join([*siblings[:slot], fold, *siblings[slot:]]))
            out.append((i if known else None, own, subroot, root, h("".join(x for level in path for x in level)), fold, fold == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def query(df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op11_sibling_shift_manifest"](df.sparkSession, str(tmp_path))
    return sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in rows.collect())))


def test_equals_sql(spark, sf):
    assert spark_rows(QUERIES["op11_sibling_shift_manifest"](spark, sf)) == sql_rows(connect(sf), ORACLES["op11_sibling_shift_manifest"])


def test_odd_documents(spark, tmp_path):
    """Null and repeated ids, null languages, repeated rows, empty and long texts, clashing names."""
    assert query(docs_df(spark), tmp_path) == sorted(map(repr, plain_manifest(documents())))


def case(name):
    n = {"one row": 1, "two rows": 2, "eight": 8, "nine": 9, "one language": 67, "languages": 40, "a run of one": 65}[name]
    langs = [None, "", "-", "=", "é", "zz", *[f"l{i}" for i in range(20)]] if name == "languages" else ["en"]
    return [(i * 7 - 20, f"Text {i}", langs[i % len(langs)], None, i) for i in range(n)]


@pytest.mark.parametrize("name", ["one row", "two rows", "eight", "nine", "one language", "languages", "a run of one"])
def test_shapes_of_trees(spark, tmp_path, name):
    rows = case(name)
    assert query(docs_df(spark, rows, extra=False), tmp_path) == sorted(map(repr, plain_manifest(rows)))


def test_an_empty_table(spark, tmp_path):
    assert query(docs_df(spark, []), tmp_path) == []


@pytest.mark.parametrize("fan_out", [2, 3])
def test_other_fan_outs(spark, fan_out):
    """With two children the sibling is the index with its last bit changed."""
    digests = {i: h(str(i)) for i in range(23)}
    leaves = spark.createDataFrame([(i, d) for i, d in digests.items()], "i long, d string").select("i", F.lit("t").alias("tree"), F.unhex("d").alias("digest"))
    rows = merkle.manifest(leaves, F.col("i"), fan_out=fan_out).withColumn("fold", merkle.text_of(merkle.folded(F.col("digest"), F.col("path")))).collect()
    root, proofs, slots = plain_tree(list(digests.values()), fan_out)
    for r in rows:
        assert r["fold"] == bytes(r["root"]).hex() == root
        assert [x["slot"] for x in r["path"]] == slots[r["i"]] and [bytes(x["siblings"]).hex() for x in r["path"]] == ["".join(x) for x in proofs[r["i"]]]


def test_any_change_is_found(spark):
    """A leaf that is not the row's does not fold to the root."""
    rows = merkle.documents_manifest(docs_df(spark, case("one language"))).cache()
    other = merkle.folded(merkle.sha(F.lit("another row")), F.col("path"))
    assert rows.filter(merkle.folded(F.col("digest"), F.col("path")) != F.col("root")).count() == 0
    assert rows.filter(other == F.col("root")).count() == 0
    one = rows.agg(F.min("root")).first()[0]
    for changed in ([*case("one language")[1:]], [*case("one language"), (9999, "x", "en", None, 1)], [(*case("one language")[0][:4], 5), *case("one language")[1:]]):
        assert merkle.documents_manifest(docs_df(spark, changed)).first()["root"] != one
