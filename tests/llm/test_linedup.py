import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import ascii_lower, docs_df, documents
from tests.oracle import connect, spark_rows, sql_rows
from verilake.llm import linedup, words
from verilake.llm.queries import ORACLES, QUERIES


def brute(rows, order, t=0.8):
    """Line numbers that go, by doc_id and text; rows alike in both are one document. order: a place for each text."""
    lines = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None and text:
            for k, x in enumerate(text.split("\n")):
                if w := ascii_lower(x).split():
                    lines[doc_id, order[text], k, text] = frozenset(w)
    gone = {}
    places = sorted(lines)
    for a, p in enumerate(places):
        x = lines[p]
        if any(10 * len(x & lines[q]) >= 10 * t * len(x | lines[q]) - 1e-9 for q in places[:a]):
            gone.setdefault((p[0], p[3]), []).append(p[2])
    return gone


def check(spark, rows):
    docs = docs_df(spark, rows)
    found = linedup.find_repeated_lines(docs).collect()
    order = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    want = brute(rows, order)
    expected = Counter()
    for i, x, *_ in rows:
        gone = want.get((i, x), [])
        expected[i, x if x is None else "\n".join(y for k, y in enumerate(x.split("\n")) if k not in gone), tuple(gone)] += 1
    assert Counter((r["doc_id"], r["text"], tuple(r["removed"])) for r in found) == expected


def test_equals_brute_force(spark):
    check(spark, documents())


@pytest.mark.parametrize("run", [2, 16])
def test_families_of_similar_lines(spark, monkeypatch, run):
    """Many lines that share their rare words, around the threshold, in runs longer than a block."""
    monkeypatch.setattr(linedup, "RUN", run)
    monkeypatch.setattr(linedup, "BLOCK", 8)
    monkeypatch.setattr(linedup, "CHECKED", 4)
    r = random.Random(3)
    base = [f"rare{k}" for k in range(24)]
    rows = []
    for i in range(70):
        words = list(base)
        for k in r.sample(range(24), r.randrange(0, 7)):
            words[k] = f"other{r.randrange(400)}"
        rows.append((i, " ".join(words) + "\n" + " ".join(r.choice(base) for _ in range(8)), None, None, None))
    r.shuffle(rows)
    check(spark, rows)


def test_rows_that_share_a_doc_id_lose_only_their_own_lines(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven"
    row = lambda i, x: (i, x, None, None, None)
    check(spark, [row(0, a), row(1, b), row(1, a)])
    check(spark, [row(1, b), row(1, a), row(2, f"{a} x\n{a}")])
    check(spark, [row(1, b), row(1, b), row(1, a + "\n" + b), row(1, None), row(None, a)])


def test_short_lines_are_compared(spark):
    row = lambda i, x: (i, x, None, None, None)
    check(spark, [row(0, "Read more\na b c d\n\nx"), row(1, "read MORE\nd c b a\n\nX"), row(2, "a b c d e\na b c\na b c d\nm n o p q r"), row(3, "m n o p q\n \n\t\n日本語")])


def test_very_large_sets(spark, monkeypatch):
    """Sets beyond the size that an entry can hold, around the threshold."""
    monkeypatch.setattr(linedup, "LARGE", 40)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[a:b]) for a, b in ((0, 60), (0, 50), (0, 49), (0, 47), (5, 60), (0, 41), (0, 39), (0, 36), (12, 60), (3, 35))]
    check(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])


def test_one_hot_line(spark):
    """A line that every document has, and near forms of it."""
    hot = "this very line is in every document of the table"
    check(spark, [(i, f"own{i} words{i} of{i} document{i}\n{hot}{' again' * (i % 3 == 1)}\n{hot}", None, None, None) for i in range(300)])


def test_lines_and_texts_of_a_batch_keep_apart():
    """Lines at the ends of texts, empty texts, and a word on either side of an edge."""
    texts = ["a b\n", "", "\n", "c", "d\n\ne f e", None, "\n\ng", "x" * 100 + "\n" + "X" * 100]
    own = linedup._LineSets(*next(words.slices(pa.array(texts)))[1:])
    assert list(zip(own.text.tolist(), own.line.tolist(), own.sizes.tolist(), strict=True)) == [(0, 0, 2), (3, 0, 1), (4, 0, 1), (4, 2, 2), (6, 2, 1), (7, 0, 1), (7, 1, 1)]
    ids = own.digests()[0].tolist()
    assert ids[-1] == ids[-2] and len(set(ids)) == 6


@pytest.mark.parametrize("block", [16, 1 << 18])
def test_word_hashes_depend_on_the_word_alone(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    monkeypatch.setattr(words, "_STEP", pow(words._BASE, block, 1 << 64))
    monkeypatch.setattr(words, "_BACK", pow(words._BASE, -block, 1 << 64))
    texts = [t for _, t, *_ in documents()]
    seen = {}
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts]).slice(1)):
        for _, data, edges in words.slices(column, 5000):
            start, stop = words.spans(data, edges)
            for h, a, b in zip(words.hashes(data, start, stop).tolist(), start.tolist(), stop.tolist(), strict=True):
                assert seen.setdefault(data[a:b].tobytes().lower(), h) == h
    assert set(seen) == {w for t in texts if t for w in t.encode().lower().split()}
    assert len(set(seen.values())) == len(seen)


def test_empty_table(spark):
    assert linedup.find_repeated_lines(docs_df(spark, [])).count() == 0


def test_stage_keeps_columns_and_drops_what_is_empty(spark):
    docs = docs_df(spark)
    out = linedup.without_repeated_lines(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = out.collect()
    assert all(r["text"] is None or r["n_chars"] in (None, 3, 5) or r["n_chars"] == len(r["text"]) for r in rows)
    assert {1, 3} & {r["doc_id"] for r in rows} == set()  # copies of document 0


def test_query_equals_sql(spark, sf):
    name = "op2_set_similarity_join"
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(connect(sf), ORACLES[name])


def test_stage_keeps_documents_of_short_lines(spark):
    """One repeated long line above many short or blank-free unique lines takes nothing else with it."""
    footer = "all the rights in this text are reserved"
    code = [f"x{k} = f({k})" for k in range(2000)]
    verse = [chr(0x4E00 + k) * 12 for k in range(300)]
    texts = [footer, "\n".join([footer, *code]), "\n".join([footer, *verse]), "\n".join([footer, *code[::-1]]), footer + "\n \n", footer + "\n\nEnd of file"]
    rows = [(i, t, None, None, len(t)) for i, t in enumerate(texts)]
    kept = {r["doc_id"]: r["text"] for r in linedup.without_repeated_lines(docs_df(spark, rows)).collect()}
    assert kept == {0: footer, 1: "\n".join(code), 2: "\n".join(verse), 5: "\nEnd of file"}


def test_blocks_find_every_match_of_a_run():
    """All rows in one pair of blocks, free or not, against plain comparison."""
    r = random.Random(8)
    words_of, rows = [f"v{k}" for k in range(40)], []
    for k in range(300):
        own = r.sample(words_of, 12) if k % 3 else rows[r.randrange(len(rows))]["text"].decode().split()[: r.randrange(9, 13)] if rows else r.sample(words_of, 12)
        text = " ".join(own).encode()
        one = linedup._LineSets(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        low, high = one.bitmaps()[0].view(np.int64).tolist()
        rows.append({"word": 1 + k // 150, "other": 2, "i": 0, "j": k // 150, "block": k % 2 if k >= 150 else 0, "free": r.random() < 0.7, "n": len(set(own)), "low": low, "high": high, "doc_id": r.randrange(50), "text_id": k, "line": 0, "id": k, "text": text})
    rows.sort(key=lambda x: (x["word"], x["other"], x["i"], x["j"]))
    want = set()
    for x in rows:
        for y in rows:
            a, b = set(x["text"].split()), set(y["text"].split())
            apart = x["i"] == x["j"] or x["block"] != y["block"]
            if x["free"] and x["word"] == y["word"] and apart and (x["doc_id"], x["text_id"]) > (y["doc_id"], y["text_id"]) and 10 * len(a & b) >= 8 * len(a | b):
                want.add(x["id"])
    batches = pa.Table.from_pylist(rows).select(linedup._BLOCK_ROW).to_batches(max_chunksize=40)
    found = [i for b in linedup._blocks(0.8)(iter(batches)) for i in b.column(0).to_pylist()]
    assert len(want) > 20 and set(found) == want and len(found) == len(want)


@pytest.mark.parametrize("run", [2, 4096])
def test_classes_that_share_half_a_digest(spark, monkeypatch, run):
    """Whatever lines have the same first half of their digests, no other line is taken for them."""
    own = linedup._LineSets

    class Narrow(own):
        def halves(self):
            return own.halves(self) & 3

    monkeypatch.setattr(linedup, "_LineSets", Narrow)
    monkeypatch.setattr(linedup, "RUN", run)
    r = random.Random(5)
    base = [f"rare{k}" for k in range(30)]
    lines = [" ".join(r.sample(base, 9)) for _ in range(40)]
    near = [x + " more" for x in lines[::3]] + [" ".join(x.split()[:-1]) for x in lines[1::3]]
    rows = [(i, "\n".join(r.sample(lines + near, 5)) + f"\nown line of document {i} number {i * i}", None, None, None) for i in range(50)]
    check(spark, rows)


def test_digests_are_of_whole_hashes(monkeypatch):
    """Lines whose words share 48 bits, upper or lower, have digests of their own; ranks change nothing."""
    plain = words.hashes
    texts = ["a b c a b", "c b a", "a b", "b c", "a b d", "", "d"]
    ranks = linedup.Ranks(np.random.default_rng(0).permutation(linedup.RARITY).astype(np.uint64))
    for bits in (0xFFFF, 0xFFFF << 48, 2**64 - 1):
        with monkeypatch.context() as m:
            m.setattr(linedup.W, "hashes", lambda data, start, stop, bits=bits: plain(data, start, stop) & np.uint64(bits))
            for own in (linedup._LineSets(*next(words.slices(pa.array(texts)))[1:], r) for r in (None, ranks)):
                ids = list(zip(*(x.tolist() for x in own.digests()), strict=True))
                assert len(ids) == 6 and ids[0] == ids[1] and len(set(ids)) == 5


@pytest.mark.parametrize("run", [8, 4096])
def test_only_long_runs_are_dealt_by_a_second_word(spark, monkeypatch, run):
    """Short runs are compared as they are; in longer ones the second word is behind the first."""
    plain, seen = linedup._in_finer_runs, []

    def counted(members, known, t):
        out = plain(members, known, t)
        seen.append((members.count(), out.count(), out.filter("other <= word").count()))
        return out

    monkeypatch.setattr(linedup, "_in_finer_runs", counted)
    monkeypatch.setattr(linedup, "RUN", run)
    monkeypatch.setattr(linedup, "BLOCK", 8)
    r = random.Random(4)
    base = [f"rare{k}" for k in range(24)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in r.sample(range(24), r.randrange(0, 7)):
            words[k] = f"other{r.randrange(400)}"
        rows.append((i, " ".join(words), None, None, None))
    check(spark, rows)
    ((members, finer, before),) = seen
    assert before == 0 and (members > 0 and finer > 0 if run == 8 else members == finer == 0)
