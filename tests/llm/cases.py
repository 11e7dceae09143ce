"""Documents with every odd case, and plain versions of what the operators compute."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and a river stone quiet lamp seven green window carries under winter bridge copper paper garden slow morning letter".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + str(r.randrange(60)) * (r.random() < 0.5) for _ in range(n)]
    return "".join(w + ("\n" if r.random() < 0.08 else " ") for w in words).strip()


def documents() -> list[tuple]:
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = prose(2, 70)
    texts = [
        base, base, near, base.upper(), None, "", "   \n\t ", "a", "one two", "?!", "a b c d", prose(3, 200), passage + " " + prose(4, 100), prose(5, 90) + " " + passage, "word " * 3000, prose(6, 20_000),
        "line one of five words\nline one of five words\nanother line that is rather different here", "line one of five words\nshort\n\n", "é ü ñ 日本語 text 😀 mixed", "x" * 30_000, "Released under the MIT License.\n" + prose(7, 60),
        "don't <|endoftext|> we'll see  double  spaces ", *[prose(100 + i, 40 + i) for i in range(30)],
    ]
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, None, None, 5), (None, None, None, None, None), (5000, near, None, "src1", 3)]


def docs_df(spark, rows=None, extra=True):
    """With columns whose names operators might use themselves."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    if extra:
        for c in ("node", "root", "digest", "row", "id", "found", "marks", "lines", "part", "key", "n", "size", "ids", "bucket", "text_crc32"):
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


def shingle_set(text, n):
    words = [w for w in ascii_lower(text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return set()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
