"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit of it a binary classifier on hashed
character n-grams tells the languages with a 1 from those with a 0: its weight
for an n-gram is the log of the n-gram's mean share in the one group over that in
the other. A text's answer to a bit is its mean weight. Decoding adds up, for
each language, the bits' losses against its codeword, each bit with a weight that
says how well it separates the languages; the smallest loss wins, and a text
whose two best codewords lie too close is ambiguous.

The n-gram counts are taken over all labelled rows that may be learned from, in
one distributed aggregation; the model is (languages + bits) x BUCKETS numbers.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from verilake.llm.common import giving_back

#: Hashed n-gram buckets, and the lengths of n-grams.
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Languages that a model can tell apart; a label column with more is an error.
MAX_LANGUAGES = 500
UNKNOWN = "und"
#: A text is ambiguous if its two best languages are closer than this in their shares of the odds.
AMBIGUOUS = 0.05
#: How fast odds fall with the loss.
SHARPNESS = 4.0

_LETTERS: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTERS


def ngrams(text: str | None) -> np.ndarray | None:
    """Bucket counts of the text's n-grams; None if it is null or has no letter.

    Letters are taken in lower case; what lies between them counts as one blank.
    """
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return None
    blank = np.uint32(32)
    code = np.where(letter, code, blank)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.concatenate(([blank], code[keep], [blank]))
    counts = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] * np.uint32(0x9E3779B1)) + code[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(mixed >> np.uint32(18), minlength=BUCKETS)
    return counts


def codewords(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of n languages.

    Up to 7 languages: every way to part them in two. More: the rows of a matrix
    drawn once with a fixed seed, of 10 log2(n) bits, with no two equal or
    opposite columns and with codewords as far apart as the best of 200 draws.
    """
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        return np.array([(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest], float).T
    random, best, apart = np.random.default_rng(1), None, -1.0
    for _ in range(200):
        m = random.choice((-1.0, 1.0), (n, math.ceil(10 * math.log2(n))))
        m = np.unique(m * m[0], axis=1)
        m = m[:, np.abs(m.sum(0)) < n]
        least = ((m.shape[1] - (m @ m.T - 2 * m.shape[1] * np.eye(n))) / 2).min() / m.shape[1]
        if least > apart:
            best, apart = m, least
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits
    bit_weights: np.ndarray  # bits

    @classmethod
    def fit(cls, languages: list[str], counts: np.ndarray) -> Model:
        """From n-gram counts, languages x BUCKETS."""
        codes = codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        weights = np.zeros((BUCKETS, codes.shape[1]))
        if len(languages) > 1:
            for b, bit in enumerate(codes.T):
                weights[:, b] = np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0))
        margin = (share @ weights) * codes  # of each language's mean text, by bit
        reach = np.maximum(margin.min(0), 1e-6) if len(languages) > 1 else np.ones(1)
        weights = weights / np.maximum(np.abs(margin).mean(0), 1e-6)
        return cls(tuple(languages), codes, weights.astype(np.float32), reach / reach.sum())

    def decode(self, counts: np.ndarray) -> tuple[str, float, bool]:
        """(language, share of the odds, whether it is ambiguous) for bucket counts."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        bits = (counts.astype(np.float32) @ self.weights).astype(float) / counts.sum()
        loss = np.exp(-np.clip(self.codes * bits, -5, 5)) @ self.bit_weights
        odds = np.exp(-SHARPNESS * (loss - loss.min()))
        odds /= odds.sum()
        best = int(np.argmax(odds))
        second = np.partition(odds, -2)[-2]
        return self.languages[best], float(odds[best]), bool(odds[best] - second < AMBIGUOUS)


def held_out(doc_id="doc_id"):
    """Whether a row must not be learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame) -> Model | None:
    """Learn from the text and label of rows that are not held out; None if there are none.

    Rows of a null label or without letters teach nothing.
    """

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (found := ngrams(text)) is not None:
                    if lang in seen:
                        seen[lang] += found
                    else:
                        seen[lang] = found
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = docs.filter(~held_out() & F.col("lang").isNotNull()).select("text", "lang")
    table = rows.mapInArrow(giving_back(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = table.limit(MAX_LANGUAGES * BUCKETS + 1).toPandas()
    languages = sorted(found["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return None
    counts = np.zeros((len(languages), BUCKETS))
    counts[np.searchsorted(languages, found["lang"]), found["bucket"]] = found["n"]
    return Model.fit(languages, counts)


def _guess(model: Model | None, text: str | None) -> tuple[str, float, bool]:
    counts = ngrams(text)
    return (UNKNOWN, 0.0, True) if counts is None or model is None else model.decode(counts)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every whole text.

    A null text or one without a letter is ``und`` with score 0. Every row is
    answered by itself, repeated rows alike.
    """
    kind = docs.schema["doc_id"].dataType
    known = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits numbers

    def run(batches):
        for batch in batches:
            found = [_guess(known.value, t) for t in batch.column(1).to_pylist()]
            lang, score, ambiguous = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to_arrow_type(kind)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind.simpleString()}, lang_pred string, score double, ambiguous boolean")


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of a known language, unchanged: those ``und`` or ambiguous go.

    Without a model nothing can be told: every text that has a letter stays.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            found = [_guess(known.value, t) for t in batch.column(at).to_pylist()] if known.value else [(None, 0.0, ngrams(t) is None) for t in batch.column(at).to_pylist()]
            keep = [not ambiguous for *_, ambiguous in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)


def op4_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
