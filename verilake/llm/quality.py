"""Quality rules by compression bands: text that zstandard shrinks too far, or hardly, goes.

Three things are asked of a text, all in one pass and without a shuffle:

- the base rule: at least 50 words, and no more than half of them in windows of
  three words that the text has twice or more;
- its compression ratio as a whole, against the limits of its length: below them
  it repeats itself, above them it is keys, hashes, base64 or other noise;
- the same of its fixed chunks, against the limits of theirs: a text goes where
  chunks outside of them hold more than ``SHARE`` of the bytes of its chunks, so
  that a long text does not hide a long stretch of either kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.llm.common import documents
from verilake.llm.words import AS_IT_IS, SPACE, hashes, mix, slices, spans

MIN_WORDS = 50
WINDOW = 3
LEVEL = 3
CHUNK = 4096
SHARE = 0.2
#: (bytes below which it holds, least ratio, largest ratio). A short text has little to refer back to, so
#: prose of 300 bytes keeps about 0.65 of them, of 1 KB 0.55, of 4 KB 0.47, of 64 KB 0.4; base64 keeps 0.76 at any length.
LIMITS = ((512, 0.30, 0.95), (2048, 0.25, 0.80), (16_384, 0.20, 0.72), (1 << 62, 0.15, 0.68))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.array([b & 0xC0 != 0x80 for b in range(256)]) & ~SPACE  # the first byte of a character that is in a word

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, n_chunks long, repetitive_share double, incompressible_share double, base_failed boolean, reason string, kept boolean"
_NAMES = [c.split()[0] for c in MEASURES.split(", ")]
Limits = tuple[tuple[int, float, float], ...]


def limits_of(size: int, limits: Limits = LIMITS) -> tuple[float, float]:
    """The least and the largest ratio that a text of ``size`` bytes may have."""
    return next((low, high) for below, low, high in limits if size < below)


def _per_text(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return sums[edges[1:]] - sums[edges[:-1]]


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier one."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        n += line in seen and bool(line.strip())
        seen.add(line)
    return n


def repeated_words(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Of words (hash, number of the text, ascending) the count by text of those in windows that a text has again."""
    inside = np.flatnonzero(text[: -(WINDOW - 1)] == text[WINDOW - 1 :])  # where a window starts
    key = text[inside].astype(np.uint64)
    for k in range(WINDOW):
        key = mix(key + h[inside + k])
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.concatenate((inside[order[1:]][same], inside[order[:-1]][same]))
    covered = np.zeros(len(text), bool)
    for k in range(WINDOW):
        covered[again + k] = True
    return np.bincount(text[covered], minlength=n)


class _Press:
    """Compression ratios of texts and of their chunks."""

    def __init__(self, limits: Limits, chunk: int):
        self.limits, self.chunk, self.zstd = limits, chunk, zstandard.ZstdCompressor(level=LEVEL)

    def ratio(self, raw: memoryview) -> float:
        return len(self.zstd.compress(raw)) / len(raw)

    def side(self, size: int, ratio: float) -> int:
        """-1 below the limits of its length, 1 above, 0 within."""
        low, high = limits_of(size, self.limits)
        return -1 if ratio < low else int(ratio > high)

    def judge(self, raw: memoryview) -> tuple[float | None, int, float, float, str | None]:
        """(ratio, chunks, share of the chunks' bytes that repeats itself, share that is noise, what is wrong)."""
        if not len(raw):
            return None, 0, 0.0, 0.0, None
        whole = self.ratio(raw)
        own = self.side(len(raw), whole)
        # a last chunk of under half a chunk is judged with the whole alone
        cuts = range(0, max(1, len(raw) - self.chunk // 2 + 1), self.chunk)
        sides = [own] if len(raw) <= self.chunk else [self.side(len(c), self.ratio(c)) for c in (raw[k : k + self.chunk] for k in cuts)]
        sizes = [min(self.chunk, len(raw) - k) for k in cuts]
        low, high = (sum(s for s, x in zip(sizes, sides, strict=True) if x == side) / sum(sizes) for side in (-1, 1))
        wrong = "repetitive" if own < 0 or low > SHARE else "incompressible" if own > 0 or high > SHARE else None
        return whole, len(sides), low, high, wrong


def measures(texts: pa.Array, limits: Limits = LIMITS, chunk: int = CHUNK) -> pa.RecordBatch:
    """The columns of MEASURES for each of the texts."""
    press, out = _Press(limits, chunk), []
    for _, data, edges in slices(texts):
        n = len(edges) - 1
        start, stop = spans(data, edges)
        of = np.searchsorted(edges, start, "right") - 1
        n_words = np.bincount(of, minlength=n)
        chars, symbols = _per_text(_LETTER[data], edges), _per_text(_SYMBOL[data], edges)
        again = repeated_words(hashes(data, start, stop, AS_IT_IS), of, n)
        failed = (n_words < MIN_WORDS) | (100 * again > 50 * n_words)
        view = memoryview(data)
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            ratio, chunks, low, high, wrong = press.judge(view[a:b])
            reason = "base rule" if failed[k] else wrong
            out.append((int(n_words[k]), int(chars[k]), int(symbols[k]), repeated_lines(data[a:b].tobytes()), int(again[k]), b - a, ratio, chunks, low, high, bool(failed[k]), reason, reason is None))
    kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[c.split()[1]] for c in MEASURES.split(", ")]
    columns = zip(*out, strict=True) if out else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _NAMES)


def judged(docs: DataFrame, limits: Limits = LIMITS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, the counts, ratios and verdict of each text, and why it goes.

    A null or empty text has no words, no ratio and fails the base rule. Words are
    told apart by 64-bit hashes, lines by themselves. Rows that share a doc_id and
    repeated rows are each judged, as are rows of a null doc_id; an empty table
    gives no rows. Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measures(batch.column(1), limits, chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], ["doc_id", *_NAMES])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def without_poor(docs: DataFrame, limits: Limits = LIMITS, chunk: int = CHUNK) -> DataFrame:
    """The documents that are kept, with all their columns, in one pass."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(measures(batch.column(at), limits, chunk).column("kept"))

    return docs.mapInArrow(run, docs.schema)


def op13_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what the base rule and the compression bands say of every document."""
    return judged(documents(spark, sf_dir)).withColumn("doc_id", F.col("doc_id").cast("long"))
