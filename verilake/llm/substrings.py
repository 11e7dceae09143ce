"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash runs over the bytes of a text. A word boundary is a cut if its hash
is the least among the boundaries around it, so that cuts depend on some forty
bytes and a few words of content and on nothing else: a passage that occurs in
two texts is cut alike in both, whatever was inserted before it. Chunks have
RADIUS + 1 words or more and 2 * RADIUS + 1 on average.

Text without blanks has no such boundaries (Chinese, Japanese, Thai, addresses,
packed code). There a stretch of more than LONG bytes falls into pieces first, at
the characters whose hash is the least among those around them, REACH bytes to
either side; each piece is a word from then on, in cuts, minimum and counts.

Chunks are deduplicated by digest: the first occurrence, by doc_id and position,
stays. A run of neighbouring repeated chunks is removed if it has MIN_WORDS words
or more; shorter repeats are ordinary language and stay. A chunk's 64-bit digest
alone may collide by chance in a corpus of 10**10 chunks, a whole run may not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from verilake.llm.common import giving_back
from verilake.sources.scratch import cut

RADIUS = 3
MIN_WORDS = 20
#: Longer stretches without a blank fall into pieces of more than REACH bytes, 2 * REACH + 1 on average.
LONG = 24
REACH = 4
HOT = 10_000
#: Bytes that the gear hash sees: one bit of it is lost with each.
GEAR_BYTES = 32

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash behind each byte: the sum of gear[byte] << distance, modulo 2**32."""
    h = _GEAR[data]
    step = 1
    while step < GEAR_BYTES:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)


def _pieces(data: np.ndarray, h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Where stretches of more than LONG bytes fall into pieces: the bytes that open one."""
    inside = np.zeros(len(data) + 1, np.int8)
    long = stop - start > LONG
    inside[start[long]] += 1
    inside[stop[long]] -= 1
    at = np.flatnonzero((np.cumsum(inside[:-1], dtype=np.int8) > 0) & (inside[:-1] == 0) & (data & 0xC0 != 0x80))
    value = np.full(len(data) + 2 * REACH, 2**32 - 1, np.uint32)
    value[at + REACH] = _mixed(h[at - 1])
    least = value[: len(data)].copy()
    for k in range(1, 2 * REACH + 1):
        np.minimum(least, value[k : k + len(data)], out=least)
    at = at[value[at + REACH] == least[at]]
    if (np.diff(at) > REACH).all():
        return at
    kept, last = [], -REACH - 1  # equal hashes, as in a run of one character: those too near to the one before go
    for p in at.tolist():
        if p - last > REACH:
            kept.append(p)
            last = p
    return np.array(kept, np.int64)


def _words(data: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of words, long stretches in pieces."""
    edge = np.flatnonzero(np.diff(np.concatenate(([1], _SPACE[data], [1])).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if len(start) and (stop - start).max() > LONG:
        more = _pieces(data, h, start, stop)
        start, stop = np.sort(np.concatenate((start, more))), np.sort(np.concatenate((stop, more)))
    return start, stop


def count_words(text: str | None) -> int:
    """Words of a text, as chunks count them."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if max(map(len, words), default=0) <= LONG:
        return len(words)
    data = np.frombuffer(raw, np.uint8)
    return len(_words(data, gear(data))[0])


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, words) of the chunks of UTF-8 bytes; they start and stop at words or pieces of long ones."""
    data = np.frombuffer(raw, np.uint8)
    h = gear(data)
    start, stop = _words(data, h)
    n = len(start)
    if not n:
        return start, stop, start
    h = _mixed(h[stop - 1])
    beyond = np.full(RADIUS, 2**32 - 1, np.uint32)
    least = h <= np.lib.stride_tricks.sliding_window_view(np.concatenate((beyond, h, beyond)), 2 * RADIUS + 1).min(1)
    cuts = np.flatnonzero(least[:-1]) + 1  # words that open a chunk
    first = np.concatenate(([0], cuts))
    last = np.concatenate((cuts, [n])) - 1
    return start[first], stop[last], last - first + 1


def _digests(raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    found = (xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True))
    return np.fromiter(found, np.uint64, len(start)).view(np.int64)


def chunk_table(docs: DataFrame) -> DataFrame:
    """digest, doc_id, ord of every chunk of every whole text; rows of a null doc_id have none."""
    names = ["digest", "doc_id", "ord"]

    def run(batches):
        for batch in batches:
            held, n = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                start, stop, _ = chunks(raw)
                held.append((_digests(raw, start, stop), np.full(len(start), doc_id, np.int64), np.arange(len(start), dtype=np.int32)))
                n += len(start)
                if n > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    return rows.mapInArrow(giving_back(run), "digest long, doc_id long, ord int")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, marks: the chunks of a document that occur more than once.

    A mark has the chunk's ord and digest, the doc_id of its first occurrence,
    whether this one is later, and whether other documents have it.
    """
    table = cut(chunk_table(docs))
    twice = table.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "ord")).alias("first"), F.max("doc_id").alias("top")).filter(F.col("n") > 1)
    twice = twice.select("digest", "n", F.col("first.doc_id").alias("first"), F.col("first.ord").alias("first_ord"), (F.col("first.doc_id") != F.col("top")).alias("across"))
    later = (F.col("doc_id") != F.col("first")) | (F.col("ord") != F.col("first_ord"))
    # a digest with a HOTth of all chunks meets its occurrences where they lie; at most HOT digests have so many
    twice = cut(twice)
    often = F.col("n") * HOT >= F.lit(twice.agg(F.sum("n")).first()[0] or 0)
    hot = F.broadcast(twice.filter(often))
    met = table.join(hot, "digest").unionByName(table.join(hot, "digest", "left_anti").join(twice.filter(~often), "digest"))
    marks = met.select("doc_id", F.struct("ord", "digest", "first", later.alias("later"), "across").alias("mark"))
    return marks.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))


def _edit(text: str, marks: list[dict], min_words: int):
    """(text without its repeated passages, words, shared words, removed words, passages)."""
    raw = text.encode("utf-8", "surrogatepass")
    start, stop, words = chunks(raw)
    digest = _digests(raw, start, stop)
    later, shared, first = np.zeros(len(start), bool), np.zeros(len(start), bool), np.zeros(len(start), np.int64)
    for m in marks:
        if m["ord"] < len(start) and digest[m["ord"]] == m["digest"]:  # else it is of another row of this doc_id
            later[m["ord"]], shared[m["ord"]], first[m["ord"]] = m["later"], m["across"], m["first"]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], later, [0])).astype(np.int8)))
    kept, at, passages, removed = [], 0, [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        n = int(words[a:b].sum())
        if n >= min_words:
            kept.append(raw[at : start[a]])
            at = stop[b - 1]
            removed += n
            passages.append({"start": int(start[a]), "stop": int(stop[b - 1]), "words": n, "first_doc": int(first[a])})
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass") if passages else text, int(words.sum()), int(words[shared].sum()), removed, passages


_REPORT = "text string, n_words int, shared_words int, removed_words int, passages array<struct<start: int, stop: int, words: int, first_doc: long>>"


def _edited(docs: DataFrame, min_words: int) -> DataFrame:
    """row (the other columns), and the edited text with its report."""
    others = [c for c in docs.columns if c != "text"]
    own = docs.select(F.struct(*[docs[c] for c in others]).alias("row"), docs["text"].alias("text"), docs["doc_id"].cast("long").alias("id"))
    found = repeats(docs).withColumnRenamed("doc_id", "found")
    joined = own.join(found.hint("shuffle_hash"), own["id"] == found["found"], "left").select("row", "text", "marks")
    shape = own.select("row").schema.add("text", "string")
    out = docs.sparkSession.createDataFrame([], _REPORT).schema
    for field in out.fields[1:]:
        shape = shape.add(field)
    kinds = [to_arrow_schema(out).field(c).type for c in out.names]

    def run(batches):
        for batch in batches:
            rows = []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if marks and text:
                    rows.append(_edit(text, marks, min_words))
                else:
                    rows.append((text, count_words(text), 0, 0, []))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["row", *out.names])

    return joined.mapInArrow(giving_back(run), shape)


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without repeated passages, and what was found, for every row.

    shared_words counts words in chunks that other documents have too, first
    occurrences included; removed_words and passages (UTF-8 byte spans, and the
    document that the first chunk was taken from) what was cut out. A null text
    stays null, a text without words stays as it is. Each piece of a stretch of
    more than LONG bytes without a blank counts as a word. Rows of a null doc_id stay
    as they are, and rows that repeat doc_id and text are one occurrence. Columns
    other than doc_id and text are dropped.
    """
    out = _edited(docs.select("doc_id", "text"), min_words)
    return out.select("row.doc_id", "text", "n_words", "shared_words", "removed_words", "passages")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with repeated passages cut out of text, and n_chars (if there) as it is then.

    Rows of which no word is left go; other columns stay as they are.
    """
    out = _edited(docs, min_words).filter((F.col("removed_words") == 0) | (F.col("removed_words") < F.col("n_words")))
    length = lambda c: F.length("text").cast(docs.schema[c].dataType).alias(c)
    return out.select(*[F.col("text") if c == "text" else F.when(F.col("removed_words") > 0, length(c)).otherwise(F.col("row")[c]).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def op6_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: repeated passages of all documents."""
    return find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
