"""Hierarchical multi-length packing.

Windows come in tiers of 4096, 2048, 1024 and 512 tokens. A document is routed by
its length: whole 4096-token runs of a long one fill windows of their own, the
rest (or a shorter document) goes to the smallest tier that holds it. Each tier
opens its windows with its own documents; the gap behind is filled from the
shorter tiers, the longest piece that fits first, and the last bit with a cut
from a shorter document. Windows are therefore full, and a full window of any
tier needs no padding. What is left when a partition ends is fewer tokens than
its smallest open window; it is cut into windows of powers of two.

Windows of a tier are counted off into step groups of the same number of tokens,
so that every training step costs the same, whatever the tier.

A task packs the documents of its input partition and ends each of its windows
itself: there is no shuffle, no group to be skewed, and a lost task is redone
from the same input. Memory: one batch of token ids, and the open tiers.
"""

from __future__ import annotations

import os
import sys
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from verilake.llm import words as W
from verilake.llm.bpe import ranges, together, vocabulary
from verilake.llm.common import giving_back

TIERS = (4096, 2048, 1024, 512)
#: Tokens of a step group.
STEP = 1 << 16
END = 2
#: Tokens that a task gathers before it packs them.
POOL = 1 << 21
#: Bytes of text that are encoded at once, about, and bytes of the memo of what the library has encoded.
SLICE = 1 << 20
MEMO_BYTES = 50_000_000


# Kinds of bytes: white space, a byte of a letter, a digit, another sign of ASCII, and those that only the library can place.
_GAP, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[W.SPACE] = _GAP
_KIND[0x27] = _ODD  # an apostrophe may open a contraction
_LOW = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


class WordEncoder:
    """Token ids of texts with a vocabulary that drops white space and case and marks the ends of words.

    Such a vocabulary never joins characters over a blank. Stretches between
    blanks that are ASCII and letters of Latin-1 are cut into words by their
    bytes, and every distinct word of a slice of text is merged by the vocabulary's ranks,
    all at once; other stretches go through the library, each once while a memo
    holds it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = vocabulary(path)
        self.memo: dict[bytes, np.ndarray] = {}
        self.held = 0

    def _words(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(data, start, stop, odd): texts in lower case, their words, and which of these are whole stretches as they were."""
        n = len(raw)
        data, kind = _LOW[raw], _KIND[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # the two signs among the letters
        kind[lead] = kind[lead + 1] = _LETTER
        upper = lead[raw[lead + 1] < 0x9F] + 1
        data[upper] += 0x20
        kind[np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))] = _ODD  # <| may open a special token
        start, stop = W.spans(raw, edges)  # stretches
        inside = np.zeros(n + 1, np.int64)
        np.cumsum(kind == _ODD, out=inside[1:])
        strange = inside[stop] > inside[start]
        opens = np.zeros(n + 1, bool)
        opens[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        for a, b in zip(start[strange].tolist(), stop[strange].tolist(), strict=True):
            opens[a:b] = False
            data[a:b] = raw[a:b]
        opens[:-1] &= kind != _GAP
        opens[start] = True
        first = np.flatnonzero(opens)
        # a word ends where the next one starts, or its stretch does
        end = np.minimum(np.append(first[1:], n), stop[np.searchsorted(start, first, "right") - 1]) if len(first) else first
        odd = np.zeros(n + 1, bool)
        odd[start[strange]] = True
        return data, first, end, odd[first]

    def _by_library(self, stretches: list[bytes]) -> list[np.ndarray]:
        new = [x for x in dict.fromkeys(stretches) if x not in self.memo]
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held, new = 0, list(dict.fromkeys(stretches))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for x, e in zip(some, self.tokenizer.encode_batch_fast([y.decode() for y in some], add_special_tokens=False), strict=True):
                self.memo[x] = np.array(e.ids, np.int32)
                self.held += 300 + len(x) + 4 * len(e.ids)
        return [self.memo[x] for x in stretches]

    def ids_of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for _, raw, edges in W.slices(texts, SLICE):
            data, start, stop, odd = self._words(raw, edges)
            bounds = np.searchsorted(start, edges)
            _, first, which = np.unique(W.hashes(data, start, stop, W.AS_IT_IS), return_index=True, return_inverse=True)
            start, stop, odd = start[first], stop[first], np.flatnonzero(odd[first])
            parts = self.vocabulary.merged_parts(data, start, stop, np.setdiff1d(np.arange(len(start)), odd))
            found = self._by_library([data[a:b].tobytes() for a, b in zip(start[odd].tolist(), stop[odd].tolist(), strict=True)])
            if found:
                parts.append((odd, np.concatenate(found), np.array([len(x) for x in found])))
            ids, first = together(len(start), parts)
            length = np.diff(first)[which]
            flat = ids[ranges(first[which], length)]
            cuts = np.concatenate(([0], np.cumsum(length)))[bounds].tolist()
            yield from (flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False))


class Packer:
    """Packs runs of tokens; a run is (tokens, owner, first token), owners are any integers.

    ``add`` takes documents, ``pack`` yields full windows as (tier, pieces) with
    pieces (owner, first token, tokens), and keeps what fills no window.
    ``finish`` yields the rest in windows of powers of two.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers)
        self.waiting: list[tuple[int, int, int]] = []
        self.tokens = 0

    def add(self, owner: int, n: int) -> None:
        if n:
            self.waiting.append((n, owner, 0))
            self.tokens += n

    def pack(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        runs, window = [], self.tiers[-1]
        for n, owner, start in self.waiting:
            while n >= window:
                yield window, [(owner, start, window)]
                self.tokens -= window
                start, n = start + window, n - window
            if n:
                runs.append((n, owner, start))
        runs.sort()
        while runs:
            n, owner, start = runs.pop()  # the longest: tiers come in descending order
            tier = next(t for t in self.tiers if t >= n)
            pieces, gap = [(owner, start, n)], tier - n
            while gap and runs:
                fits = bisect_right(runs, (gap, sys.maxsize, 0))
                n, owner, start = runs.pop(fits - 1 if fits else -1)
                if n > gap:  # none fits: the longest is cut, its rest goes to the tier it now fits
                    insort(runs, (n - gap, owner, start + gap))
                    n = gap
                pieces.append((owner, start, n))
                gap -= n
            if gap:
                self.waiting = [(n, owner, start) for owner, start, n in pieces]
                return
            yield tier, pieces
            self.tokens -= tier
        self.waiting = []

    def finish(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        yield from self.pack()
        runs = self.waiting[::-1]
        self.waiting = []
        while self.tokens:
            size = 1 << (self.tokens.bit_length() - 1)
            pieces, gap = [], size
            while gap:
                n, owner, start = runs.pop()
                if n > gap:
                    runs.append((n - gap, owner, start + gap))
                    n = gap
                pieces.append((owner, start, n))
                gap -= n
            yield size, pieces
            self.tokens -= size


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder, which keeps its memo from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pack(docs: DataFrame, vocabulary_path: str, tiers: tuple[int, ...] = TIERS, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence.

    Every document ends with token END; a null or empty text is that token alone.
    Repeated rows and rows of a null doc_id are packed each by itself. An empty
    table gives no rows. Columns other than doc_id and text are dropped. Column
    ids holds a piece's tokens as little-endian uint32, unless with_ids is false.
    """
    end = np.array([END], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", *(["ids"] if with_ids else [])]
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]

    def run(batches):
        encoder, packer = word_encoder(vocabulary_path), Packer(tiers)
        task = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[object, memoryview]] = {}  # documents whose tokens aren't all placed
        number = sequences = 0
        closed: dict[int, int] = {}

        def emit(windows):
            nonlocal sequences
            rows = []
            for tier, pieces in windows:
                k = closed.get(tier, 0)
                closed[tier] = k + 1
                at, step = 0, task + (tier << 24) + k * tier // STEP
                for owner, start, n in pieces:
                    doc_id, ids = held[owner]
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((doc_id, start, n, zlib.crc32(part), len(ids) // 4, task + sequences, at, tier, step, *([bytes(part)] if with_ids else [])))
                    at += n
                sequences += 1
            waiting = {owner for _, owner, _ in packer.waiting}
            for owner in [x for x in held if x not in waiting]:
                del held[owner]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, id_type if i == 0 else kinds[i]) for i, c in enumerate(columns)], names)

        for batch in batches:
            for doc_id, tokens in zip(batch.column(0).to_pylist(), encoder.ids_of(batch.column(1)), strict=True):
                ids = tokens.astype("<u4").tobytes() + end
                held[number] = (doc_id, memoryview(ids))
                packer.add(number, len(ids) // 4)
                number += 1
                if packer.tokens >= POOL:
                    yield emit(packer.pack())
        yield emit(packer.finish())

    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), schema)


def op9_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents packed into windows of at most 4096 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
