"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon.

Frequent words are compiled into a minimal acyclic automaton: words that share
an ending share its states, and each edge carries the number of words before it,
so that reading a word sums up to its number, under which the ids stand. The
automaton is one flat file that each executor maps into memory once, whatever
the number of its Python workers. A word that is not in it is merged exactly, by
the vocabulary's merge ranks.

Texts are worked on in slices: their words are told apart by hash, every distinct
word of a slice is read by the transducer (all of them at once, byte by byte) or
merged (all at once, merge by merge), and texts are put together from the words.

Which words are compiled changes only the speed: both ways give the same ids.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import mmap
import os
import shutil
import struct
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.llm import words as W

#: A word is frequent if it is at least this share of all words, so that at most
#: 1 / FREQUENT words are, whatever the input; frequent words are compiled.
FREQUENT = 2.0**-17
#: Bytes of text that are worked on at once, about.
SLICE = 1 << 23
#: Longer words are merged one by one.
LONG = 40

# Code points that became letters or numbers after Unicode 16,
# which the vocabulary's library does not count as such.
_LATER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_L, _N = rf"[\p{{L}}--[{_LATER}]]", rf"[\p{{N}}--[{_LATER}]]"
# Fixed value: the vocabulary's pre-tokenizer pattern.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+", regex.V1)

# -- words of texts ---------------------------------------------------------

#: Kinds of bytes: a byte of a letter, a digit, other ASCII, a single line break between others, a single blank
#: between others (it belongs to what follows), and those that only the pattern itself can place.
_LETTER, _DIGIT, _SIGN, _BREAK, _BLANK, _ODD = range(6)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x0A], _KIND[0x20], _KIND[0x27] = _BREAK, _BLANK, _ODD  # an apostrophe may open a contraction
#: What may stand beside a blank or a break that is single: no byte of white space, ASCII or other.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x21, 0x7F), 0xC3]] = True


def word_starts(data: np.ndarray, edges: np.ndarray, split_special: regex.Pattern | None, specials: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, special): where the words of texts start, and which are special tokens; every byte is of a word.

    Letters of Latin-1 and ASCII, digits and signs are placed by their bytes. A
    stretch between blanks that holds anything else goes through the pattern, as
    does a whole text with a special token.
    """
    n = len(data)
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the two signs among the letters
    kind[lead] = kind[lead + 1] = _LETTER
    solid = _SOLID[data]
    solid[lead + 1] = True
    inner = np.zeros(n + 1, bool)  # whether the byte before is of the same text
    inner[1:n] = True
    inner[edges] = False
    single = np.flatnonzero((kind == _BLANK) | (kind == _BREAK))
    ok = inner[single] & inner[single + 1]
    some = single[ok]
    ok[ok] = solid[some - 1] & solid[some + 1]
    kind[single[~ok]] = _ODD
    opens = np.empty(n, bool)  # a word starts here, as far as bytes can tell
    opens[:1] = True
    opens[1:] = kind[1:] != kind[:-1]
    after = np.flatnonzero(kind[:-1] == _BLANK) + 1
    opens[after] = False
    own = edges[:-1][edges[:-1] < n]
    opens[own] = True
    special = np.zeros(0, np.int64)
    odd = kind == _ODD
    raw = data.tobytes()
    if specials and any(s in raw for s in specials):
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if any(s in raw[a:b] for s in specials):
                odd[a:b] = True
                kind[a:b] = _ODD
    if odd.any():
        # stretches run from blank to blank, within a text
        bounds = np.union1d(np.flatnonzero(kind == _BLANK), own)
        bounds = bounds[bounds < n]
        counts = np.add.reduceat(odd, bounds, dtype=np.int64)
        ends = np.append(bounds[1:], n)
        placed, found = [], []
        for k in np.flatnonzero(counts).tolist():
            a, b = int(bounds[k]), int(ends[k])
            opens[a:b] = False
            part = raw[a:b]
            if specials and any(s in part for s in specials):
                for x in split_special.split(part.decode()):
                    if x.encode() in specials:
                        found.append(a)
                        placed.append(a)
                        a += len(x.encode())
                    else:
                        for w in WORD.findall(x):
                            placed.append(a)
                            a += len(w.encode())
            else:
                for w in WORD.findall(part.decode()):
                    placed.append(a)
                    a += len(w.encode())
        opens[placed] = True
        special = np.array(found, np.int64)
    return np.flatnonzero(opens), special


# -- the automaton ----------------------------------------------------------


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The transducer file for (word, ids) pairs; words are distinct, in any order.

    Built incrementally over the sorted words: when the next word leaves a path,
    the states of that path are final and are merged with equal ones. Layout:
    counts, then per state its first edge, per edge target and skip, per word the
    start of its ids, the ids, and per edge the label and per state the end flag.
    """
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]], int]] = []  # (ends, edges, words below)
    path: list[list] = [[False, []]]  # not yet settled: [ends, edges to settled states]
    labels: list[int] = []

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            ends, edges = path.pop()
            key = (ends, tuple(edges))
            at = register.get(key)
            if at is None:
                at = register[key] = len(states)
                states.append((ends, edges, ends + sum(states[t][2] for _, t in edges)))
            path[-1][1].append((labels.pop(), at))

    last = b""
    for word, _ in entries:
        common = len(os.path.commonprefix([last, word]))
        settle(common)
        for c in word[common:]:
            path.append([False, []])
            labels.append(c)
        path[-1][0] = True
        last = word
    settle(0)
    ends, edges = path[0]
    states.append((ends, edges, 0))  # the start state is the last

    edge, target, skip, final = array("Q"), array("I"), array("I"), bytearray()
    for at, (ends, edges, _) in enumerate(states):
        final.append(ends)
        before = int(ends)
        for c, t in edges:
            edge.append(at << 8 | c)
            target.append(t)
            skip.append(before)
            before += states[t][2]
    start, ids = array("I", [0]), array("I")
    for _, own in entries:
        ids.extend(own)
        start.append(len(ids))
    counts = struct.pack("<4Q", len(states), len(edge), len(entries), len(ids))
    return counts + b"".join(x.tobytes() for x in (edge, target, skip, start, ids)) + bytes(final)


class Lexicon:
    """A transducer file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.n_states, n_edges, self.n_words, n_ids = struct.unpack_from("<4Q", self.map)
        at, cuts = 32, []
        for kind, n in (("<u8", n_edges), ("<u4", n_edges), ("<u4", n_edges), ("<u4", self.n_words + 1), ("<u4", n_ids), ("u1", self.n_states)):
            cuts.append(np.frombuffer(self.map, kind, n, at))
            at += cuts[-1].nbytes
        self.edge, self.target, self.skip, self.start, self.ids, self.final = cuts

    def find(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The number of each word data[start:stop], -1 if it is not in the lexicon."""
        state = np.full(len(start), self.n_states - 1, np.int64)
        number = np.zeros(len(start), np.int64)
        found = np.full(len(start), -1, np.int64)
        live, at = np.arange(len(start)), start.copy()
        while len(live):
            ends = at == stop[live]
            over = live[ends]
            found[over] = np.where(self.final[state[over]] > 0, number[over], -1)
            live, at = live[~ends], at[~ends]
            if not len(live) or not len(self.edge):
                break
            key = (state[live].astype(np.uint64) << np.uint64(8)) | data[at]
            edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[edge] == key
            live, at, edge = live[hit], at[hit] + 1, edge[hit]
            number[live] += self.skip[edge]
            state[live] = self.target[edge]
        return found

    def get(self, word: bytes) -> list[int] | None:
        """The word's ids, or None if it is not in the lexicon."""
        k = int(self.find(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.full(1, len(word)))[0])
        return None if k < 0 else self.ids[self.start[k] : self.start[k + 1]].tolist()


# -- the vocabulary ---------------------------------------------------------


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: fixed values."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = [""] * 256, 0
    for b in range(256):
        if b in kept:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return letters


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, behind one another."""
    total = np.cumsum(length)
    return np.repeat(start - (total - length), length) + np.arange(total[-1] if len(total) else 0)


def together(n: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first) of n words from (words, ids, lengths) parts: all ids in the order of words, and where each word's begin, with the end."""
    length = np.zeros(n, np.int64)
    for at, _, lengths in parts:
        length[at] = lengths
    first = np.concatenate(([0], np.cumsum(length)))
    out = np.empty(first[-1], np.int32)
    for at, ids, lengths in parts:
        out[ranges(first[at], lengths)] = ids
    return out, first


class _PairTable:
    """Merge ranks of pairs of ids, many pairs at once: two places for each pair (cuckoo hashing)."""

    def __init__(self, rank: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(rank)).bit_length())
        pairs = np.array(list(rank), np.uint64).reshape(-1, 2)
        keys = ((pairs[:, 0] << np.uint64(32)) | pairs[:, 1]).tolist()
        for seed in range(1, 100):
            self.factors = [np.uint64(W.mix(np.array([2 * seed + k], np.uint64))[0] | np.uint64(1)) for k in (0, 1)]
            if self._fill(keys, list(rank.values())):
                return
        raise ValueError("no place for every pair")

    def _fill(self, keys: list[int], ranks: list[int]) -> bool:
        places = np.stack(self._places(np.array(keys, np.uint64)), 1).tolist()
        held = [-1] * (2 << self.bits)
        for k in range(len(keys)):
            side = 0
            for _ in range(200):
                at = places[k][side]
                held[at], k = k, held[at]
                if k < 0:
                    break
                side = 1 if places[k][0] == at else 0
            else:
                return False
        self.key = np.array([keys[k] if k >= 0 else 2**64 - 1 for k in held], np.uint64)
        self.rank = np.array([ranks[k] if k >= 0 else len(ranks) for k in held], np.int32)
        self.never = len(ranks)
        return True

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return (keys * self.factors[0]) >> shift, ((keys * self.factors[1]) >> shift) + np.uint64(1 << self.bits)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs; ``never`` for pairs that do not merge, and where b is -1."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint32)
        first, second = self._places(keys)
        found = np.where(self.key[second] == keys, self.rank[second], self.never)
        found = np.where(self.key[first] == keys, self.rank[first], found)
        return found


class Vocabulary:
    """A byte-level BPE vocabulary file: exact merges, and ids back to bytes.

    In a vocabulary with word ends, a word's last byte has an id of its own.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], _byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_id = [ids[c] for c in letters]
        self.end_id = [ids[c + (spec["model"].get("end_of_word_suffix") or "")] for c in letters]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []  # by rank
        for a, b in (pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"]):
            self.rank[ids[a], ids[b]] = len(self.merged)
            self.merged.append(ids[a + b])
        self.never = len(self.merged)
        self.pairs = _PairTable(self.rank)
        self.byte_ids, self.end_ids, self.merged_ids = (np.array(x, np.int32) for x in (self.byte_id, self.end_id, self.merged))
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.special_bytes = tuple(content.encode() for content in self.special)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """The word's ids: the pair of lowest rank, leftmost first, is merged until none is left."""
        byte_id = self.byte_id
        ids = [byte_id[b] for b in word]
        ids[-1:] = [self.end_id[b] for b in word[-1:]]
        if len(ids) > 64:
            return self._merge_long(ids)
        rank, never = self.rank.get, self.never
        ranks = [rank(p, never) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != never:
            i = ranks.index(best)
            new = ids[i] = self.merged[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((new, ids[i + 1]), never)
            if i:
                ranks[i - 1] = rank((ids[i - 1], new), never)
        return ids

    def merge_all(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the words data[start:stop], of at most LONG bytes, as ``merge`` gives them.

        Every round makes the first merge of lowest rank in each word that has one.
        """
        n, width = len(start), int((stop - start).max(initial=1))
        at = start[:, None] + np.arange(width)
        ids = np.where(at < stop[:, None], self.byte_ids[data[np.minimum(at, len(data) - 1)]], -1).astype(np.int32)
        ids[np.arange(n), stop - start - 1] = self.end_ids[data[stop - 1]]
        ranks = np.full((n, width), self.never, np.int32)
        ranks[:, :-1] = np.where(ids[:, 1:] >= 0, self.pairs.get(ids[:, :-1], ids[:, 1:]), self.never)
        after = np.tile(np.arange(1, width + 1, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int16), (n, 1))
        live = np.arange(n)
        ids = np.concatenate((ids, np.full((n, 1), -1, np.int32)), 1)  # a stop behind the last place
        while len(live):
            i = ranks[live].argmin(1)
            best = ranks[live, i]
            going = best != self.never
            live, i, best = live[going], i[going], best[going]
            j = after[live, i].astype(np.int64)
            k = after[live, j].astype(np.int64)  # behind the pair, width if nothing is
            new = self.merged_ids[best]
            ids[live, i], ids[live, j], ranks[live, j] = new, -1, self.never
            after[live, i] = k
            more = k < width
            before[live[more], k[more]] = i[more]
            right = ids[live, k]
            ranks[live, i] = np.where(right >= 0, self.pairs.get(new, right), self.never)
            h = before[live, i].astype(np.int64)
            left = h >= 0
            ranks[live[left], h[left]] = self.pairs.get(ids[live[left], h[left]], new[left])
        kept = ids >= 0
        return ids[kept], kept.sum(1)

    def merged_parts(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, ids, lengths) parts of the words ``which`` of data[start:stop], words of like lengths together."""
        size, parts = (stop - start)[which], []
        for low, high in ((0, 8), (8, 12), (12, 20), (20, LONG)):
            at = which[(size > low) & (size <= high)]
            for k in range(0, len(at), 50_000):
                some = at[k : k + 50_000]
                parts.append((some, *self.merge_all(data, start[some], stop[some])))
        for k in which[size > LONG].tolist():
            ids = np.array(self.merge(data[start[k] : stop[k]].tobytes()), np.int32)
            parts.append((np.array([k]), ids, np.array([len(ids)])))
        return parts

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, n log n for very long words."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.rank.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


class Codec:
    """Encodes and decodes texts with a vocabulary and, if given, a lexicon file."""

    def __init__(self, vocabulary_path: str, lexicon_path: str | None = None):
        self.vocabulary = vocabulary(vocabulary_path)
        self.lexicon = Lexicon(lexicon_path) if lexicon_path else None
        self.asked = self.known = 0  # distinct words of slices, and those that the lexicon had

    def word_ids(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of the words data[start:stop] behind one another, and where each word's begin, with the end."""
        n, parts = len(start), []
        numbers = self.lexicon.find(data, start, stop) if self.lexicon else np.full(n, -1)
        self.asked += n
        self.known += int((numbers >= 0).sum())
        at = np.flatnonzero(numbers >= 0)
        if len(at):
            first, n_ids = self.lexicon.start[numbers[at]].astype(np.int64), np.diff(self.lexicon.start).astype(np.int64)[numbers[at]]
            parts.append((at, self.lexicon.ids[ranges(first, n_ids)].astype(np.int32), n_ids))
        return together(n, parts + self.vocabulary.merged_parts(data, start, stop, np.flatnonzero(numbers < 0)))

    def distinct(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: which distinct word each word is, the words up to each text, (start, stop) of the distinct ones, and the special ones."""
        v = self.vocabulary
        start, special = word_starts(data, edges, v.split_special, v.special_bytes)
        stop = np.append(start[1:], len(data))
        h = W.hashes(data, start, stop, W.AS_IT_IS)
        h[np.searchsorted(start, special)] += np.uint64(1)  # the same bytes may also be an ordinary word
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        return which, np.searchsorted(start, edges), start[first], stop[first], np.searchsorted(start, special)

    def runs(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(which, bounds, ids, first) of slices of a column of texts: the distinct word that each word is, the words up to
        each text, the distinct words' ids behind one another, and where each word's begin."""
        special_id = self.vocabulary.special
        for _, data, edges in W.slices(texts, SLICE):
            which, bounds, start, stop, special = self.distinct(data, edges)
            ids, first = self.word_ids(data, start, stop)
            if len(special):
                own = {int(k): special_id[data[start[k] : stop[k]].tobytes().decode()] for k in np.unique(which[special])}
                rows = [np.array([own[k]]) if k in own else ids[first[k] : first[k + 1]] for k in range(len(start))]
                ids, first = np.concatenate(rows).astype(np.int32), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            yield which, bounds, ids, first

    def ids_of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for which, bounds, ids, first in self.runs(texts):
            length = np.diff(first)[which]
            flat = ids[ranges(first[which], length)]
            cuts = np.concatenate(([0], np.cumsum(length)))[bounds]
            yield from (flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return next(self.ids_of(pa.array([text], pa.string()))).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODECS: dict[tuple, Codec] = {}


def codec(vocabulary_path: str, lexicon_name: str | None) -> Codec:
    """This worker's codec; the lexicon file is the one that Spark has put on this node."""
    key = (vocabulary_path, lexicon_name)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary_path, SparkFiles.get(lexicon_name) if lexicon_name else None)
    return _CODECS[key]


# -- Spark ------------------------------------------------------------------


def word_counts(docs: DataFrame, vocabulary_path: str, share: float = FREQUENT) -> DataFrame:
    """(word binary, n long): how often the frequent words occur, and in a null word the number of all words.

    A slice of text gives the words that are at least ``share`` of its words; a
    word of that share of all words is so frequent in some slice. What a word
    counts where it is rarer is left out: it decides nothing but the lexicon.
    """

    def count(batches):
        own = codec(vocabulary_path, None)
        for batch in batches:
            for _, data, edges in W.slices(batch.column(0), SLICE):
                which, _, start, stop, special = own.distinct(data, edges)
                n = np.bincount(which, minlength=len(start))
                n[which[special]] = 0
                at = np.flatnonzero(n >= max(2.0, share * len(which)))
                found = [data[a:b].tobytes() for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.binary()), pa.array([len(which), *n[at].tolist()], pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, vocabulary_path: str, share: float = FREQUENT) -> list[bytes]:
    """The words that are at least ``share`` of all words, hence at most 1 / share words."""
    counts = word_counts(docs, vocabulary_path, share).persist()
    try:
        total = counts.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
        return sorted(bytes(r["word"]) for r in counts.filter("word IS NOT NULL").filter(F.col("n") >= F.lit(max(2.0, share * total))).collect())
    finally:
        counts.unpersist()


def publish_lexicon(spark: SparkSession, words: Iterable[bytes], vocabulary_path: str) -> str:
    """Compile the words' ids and hand the file to every executor, later ones too; its name."""
    merge = vocabulary(vocabulary_path).merge
    blob = compile_lexicon((w, merge(w)) for w in words)
    name = f"lexicon-{hashlib.sha256(blob).hexdigest()[:16]}.bin"
    if name not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        folder = tempfile.mkdtemp(prefix="lexicon-")  # of the driver, which serves the file to executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, name)
        with open(path, "wb") as f:
            f.write(blob)
        spark.sparkContext.addFile(f"file://{path}")
    return name


def encode_documents(docs: DataFrame, vocabulary_path: str, lexicon_name: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (int array) of every whole text.

    A null text is an empty one: no ids. Repeated rows are encoded each by
    itself; columns other than doc_id and text are dropped.
    """

    def encode(batches):
        own = codec(vocabulary_path, lexicon_name)
        for batch in batches:
            ids = list(own.ids_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, text of each row of doc_id, ids; null ids decode to an empty text."""

    def decode(batches):
        own = codec(vocabulary_path, None)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trips(docs: DataFrame, vocabulary_path: str, lexicon_name: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""

    def digest(batches):
        own = codec(vocabulary_path, lexicon_name)
        for batch in batches:
            n_tokens, ids_sha, text_sha = [], [], []
            for which, bounds, ids, first in own.runs(batch.column(1)):
                cuts, flat = first.tolist(), ids.tolist()
                each = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]  # of each distinct word
                written = [",".join(map(str, x)) for x in each]
                decoded = [own.decode_bytes(x) for x in each]
                n, which = np.concatenate(([0], np.cumsum(np.diff(first)[which]))), which.tolist()
                n_tokens += np.diff(n[bounds]).tolist()
                for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                    words = which[a:b]
                    ids_sha.append(hashlib.sha256(",".join(map(written.__getitem__, words)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(map(decoded.__getitem__, words)).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digest, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: encode and decode every document with the byte-level vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trips(docs, path, publish_lexicon(spark, frequent_words(docs, path), path))
