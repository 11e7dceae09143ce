"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-case words, however few; lines without a word are
not compared. Lines of equal sets are one class; its first occurrence is the
class's place. Two classes match if their Jaccard similarity is THRESHOLD or
more. A line goes if an earlier line matches it: earlier is by doc_id, then (for
rows that share it) by the text's hash, then by line.

The join orders the words of a line by rarity. Two matching lines must share one
of the first n - ceil(t * n) + 1 words (prefix filter), their sizes must be
within t of each other (length filter), and at the first word that they share
enough words must be left behind it in both, which must stand among the first
n - ceil(2t / (1 + t) * n) + 1 of the smaller one (positional filter). What passes
is verified on the full sets. Rarity comes from counts in RARITY hashed
buckets over all lines: any order gives the same matches, a rare-first one gives
few candidates.

Prefix words travel as packed arrays, dealt by word, and are sorted and paired
in numpy; a bitmap of each set rules out most pairs that share a word by chance.
A line is first verified against a few lines of the run and against its earliest
one; only those left without a match go on. Each is compared with the earlier
lines of its runs, in blocks. Runs longer than RUN are dealt by the word and a
later one before: two matching lines that share a word of their prefixes share
two of prefixes that are one word longer. No run is cut short.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.llm import words as W
from verilake.llm.common import giving_back
from verilake.sources.scratch import cut

THRESHOLD = 0.8
RARITY = 1 << 18
#: Longer runs of a word are not paired at once; what is left of them is dealt by a second word.
RUN = 4096
#: Pairs of a line that are verified at once; more wait until these have not matched.
FIRST = 2
BLOCK = 512
#: Packed words that meet in one task, about; partners checked against one line in one task.
PART = 500_000
CHECKED = 256
#: A class with a HOTth of all lines meets them where they lie; at most HOT classes have so many.
HOT = 10_000

#: A prefix word of a line: 48 bits (rank and hash) and the set's size (16 bits), the words from this one on (16 bits), the class
#: (half of the set's digest), the doc_id, and a bitmap. A size of LARGE or more is LARGE, and then so are the words from here on.
_ENTRY = np.dtype([("key", "<u8"), ("left", "<u2"), ("id", "<i8"), ("doc", "<i8"), ("bits", "<u8", 2)])
LARGE = 2**16 - 1
_LOW = np.uint64(2**48 - 1)
_REST = np.uint64(2**30 - 1)


class Ranks:
    """The place of each bucket of words from rare to frequent, and the bucket of each place."""

    def __init__(self, places: np.ndarray):
        self.places = places
        self.buckets = np.empty_like(places)
        self.buckets[places] = np.arange(len(places), dtype=np.uint64)

    def ranked(self, h: np.ndarray) -> np.ndarray:
        """48 bits of each word, which ascend from rare to frequent: the rank of its bucket, then 30 bits of its hash."""
        return (self.places[h >> np.uint64(46)] << np.uint64(30)) | ((h >> np.uint64(16)) & _REST)

    def unranked(self, words: np.ndarray) -> np.ndarray:
        """The upper 48 bits of the hashes again."""
        return (self.buckets[words >> np.uint64(30)] << np.uint64(30)) | (words & _REST)


class _LineSets:
    """The word sets of the lines of some texts.

    ``words`` ascend in each set; ``at`` is the set's number. Of each set there
    is the text that it is of, the line there, its size and its digest, which
    does not depend on the ranks. Words are told apart by 48 bits of their hashes,
    and sets by all 64: one half of a digest is of the upper 48 bits of the words,
    the other of the lower 48.
    """

    def __init__(self, data: np.ndarray, edges: np.ndarray, ranks: Ranks | None = None):
        start, stop = W.spans(data, edges)
        self.hashes = W.hashes(data, start, stop)  # of every word, repeats too
        breaks = np.flatnonzero(data == 10) + 1
        n_lines = np.diff(np.searchsorted(breaks, edges, "right")) + 1
        opens = np.sort(np.concatenate((edges[:-1], breaks)), kind="stable")
        line = np.searchsorted(opens, start, "right") - 1
        fresh = np.ones(len(line), bool)
        fresh[1:] = line[1:] != line[:-1]
        own = line[fresh]
        self.number = np.cumsum(fresh) - 1
        self.n = len(own)
        self.words, self.at = self._distinct(self.hashes >> np.uint64(16) if ranks is None else ranks.ranked(self.hashes))
        self.mixed = W.mix((self.words if ranks is None else ranks.unranked(self.words)) * np.uint64(0x9E3779B97F4A7C15))
        self.starts = np.searchsorted(self.at, np.arange(self.n + 1))
        self.sizes = np.diff(self.starts)
        first = np.concatenate(([0], np.cumsum(n_lines)))
        self.text = np.searchsorted(first, own, "right") - 1
        self.line = own - first[self.text]

    def _distinct(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different ones of 48 bits of each word, ascending in each set, and their sets."""
        kept = []
        for low in range(0, self.n, 1 << 16):
            a, b = np.searchsorted(self.number, (low, low + (1 << 16)))
            both = np.sort(((self.number[a:b] - low).astype(np.uint64) << np.uint64(48)) | w[a:b])
            both = both[np.concatenate(([True], both[1:] != both[:-1]))]
            kept.append((both & _LOW, (both >> np.uint64(48)).astype(np.int64) + low))
        words, at = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return words, at

    def _summed(self, values: np.ndarray, how=np.add) -> np.ndarray:
        return how.reduceat(values, self.starts[:-1]) if len(self.sizes) else np.zeros(0, np.uint64)

    def halves(self) -> np.ndarray:
        """The first half of the digest of each set: the sum of a random number for the upper 48 bits of each word."""
        return self._summed(self.mixed).view(np.int64)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Both halves."""
        lower, at = self._distinct(self.hashes & _LOW)
        second = np.add.reduceat(W.mix(lower * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(at, np.arange(self.n))) if self.n else np.zeros(0, np.uint64)
        return self.halves(), second.view(np.int64)

    def bitmaps(self) -> np.ndarray:
        """128 bits for each set: the exclusive or of one bit for each word."""
        bit = self.mixed >> np.uint64(57)
        one = np.uint64(1) << (bit & np.uint64(63))
        high = one * (bit >> np.uint64(6))
        return np.stack([self._summed(x, np.bitwise_xor) for x in (one ^ high, high)], 1)


def _overlap(a, b, t: float):
    """Common words that two sets of these sizes need."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def _prefix_size(n, t: float):
    return n - np.ceil(t * n - 1e-9) + 1


_PIECE = 1024  # buckets that travel together


def line_table(docs: DataFrame) -> DataFrame:
    """Of one pass over the texts: doc_id, text_id, line (from 0), and the digest (id, more) and size n of the word set of every line that has a word.

    Rows that have a piece instead hold what a task has counted of the words of
    some buckets; ``_ranks`` adds them up.
    """
    names = ["doc_id", "text_id", "line", "id", "more", "n", "piece", "counts"]

    def run(batches):
        counts = np.zeros(RARITY, np.int64)
        for batch in batches:
            for row, data, edges in W.slices(batch.column(2)):
                own = _LineSets(data, edges)
                counts += np.bincount(own.hashes >> np.uint64(46), minlength=RARITY)
                at = pa.array(own.text + row)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(own.line.astype(np.int32)), *map(pa.array, own.digests()), pa.array(own.sizes.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], names)
        rows = counts.reshape(-1, _PIECE)
        at = np.flatnonzero(rows.any(1))
        blobs = pa.array([rows[k].tobytes() for k in at.tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), t) for t in [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()]), pa.array(at.astype(np.int32)), blobs], names)

    return docs.mapInArrow(giving_back(run), "doc_id long, text_id long, line int, id long, more long, n int, piece int, counts binary")


def _ranks(table: DataFrame) -> Ranks:
    """From the counts of all texts; twice RARITY numbers."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, np.int64)
                total[k] = total[k] + own if k in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "counts"])

    schema = "piece int, counts binary"
    counts = np.zeros((RARITY // _PIECE, _PIECE), np.int64)
    added = table.filter("piece IS NOT NULL").select("piece", "counts").mapInArrow(add, schema)  # the counts of a task's share of the table
    for r in added.repartition("piece").mapInArrow(add, schema).collect():
        counts[r["piece"]] += np.frombuffer(r["counts"], np.int64)
    places = np.empty(RARITY, np.uint64)
    places[np.argsort(counts.ravel(), kind="stable")] = np.arange(RARITY, dtype=np.uint64)
    return Ranks(places)


def _prefixes(docs: DataFrame, known, parts: int, t: float) -> DataFrame:
    """part, entries: the prefix words of every line, packed, dealt by word.

    Sets of so few words that only an equal one can match have none.
    """

    def run(batches):
        seen, held, n = set(), [], 0

        def flush():
            nonlocal held, n
            entries = np.concatenate(held) if held else np.zeros(0, _ENTRY)
            part = (W.mix(entries["key"] >> np.uint64(16)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            entries, part = entries[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            blobs = [x.tobytes() for x in np.split(entries, cuts)] if len(part) else []
            firsts = np.concatenate(([0], cuts)).astype(int) if len(part) else cuts
            held, n = [], 0
            return pa.RecordBatch.from_arrays([pa.array(part[firsts], pa.int32()), pa.array(blobs, pa.binary())], ["part", "entries"])

        for batch in batches:
            docs_of = batch.column(0).to_numpy()
            for row, data, edges in W.slices(batch.column(1)):
                own = _LineSets(data, edges, known.value)
                ids, bits = own.halves(), own.bitmaps()
                same = ids.view(np.uint64) ^ W.mix(bits[:, 0] ^ W.mix(bits[:, 1]))  # sets that share a half have other bitmaps
                _, first = np.unique(same, return_index=True)
                fresh = np.zeros(len(ids), bool)
                fresh[first] = True
                fresh &= own.sizes >= t * (own.sizes + 1) - 1e-9  # smaller sets have only equal ones at t
                fresh &= np.array([x not in seen for x in same.tolist()], bool)  # a task's repeats of a line add nothing
                if len(seen) > 200_000:
                    seen.clear()
                seen.update(same[fresh].tolist())
                keep = fresh[own.at] & (np.arange(len(own.at)) - own.starts[own.at] < _prefix_size(own.sizes, t)[own.at])
                e, at = np.zeros(int(keep.sum()), _ENTRY), own.at[keep]
                n_words = np.minimum(own.sizes, LARGE)[at]
                e["key"], e["id"], e["doc"], e["bits"] = (own.words[keep] << np.uint64(16)) | n_words.astype(np.uint64), ids[at], docs_of[own.text[at] + row], bits[at]
                e["left"] = np.where(n_words < LARGE, np.minimum(own.starts[at + 1] - np.flatnonzero(keep), LARGE), LARGE)
                held.append(e)
                n += len(e)
                if n > 200_000:
                    yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "part int, entries binary")


def _run_pairs(t: float):
    """Of the packed entries of a part: pairs of classes to verify (kind 0), entries that wait (kind 1).

    Two classes of a word's run are a pair if their sizes, the words left behind
    this one, and the number of bits in which their bitmaps differ, leave room
    for the overlap: an exclusive or differs in no more bits than the sets do in
    words. A class's pairs with the earliest documents are given out; if there are more, the classes of
    the rest wait with the word.
    """

    def pair_up(e: np.ndarray):
        e = e[np.lexsort((e["doc"], e["id"], e["key"]))]
        fresh = np.ones(len(e), bool)
        fresh[1:] = (e["key"][1:] != e["key"][:-1]) | (e["id"][1:] != e["id"][:-1]) | (e["bits"][1:] != e["bits"][:-1]).any(1)
        e = e[fresh]  # of a class its first document here; classes of one id are told apart by their bitmaps
        word, n = e["key"] >> np.uint64(16), (e["key"] & np.uint64(0xFFFF)).astype(np.int64)
        opens = np.ones(len(e), bool)
        opens[1:] = word[1:] != word[:-1]
        first = np.flatnonzero(opens)
        length = np.diff(np.concatenate((first, [len(e)])))
        place = np.arange(len(e)) - np.repeat(first, length)
        waits = np.repeat(length > RUN, length)
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        later, back = np.flatnonzero((place > 0) & ~waits), 1
        left, low, high = e["left"].astype(np.int64), e["bits"][:, 0].copy(), e["bits"][:, 1].copy()
        while len(later):
            b = later - back
            ok = n[b] >= t * n[later] - 1e-9  # sizes ascend: none further back is nearer
            later, b = later[ok], b[ok]
            both = n[later] + n[b]
            need = t / (1 + t) * both - 1e-9
            ok = np.minimum(left[later], left[b]) >= need
            a, b, both, need = later[ok], b[ok], both[ok], need[ok]
            differ = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b])
            ok = ((both - differ) // 2 >= need) | (n[a] == LARGE)
            x.append(a[ok])
            y.append(b[ok])
            back += 1
            later = later[place[later] >= back]
        x, y = np.concatenate(x), np.concatenate(y)
        swap = e["doc"][x] < e["doc"][y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        order = np.lexsort((e["id"][y], e["doc"][y], x))  # the earliest documents first: the same in most runs of a family
        x, y = x[order], y[order]
        opens = np.ones(len(x), bool)
        opens[1:] = x[1:] != x[:-1]
        nth = np.arange(len(x)) - np.repeat(np.flatnonzero(opens), np.diff(np.concatenate((np.flatnonzero(opens), [len(x)]))))
        now = nth < FIRST
        waits[x[~now]] = waits[y[~now]] = True
        return np.stack((e["id"][x[now]], e["id"][y[now]]), 1), e[waits]

    def run(batches):
        at, held = None, []

        def flush():
            pairs, members = pair_up(np.concatenate(held) if held else np.zeros(0, _ENTRY))
            held.clear()
            waiting = [members["id"], (members["key"] >> np.uint64(16)).astype(np.int64), (members["key"] & np.uint64(0xFFFF)).astype(np.int64), members["bits"][:, 0].view(np.int64), members["bits"][:, 1].view(np.int64)]
            given = [*pairs.T, None, None, None]
            column = lambda x, n: pa.nulls(n, pa.int64()) if x is None else pa.array(x)
            columns = [pa.concat_arrays([column(a, len(pairs)), column(b, len(members))]) for a, b in zip(given, waiting, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int32), (len(pairs), len(members)))), *columns], ["kind", "x", "y", "n", "low", "high"])

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != at:
                    yield flush()
                    at = part
                held.append(np.frombuffer(blob, _ENTRY))
        yield flush()

    return run


def _verified(pairs: DataFrame, texts: DataFrame, known, t: float) -> DataFrame:
    """x of those of the distinct pairs (x, y) of classes that match; texts: id, text of a line.

    Lines behind their y are compared by hashes, many at once; those that pass, by
    the words.
    """
    salts = pairs.groupBy("y").agg(F.ceil(F.count("*") / CHECKED).cast("int").alias("salts"))
    members = pairs.join(salts, "y").select("x", "y", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("nth"))
    firsts = salts.select(F.col("y").alias("x"), "y", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("nth"))
    rows = members.unionByName(firsts).join(texts, F.col("x") == F.col("id")).select("y", "salt", "nth", "x", "text")
    spread = rows.repartition("y", "salt").sortWithinPartitions("y", "salt", "nth")

    def matching(hub, hub_text, first, texts, data, edges):
        """The rows of a slice that match their y, and the last y there: group 0 belongs to the y before."""
        own, group = _LineSets(data, edges, known.value), np.cumsum(first)
        is_hub, of = first[own.text], group[own.text]
        keys = (of[own.at].astype(np.uint64) << np.uint64(48)) | own.words
        hubs = np.concatenate((hub, keys[is_hub[own.at]]))  # ascending
        sizes, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        sizes[0], sizes[of[is_hub]], rows[of[is_hub]] = len(hub), own.sizes[is_hub], own.text[is_hub]
        found = []
        if len(own.sizes) and len(hubs):
            there = hubs[np.minimum(np.searchsorted(hubs, keys), len(hubs) - 1)] == keys
            common = np.add.reduceat(there, own.starts[:-1], dtype=np.int64)
            for k in np.flatnonzero(~is_hub & (common >= t / (1 + t) * (own.sizes + sizes[of]) - 1e-9)).tolist():
                row, at = int(own.text[k]), int(of[k])
                a, b = (set(x.lower().split()) for x in (texts[row].as_py(), hub_text if at == 0 else texts[int(rows[at])].as_py()))
                if len(a & b) >= _overlap(len(a), len(b), t):
                    found.append(row)
        if first.any():
            last = np.flatnonzero(is_hub)[-1]
            hub, hub_text = own.words[own.starts[last] : own.starts[last + 1]], texts[int(own.text[last])].as_py()
        return found, hub, hub_text

    def run(batches):
        hub, hub_text = np.zeros(0, np.uint64), b""
        for batch in batches:
            found, first, texts = [], batch.column(2).to_numpy() == 0, batch.column(4)
            for row, data, edges in W.slices(texts):
                n = len(edges) - 1
                rows, hub, hub_text = matching(hub, hub_text, first[row : row + n], texts.slice(row, n), data, edges)
                found += [row + r for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(found, pa.int64()))], ["id"])

    return spread.mapInArrow(giving_back(run), "id long").distinct()


def _in_finer_runs(members: DataFrame, known, t: float) -> DataFrame:
    """Members of runs by the word and each later word of a prefix that is one word longer, without the text.

    Two matching lines are both in the run of the first word that they share, with the second one behind it.
    """
    kept = ["word", "id", "place", "free", "n", "low", "high"]

    def run(batches):
        for batch in batches:
            words = batch.column("word").to_numpy()
            for row, data, edges in W.slices(batch.column("text")):
                own = _LineSets(data, edges, known.value)
                keep = np.arange(len(own.at)) - own.starts[own.at] <= _prefix_size(own.sizes, t)[own.at]
                other, at = own.words[keep].astype(np.int64), own.text[own.at[keep]] + row
                second = other > words[at]
                rows = pa.array(at[second])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in kept), pa.array(other[second])], [*kept, "other"])

    place = members.schema["place"].dataType.simpleString()
    return members.select(*kept, "text").mapInArrow(giving_back(run), f"word long, id long, place {place}, free boolean, n long, low long, high long, other long")


_BLOCK_ROW = ["word", "other", "i", "j", "block", "free", "n", "low", "high", "doc_id", "text_id", "line", "id", "text"]


def _blocks(t: float):
    """Unmatched lines of a pair of blocks that match an earlier line there, on their full sets.

    Sizes and bitmaps leave few pairs whose sets must be made.
    """

    def matched(rows: pa.Table):
        """Ids of the rows, whole pairs of blocks in order, that go."""
        columns = {c: rows.column(c).to_numpy() for c in _BLOCK_ROW if c not in ("id", "text")}
        order = np.lexsort([columns[c] for c in ("n", "j", "i", "other", "word")])
        word, other, i, j, block, free, n, low, high, *place = (columns[c][order] for c in _BLOCK_ROW[:12])
        low, high = low.view(np.uint64), high.view(np.uint64)
        opens = np.ones(len(n), bool)
        opens[1:] = (word[1:] != word[:-1]) | (other[1:] != other[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        first = np.flatnonzero(opens)
        at = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
        when = np.empty(len(n), np.int64)
        when[np.lexsort(place[::-1])] = np.arange(len(n))
        texts, ids, sets, gone = rows.column("text").combine_chunks(), rows.column("id").to_numpy()[order], {}, set()

        def words(k: int) -> set[bytes]:
            if k not in sets:
                sets[k] = set(texts[int(order[k])].as_py().lower().split())
            return sets[k]

        later, back = np.flatnonzero(at > 0), 1
        while len(later):
            ok = n[later - back] >= t * n[later] - 1e-9  # sizes ascend: none further back is nearer
            going = later = later[ok]
            later = later[free[later] | free[later - back]]  # of two that are decided nothing is asked
            b = later - back
            both = n[later] + n[b]
            differ = np.bitwise_count(low[later] ^ low[b]).astype(np.int64) + np.bitwise_count(high[later] ^ high[b])
            ok = (((both - differ) // 2 >= t / (1 + t) * both - 1e-9) | (n[later] == LARGE)) & ((i[later] == j[later]) | (block[later] != block[b])) & (ids[later] != ids[b])
            x, y = np.where(when[later] > when[b], later, b)[ok], np.where(when[later] > when[b], b, later)[ok]
            for k, o in zip(x[free[x]].tolist(), y[free[x]].tolist(), strict=True):
                if k not in gone and len(words(k) & words(o)) >= _overlap(len(words(k)), len(words(o)), t):
                    gone.add(k)
            back += 1
            later = going[at[going] >= back]
        return pa.RecordBatch.from_arrays([pa.array(ids[sorted(gone)], pa.int64())], ["id"])

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([held.column(c).to_numpy() for c in _BLOCK_ROW[:4]])
            changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))
            if len(changes):
                yield matched(held.slice(0, int(changes[-1]) + 1))
                held = held.slice(int(changes[-1]) + 1)
        if held is not None and held.num_rows:
            yield matched(held)

    return run


def _lines_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, text of the wanted lines (id, doc_id, text_id, line)."""
    lists = wanted.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))
    found = docs.join(lists.hint("shuffle_hash"), ["doc_id", "text_id"]).select(F.split("text", "\n", -1).alias("lines"), F.explode("wanted").alias("w"))
    return found.select("w.id", F.get("lines", F.col("w.line")).cast("binary").alias("text"))


def _with_ids(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, text of the rows that are compared; rows alike in both ids are one document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_id, lines: the numbers (from 0) of the lines of each document that an earlier line matches."""
    t = threshold
    docs = _with_ids(docs)
    everything = cut(line_table(docs))
    known = docs.sparkSession.sparkContext.broadcast(_ranks(everything))  # RARITY numbers
    table = everything.filter("piece IS NULL").drop("piece", "counts")
    keys = ["id", "more"]
    classes = table.groupBy(*keys).agg(F.min(F.struct("doc_id", "text_id", "line")).alias("place"), F.first("n").alias("n"), F.count("*").alias("lines"))
    classes = cut(classes.withColumn("number", F.monotonically_increasing_id()))
    sizes = classes.agg(F.sum("n").alias("words"), F.sum("lines").alias("lines")).first()
    parts = max(1, math.ceil((sizes["words"] or 0) * (1.2 - t) / PART))
    packed = _prefixes(docs, known, parts, t).repartition(parts, "part").sortWithinPartitions("part")
    found = cut(packed.mapInArrow(giving_back(_run_pairs(t)), "kind int, x long, y long, n long, low long, high long"))

    # entries know a class by half of its digest; from here on it goes by its number, and if classes share that half, each of them does
    pairs, members = found.filter("kind = 0").select("x", "y").distinct(), found.filter("kind = 1").withColumnRenamed("x", "half").withColumnRenamed("y", "word")
    met = pairs.select(F.col("x").alias("half")).union(pairs.select("y")).union(members.select("half")).distinct()
    named = cut(classes.select(F.col("id").alias("half"), F.col("number").alias("id"), "place").join(met.hint("shuffle_hash"), "half"))
    of = lambda c: named.select(F.col("half").alias(c), F.col("id").alias("id_" + c), F.col("place").alias("place_" + c))
    later = F.col("place_x") > F.col("place_y")
    pairs = pairs.join(of("x"), "x").join(of("y"), "y").filter("id_x <> id_y")
    pairs = pairs.select(F.when(later, F.col("id_x")).otherwise(F.col("id_y")).alias("x"), F.when(later, F.col("id_y")).otherwise(F.col("id_x")).alias("y"))
    members = cut(members.join(named, "half").select("word", "id", "place", "n", "low", "high"))
    first = members.groupBy("word").agg(F.min(F.struct("place", "id", "n", "low", "high")).alias("first"))
    size = F.col("n") + F.col("first.n")
    differ = F.bit_count(F.col("low").bitwiseXOR(F.col("first.low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("first.high")))
    may_match = (F.least("n", "first.n") >= t * F.greatest("n", "first.n") - F.lit(1e-9)) & (((size - differ) / 2 >= t / (1 + t) * size - F.lit(1e-9)) | (F.greatest("n", "first.n") == LARGE))
    to_first = members.join(first, "word").filter((F.col("id") != F.col("first.id")) & may_match)
    pairs = cut(pairs.union(to_first.select("id", "first.id")).distinct())
    texts = cut(_lines_at(docs, named.select("id", "place.*")))

    gone = cut(_verified(pairs, texts, known, t))
    free = members.join(gone.withColumn("gone", F.lit(True)), "id", "left").withColumn("free", F.col("gone").isNull())
    # a run is done with if no line behind its first one is still unmatched; one that is no longer than those paired at once needs no second word
    runs = free.groupBy("word").agg(F.max(F.when(F.col("free"), F.col("place"))).alias("last"), F.min("place").alias("start"), (F.count("*") > RUN).alias("long")).filter("last > start").select("word", "long")
    going = cut(free.join(runs, "word"))
    finer = _in_finer_runs(going.filter("long").join(texts, "id"), known, t)
    rest = cut(going.filter("NOT long").withColumn("other", F.col("word")).select(finer.columns).unionByName(finer))
    runs = rest.groupBy("word", "other").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max(F.when(F.col("free"), F.col("place"))).alias("last"), F.min("place").alias("start")).filter("last > start")
    rest = rest.join(runs, ["word", "other"]).filter("free OR place < last").join(texts, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("word", "other", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "free", "n", "low", "high", "place.*", "id", "text").select(*_BLOCK_ROW)
    more = rest.repartition("word", "other", "i", "j").sortWithinPartitions("word", "other", "i", "j").mapInArrow(giving_back(_blocks(t)), "id long")
    gone = gone.union(more).distinct()

    # only the lines of classes that go, or that have more than one line, meet a verdict
    verdict = classes.join(gone.select(F.col("id").alias("number"), F.lit(True).alias("gone")), "number", "left").filter("gone OR lines > 1")
    verdict = cut(verdict.select(*keys, "place", "lines", F.coalesce("gone", F.lit(False)).alias("gone")))
    often = F.col("lines") * HOT >= F.lit(sizes["lines"] or 0)
    hot = F.broadcast(verdict.filter(often))  # HOT rows at most
    met = table.join(hot, keys).unionByName(table.join(hot, keys, "left_anti").join(verdict.filter(~often).hint("shuffle_hash"), keys))
    out = met.filter(F.col("gone") | (F.struct("doc_id", "text_id", "line") != F.col("place")))
    return out.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _cleaned(docs: DataFrame, threshold: float) -> DataFrame:
    """row (all columns) and text without the repeated lines, with the counts of lines."""
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(docs["text"]).alias("own_text"))
    found = repeated_lines(docs, threshold)
    lines = F.split(F.col("row.text"), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("lines"), i)), "\n")
    removed = F.coalesce(F.size("lines"), F.lit(0))
    text = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(kept)
    joined = own.join(found.hint("shuffle_hash"), (own["own_id"] == found["doc_id"]) & (own["own_text"] == found["text_id"]), "left")
    return joined.select("row", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(removed).alias("removed_lines"), F.col("lines").alias("removed"))


def find_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text without its repeated lines, n_lines, removed_lines, removed (line numbers), for every row.

    A line without a word stays, as does a null or empty text, which has no
    lines. Rows of a null doc_id stay as they are. Rows that repeat doc_id and
    text are one document; rows that share only the doc_id are documents of
    their own, in the order of their texts' hashes. Columns other than doc_id and
    text are dropped.
    """
    out = _cleaned(docs.select("doc_id", "text"), threshold)
    return out.select("row.doc_id", "text", "n_lines", "removed_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with repeated lines cut out of text, and n_chars (if there) as it is then.

    Rows that lost lines go if nothing but blanks is left. Other columns stay as
    they are.
    """
    out = _cleaned(docs, threshold).filter((F.col("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    length = lambda c: F.when(F.col("removed_lines") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c)
    return out.select(*[F.col("text") if c == "text" else length(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def op2_set_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: repeated lines of all documents."""
    return find_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS x
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND text <> '')
), words AS (
  SELECT doc_id, line, list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM lines
), sets AS (
  SELECT doc_id, line, list_sort(list_distinct(w)) AS s FROM words WHERE len(w) > 0
), classes AS (
  SELECT s, min(ROW(doc_id, line)) AS place, row_number() OVER (ORDER BY min(ROW(doc_id, line))) AS c FROM sets GROUP BY s
), items AS (
  SELECT c, len(s) AS n, unnest(s) AS w FROM classes
), common AS (
  SELECT a.c AS x, b.c AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k FROM items a JOIN items b ON a.w = b.w AND a.c > b.c AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n GROUP BY a.c, b.c
), gone AS (
  SELECT DISTINCT x FROM common WHERE 10 * k >= 8 * (nx + ny - k)
), removed AS (
  SELECT t.doc_id, t.line FROM sets t JOIN classes c ON t.s = c.s LEFT JOIN gone g ON g.x = c.c WHERE g.x IS NOT NULL OR ROW(t.doc_id, t.line) <> c.place
), kept AS (
  SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.line) FILTER (WHERE r.line IS NULL) AS text, count(*) AS n_lines, count(r.line) AS removed_lines,
         list(l.line ORDER BY l.line) FILTER (WHERE r.line IS NOT NULL) AS removed
  FROM lines l LEFT JOIN removed r ON l.doc_id = r.doc_id AND l.line = r.line GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, CASE WHEN d.text IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS n_lines, CAST(coalesce(k.removed_lines, 0) AS INTEGER) AS removed_lines,
       CAST(coalesce(k.removed, []) AS INTEGER[]) AS removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
