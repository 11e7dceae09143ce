"""License scans: MinHash bands over text windows, verified by shingle containment.

Templates are cut into windows of WINDOW words, one at each word (a shorter
template is one window). A document is cut alike, into overlapping windows one
STRIDE apart. Windows whose signatures share a band are candidates: a verbatim
window always shares all of them, and with BANDS bands of ROWS rows a window of
similarity s is missed with a chance of (1 - s ** ROWS) ** BANDS, 1e-6 at 0.8.
For a candidate the template's word shingles are sought in the words around the
window; it is a finding if CONTAINMENT of them are there. Licenses share most of
their words with their other versions: of findings of different licenses in one
place, the one of the highest containment stays (then the longest template).

Templates are a small table that the caller gives; they and their bands are
broadcast behind a check of their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from verilake.llm import words as W
from verilake.llm.license_table import TABLE
from verilake.llm.setsketch import mix, shingles

SHINGLE = 2
WINDOW = 8
STRIDE = 1
BANDS, ROWS = 16, 2
CONTAINMENT = 0.8
MAX_TEMPLATES = 10_000

# Notices that name a license, then full texts, headers and usual wordings.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    *TABLE,
)

#: With the marks that open comment lines.
_PUNCTUATION = b".,;:!?\"'()[]{}*#/<>-"
_DROPPED = np.isin(np.arange(256), list(_PUNCTUATION))
#: A finding gives way to a better one of another license that has so much of its words.
COVERED = 0.8


def _words_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text, without case and punctuation."""
    for _, data, edges in W.slices(texts):
        keep = ~_DROPPED[data]
        data, edges = data[keep], np.concatenate(([0], np.cumsum(keep)))[edges]
        start, stop = W.spans(data, edges)
        h = W.hashes(data, start, stop)
        cuts = np.searchsorted(start, edges).tolist()
        yield from (h[a:b] for a, b in zip(cuts, cuts[1:], strict=False))


def _words(text: str | None) -> np.ndarray:
    return next(_words_of(pa.array([text], pa.string())))


def _signatures(windows: np.ndarray) -> np.ndarray:
    """MinHash band keys of windows by shingles: windows by BANDS."""
    seeds = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    least = np.full((len(windows), len(seeds)), 2**64 - 1, np.uint64)
    for column in windows.T:
        np.minimum(least, mix(column[:, None] + seeds), out=least)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(windows), 1))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, r::ROWS])
    return keys


def _windows(sh: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    return sh[starts[:, None] + np.arange(k)]


@dataclass
class Templates:
    """Templates ready to be sought: their shingles, and the windows behind each band key."""

    names: list[str]
    sets: list[np.ndarray]
    lengths: list[int]  # in words
    own: list[int]  # width of the windows of each template
    widths: list[int]  # of windows, in shingles
    known: dict[int, np.ndarray]  # shingles of the templates of each width
    bands: dict[int, set[int]]

    @classmethod
    def of(cls, templates: list[tuple[str, str]]) -> Templates:
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        names, sets, lengths, own, widths, bands = [], [], [], [], {}, {}
        for name, text in templates:
            h = _words(text)
            if not len(h):
                continue
            sh = shingles(h, SHINGLE)
            k = min(len(sh), WINDOW - SHINGLE + 1)
            widths.setdefault(k, []).append(sh)
            for key in np.unique(_signatures(_windows(sh, np.arange(len(sh) - k + 1), k))).tolist():
                bands.setdefault(key, set()).add(len(names))
            names.append(name)
            sets.append(np.unique(sh))
            lengths.append(len(h))
            own.append(k)
        return cls(names, sets, lengths, own, sorted(widths), {k: np.unique(np.concatenate(x)) for k, x in widths.items()}, bands)

    def find(self, text: str | None) -> list[dict]:
        """The templates in a text, each with its words and how much of it is there."""
        return self.find_in(_words(text))

    def find_in(self, h: np.ndarray) -> list[dict]:
        """The same for a text's word hashes."""
        if not len(h):
            return []
        sh = shingles(h, SHINGLE)
        places: dict[int, set[tuple[int, int]]] = {}
        seen = {}
        for width in self.widths:
            known = self.known[width]
            at = np.minimum(np.searchsorted(known, sh), len(known) - 1)
            seen[width] = np.flatnonzero(known[at] == sh)
        for width, hits in seen.items():
            if not len(hits):  # a window without a shingle of a template shares no minimum with one
                continue
            k = min(width, len(sh))
            starts = np.unique((hits[:, None] - np.arange(k)).ravel())
            starts = starts[(starts >= 0) & (starts <= len(sh) - k) & (starts % STRIDE == 0)]
            keys = _signatures(_windows(sh, starts, k))
            for s, own in zip(starts.tolist(), keys.tolist(), strict=True):
                for t in {t for key in own for t in self.bands.get(key, ())}:
                    places.setdefault(t, set()).add((max(0, s - len(self.sets[t])), min(len(sh), s + k + len(self.sets[t]))))
        found: dict[int, list[tuple[int, int, float]]] = {}
        for t, around in places.items():
            within = np.array(sorted(around))
            enough = np.diff(np.searchsorted(seen[self.own[t]], within), axis=1)[:, 0] >= CONTAINMENT * len(self.sets[t])
            if not enough.any():  # fewer words around than the template needs
                continue
            there = np.flatnonzero(np.isin(sh, self.sets[t]))
            within = {tuple(x) for x in np.searchsorted(there, within[enough]).tolist()}  # windows around the same shingles give the same
            for a, b in within:
                if b - a < CONTAINMENT * len(self.sets[t]):
                    continue
                share = len(np.unique(sh[there[a:b]])) / len(self.sets[t])
                if share >= CONTAINMENT:
                    found.setdefault(t, []).append((int(there[a]), int(there[b - 1]) + SHINGLE, share))
        out = []
        for t, spans in found.items():
            start, stop, share = None, -1, 0.0
            for a, b, s in [*sorted(spans), (len(h) + 1, 0, 0.0)]:  # spans that overlap are one finding
                if start is not None and a >= stop:
                    out.append({"license": self.names[t], "template": t, "start_word": start, "words": min(stop, len(h)) - start, "containment": share})
                    start = None
                if start is None:
                    start, stop, share = a, b, s
                else:
                    stop, share = max(stop, b), max(share, s)
        return sorted((x for x in out if not any(self._beats(y, x) for y in out)), key=lambda x: (x["start_word"], x["template"]))

    def _beats(self, y: dict, x: dict) -> bool:
        """Whether y, of another license, tells better what is at the place of x."""
        both = min(x["start_word"] + x["words"], y["start_word"] + y["words"]) - max(x["start_word"], y["start_word"])
        rank = lambda f: (f["containment"], len(self.sets[f["template"]]))
        return x["license"] != y["license"] and both >= COVERED * x["words"] and rank(y) > rank(x)


_FOUND = "licenses array<string>, n_findings int, findings array<struct<license: string, template: int, start_word: int, words: int, containment: double>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, licenses (distinct names), n_findings, findings of every whole text.

    Templates are (name, text). A null or empty text has no findings. Every row
    is scanned by itself, repeated rows alike; other columns are dropped.
    """
    kind = docs.schema["doc_id"].dataType
    known = docs.sparkSession.sparkContext.broadcast(Templates.of(list(templates)))  # MAX_TEMPLATES at most
    finding = pa.struct([("license", pa.string()), ("template", pa.int32()), ("start_word", pa.int32()), ("words", pa.int32()), ("containment", pa.float64())])

    def run(batches):
        for batch in batches:
            found = [known.value.find_in(h) for h in _words_of(batch.column(1))]
            names = [sorted({x["license"] for x in f}) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(map(len, found), pa.int32()), pa.array(found, pa.list_(finding))], ["doc_id", "licenses", "n_findings", "findings"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, {_FOUND}")


def op8_window_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: license notices in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
