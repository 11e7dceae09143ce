"""The words of many texts at once, from Arrow buffers, in numpy.

Words are what white space parts (blank, tab to carriage return), A-Z in lower
case. A word's hash is a polynomial of its bytes modulo 2**64, which prefix sums
over a block of text give for all its words in a few passes over the bytes; long
words, for which such a polynomial is weaker, are hashed one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are summed at once.
BLOCK = 1 << 18
#: Longer words are hashed by xxhash.
LONG = 48

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    found = np.full(BLOCK, base, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


_BASE = 0xD1342543DE82EF95
_UP = _powers(_BASE)
_DOWN = _powers(pow(_BASE, -1, 1 << 64))
_STEP, _BACK, _ALL = pow(_BASE, BLOCK, 1 << 64), pow(_BASE, -BLOCK, 1 << 64), (1 << 64) - 1
#: A random number for each byte, and one that is the same for a letter of ASCII in either case.
AS_IT_IS = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
LOWER = AS_IT_IS[[b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts and where each text starts, with the end; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the words of ``data``; no word reaches over an edge."""
    gap = np.ones(len(data) + 2, bool)  # one more on either side
    np.less(data - np.uint8(0x09), np.uint8(5), out=gap[1:-1])  # tab to carriage return
    gap[1:-1] |= data == 0x20
    inner = edges[(edges > 0) & (edges < len(data))]
    turns = np.flatnonzero(gap[1:] != gap[:-1])  # words open and close in turn
    start, stop = turns[::2], turns[1::2]
    across = inner[~gap[inner] & ~gap[inner + 1]]
    if len(across):
        start, stop = (np.sort(np.concatenate((x, np.unique(across)))) for x in (start, stop))
    return start, stop


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, byte: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word; ``byte`` is LOWER, or AS_IT_IS to tell letters of either case apart."""
    h = np.zeros(len(start), np.uint64)
    ends, scales = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    carry, up, down = 0, 1, 1
    sums = np.zeros(BLOCK + 1, np.uint64)
    i = j = 0
    for at in range(0, len(data), BLOCK):
        own = data[at : at + BLOCK]
        n = len(own)
        np.cumsum(byte[own] * _UP[:n], out=sums[1 : n + 1])
        i2, j2 = i + np.searchsorted(start[i:], at + n), j + np.searchsorted(stop[j:], at + n, "right")
        local = start[i:i2] - at
        scale = _DOWN[local] * np.uint64(down)
        # of a word that starts here: less what is before it; the sum up to its end comes when that is reached
        h[i:i2] = (sums[local] * np.uint64(up) + np.uint64(carry)) * scale
        ends[j:j2] = sums[stop[j:j2] - at] * np.uint64(up) + np.uint64(carry)
        scales[i:i2] = scale
        carry, up, down = (carry + up * int(sums[n])) & _ALL, (up * _STEP) & _ALL, (down * _BACK) & _ALL
        i, j = i2, j2
    h = mix(ends * scales - h)
    for k in np.flatnonzero(stop - start > LONG).tolist():
        word = data[start[k] : stop[k]].tobytes()
        h[k] = xxhash.xxh3_64_intdigest(word.lower() if byte is LOWER else word)
    return h


def slices(texts: pa.Array, size: int = 1 << 20):
    """(first row, data, edges) of runs of texts of about ``size`` bytes each; a longer text makes a run of its own."""
    data, edges = buffers(texts)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(edges, edges[row] + size, "right")) - 1)
        yield row, data[edges[row] : edges[end]], edges[row : end + 1] - edges[row]
        row = end
