"""Vectorised text kernel: words and word-sequence hashes of an Arrow string column, without a Python loop.

A column is taken as one byte buffer.  Words are runs of non-separator bytes; a word's 64-bit hash is a polynomial
over its bytes, obtained for all words at once from a wrapping prefix sum; n-gram hashes are polynomials over word
hashes.  Null texts count as empty texts; words never cross rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PART = 4 << 20
_R, _Q1, _Q2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_M64 = (1 << 64) - 1


def _lut(norm: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if norm:  # ASCII punctuation and control bytes separate; ASCII letters are lowered; other bytes belong to words
        for b in range(128):
            t[b] = ord(chr(b).lower()) if chr(b).isalnum() else 0
    else:
        t[[9, 10, 11, 12, 13, 32]] = 0
    return t


PLAIN, NORM = _lut(False), _lut(True)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(r: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n."""
    out = []
    for base in (r, pow(r, -1, 1 << 64)):
        p = np.full(n, base & _M64, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Powers:
    """Growing tables of powers; one for a task."""

    def __init__(self) -> None:
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, r: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self.kept.get(r)
        if have is None or len(have[0]) < n:
            have = self.kept[r] = powers(r, max(n, 1 << 16))
        return have[0][:n], have[1][:n]


def slices(texts: pa.Array, most: int = 1 << 20):
    """(first row, buffer, offsets) for runs of rows of about `most` bytes; a longer text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, lut: np.ndarray, pw: Powers, part: int = PART):
    """(hashes, starts, ends, first): of all words in order; row r has words first[r]:first[r + 1].

    Bytes are taken in parts of about `part`, cut between words, so that a very long text needs memory for its words only.
    """
    if len(data) <= part:
        h, starts, ends = _words(data, off, lut, pw)
        return h, starts, ends, np.searchsorted(starts, off)
    got, a = [], 0
    while a < len(data):
        b = a + part
        while b < len(data):
            gap = np.flatnonzero(lut[data[b : b + part]] == 0)
            b += gap[0] if len(gap) else part
            if len(gap):
                break
        b = min(b, len(data))
        rows = off[(off > a) & (off < b)]
        h, starts, ends = _words(data[a:b], np.concatenate([[a], rows, [b]]) - a, lut, pw)
        got.append((h, starts + a, ends + a))
        a = b
    h, starts, ends = (np.concatenate(x) for x in zip(*got))
    return h, starts, ends, np.searchsorted(starts, off)


def _words(data: np.ndarray, off: np.ndarray, lut: np.ndarray, pw: Powers):
    v = lut[data]
    n = len(v)
    keep = v != 0
    edge = np.zeros(n + 1, bool)  # a word begins at i
    begin = keep.copy()
    begin[1:] &= ~keep[:-1]
    rows = off[1:-1]
    rows = rows[rows < n]
    begin[rows] = keep[rows]
    starts = np.flatnonzero(begin)
    edge[:n] = ~keep
    edge[n] = True
    edge[rows] = True
    stops = np.flatnonzero(edge)
    ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    p, q = pw.of(_R, n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((v.astype(np.uint64) + np.uint64(1)) * p[:n], out=c[1:])
    h = mix((c[ends] - c[starts]) * q[starts])
    return h, starts, ends


def grams(h: np.ndarray, k: int, pw: Powers, second: bool = False) -> np.ndarray:
    """Hash of the k words from each place on; shorter by k - 1, over all rows (windows across rows are the caller's to drop)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    p, q = pw.of(_Q2 if second else _Q1, n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(h * p[:n], out=c[1:])
    return mix((c[k:] - c[: n - k + 1]) * q[: n - k + 1])


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each place of n words: whether k words from it on lie in one row."""
    ok = np.zeros(n + 1, np.int32)
    np.add.at(ok, first[:-1], 1)
    last = np.maximum(first[1:] - k + 1, first[:-1])
    np.add.at(ok, last, -1)
    return (np.cumsum(ok)[:n] > 0)[: max(0, n - k + 1)]


def sliding(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over each w successive values, by doubling."""
    if len(x) < w:
        return x[:0]
    span, have = x, 1
    while have * 2 <= w:
        span = op(span[:-have], span[have:])
        have *= 2
    return op(span[: len(x) - w + 1], span[w - have : w - have + len(x) - w + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
