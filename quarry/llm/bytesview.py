"""Whole UTF-8 texts as flat byte arrays, and their words as arrays of hashes.

Arrow hands a text column over as one byte buffer with offsets. The helpers
here work on that buffer with numpy, a bounded block at a time, so no Python
string per word is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ALNUM_WORD = np.zeros(256, dtype=bool)  # 0-9, a-z, every byte of a non-ASCII character
ALNUM_WORD[48:58] = ALNUM_WORD[97:123] = ALNUM_WORD[128:] = True

SPACED_WORD = np.ones(256, dtype=bool)  # everything but space and \t \n \v \f \r
SPACED_WORD[9:14] = SPACED_WORD[32] = False


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n + 1, dtype=np.uint64)
    if n:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_POW = _powers(_P, BLOCK)
_POW_INV = _powers(_P_INV, BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; a null row is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``limit`` bytes each, one row at least."""
    sizes = np.diff(utf8(batch.column(batch.schema.get_field_index(name)))[1])
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


class Words:
    """Words of all rows: ``start``/``end`` byte positions, ``hash``, and ``row`` offsets into them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.data = data
        starts, ends, hashes = [], [], []
        edges = np.unique(offsets)
        at = 0
        while at < len(data):
            stop = min(at + BLOCK, len(data))
            if stop < len(data):  # a block ends between words
                back = data[at:stop][::-1]
                gap = int(np.argmin(inside[LOWER[back]]))
                if not inside[LOWER[back[gap]]]:
                    stop -= gap
                else:  # one word fills the block: take it whole
                    rest = ~inside[LOWER[data[stop:]]]
                    stop += int(np.argmax(rest)) if rest.any() else len(rest)
            lo, hi = np.searchsorted(edges, [at, stop], side="left")
            s, e, h = _block(LOWER[data[at:stop]], edges[lo:hi] - at, inside)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(h)
            at = stop
        self.start = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        self.row = np.searchsorted(self.start, offsets, side="left")

    def text(self, lo: int, hi: int) -> list[str]:
        """Words ``lo`` to ``hi`` as strings, in lower case."""
        return [LOWER[self.data[a:b]].tobytes().decode("utf-8", "replace") for a, b in zip(self.start[lo:hi], self.end[lo:hi], strict=True)]


def _block(low: np.ndarray, edges: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = inside[low]
    before = np.empty_like(m)
    before[:1] = False
    before[1:] = m[:-1]
    before[edges[edges < len(m)]] = False  # words end with their row
    s = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1:] = False
    after[:-1] = m[1:]
    after[edges[edges > 0] - 1] = False
    e = np.flatnonzero(m & ~after) + 1
    n = len(low)
    pw, pi = (_POW, _POW_INV) if n <= BLOCK else (_powers(_P, n), _powers(_P_INV, n))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * pw[:n], out=total[1:])
    return s, e, mix((total[e] - total[s]) * pi[s])
