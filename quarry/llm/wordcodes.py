"""Words of whole texts as numbers: each block of a batch with a dictionary of its distinct words.

Equal words get equal codes by their bytes, not by a hash, so what is counted or
looked up by code is exact. Blocks bound the memory whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quarry.llm.bytesview import LOWER, utf8

BLOCK = 1 << 20


@dataclass
class Block:
    """Words of a stretch of text: ``code`` into ``words``, the ``row`` they stand in, and, if asked for, ``stretch``, equal for words with no breaking byte between them."""

    code: np.ndarray
    words: list[bytes]
    row: np.ndarray
    stretch: np.ndarray | None


def cuts(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``limit`` bytes that end after a breaking byte or with a row; one without any of both is as long as it has to be."""
    at = 0
    while at < len(data):
        stop = min(at + limit, len(data))
        if stop < len(data):
            edge = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
            back = breaks[data[at:stop][::-1]]
            inner = stop - int(np.argmax(back)) if back.any() else at
            if max(edge, inner) > at:
                stop = max(edge, inner)
            else:
                row_end = int(offsets[np.searchsorted(offsets, stop, side="left")])
                step = 1 << 16
                for a in range(stop, row_end, step):
                    found = breaks[data[a : min(a + step, row_end)]]
                    if found.any():
                        row_end = a + int(np.argmax(found)) + 1
                        break
                stop = row_end
        yield at, stop
        at = stop


Split = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def blocks(column: pa.Array, inside: np.ndarray, breaks: np.ndarray, *, fold: bool, limit: int = BLOCK, split: Split | None = None, stretches: bool = True) -> Iterator[Block]:
    """The words of a string column, runs of bytes that are ``inside``; with ``fold`` A-Z in lower case. Null rows have none.

    ``split`` may cut words further: from the bytes and whether a word starts at
    each it gives the bytes to take and whether a word or part starts there.
    """
    data, offsets = utf8(column)
    for at, stop in cuts(data, offsets, breaks, limit):
        raw = data[at:stop]
        low = LOWER[raw] if fold else raw
        m = inside[low]
        lo, hi = np.searchsorted(offsets, [at, stop], side="left")
        edges = np.unique(offsets[lo:hi]) - at
        before = np.zeros(len(m), dtype=bool)
        before[1:] = m[:-1]
        before[edges] = False  # words end with their row
        begins = m & ~before
        if split is not None:
            low, begins = split(low, begins)
        start = np.flatnonzero(begins)
        if not len(start):
            continue
        kept = np.cumsum(m, dtype=np.int32)  # bytes of words up to here
        begin = kept[start] - 1
        ends = np.append(begin, kept[-1]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[m]))]).dictionary_encode()
        row = np.searchsorted(offsets, start + at, side="right") - 1
        stretch = np.cumsum(breaks[low], dtype=np.int32)[start] if stretches else None
        # by way of numpy is faster; op12, near its bound on memory, held less without (README)
        words = coded.dictionary.to_pylist() if split is None else coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        yield Block(coded.indices.to_numpy(), words, row, stretch)


def dense(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``keys`` below ``bound`` in ascending order, where each key stands among them, and how often each occurs."""
    if bound <= 4 * len(keys) + 1024:
        counts = np.bincount(keys, minlength=bound)
        present = np.flatnonzero(counts)
        place = np.zeros(bound, dtype=np.int64)
        place[present] = np.arange(len(present))
        return present, place[keys], counts[present]
    return np.unique(keys, return_inverse=True, return_counts=True)
