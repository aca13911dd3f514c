"""Word shingles of whole texts: 64-bit hashes, their distinct sets, and MinHash signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bytesview import SPACED_WORD, Words, mix, slices, utf8

_Q = np.uint64(0xD6E8FEB86659FD93)


def of_rows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles row by row, and row offsets; a row of fewer words gives one shingle of them all."""
    h, row = words.hash, words.row
    n = np.diff(row)
    per = np.maximum(n - k + 1, np.minimum(n, 1))
    out_row = np.concatenate([[0], np.cumsum(per)])
    first = np.repeat(row[:-1] - out_row[:-1], per) + np.arange(out_row[-1])
    width = np.repeat(np.minimum(n, k), per)
    total, q = mix(width.astype(np.uint64)), np.ones(1, dtype=np.uint64)
    for j in range(k):
        take = np.minimum(first + j, max(len(h) - 1, 0))
        part = h[take] * q if len(h) else np.zeros(0, dtype=np.uint64)
        total = total + np.where(width > j, part, np.uint64(0))
        q = q * _Q
    return mix(total), out_row


def distinct(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in ascending order, flat, with row offsets."""
    flat, at = of_rows(Words(*utf8(texts), SPACED_WORD), k)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = np.sort(flat[a:b])
        sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if b > a else own)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else flat), np.concatenate([[0], np.cumsum(size)])


def _coefficients(m: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:m] | np.uint64(1), seeds[m:]


def signatures(flat: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """``m`` 16-bit MinHash symbols for each row; rows without shingles give zeros."""
    size = np.diff(at)
    out = np.zeros((len(size), m), dtype=np.int16)
    full = np.flatnonzero(size)
    if len(full):
        starts = at[:-1][full]
        for j, (a, b) in enumerate(zip(*_coefficients(m), strict=True)):
            out[full, j] = mix(np.minimum.reduceat(flat * a + b, starts)).astype(np.uint16).view(np.int16)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def _digests(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """A digest of each row's set; null for an empty one."""
    return pa.array([hashlib.blake2b(flat[a:b], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


def features(docs: DataFrame, k: int, m: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id, n_shingles, set_key`` (digest of the set; null if empty) and ``sig array<smallint>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                flat, at = distinct(part.column("text"), k)
                sig = signatures(flat, at, m)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * m, pa.int32()), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at)), _digests(flat, at), lists], ["id", "n_shingles", "set_key", "sig"])

    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {kind}, n_shingles long, set_key binary, sig array<smallint>")


def shingle_sets(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id, set_key`` and the full set ``shingles array<bigint>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                flat, at = distinct(part.column("text"), k)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), _digests(flat, at), lists], ["id", "set_key", "shingles"])

    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {kind}, set_key binary, shingles array<bigint>")
