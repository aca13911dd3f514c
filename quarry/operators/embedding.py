"""Embedding of texts by a replaceable function, loaded once per partition."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Embedder = Callable[[list[str]], np.ndarray]


_WORD = re.compile("[^ \t\n\r\f\v]+")
_LOWER = {upper: upper + 32 for upper in range(65, 91)}


def hashing_embedder(texts: list[str], width: int = 768) -> np.ndarray:
    """Signed feature hashing of words, scaled to unit length; a text without words gives zeros.

    Words lie between ASCII white space, A-Z in lower case. The first four bytes
    of a word's MD5 give its place, their first bit its sign.
    """
    out = np.zeros((len(texts), width))
    places: dict[str, tuple[int, int]] = {}
    for row, text in zip(out, texts, strict=True):
        for word in _WORD.findall(text.translate(_LOWER)):
            if word not in places:
                h = int.from_bytes(md5(word.encode()).digest()[:4], "big")
                places[word] = h % width, 1 if h >> 31 else -1
            at, sign = places[word]
            row[at] += sign
        if (square := row @ row) > 0:
            row /= np.sqrt(square)
    return out.astype(np.float32)


def token_groups(counts: list[int], budget: int, most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of ``budget`` tokens together and ``most`` texts at the utmost; a text above the budget stands alone."""
    out, start, used = [], 0, 0
    for i, n in enumerate(counts):
        if i > start and (used + n > budget or i - start >= most):
            out.append((start, i))
            start, used = i, 0
        used += n
    return [*out, (start, len(counts))] if counts else []


def _vectors(model: Embedder, texts: list[str], width: int) -> list[np.ndarray]:
    found = np.asarray(model(texts), dtype=np.float32)
    if found.shape != (len(texts), width):
        raise ValueError(f"the embedder gave {found.shape}, not {(len(texts), width)}")
    return list(found)


def _each(model: Embedder, texts: list[str], width: int) -> tuple[list[np.ndarray | None], list[str | None]]:
    """Vectors and errors; a group that fails is tried text by text, so that a fault stays with its text."""
    try:
        return _vectors(model, texts, width), [None] * len(texts)
    except Exception as fault:
        if len(texts) == 1:
            return [None], [f"{type(fault).__name__}: {fault}"]
        one_by_one = [_each(model, [t], width) for t in texts]
        return [v for vs, _ in one_by_one for v in vs], [e for _, es in one_by_one for e in es]


def embed(chunks: DataFrame, embedder: Callable[[], Embedder] | None = None, *, text_col: str = "text", width: int = 768, batch: int = 256, budget: int = 17_000, errors: bool = False) -> DataFrame:
    """Add ``embedding array<float>``, one vector per text. ``embedder`` makes the function, once per partition; its width is checked.

    The function gets ``budget`` tokens and ``batch`` texts at the utmost
    (tokens as ``n_tokens`` says, else between white space). With ``errors``, a
    text it raises on gets no vector but ``error``, ``"{type}: {message}"``;
    without, the job fails.
    """
    make = embedder or (lambda: partial(hashing_embedder, width=width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for rows in batches:  # of up to 10,000 texts; a group of them at a time is made Python's
            texts = lambda a, n, column=rows.column(text_col): [t or "" for t in column.slice(a, n).to_pylist()]
            counted = "n_tokens" in rows.schema.names
            counts = rows.column("n_tokens").to_pylist() if counted else [len(t.split()) for a in range(0, len(rows), batch) for t in texts(a, batch)]
            for a, b in token_groups(counts, budget, batch):
                found, faults = _each(model, texts(a, b - a), width) if errors else (_vectors(model, texts(a, b - a), width), None)
                part = rows.slice(a, b - a)
                made = [pa.array(found, pa.list_(pa.float32())), *([pa.array(faults, pa.string())] if errors else [])]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "embedding", *(["error"] if errors else [])])

    rows = chunks.drop("embedding", "error") if errors else chunks.drop("embedding")
    new = [(F.lit(None) if errors else F.array()).cast("array<float>").alias("embedding"), *([F.lit(None).cast("string").alias("error")] if errors else [])]
    return rows.mapInArrow(run, rows.select("*", *new).schema)
