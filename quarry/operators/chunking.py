"""Documents to overlapping token chunks, and chunks to batches within a token budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.text import tokens


def pages_to_text(pages: Column) -> Column:
    """Bodies that are not empty, joined by a space in list order."""
    return F.array_join(F.transform(F.filter(pages, lambda p: p.body.isNotNull() & (p.body != "")), lambda p: p.body), " ")


def page_rows_to_text(pages: DataFrame, id_col: str = "doc_id", order_col: str = "pos") -> DataFrame:
    """As :func:`pages_to_text`, for pages that arrive as rows."""
    rows = F.array_sort(F.collect_list(F.struct(order_col, "body")))
    return pages.groupBy(id_col).agg(pages_to_text(rows).alias("text"))


def chunk_count(n: Column, max_tokens: int, overlap: int) -> Column:
    step = max_tokens - overlap
    return F.when(n == 0, 0).when(n <= max_tokens, 1).otherwise(1 + F.ceil((n - max_tokens) / step)).cast("int")


def _step(max_tokens: int, overlap: int) -> int:
    if overlap >= max_tokens or overlap < 0 or max_tokens < 1:
        raise ValueError("overlap must be at least 0 and below max_tokens")
    return max_tokens - overlap


def chunk(docs: DataFrame, *, text_col: str = "text", max_tokens: int = 800, overlap: int = 200, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """Replace the text of each row by its chunks: ``chunk_index, text, n_tokens``.

    Chunk ``i`` holds tokens from ``i * (max_tokens - overlap)`` on; the last is
    the first that reaches the end. ``tokenize`` gives the tokens of a text,
    which joined give the text back. Empty or null texts give no chunk. No
    shuffle: a row's chunks are cut from its own token list.
    """
    step = _step(max_tokens, overlap)
    rest = [c for c in docs.columns if c != text_col]
    # a text is empty if its token list is; asking the text keeps the list from being made twice
    t = docs.where(F.length(text_col) > 0).select(*rest, tokenize(F.col(text_col)).alias("__t"))
    last = chunk_count(F.size("__t"), max_tokens, overlap) - 1
    parts = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("chunk_index"), F.array_join(F.slice("__t", i * step + 1, F.lit(max_tokens)), "").alias("text"),
            F.least(F.lit(max_tokens), F.size("__t") - i * step).alias("n_tokens"),
        ),
    )
    return t.select(*rest, F.inline(parts))


def chunk_bytes(docs: DataFrame, ends: Callable[[Column], Column], *, text_col: str = "text", max_tokens: int = 800, overlap: int = 200) -> DataFrame:
    """As :func:`chunk`, for tokens that are bytes and may end inside a character.

    ``ends`` gives the byte offsets at which a text's tokens end (see
    :func:`quarry.functions.bpe.token_ends`). Half characters at the edges of a
    chunk become U+FFFD.
    """
    step = _step(max_tokens, overlap)
    rest = [c for c in docs.columns if c != text_col]
    t = docs.where(F.length(text_col) > 0).select(*rest, F.col(text_col).cast("binary").alias("__b"), ends(F.col(text_col)).alias("__e"))
    last = chunk_count(F.size("__e"), max_tokens, overlap) - 1
    t = t.select(*rest, "__b", "__e", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    n = F.least(F.lit(max_tokens), F.size("__e") - F.col("chunk_index") * step)
    begin = F.when(F.col("chunk_index") == 0, 0).otherwise(F.try_element_at("__e", F.col("chunk_index") * step))
    stop = F.element_at("__e", F.col("chunk_index") * step + n)
    return t.select(*rest, "chunk_index", F.make_valid_utf8(F.substring("__b", begin + 1, stop - begin).cast("string")).alias("text"), n.alias("n_tokens"))


def chunk_totals(docs: DataFrame, n_tokens: Column, *, max_tokens: int = 800, overlap: int = 200) -> DataFrame:
    """``docs`` with ``n_chunks`` and ``chunk_tokens``, the tokens of all chunks, from the number of tokens alone."""
    _step(max_tokens, overlap)
    n = docs.withColumn("__n", n_tokens).withColumn("n_chunks", chunk_count(F.col("__n"), max_tokens, overlap).cast("long"))
    return n.withColumn("chunk_tokens", F.when(F.col("n_chunks") > 0, F.col("__n") + overlap * (F.col("n_chunks") - 1)).otherwise(0).cast("long")).drop("__n")


def pack_counts(counts: list[int], limit: int) -> list[tuple[int, int, int, int]]:
    """Greedy batches in order: ``(batch_no, item, piece_no, n_tokens)``.

    An item above the limit is cut in pieces of ``limit - 1``, each a batch of
    its own that leaves before the batch being filled.
    """
    out, pending, used, sent = [], [], 0, 0
    for item, n in enumerate(counts):
        if n > limit:
            for piece, start in enumerate(range(0, n, limit - 1)):
                out.append((sent, item, piece, min(limit - 1, n - start)))
                sent += 1
            continue
        if pending and used + n > limit:
            out += [(sent, i, 0, m) for i, m in pending]
            sent, pending, used = sent + 1, [], 0
        pending.append((item, n))
        used += n
    return out + [(sent, i, 0, m) for i, m in pending]


def token_batches(chunks: DataFrame, *, limit: int = 17_000, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, batch_no, chunk_index, piece_no, n_tokens``: batches of each document's chunks within the limit.

    Only counts travel: one list per document, folded in order next to others of
    its partition. Vectors come back by these keys, never by position.
    """
    if limit < 2:
        raise ValueError("limit must be 2 at least")
    lists = chunks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "n_tokens"))).alias("c"))
    lists = lists.select(id_col, F.transform("c", lambda x: x.chunk_index).alias("i"), F.transform("c", lambda x: x.n_tokens).alias("n"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, b, int(index[i]), p, m) for d, index, n in zip(f[id_col], f["i"], f["n"], strict=True) for b, i, p, m in pack_counts([int(x) for x in n], limit)]
            yield pd.DataFrame(rows, columns=[id_col, "batch_no", "chunk_index", "piece_no", "n_tokens"])

    kind = chunks.schema[id_col].dataType.simpleString()
    return lists.mapInPandas(fold, f"{id_col} {kind}, batch_no int, chunk_index int, piece_no int, n_tokens int")
