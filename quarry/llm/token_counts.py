"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bytesview import slices

#: Up to here a text has no character on which Unicode versions of the two libraries could differ.
_PLAIN = re.compile(r"[\t\n\r -~¡-ſ]*\Z")
_CUT = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")
_PIECE = 1 << 16


@lru_cache(maxsize=4)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _fast(path: str, pattern: str, specials: tuple[tuple[str, int], ...]):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))


def pieces(text: str, size: int = _PIECE) -> Iterator[str]:
    """Cut a long text before single spaces between a printable ASCII character and a letter.

    No token of a byte-level vocabulary that splits words before their space
    reaches over such a place, so counts of pieces add up. A stretch without
    such a place stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def counts(texts: list[str], tokenizer: str, ranks: str | None = None, pattern: str | None = None, piece: int = _PIECE) -> list[int]:
    """Token counts as ``tokenizers`` gives them for the file ``tokenizer``, without added special tokens.

    With ``ranks``, the same vocabulary as a rank file, texts of plain Latin
    characters go through the faster library, which gives the same tokens there.
    """
    slow = _slow(tokenizer)
    fast = None
    if ranks and pattern:
        specials = tuple(sorted((t.content, i) for i, t in slow.get_added_tokens_decoder().items() if t.special))
        fast = _fast(ranks, pattern, specials)
    out, late, owner = [0] * len(texts), [], []
    for i, text in enumerate(texts):
        for part in pieces(text, piece):
            if fast is not None and _PLAIN.match(part):
                out[i] += len(fast.encode(part, allowed_special="all"))
            else:
                late.append(part)
                owner.append(i)
    if late:
        for i, code in zip(owner, slow.encode_batch(late, add_special_tokens=False), strict=True):
            out[i] += len(code)
    return out


def count_tokens(docs: DataFrame, tokenizer: str, *, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text.

    Only lengths leave Python. Batches hold about ``batch_bytes`` of text, long
    texts are encoded in pieces cut at safe places; nothing is truncated or
    shuffled. A null text counts as empty (0, 0); null ids and repeated rows
    give a row each; further columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            for part in slices(batch, "text", batch_bytes):
                n = counts(part.column("text").to_pylist(), tokenizer, ranks, pattern)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
