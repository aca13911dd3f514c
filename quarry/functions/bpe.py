"""Byte-pair tokens of texts from a local rank file, by an Arrow function that gives offsets only."""

from __future__ import annotations

from base64 import b64decode
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, functions as F


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str):
    """The encoder of a rank file (a token in base64 and its rank on each line); loaded once in a worker process."""
    import tiktoken

    with open(ranks, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b64decode(token): int(rank) for token, rank in pairs}, special_tokens={})


def token_ends(text: Column, ranks: str, pattern: str) -> Column:
    """Where each token of a text ends, in bytes of UTF-8: as many numbers as tokens. Null gives none; special strings are plain text.

    ``ranks`` is a path that every executor can open.
    """

    @F.pandas_udf("array<int>")
    def ends(texts: pd.Series) -> pd.Series:
        encoder = encoding(ranks, pattern)
        return texts.map(lambda t: list(accumulate(map(len, encoder.decode_tokens_bytes(encoder.encode_ordinary(t))))) if t else [])

    return ends(text)
