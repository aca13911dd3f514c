"""Benchmark decontamination by winnowing.

Of every run of ``w`` consecutive word k-grams the one with the smallest hash is
a fingerprint, on both sides. With ``k + w - 1`` equal to the window of ``n``
words, any shared span of ``n`` words holds a fingerprint of both texts at the
same place. Fingerprints are joined, and each hit is extended word by word to
the left and right, as far as any window around it can reach; the extension
compares the words themselves. Items shorter than a window are looked up by the
hash of all their words, at every place of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.bytesview import ALNUM_WORD, Words, mix, slices, utf8
from quarry.scratch import materialize
from quarry.spread import copied, deal, hot_parts

_Q = np.uint64(0xA0761D6478BD642F)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: The filter sent to every task has so many bits at most, however large the benchmark is.
_FILTER_BITS = 22

_HIT = "struct<size:int,h:long,pos:int,left:array<string>,gram:array<string>,right:array<string>>"


def _grams(words: Words, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; ``_NONE`` where the row ends before."""
    h, row = words.hash, words.row
    out = np.full(len(h), _NONE)
    if len(h) >= n:
        total, q = np.zeros(len(h) - n + 1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
        for j in range(n):
            total += h[j : len(h) - n + 1 + j] * q
            q = q * _Q
        out[: len(total)] = mix(total + np.uint64(n)) >> np.uint64(1)  # below _NONE
        ends = row[1:]
        for j in range(1, n):  # words too close to their row's end
            late = ends - j
            out[late[(late >= row[:-1]) & (late >= 0)]] = _NONE
    return out


def _running_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def fingerprints(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the smallest hash of some run of ``w`` k-grams (all of them on ties)."""
    if len(grams) < w:
        return np.zeros(0, dtype=np.int64)
    low = _running_min(grams, w)
    pad = np.zeros(w - 1, dtype=np.uint64)
    most = ~_running_min(~np.concatenate([pad, low, pad]), w)  # largest of the minima of the runs around a place
    return np.flatnonzero((most == grams) & (grams != _NONE))


def _hits(words: Words, k: int, n: int, short: list[int], known: np.ndarray | None) -> list[list[dict]]:
    """For each row its fingerprints (size ``k``) and its runs of ``short`` words (sizes below 0), with the words around."""
    found: list[list[dict]] = [[] for _ in range(len(words.row) - 1)]
    row = words.row
    for size, whole in [(k, False), *((x, True) for x in short)]:
        grams = _grams(words, size)
        at = np.flatnonzero(grams != _NONE) if whole else fingerprints(grams, n - k + 1)
        if known is not None and len(at):
            at = at[known[_slot(size, grams[at])]]
        if not len(at):
            continue
        owner = np.searchsorted(row, at, side="right") - 1
        reach = 0 if whole else n - k
        for p, r in zip(at.tolist(), owner.tolist(), strict=True):
            a, b = max(int(row[r]), p - reach), min(int(row[r + 1]), p + size + reach)
            t = words.text(a, b)
            found[r].append({"size": -size if whole else size, "h": int(grams[p]), "pos": p - int(row[r]), "left": t[: p - a][::-1], "gram": t[p - a : p - a + size], "right": t[p - a + size :]})
    return found


def _slot(size: int, h: np.ndarray) -> np.ndarray:
    return (mix(h + np.uint64(size)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _texts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).cast("string").alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def _item_grams(items: DataFrame, k: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints of the items: ``id, size, h, slot, left, gram, right``; a short item is one gram of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*utf8(part.column("text")), ALNUM_WORD)
                long = _hits(words, k, n, [], None)
                out = []
                for i, (item, a, b) in enumerate(zip(part.column("id").to_pylist(), words.row[:-1].tolist(), words.row[1:].tolist(), strict=True)):
                    if b - a >= n:
                        out += [x | {"id": item} for x in long[i]]
                    elif b > a:
                        one = Words.__new__(Words)
                        one.hash, one.row = words.hash[a:b], np.array([0, b - a])
                        h = int(_grams(one, b - a)[0])
                        out.append({"id": item, "size": -(b - a), "h": h, "pos": 0, "left": [], "gram": words.text(a, b), "right": []})
                for x in out:
                    x["slot"] = int(_slot(abs(x["size"]), np.array([x["h"]], dtype=np.uint64))[0])
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows, kind = _texts(items, id_col, text_col)
    ids = pa.int64() if kind in ("bigint", "int") else pa.string()
    words = pa.list_(pa.string())
    schema = pa.schema([("id", ids), ("size", pa.int32()), ("h", pa.int64()), ("slot", pa.int32()), ("left", words), ("gram", words), ("right", words)])
    rows = rows.withColumn("id", F.col("id").cast("bigint" if ids == pa.int64() else "string"))
    return rows.mapInArrow(run, f"id {'bigint' if ids == pa.int64() else 'string'}, size int, h long, slot int, left array<string>, gram array<string>, right array<string>")


def _equal_prefix(a: Column, b: Column) -> Column:
    """How many words two lists share from their start."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def overlaps(docs: DataFrame, items: DataFrame, *, window: int = 13, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """What each document shares with the benchmark.

    Per distinct ``(doc_id, text)`` row: ``doc_id, n_words, spans
    array<struct<start,stop>>`` (word positions, disjoint, ascending), ``n_hit``
    (words inside them) and ``items`` (distinct ids of matching items, as
    strings, sorted).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased,
    of whole texts. A window is ``window`` consecutive words of an item; an item
    of fewer words is one window, one without words none. Null texts have no
    words; null item ids match but are not listed; repeated item rows change
    nothing; exact repeats of a document give one row; tables may be empty and
    have further columns.
    """
    spark = docs.sparkSession
    own = _item_grams(items, k, window, item_col, item_text_col)
    # equal surroundings are one entry with a name of its own, however many items hold the passage
    own = own.withColumn("name", F.md5(F.to_json(F.struct("size", "h", "left", "gram", "right"))))
    own = materialize(own, "item-grams")
    bench = materialize(own.groupBy("name").agg(*[F.first(c).alias(c) for c in ("size", "h", "slot", "left", "gram", "right")]), "benchmark-grams")
    holders = own.where("id is not null").select("name", F.col("id").cast("string").alias("item")).distinct()
    slots = bench.select("slot").distinct().toArrow().column("slot").to_numpy()  # 2^22 small numbers at most
    sizes = sorted(-r.size for r in bench.where("size < 0").select("size").distinct().collect())  # window - 1 numbers at most
    bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
    bits[slots] = True
    sent = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                words = Words(*utf8(part.column("text")), ALNUM_WORD)
                hits = _hits(words, k, window, sizes, known)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tag"), pa.array(np.diff(words.row)), pa.array(hits, pa.list_(hit))], ["id", "tag", "n_words", "hits"])

    text = pa.list_(pa.string())
    hit = pa.struct([("size", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()), ("left", text), ("gram", text), ("right", text)])
    rows, kind = _texts(docs, id_col, text_col)
    read = rows.mapInArrow(run, f"id {kind}, tag long, n_words long, hits array<{_HIT}>")
    # rows without hits stay in the same plan; their join keys differ, so they don't meet in one task
    flat = read.select("id", "tag", "n_words", F.explode_outer("hits").alias("x")).select("id", "tag", "n_words", "x.*")
    flat = flat.withColumns({"h": F.coalesce("h", F.xxhash64("id", "tag")), "size": F.coalesce("size", F.lit(0))})
    b = bench.select("size", "h", F.col("left").alias("b_left"), F.col("gram").alias("b_gram"), F.col("right").alias("b_right"), "name")
    met = flat.join(b, ["size", "h"], "left")
    to_left, to_right = _equal_prefix(F.col("left"), F.col("b_left")), _equal_prefix(F.col("right"), F.col("b_right"))
    length = F.abs("size") + to_left + to_right
    true_hit = (F.col("gram") == F.col("b_gram")) & ((F.col("size") < 0) | (length >= window))
    span = F.struct((F.col("pos") - to_left).alias("start"), (F.col("pos") + F.abs("size") + to_right).alias("stop"))
    met = met.select("id", "tag", "n_words", F.when(true_hit, span).alias("span"), F.when(true_hit, F.col("name")).alias("name"))
    by = met.groupBy("id", "tag").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("name").alias("names"))
    by = materialize(by, "hits")
    # names become items once a document, and a passage that many documents hold is dealt to several tasks
    found = by.select("id", "tag", F.explode("names").alias("name"))
    hot = hot_parts(found.groupBy("name").agg(F.count("*").alias("n")), ["name"])
    found = deal(found, hot, ["name"], ["id", "tag"]).join(copied(holders, hot, ["name"]), ["name", "part"])
    found = found.groupBy(F.col("id").alias("hit_id"), F.col("tag").alias("hit_tag")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    by = by.join(found, by["id"].eqNullSafe(found["hit_id"]) & by["tag"].eqNullSafe(found["hit_tag"]), "left")
    by = by.select("id", "tag", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def join_up(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last.start.alias("start"), F.greatest(last.stop, s.stop).alias("stop"))))
        return F.when((F.size(done) > 0) & (last.stop >= s.start), grown).otherwise(F.concat(done, F.array(s)))

    by = by.withColumn("spans", F.aggregate("spans", none, join_up))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return by.select(F.col("id").alias(id_col), "n_words", "spans", n_hit.alias("n_hit"), "items")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty lies in a matching window."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
