"""Near duplicates: a multi-index Hamming join over b-bit MinHash signatures.

A signature has ``chunks * width`` symbols of 16 bits. If two signatures differ
in fewer than ``2 * chunks`` symbols, some chunk has one wrong symbol at most
(pigeonhole), so both rows share one of that chunk's keys: the chunk with one
symbol left out, each in turn. All pairs under that distance therefore become
candidates; pairs beyond it usually do as well, and those that cannot reach the
similarity but for one in a million are dropped by distance.
What is left is confirmed on full shingle sets.

Copies are joined to one class before that. Rows of a key are first compared
with the key's smallest row only, its head; components of these links are
closed; then rows under one head that still lie in different components are
compared with each other in blocks, as products of their shingle matrices, and a
block passes on one link for each two components. Comparisons inside a component
cannot change it, so no link between components is lost and no group emits all
its pairs. Keys and heads with many rows are dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bytesview import mix
from quarry.llm.components import components
from quarry.scratch import materialize, release
from quarry.llm.shingles import features, shingle_sets
from quarry.spread import copied, deal, hot_parts, share, unsent, with_parts

_SEMI_BUCKETS = 1 << 20
#: A block of rows under one head holds about so many rows, and shingles.
_BLOCK, _BLOCK_SHINGLES = 1024, 1 << 20
_COLUMNS = 4096


def chunk_keys(sig: np.ndarray, chunks: int, width: int) -> np.ndarray:
    """For each row the ``chunks * width`` keys: a chunk without its i-th symbol."""
    s = mix(sig.astype(np.uint16).astype(np.uint64).reshape(len(sig), chunks, width) + (np.arange(chunks * width, dtype=np.uint64) << np.uint64(16)).reshape(1, chunks, width))
    whole = s.sum(axis=2, dtype=np.uint64)
    tag = mix(np.arange(1, chunks * width + 1, dtype=np.uint64)).reshape(1, chunks, width)
    return mix(whole[:, :, None] - s + tag).reshape(len(sig), chunks * width).view(np.int64)


def _keyed(classes: DataFrame, chunks: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                sig = part.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(len(part), chunks * width)
                keys = chunk_keys(sig, chunks, width)
                ids = part.column("id").take(pa.array(np.repeat(np.arange(len(part)), keys.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), ids], ["key", "id"])

    return classes.select(F.col("no").alias("id"), "sig").mapInArrow(run, "key long, id long")


def _sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``id, shingles`` of the classes whose number is in ``ids``, written."""
    # at most _SEMI_BUCKETS numbers, however many ids: small enough to send to every task, and texts need no shuffle
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(_SEMI_BUCKETS)).cast("int")
    asked = classes.select("no", F.col("rep").alias("id"), "set_key").join(unsent(ids.select(F.col("id").alias("no")).distinct()), "no", "left_semi")
    wanted = F.broadcast(asked.select(bucket("id").alias("bucket")).distinct())
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("bucket", bucket("id")).join(wanted, "bucket", "left_semi")
    # an id may stand for several texts, and a text for several rows of an id
    found = shingle_sets(some, k, "id").join(unsent(asked), ["id", "set_key"]).groupBy(F.col("no").alias("id")).agg(F.first("shingles").alias("shingles"))
    return materialize(found, "sets")


def _shared(x, y):
    return F.size(F.array_intersect(x, y)).cast("long")


def _reaches(shared, x, y, similarity: float):
    return shared * 1000 >= (F.size(x) + F.size(y) - shared) * round(similarity * 1000)


def shared_counts(flat: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each row of ``left`` shares with each of ``right``; rows are sets in ``flat`` between offsets ``at``."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    word, number, held = np.unique(flat, return_inverse=True, return_counts=True)
    often = held > 1  # others are shared by no two rows
    column = (np.cumsum(often) - 1)[number]
    use = often[number]
    row, column = row[use], column[use]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, n = np.zeros((len(left), len(right)), dtype=np.float32), len(at) - 1
    for c in range(0, int(often.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, [c, c + _COLUMNS])
        m = np.zeros((n, min(_COLUMNS, int(column[-1]) + 1 - c)), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - c] = 1
        out += m[left] @ m[right].T  # whole numbers below 2^24: exact
    return out


def _across(similarity: float):
    def run(rows: pa.Table) -> pa.Table:
        made = []
        heads = rows.column("head").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(heads, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(heads[order])) + 1):
            part = rows.take(pa.array(mine))
            component = part.column("component").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            if component.max(initial=0) == 0:
                continue
            sets = part.column("shingles").combine_chunks()
            flat, size = sets.flatten().to_numpy(), np.diff(sets.offsets.to_numpy())
            block, lo, hi = (part.column(c).to_numpy() for c in ("block", "lo", "hi"))
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            shared = shared_counts(flat, np.concatenate([[0], np.cumsum(size)]), left, right).astype(np.float64)
            linked = (shared * 1000 >= (size[left][:, None] + size[right][None, :] - shared) * round(similarity * 1000)) & (component[left][:, None] != component[right][None, :])
            i, j = np.nonzero(linked)
            i, j = left[i], right[j]
            pair = np.minimum(component[i], component[j]) * len(component) + np.maximum(component[i], component[j])
            _, first = np.unique(pair, return_index=True)
            made.append(pa.table({"a": part.column("id").take(pa.array(i[first])), "b": part.column("id").take(pa.array(j[first]))}))
        return pa.concat_tables(made) if made else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, *, k: int = 5, similarity: float = 0.8, chunks: int = 10, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept``.

    Links join rows whose sets of distinct ``k``-word shingles have a Jaccard
    similarity of ``similarity`` or more. Texts are lower-cased (A-Z) and split
    at ASCII white space, whole. Fewer than ``k`` words make one shingle; null
    or blank texts have none and link with nothing. Every row gives a row: equal
    rows share their component, and rows of one id with different texts are
    judged each by its own text. A null id takes no part (component null, kept).
    Further columns are ignored; an empty table gives no rows. With the default
    chunks a pair at exactly the similarity is missed with a probability of
    about 2e-6.
    """
    f = materialize(features(docs, k, chunks * width, id_col, text_col), "features")
    classes = f.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("rows"))
    classes = materialize(classes.withColumn("no", F.monotonically_increasing_id()), "classes")  # numbered once, as written
    found, done = _links(docs, classes, k=k, similarity=similarity, chunks=chunks, width=width, id_col=id_col, text_col=text_col)
    comp = components(found)
    release(*done)
    member = classes.select("no", "set_key", "rep").join(unsent(comp.withColumnRenamed("node", "no")), "no", "left").withColumn("component", F.coalesce("component", "no"))
    least = member.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    hot = hot_parts(least, ["component"])
    member = deal(member, hot, ["component"], ["no"]).join(unsent(copied(least, hot, ["component"])), ["component", "part"]).select("set_key", "component_id")
    # one text may be that of many rows
    copies = hot_parts(classes.select("set_key", F.col("rows").alias("n")), ["set_key"])
    rows = deal(f.where("set_key is not null").select("id", "n_shingles", "set_key"), copies, ["set_key"], ["id"])
    out = rows.join(unsent(copied(member, copies, ["set_key"])), ["set_key", "part"], "left").select("id", "n_shingles", "component_id")
    out = out.unionByName(f.where("set_key is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _links(docs: DataFrame, classes: DataFrame, *, k: int, similarity: float, chunks: int, width: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """Links ``a, b`` between class numbers that give all components, and the written tables they are read from."""
    keyed = _keyed(classes, chunks, width)
    heads = materialize(keyed.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1"), "heads")
    hot = hot_parts(heads, ["key"])
    shared = deal(keyed, hot, ["key"], ["id"]).join(unsent(copied(heads, hot, ["key"])), ["key", "part"])
    shared = materialize(shared, "keys")
    pairs = materialize(shared.where("id <> head").select("head", "id").distinct(), "pairs")
    sets = _sets(pairs.select(F.explode(F.array("head", "id")).alias("id")), classes, docs, k, id_col, text_col)
    popular = hot_parts(pairs.groupBy("head").agg(F.count("*").alias("n")), ["head"])
    both = deal(pairs, popular, ["head"], ["id"]).join(unsent(sets.withColumnRenamed("shingles", "y")), "id")
    own = pairs.select("head").distinct().join(unsent(sets.select(F.col("id").alias("head"), F.col("shingles").alias("x"))), "head")
    both = both.join(unsent(copied(own, popular, ["head"])), ["head", "part"])
    linked = materialize(both.where(_reaches(_shared("x", "y"), "x", "y", similarity)).select(F.col("head").alias("a"), F.col("id").alias("b")), "linked")
    comp = components(linked)

    # keys of two rows are settled; of the others, those with rows in several components are compared across them
    rest = shared.where("n > 2").select("key", "part", "head", "id").join(unsent(comp.withColumnRenamed("node", "id")), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    pool = rest.where("id <> head").join(unsent(copied(mixed, hot, ["key"])), ["key", "part"]).select("head", "id", "component").distinct()
    pool = materialize(pool.join(unsent(sets), "id"), "pool")
    release(heads, shared, pairs, sets, linked)
    size = F.sum(F.size("shingles").cast("long"))
    blocks = pool.groupBy("head").agg(F.greatest(F.count("*"), F.ceil(size * (_BLOCK / _BLOCK_SHINGLES))).alias("n"))
    blocked = with_parts(pool, hot_parts(blocks, ["head"], _BLOCK), ["head"]).withColumn("block", share(["id"], F.col("parts")))
    # every two blocks of a head meet once; heads of one block share a task's work with others
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    blocked = blocked.withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    held = pool.agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).alias("size")).first()
    packs = max(1, -(-held["n"] // _BLOCK), -(-held["size"] // _BLOCK_SHINGLES))
    blocked = blocked.withColumn("pack", F.when(F.col("parts") > 1, F.xxhash64("head")).otherwise(F.pmod(F.xxhash64("head"), F.lit(packs)).cast("long")))
    across = blocked.select("pack", "lo", "hi", "block", "head", "id", "component", "shingles").groupBy("pack", "lo", "hi").applyInArrow(_across(similarity), "a long, b long")
    return across.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))), [pool]
