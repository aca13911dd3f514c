"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation, three rounds of random signs and a Hadamard transform,
turns each unit vector; its bucket is the signed axis it lies nearest to. Each
of several tables has its own rotation. A query visits, in each table, the
buckets of the axes nearest to it. Everything met there is scored exactly on
the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.spread import copied, deal, hot_parts
from quarry.scratch import materialize

BLOCK = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width, half = *x.shape, 1
    while half < width:
        y = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-rotation of one table; rows are padded with zeros to a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    draw = np.random.default_rng([seed, table])
    for _ in range(3):
        x = hadamard(x * draw.choice([-1.0, 1.0], width))
    return x


def buckets(x: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` signed axes nearest to each row, nearest first."""
    both = np.concatenate([x, -x], axis=1)
    n = min(n, both.shape[1])
    near = np.argpartition(-both, n - 1, axis=1)[:, :n] if n < both.shape[1] else np.tile(np.arange(n), (len(x), 1))
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, axis=1), axis=1, kind="stable"), axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _placed(rows: DataFrame, dim: int, tables: int, probes: int, top: float | None, seed: int) -> DataFrame:
    """``rep, embedding`` once for each table and bucket it belongs to or visits. ``top``: the largest norm, where norms differ."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("embedding"), dim)
                if top is not None:  # one more axis makes all lengths equal: then the largest inner product is the smallest angle
                    rest = np.zeros(len(x)) if probes > 1 else np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))
                    x = np.column_stack([x, rest])
                for t in range(tables):
                    b = buckets(rotate(x, t, seed), probes)
                    again = part.take(pa.array(np.repeat(np.arange(len(part)), b.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.size, t, dtype=np.int32)), pa.array(b.reshape(-1).astype(np.int32)), *again.columns], ["tab", "bucket", *part.schema.names])

    return rows.mapInArrow(run, f"tab int, bucket int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}")


def _ranked(q: np.ndarray, score: np.ndarray, reps: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best, by score, then id; ``q`` ascending in the result."""
    order = np.lexsort((reps, -score, q))
    own = q[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def _scored(dim: int, k: int, ids: pa.DataType):
    hit = pa.struct([("less", pa.float64()), ("rep", ids)])
    schema = pa.schema([("query", ids), ("hits", pa.list_(hit))])

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return schema.empty_table()
        a, b = (_matrix(t.column("embedding").combine_chunks(), dim) for t in (queries, rows))
        names, reps = queries.column("rep").combine_chunks(), rows.column("rep").combine_chunks()
        plain = reps.to_numpy(zero_copy_only=False)
        if plain.dtype == object:
            plain = plain.astype(str)
        # no two ways to add up a product differ by more
        slack = 4 * dim * np.finfo(float).eps * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
        out = []
        for at in range(0, len(a), 512):
            part = a[at : at + 512]
            rough = part @ b.T
            if k < len(b):  # whatever may be among the best, ties of the last included
                least = np.partition(rough, len(b) - k, axis=1)[:, len(b) - k] - slack[at : at + 512]
                q, p = np.nonzero(rough >= least[:, None])
            else:
                q, p = np.divmod(np.arange(rough.size), len(b))
            score = (part[q] * b[p]).sum(axis=1)  # each pair in the same order of additions, wherever it is met
            best = _ranked(q, score, plain[p], k)
            own, first = np.unique(q[best], return_index=True)
            hits = pa.StructArray.from_arrays([pa.array(-score[best]), reps.take(pa.array(p[best]))], fields=list(hit))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(best)).astype(np.int32)), hits)
            out.append(pa.Table.from_arrays([names.take(pa.array(own + at)), lists], schema=schema))
        return pa.concat_tables(out)

    return run


def search(vectors: DataFrame, is_query: str, *, k: int = 20, tables: int = 12, probes: int = 9, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of each row that meets the SQL condition ``is_query``, by largest inner product in double precision.

    ``query_id, rank int, <id> , score``; nearest first, ties to the smaller id;
    the query's own id is left out. Every row is indexed; nothing is fitted to
    the data, and a query visits ``probes`` buckets of each of ``tables`` tables
    whatever the size. Everything met in them is ranked: no tie is cut before it
    is scored exactly. A query that meets fewer than ``k`` others there is
    compared with all rows.

    Equal vectors are one class, searched once and expanded to their smallest
    ``k + 1`` ids, which are all that can rank. Both the queries that visit a
    bucket and its rows are split into blocks of bounded size. Vectors that are
    null, zero, hold a null or a non-finite component, or have another length
    than most rows, and rows with a null id take no part. Repeated rows count
    once. An id is one vector: where rows of an id differ, the smallest of their
    vectors (by its components in order) stands for it, as query and as
    candidate. Rows whose norms differ by more than a thousandth get a further
    axis, so that the largest inner products are the nearest directions; further columns are ignored; an empty table gives no rows.
    """
    good = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("embedding"), F.expr(is_query).alias("asks"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = good.where(F.col("id").isNotNull() & finite.eqNullSafe(True) & F.exists("embedding", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    sizes = good.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.min(norm).alias("low"), F.max(norm).alias("high")).orderBy(F.desc("n"), "dim").first()
    kind = good.schema["id"].dataType.simpleString()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    dim = sizes["dim"]
    top = sizes["high"] if sizes["high"] > 1.001 * sizes["low"] else None
    good = good.where(F.size("embedding") == dim)
    named = good.select("id", F.xxhash64("embedding").alias("h")).distinct().groupBy("id").count().where("count > 1").select("id")
    named = materialize(named, "ambiguous")
    if not named.isEmpty():
        one = good.join(named, "id", "left_semi").groupBy("id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks"))
        good = good.join(named, "id", "left_anti").unionByName(one)
    axes = 2 << max(0, dim - 1 + (top is not None)).bit_length()
    probes = min(axes, probes)

    # the k + 1 smallest ids of each distinct vector; Spark cuts the rows before the shuffle
    low = good.withColumn("nth", F.row_number().over(Window.partitionBy("embedding").orderBy("id"))).where(F.col("nth") <= k + 1)
    classes = materialize(low.groupBy("embedding").agg(F.min("id").alias("rep"), F.array_sort(F.collect_set("id")).alias("ids")), "classes")
    asked = good.where("asks").select("id", "embedding").distinct().join(classes.select("embedding", "rep"), "embedding").select(F.col("id").alias("query_id"), "rep")
    asked = materialize(asked, "queries")
    same = asked.groupBy("rep").agg(F.count("*").alias("n"))
    ask = materialize(classes.select("rep", "embedding").join(same, "rep", "left_semi"), "asked")

    ids = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    n = classes.count()

    def nearest(asking: DataFrame, tables: int, probes: int) -> DataFrame:
        """``query, hits``: the best ``k + 1`` classes met in the buckets visited."""
        # an even bucket has a quarter of a block of rows and of queries
        blocks = max(1, -(-n // (axes * BLOCK // 4)))
        crowds = max(1, -(-asking.count() * probes // (axes * BLOCK // 4)))
        index = _placed(classes.select("rep", "embedding"), dim, tables, 1, top, seed)
        index = index.withColumns({"block": _share("rep", blocks), "crowd": F.explode(F.sequence(F.lit(0), F.lit(crowds - 1)))})
        visits = _placed(asking, dim, tables, probes, top, seed)
        visits = visits.withColumns({"crowd": _share("rep", crowds), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        place = ["tab", "bucket", "block", "crowd"]
        met = visits.groupBy(*place).cogroup(index.groupBy(*place)).applyInArrow(_scored(dim, k + 1, ids), f"query {kind}, hits array<struct<less:double,rep:{kind}>>")
        # short lists, one for each bucket and block a query visits: merge them; a row is met once in each table at most
        ahead = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, (k + 1) * tables)
        return materialize(met.groupBy("query").agg(F.slice(F.array_distinct(ahead), 1, k + 1).alias("hits")), "nearest")

    best = nearest(ask, tables, probes)
    enough = best.where(F.size("hits") >= min(k + 1, n))
    short = ask.join(enough.select(F.col("query").alias("rep")), "rep", "left_anti")
    if not short.isEmpty():  # a query that met too few rows visits every bucket of the first table
        best = enough.unionByName(nearest(short, 1, axes))
    best = best.select(F.col("query").alias("rep"), F.explode("hits").alias("hit")).select("rep", (-F.col("hit.less")).alias("score"), F.col("hit.rep").alias("found"))
    wide = best.join(classes.select(F.col("rep").alias("found"), "ids"), "found").select("rep", "score", F.explode("ids").alias("id"))
    # many queries may share a vector
    hot = hot_parts(same, ["rep"])
    wide = deal(asked, hot, ["rep"], ["query_id"]).join(copied(wide, hot, ["rep"]), ["rep", "part"]).where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return wide.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _share(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
