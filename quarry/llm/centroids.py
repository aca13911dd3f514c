"""Centroid clustering of embeddings in exact integers, by JVM-native expressions only.

Components become integers, distances are folds over literal centroid arrays
(``zip_with`` and ``aggregate``), ``array_min`` of structs chooses the cluster
and plain column sums, which compile into the aggregation's own loop, move the
centroids. What the driver holds is ``k`` centroids and the sums of each, however
many vectors there are; no vector is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.scratch import materialize

#: Below this, 64 squared differences add up within 64 bits.
_MOST = 1 << 27


def quantised(rows: DataFrame, *, width: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, q array<bigint>, norm``: ``floor(scale * x)`` of each component, and the sum of their squares.

    Vectors that are null, of another width or hold a null or non-finite
    component are left out.
    """
    v = F.col(vec_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < _MOST, F.floor(y)).otherwise(F.raise_error(F.lit("a component is too large for exact distances in 64 bits")))

    kept = rows.where((F.size(v) == width) & ~odd)
    return kept.select(F.col(id_col).alias("id"), F.transform(v, whole).alias("q")).withColumn("norm", F.expr("aggregate(q, 0L, (s, x) -> s + x * x)"))


def _literal(numbers: list[int]) -> str:
    return "array(" + ", ".join(f"{x}L" for x in numbers) + ")"


def nearest(centroids: list[list[int]]) -> Column:
    """``struct<d, cluster>`` of the centroid nearest to ``q``, ties to the smaller number; ``d`` lacks the vector's own ``norm``.

    ``|q - c|^2 = |q|^2 + |c|^2 - 2 q c``: one product a component, all in integers.
    """
    far = "named_struct('d', {}L - 2 * aggregate(zip_with(q, {}, (x, c) -> x * c), 0L, (s, p) -> s + p), 'cluster', {})"
    return F.expr("array_min(array(" + ", ".join(far.format(sum(x * x for x in c), _literal(c), i) for i, c in enumerate(centroids)) + "))")


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of salt and id; equal ids by their components, null ids last."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "q")
    return [list(r.q) for r in hashed.orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: the componentwise floor of each cluster's mean; an empty cluster keeps its centroid."""
    near = vectors.select(nearest(centroids).getField("cluster").alias("cluster"), "q")
    sums = [F.sum(F.get("q", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))]
    out = list(centroids)
    for row in near.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # k rows at most
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(len(sums))]
    return out


def cluster(rows: DataFrame, *, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per kept vector: id, ``cluster, distance`` (squared), ``cluster_inertia, inertia`` (distances summed over its cluster and over all), ``centroid array<bigint>``.

    See :func:`quantised` for what is kept. Centroids start at ``k`` vectors
    chosen by a digest of their ids (fewer, if there are fewer), then ``rounds``
    rounds move them. Repeated rows and ids count as often as they stand there;
    null ids are ids like any other, chosen last. An empty table gives an empty
    one; further columns are ignored. A component of 2^27 / ``scale`` or more
    raises an error, as distances would leave 64 bits.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    vectors = materialize(quantised(rows, width=width, scale=scale, id_col=id_col, vec_col=vec_col), "vectors")
    centroids = first_centroids(vectors, k, salt)
    if not centroids:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    near = vectors.select("id", "norm", nearest(centroids).alias("near"))
    done = materialize(near.select("id", F.col("near.cluster").alias("cluster"), (F.col("norm") + F.col("near.d")).alias("distance")), "clusters")
    inertia = [0] * len(centroids)
    for row in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect():  # k rows at most
        inertia[row.cluster] = row.d
    own = F.col("cluster") + 1
    return done.select(
        F.col("id").alias(id_col), "cluster", "distance", F.element_at(F.expr(_literal(inertia)), own).alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"),
        F.element_at(F.expr("array(" + ", ".join(map(_literal, centroids)) + ")"), own).alias("centroid"),
    )


def digest(clusters: DataFrame) -> DataFrame:
    """``clusters`` with ``centroid_sha256`` in place of the centroid: the digest of its components in decimal, joined by commas."""
    return clusters.withColumn("centroid_sha256", F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)).drop("centroid")
