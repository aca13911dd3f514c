"""Queries over ``embeddings``: retrieval and the 3-D map."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import mapping, retrieval
from quarry.scratch import scratch_path
from quarry.sources import tables


def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def asked(spark, sf_dir):
    """Every 25th vector as a query, of a type by its number."""
    return vectors(spark, sf_dir).where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.expr("element_at(array('terraform', 'code_generation', 'general_qa', 'documentation', 'other'), cast(vec_id / 25 % 5 + 1 as int))").alias("query_type"), "embedding")


#: The vectors are hardly alike: thresholds that some hits reach and others do not.
LOWER = {"terraform": 0.3, "code_generation": 0.27, "general_qa": 0.24, "documentation": 0.2}


def chunk_rows(spark, sf_dir):
    """The vectors that are no queries."""
    return vectors(spark, sf_dir).where("vec_id % 25 <> 0").select(F.col("vec_id").alias("chunk_id"), "embedding", (F.col("vec_id") % 40).alias("doc_id"), F.concat(F.lit("text "), "vec_id").alias("text"))


def p11_thresholds(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", retrieval.threshold(F.col("query_type")).alias("threshold"))


def _hits(spark, sf_dir):
    """Without the types' thresholds, so that all queries find their ten."""
    return retrieval.vector_search(asked(spark, sf_dir), chunk_rows(spark, sf_dir), limit=10, least=0.0)


def v1_vector_search(spark, sf_dir):
    least = retrieval.threshold(F.col("query_type"), LOWER, 0.2)
    return retrieval.vector_search(asked(spark, sf_dir), chunk_rows(spark, sf_dir), limit=10, least=least).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


def v1_vector_search_all(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


def j8_merge_hits(spark, sf_dir):
    h = _hits(spark, sf_dir).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")
    return retrieval.merge_hits(h.where("rank <= 6"), h.where("rank >= 4").withColumn("similarity", F.round(F.col("similarity") + F.lit(0.01), 6)))


def _joined(spark, sf_dir):
    return _hits(spark, sf_dir).withColumn("similarity", F.round("similarity", 6)).join(chunk_rows(spark, sf_dir).drop("embedding"), "chunk_id")


def a13_quality(spark, sf_dir):
    q = retrieval.quality(_joined(spark, sf_dir))
    return q.withColumn("mean_similarity", F.round("mean_similarity", 4))


def a14_contexts(spark, sf_dir):
    c = retrieval.contexts(_joined(spark, sf_dir))
    return c.select("query_id", "context", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


def v2_standardise(spark, sf_dir):
    s = mapping.standardise(vectors(spark, sf_dir))
    return s.select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", "i", (F.round("v", 4) + 0.0).alias("v"))


def v3_pca(spark, sf_dir):
    return mapping.pca(mapping.standardise(vectors(spark, sf_dir))).select("vec_id", *[(F.round(F.col("coords")[n - 1], 5) + 0.0).alias(f"axis_{n}") for n in (1, 2, 3)])


def v4_neighbours(spark, sf_dir):
    return mapping.knn_graph(vectors(spark, sf_dir)).select("vec_id", "neighbour", F.round("distance", 5).alias("distance"), "rank")


def v4_neighbour_descent(spark, sf_dir):
    """The form for large tables; most of what ``v4_neighbours`` gives."""
    return mapping.knn_descent(vectors(spark, sf_dir)).select("vec_id", "neighbour", F.round("distance", 5).alias("distance"), "rank")


def v5_fuzzy_weights(spark, sf_dir):
    v = vectors(spark, sf_dir)
    k = mapping.neighbour_count(v.count())
    return mapping.fuzzy_weights(mapping.knn_graph(v, k=k), k).withColumn("weight", F.round("weight", 5))


def v6_layout(spark, sf_dir):
    return mapping.layout(mapping.standardise(vectors(spark, sf_dir)))


def v7_scale(spark, sf_dir):
    c = vectors(spark, sf_dir).select("vec_id", F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 2).alias("coords"))
    return mapping.scale(c).select("vec_id", *[F.round(a, 6).alias(a) for a in "xyz"])


def v8_map(spark, sf_dir):
    return mapping.map_all(vectors(spark, sf_dir))


def v8_map_extent(spark, sf_dir):
    """What must hold of a map of any layout: every row once, finite, the largest coordinate 10."""
    m = mapping.map_all(vectors(spark, sf_dir))
    return m.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"), F.round(F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z"))), 6).alias("extent"), F.count_if(F.isnan("x") | F.isnan("y") | F.isnan("z")).alias("lost"))


def s5_coordinates(spark, sf_dir):
    """Coordinates written as a whole, replaced, and read back."""
    c = vectors(spark, sf_dir).select("vec_id", F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 2).alias("coords"))
    path = scratch_path(spark, "coordinates")
    tables.write_coordinates(mapping.scale(c, to=1.0), path)
    tables.write_coordinates(mapping.scale(c), path)
    tables.write_coordinates(None, path)
    return tables.read_coordinates(spark, path).select("vec_id", *[F.round(a, 6).alias(a) for a in "xyz"])


def s4_embedding_text(spark, sf_dir):
    back = tables.embeddings_from_text(tables.embeddings_as_text(vectors(spark, sf_dir)))
    return back.select("vec_id", F.size("embedding").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


QUERIES = {f.__name__: f for f in (p11_thresholds, v1_vector_search, v1_vector_search_all, j8_merge_hits, a13_quality, a14_contexts, v2_standardise, v3_pca, v4_neighbours, v4_neighbour_descent, v5_fuzzy_weights, v6_layout, v7_scale, v8_map, v8_map_extent, s5_coordinates, s4_embedding_text)}

_T = "CASE vec_id // 25 % 5 WHEN 0 THEN 0.7 WHEN 1 THEN 0.6 ELSE 0.5 END"
_HITS = """WITH q AS (SELECT vec_id AS query_id, {least} AS least, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 25 = 0), c AS (SELECT vec_id AS chunk_id, vec_id % 40 AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 25 <> 0),
  s AS (SELECT query_id, chunk_id, doc_id, least, list_cosine_similarity(q.e, c.e) AS sim FROM q, c),
  h AS (SELECT query_id, chunk_id, doc_id, round(sim, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, chunk_id) AS INT) AS rank FROM s WHERE sim >= least QUALIFY rank <= 10)
"""


def _axis(n: int, m: str) -> str:
    """The first principal axis ``w{n}`` of the matrix in ``m``, by squaring it until one axis is left, and ``m{n}``, the matrix without it."""
    trace = "[m[k][k] for k in range(1, len(m) + 1)]"
    return f"""p{n} AS (SELECT 0 AS t, m FROM {m} UNION ALL SELECT t + 1, [[list_dot_product(r, c) / (s * s) for c in m] for r in m] FROM (SELECT t, m, list_sum({trace}) AS s FROM p{n}) WHERE t < 16),
  b{n} AS (SELECT m[list_position({trace}, list_max({trace}))] AS r FROM p{n} WHERE t = 16),
  w{n} AS (SELECT [x / sqrt(list_dot_product(r, r)) * CASE WHEN list_max(r) >= -list_min(r) THEN 1 ELSE -1 END for x in r] AS v FROM b{n}),
  m{n} AS (SELECT [[m[i][j] - l * v[i] * v[j] for j in range(1, len(m) + 1)] for i in range(1, len(m) + 1)] AS m FROM (SELECT m, v, list_dot_product(v, [list_dot_product(x, v) for x in m]) AS l FROM {m}, w{n}))"""


_NEAR = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS neighbour, CASE WHEN a.vec_id = b.vec_id THEN 0.0 ELSE round(1 - list_cosine_similarity(a.e, b.e), 9) END AS distance FROM e a, e b),
  near AS (SELECT vec_id, neighbour, distance, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, vec_id <> neighbour, neighbour) AS INT) AS rank FROM d QUALIFY rank <= (SELECT least(15, greatest(2, count(*) - 1)) FROM e))"""
_LOW = _HITS.format(least="0.0")
ORACLES = {
    "p11_thresholds": f"SELECT vec_id AS query_id, CAST({_T} AS DOUBLE) AS threshold FROM embeddings WHERE vec_id % 25 = 0",
    "v1_vector_search": _HITS.format(least="[0.3, 0.27, 0.24, 0.2, 0.2][vec_id // 25 % 5 + 1]") + "SELECT query_id, chunk_id, similarity, rank FROM h",
    "v1_vector_search_all": _LOW + "SELECT query_id, chunk_id, similarity, rank FROM h",
    "j8_merge_hits": _LOW + ", b AS (SELECT query_id, chunk_id, similarity FROM h WHERE rank <= 6 UNION ALL SELECT query_id, chunk_id, round(similarity + 0.01, 6) FROM h WHERE rank >= 4), m AS (SELECT query_id, chunk_id, max(similarity) AS similarity FROM b GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INT) AS rank FROM m",
    "a13_quality": _LOW + "SELECT query_id, count(*) AS hits, count(DISTINCT doc_id) AS documents, max(similarity) AS max_similarity, round(avg(similarity), 4) AS mean_similarity, count(*) >= 3 AS enough_context FROM h GROUP BY query_id",
    "a14_contexts": _LOW + "SELECT query_id, string_agg('text ' || chunk_id, chr(10) || chr(10) ORDER BY rank) AS context, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS sources FROM h GROUP BY query_id",
    "v2_standardise": "WITH u AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT i, avg(v) AS a, stddev_pop(v) AS s FROM u GROUP BY i) SELECT vec_id, i, round(CASE WHEN s > 1e-12 THEN (v - a) / s ELSE 0 END, 4) + 0.0 AS v FROM u JOIN m USING (i)",
    "v3_pca": f"""WITH RECURSIVE u AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), mo AS (SELECT i, avg(v) AS a, stddev_pop(v) AS s FROM u GROUP BY i),
      y AS (SELECT vec_id, i, CASE WHEN s > 1e-12 THEN (v - a) / s ELSE 0 END AS v FROM u JOIN mo USING (i)), z AS (SELECT vec_id, list(v ORDER BY i) AS z FROM y GROUP BY vec_id), q AS (SELECT i, list(v ORDER BY vec_id) AS c FROM y GROUP BY i),
      m0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT a.i, list(list_dot_product(a.c, b.c) / len(a.c) ORDER BY b.i) AS r FROM q a, q b GROUP BY a.i)), {_axis(1, "m0")}, {_axis(2, "m1")}, {_axis(3, "m2")}
      SELECT vec_id, {", ".join(f"round(list_dot_product(z, w{n}.v), 5) + 0.0 AS axis_{n}" for n in (1, 2, 3))} FROM z, w1, w2, w3""",
    "v4_neighbours": f"WITH {_NEAR} SELECT vec_id, neighbour, round(distance, 5) AS distance, rank FROM near",
    "v5_fuzzy_weights": f"""WITH RECURSIVE {_NEAR},
      l AS (SELECT vec_id AS i, list(distance ORDER BY distance, neighbour) AS d, list(neighbour ORDER BY distance, neighbour) AS j, coalesce(min(distance) FILTER (distance > 0), 0) AS rho FROM near WHERE vec_id <> neighbour GROUP BY vec_id),
      g AS (SELECT log2(least(15, greatest(2, count(*) - 1))) AS goal FROM e),
      s AS (SELECT i, d, rho, CAST(1 AS DOUBLE) AS sigma, CAST(0 AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi, 0 AS step FROM l
        UNION ALL SELECT i, d, rho, CASE WHEN t > goal THEN (lo + sigma) / 2 WHEN isinf(hi) THEN sigma * 2 ELSE (sigma + hi) / 2 END, CASE WHEN t > goal THEN lo ELSE sigma END, CASE WHEN t > goal THEN sigma ELSE hi END, step + 1
        FROM (SELECT s.*, goal, list_sum([exp(-greatest(0, x - rho) / sigma) for x in d]) AS t FROM s, g WHERE step < 64) WHERE abs(t - goal) >= 1e-9),
      f AS (SELECT i, arg_max(sigma, step) AS sigma FROM s GROUP BY i),
      w AS (SELECT i, unnest(j) AS j, unnest([exp(-greatest(0, x - rho) / greatest(sigma, 1e-3 * list_avg(d))) for x in d]) AS w FROM l JOIN f USING (i)),
      m AS (SELECT least(i, j) AS a, greatest(i, j) AS b, coalesce(max(w) FILTER (i < j), 0) AS p, coalesce(max(w) FILTER (i > j), 0) AS q FROM w GROUP BY 1, 2)
      SELECT a, b, round(p + q - p * q, 5) AS weight FROM m""",
    "v7_scale": "WITH c AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), m AS (SELECT max(greatest(abs(x), abs(y))) AS m FROM c) SELECT vec_id, round(x * (10 / m), 6) AS x, round(y * (10 / m), 6) AS y, CAST(0 AS DOUBLE) AS z FROM c, m",
    "s5_coordinates": "WITH c AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), m AS (SELECT max(greatest(abs(x), abs(y))) AS m FROM c) SELECT vec_id, round(x * (10 / m), 6) AS x, round(y * (10 / m), 6) AS y, CAST(0 AS DOUBLE) AS z FROM c, m",
    "v8_map_extent": "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, CAST(10 AS DOUBLE) AS extent, CAST(0 AS BIGINT) AS lost FROM embeddings",
    "s4_embedding_text": "SELECT vec_id, CAST(len(embedding) AS INT) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings",
}
