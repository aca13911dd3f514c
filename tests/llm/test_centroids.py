"""Integer clustering against a plain version, and what is kept of odd rows."""

import math
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import centroids, queries


def plainly(rows, k, rounds, width, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((x - c) ** 2 for x, c in zip(v, centre)), n) for n, centre in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted(((i, n, d, sum(e for _, e, m in found if m == n), total, sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def ours(df, **given):
    return sorted((tuple(r) for r in centroids.digest(centroids.cluster(df, **given)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_same_as_plain_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 37 + j * 11) % 23 - 11) / 7.0 for j in range(4)]) for i in range(60)]
    rows += [(3, rows[3][1]), (3, [0.1, -0.1, 2.5, -3.25]), (None, [1.0, 1.0, -1.0, 0.0]), (None, [0.0, 0.0, 0.0, 0.0])]  # repeats, null ids
    rows += [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0, nan, 0.0, 0.0]), (104, [1.0, -inf, 0.0, 0.0]), (105, [1.0, None, 0.0, 0.0]), (106, [1.0] * 5)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(30)]  # ties
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, q string")  # extra columns with clashing names
    for k in (1, 7, 200):
        assert ours(df, k=k, rounds=3, width=4) == plainly(rows, k, 3, 4)


def test_negative_means_are_floored(spark):
    df = spark.createDataFrame([(1, [-1.0]), (2, [-1.0]), (3, [-2.0])], "vec_id long, embedding array<double>")
    found = centroids.cluster(df, k=1, rounds=1, width=1, scale=1).select("centroid").distinct().collect()
    assert [list(r.centroid) for r in found] == [[-2]]


def test_empty_and_too_large(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.digest(centroids.cluster(none)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster(none).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), width=1).count()


def test_no_python_in_the_plan(spark, sf_dir):
    vectors = centroids.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    plan = vectors.select(centroids.nearest([[0] * 64, [1] * 64]).getField("cluster").alias("c"), "q").groupBy("c").agg(*[F.sum(F.get("q", F.lit(i))) for i in range(64)])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    frame = con.sql(queries.ORACLES["op11_centroid_clusters"]).df()
    got = queries.op11_centroid_clusters(spark, sf_dir).toPandas()
    assert sorted(map(tuple, got[list(frame.columns)].values.tolist())) == sorted(map(tuple, frame.values.tolist()))
