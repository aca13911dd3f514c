import os

import numpy as np
import pytest

from quarry.llm import cross_polytope as cp

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, each=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for q in np.flatnonzero(ids % each == 0):
        s = (x[q] * x).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r["rank"] == len(own)
    return out


def recall(found, truth):
    return sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in own}) for q, own in truth.items()) / sum(map(len, truth.values()))


ASKS = "vec_id % 20 = 0"


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_tables_recall(spark, sf_dir, table):
    df = spark.read.parquet(f"{os.path.dirname(sf_dir)}/{table}/embeddings.parquet")
    truth = brute([(r.vec_id, r.embedding) for r in df.collect()])
    found = got(cp.search(df, ASKS))
    assert found.keys() == truth.keys() and 0.9 <= recall(found, truth)
    assert all(own == sorted(own, key=lambda x: (-x[1], x[0])) for own in found.values())
    scores = {(r.vec_id): np.array(r.embedding, dtype=np.float64) for r in df.collect()}
    assert all(s == pytest.approx(float(scores[q] @ scores[i]), abs=1e-12) for q, own in found.items() for i, s in own)


def test_recall_with_hashing_alone(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 64))
    x = base[r.integers(0, 40, 6000)] + 0.8 * r.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert recall(got(cp.search(df, ASKS)), brute(rows)) > 0.9
    scaled = [(i, (np.array(v) * (1 + i % 5)).tolist(), None) for i, v, _ in rows]  # lengths differ
    assert recall(got(cp.search(spark.createDataFrame(scaled, SCHEMA), ASKS)), brute(scaled)) > 0.9


def test_ties_copies_and_small_tables(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(30, 8)).astype(np.float32)
    rows = [(i, x[0 if i % 3 else i % 30].tolist(), i) for i in range(150)]
    assert got(cp.search(spark.createDataFrame(rows, SCHEMA), ASKS)) == brute(rows)
    few = rows[:5]
    assert got(cp.search(spark.createDataFrame(few, SCHEMA), ASKS)) == brute(few)


def test_many_distinct_vectors_with_one_score(spark):
    """No tie is cut before ids decide; every bucket is visited, so the answer is exact."""
    r = np.random.default_rng(5)
    rest = r.normal(size=(3000, 7))
    rest *= np.sqrt(0.75) / np.linalg.norm(rest, axis=1, keepdims=True)
    rows = [(20, [1.0] + [0.0] * 7, 0)] + [(i, [0.5, *v.tolist()], 0) for i, v in zip(r.permutation(range(21, 9000))[:3000].tolist(), rest, strict=True) if i % 20]
    found = got(cp.search(spark.createDataFrame(rows, SCHEMA), "vec_id = 20", probes=16))
    assert found == {20: [(i, 0.5) for i in sorted(x[0] for x in rows[1:])[:20]]}


def test_many_queries_share_a_vector(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, x[0 if i % 20 == 0 else i % 40].tolist(), i) for i in range(6000)]
    found = got(cp.search(spark.createDataFrame(rows, SCHEMA), ASKS, k=3, probes=16))
    assert found == brute(rows, k=3)


def test_bad_vectors_repeats_empty(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, -1.0], 2)]
    bad = [(20, None, 1), (40, [0.0, 0.0], 1), (60, [None, 1.0], 1), (80, [nan, 1.0], 1), (100, [inf, 1.0], 1), (120, [1.0], 1), (None, [1.0, 0.0], 1), (140, [], 1)]
    schema = SCHEMA + ", score string, rep int, ids string"
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in good + bad + good], schema)
    assert got(cp.search(df, ASKS)) == brute(good)
    assert cp.search(df.limit(0), ASKS).count() == 0


def test_an_id_with_several_vectors_is_its_smallest(spark):
    """As query (20) and as candidate (29, 3); no id is ranked twice."""
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=4).astype(np.float32).tolist(), i) for i in range(60)]
    more = [(29, [9.0, 9.0, 9.0, 9.0], 1), (20, [-50.0, 0.0, 0.0, 1.0], 1), (3, rows[29][1], 1), (3, [8.0, 0.0, 0.0, 0.0], 1)]
    one = {}
    for i, v, _ in rows + more:
        one[i] = min(one.get(i, v), v)
    found = got(cp.search(spark.createDataFrame(rows + more, SCHEMA), ASKS))
    assert found == brute([(i, v, 0) for i, v in one.items()])
    assert all(len({i for i, _ in hits}) == len(hits) for hits in found.values())


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 50))
    y = cp.rotate(x, 3, 1)
    assert np.allclose((y * y).sum(axis=1), (x * x).sum(axis=1) * 64**3)
