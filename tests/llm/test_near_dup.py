import random
import re

import numpy as np
import pytest

from quarry.llm import near_dup as nd
from quarry.llm.components import components
from quarry.spread import hot_parts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(docs, k, per=80):
    sets = {d: shingles(t, k) for d, t in docs}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= per * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= per * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("k", [2, 5])
def test_table_against_all_pairs(spark, sf_dir, k):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], k)
    assert got(nd.near_duplicates(docs, k=k)) == expected
    assert any(v[1] != d for d, v in expected.items())


def test_drifting_chains_and_large_groups(spark):
    r = random.Random(3)
    docs = []
    for g in range(4):
        base = [f"w{r.randrange(300)}" for _ in range(120)]
        for i in range(60):  # each differs a little from the one before: ends of the chain are far apart
            base = [x if r.random() > 0.03 else f"n{r.randrange(10**6)}" for x in base]
            docs.append((g * 1000 + i * 7, " ".join(base)))
    docs += [(9000 + i, "same text here again") for i in range(40)] + [(9500, None), (9501, ""), (9502, " \t\n"), (9503, "one"), (9504, "ONE"), (9505, "a b"), (9506, "A  b\n")]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(nd.near_duplicates(df, k=2)) == brute(docs, 2)


def test_nulls_repeats_clashes_empty(spark):
    schema = "doc_id long, text string, key long, component string, rep int"
    rows = [(3, "a b c", 1, "x", 1), (3, "a b c", 1, "x", 1), (None, "a b c", 1, "x", 1), (2, "A b c", None, None, None)]
    out = nd.near_duplicates(spark.createDataFrame(rows, schema), k=2)
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in out.collect()) == [(0, None, True), (2, 2, True), (3, 2, False), (3, 2, False)]
    assert nd.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_one_id_with_several_texts(spark):
    rows = [(5, "a b c"), (5, "x y z"), (1, "a b c"), (5, "x y z"), (7, "X Y  z")]
    out = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out.collect()) == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 5, False)]
    named = nd.near_duplicates(spark.createDataFrame([(f"n{i}", t) for i, t in rows], "doc_id string, text string"), k=2)
    assert {(r.doc_id, r.component_id) for r in named.collect()} == {("n1", "n1"), ("n5", "n1"), ("n5", "n5"), ("n7", "n5")}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (600, 600)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(nd, "_COLUMNS", 3)
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 40, r.integers(0, 30))) for _ in range(20)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    left, right = np.arange(0, 20, 2), np.arange(5, 20)
    got = nd.shared_counts(np.concatenate(sets), at, left, right)
    assert all(got[x, y] == len(set(sets[i]) & set(sets[j])) for x, i in enumerate(left) for y, j in enumerate(right) if i != j)


@pytest.mark.parametrize("rows", [3, 1024])
def test_hot_keys_and_blocks(spark, monkeypatch, rows):
    """Near copies of one text, most too far from the head and from most others; keys, heads and blocks are split."""
    monkeypatch.setattr(nd, "_BLOCK", rows)
    monkeypatch.setattr(nd, "hot_parts", lambda counts, keys, n=rows: hot_parts(counts, keys, n))
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = [(i * 3, " ".join(x if r.random() > 0.045 else f"n{r.randrange(4)}" for x in base)) for i in range(160)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    expected = brute(docs, 2)
    assert got(nd.near_duplicates(df, k=2)) == expected
    assert 1 < len({c for _, c, _ in expected.values()}) < 150


def test_only_bucket_numbers_are_sent(spark, sf_dir, monkeypatch):
    """However small Spark takes a table to be, it is shuffled: the driver holds no table that grows with the rows."""
    plans = []

    def noted(df, tag, write=nd.materialize):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(nd, "materialize", noted)
    monkeypatch.setattr("quarry.llm.components.materialize", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        noted(nd.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")), "out")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sent = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert sent and [line for line in sent if "bucket" not in line] == []
