import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import cube_mix as cm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(size, weights=(3, 1, 2), share=1.5, most=2.0):
    """By the rule as told: share by weight, stop at the cap, share the excess again."""
    order = sorted((s for s in size if s is not None), key=str) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(size.values())
    while left > 1e-9 and open_:
        total, excess = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weight[s] / total
        for s in list(open_):
            if target[s] >= most * size[s]:
                excess += target[s] - most * size[s]
                target[s] = most * size[s]
                open_.discard(s)
        left = excess
    return target


def check(rows, docs):
    size, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    words = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    for d, t, s in docs:
        size[s] += words[d]
        most[s] = max(most[s], words[d])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d is None, d or 0) for d, *_ in docs)
    target = plain_targets(size)
    for r in rows:
        assert r.size == words[r.doc_id] and r.source_size == size[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= most[s]
    return taken, target


def test_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text, r.source) for r in df.collect()]
    one = cm.mix(df).collect()
    check(one, docs)
    assert sorted(one) == sorted(cm.mix(df.repartition(7)).collect())  # reruns agree


def test_levels_and_hot_source(spark, monkeypatch):
    monkeypatch.setattr(cm, "BLOCK", 40)
    r = random.Random(4)
    docs = [(i, "w " * r.choice([0, 1, 5, 9, 30]), r.choice(["hot"] * 4 + ["b", "é", None])) for i in range(3000)]
    taken, target = check(cm.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect(), docs)
    assert abs(taken["hot"] - target["hot"]) < 5


def test_nulls_repeats_clashes_empty(spark):
    schema = "doc_id long, text string, source string, size string, target string, p int"
    rows = [(1, None, None, "x", None, 1), (2, "a b", "s", None, None, None), (None, "c", "s", None, None, None), (3, "", "empty", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    check(cm.mix(df).collect(), [r[:3] for r in rows])
    assert cm.mix(spark.createDataFrame([rows[1]] * 3, schema)).count() == 3
    assert cm.mix(df.limit(0)).count() == 0


def test_flight_keeps_totals():
    draw = np.random.default_rng(0).random
    size = [float(x) for x in np.random.default_rng(1).integers(1, 1000, 500)]
    p = cm.fly(size, [0.37] * 500, draw)
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(0.37 * 500) and np.dot(size, p) == pytest.approx(0.37 * sum(size))


def test_inclusion_probabilities():
    size = [1.0, 2, 3, 4, 5, 6, 7, 8]
    seen = np.zeros(8)
    for i in range(3000):
        p = cm.fly(size, [0.25] * 8, np.random.default_rng(i).random)
        seen += p
    assert np.abs(seen / 3000 - 0.25).max() < 0.05
