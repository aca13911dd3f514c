import random
import re

import pytest

from quarry.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= own
        out[doc] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in df.collect()}


def test_tables_against_brute_force(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(dc.overlaps(docs, items)) == expected
    assert any(v[1] for v in expected.values())


@pytest.mark.parametrize("seed", range(3))
def test_small_vocabulary(spark, seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["a", "B", "b", "é", "x9"]) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 5, 12, 13, 14, 30]))) for i in range(6 + seed)] + [(90, None), (91, " .-"), (92, "zz")]
    docs = [(i, text(r.randrange(0, 200))) for i in range(60)] + [(70, None), (71, ""), (72, "ZZ zz zz"), (73, text(20000))]
    docs += [(80, "pre " + items[-4][1] + " post"), (None, "zz")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert got(dc.overlaps(d, b)) == brute(docs, items)


def test_nulls_repeats_clashes_empty(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    schema = "doc_id long, text string, item_id string, h long, size int"
    docs = spark.createDataFrame([(1, passage, None, 1, 1), (1, passage, None, 1, 1), (2, None, "x", None, None)], schema)
    items = spark.createDataFrame([(5, passage, 1), (5, passage, 2), (None, passage, 3), (6, passage.upper() + " more", 4)], "item_id long, text string, doc_id long")
    rows = dc.overlaps(docs, items).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows) == [(1, 20, 20, ["5", "6"]), (2, 0, 0, [])]
    assert dc.overlaps(docs.limit(0), items).count() == 0
    assert got(dc.overlaps(docs, items.limit(0))) == {1: (20, 0, []), 2: (0, 0, [])}


def test_fingerprint_in_every_window():
    import numpy as np

    r = np.random.default_rng(2)
    for spread in (3, 1 << 40):
        grams = r.integers(0, spread, 500).astype(np.uint64)
        chosen = set(dc.fingerprints(grams, 9).tolist())
        for i in range(len(grams) - 8):
            assert i + int(np.argmin(grams[i : i + 9])) in chosen
