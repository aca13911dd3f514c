"""Collocations against a plain count of everything, for every width of the first round."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import phrases, queries, wordcodes


def plainly(rows, top, least, inside):
    out = []
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for lang in n:
        rest = []
        for (g, w), a in cands.items():
            if g != lang:
                continue
            if any(h == g and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * b >= inside * a for (h, v), b in cands.items()):
                continue
            s, _, left, right = min((1_000_000 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
            rest.append((-s, -a, " ".join(w).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rest)[:top])]
    return sorted(out)


def ours(df, **given):
    return sorted(tuple(r) for r in phrases.collocations(df, **given).collect())


def corpus(seed, docs=60, vocabulary=12):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "ÀB", "a b", "X"]
    weights = [1 / (i + 1) for i in range(len(words))]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", " ! "]
    rows = [(draw.choice(["en", "de", None]), "".join(w + draw.choices(ends, [20, 2, 1, 1, 1, 1, 1, 1, 1])[0] for w in draw.choices(words, weights, k=draw.randint(0, 60)))) for _ in range(docs)]
    return rows + [("en", None), ("en", ""), ("fr", "..., ;"), (None, "New York " * 40), ("en", "a a a a a a a a a a a a a a"), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "top", "first", "bits"), [(1, 2000, None, 24), (2, 5, 1, 20), (3, 9, 2, 8), (4, 1, 1, 24)])
def test_same_as_plain(spark, seed, top, first, bits):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "lang string, text string, n int, phrase string").repartition(5)
    assert ours(df, top=top, least=4, first=first, bits=bits) == plainly(rows, top, 4, 50)


def test_rounds_go_on_until_enough_survive(spark):
    """Pairs that score best lie in longer phrases, so the first rounds leave fewer than asked."""
    rows = [("en", f"a{i} b{i} c{i}") for i in range(30) for _ in range(12)] + [("en", f"p{i} q{i}. p{i} z. q{i} z") for i in range(9) for _ in range(10)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for top in (3, 32, 35):
        assert ours(df, top=top, least=10, first=1) == plainly(rows, top, 10, 50)


def test_empty_table(spark):
    found = phrases.collocations(spark.createDataFrame([], "lang string, text string"))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and found.count() == 0


def test_counts_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("3000000000000L a", "4000000000000L l", "5000000000000L r")
    assert row.select(phrases.score(row.a, row.l, row.r)).first()[0] == 10**6 * 9 * 10**24 // (20 * 10**24)


def test_blocks_cut_nowhere_else_than_at_breaks():
    texts = ["", "one two. three four", None, "x" * 50, "a b c d e f g h", "end.", "é è\tê, ü"]
    column = pa.array(texts)
    seen = []
    for limit in (1, 3, 7, 1000):
        got = []
        for b in wordcodes.blocks(column, phrases.WORD, phrases.BREAKS, fold=True, limit=limit):
            joined = (b.row[1:] == b.row[:-1]) & (b.stretch[1:] == b.stretch[:-1])
            got += [(int(r), b.words[c].decode(), bool(j)) for r, c, j in zip(b.row, b.code, np.append(joined, False))]
        seen.append(got)
    assert all(s == seen[0] for s in seen)
    assert [w for _, w, _ in seen[0]] == [w for t in texts if t for w in re.findall("[^ \t.,]+", t)]


def test_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(tuple(r) for r in queries.op12_collocations(spark, sf_dir).collect()) == sorted(con.sql(queries.ORACLES["op12_collocations"]).fetchall())
