import random
from math import log2

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import ppm
from quarry.llm.bytesview import utf8


def plain_code_length(counts, order, data):
    """The definition, byte by byte, over dictionaries context -> {byte: count}."""
    bits = 0.0
    for i, b in enumerate(data):
        for k in range(min(order, i), -1, -1):
            own = counts.get(data[i - k : i])
            if not own:
                continue
            n, t = sum(own.values()), len(own)
            if b in own:
                bits -= log2(own[b] / (n + t))
                break
            bits -= log2(t / (n + t))
        else:
            bits += 8
    return bits


def tree(texts, order):
    out = {}
    for x in texts:
        data = x.encode()
        for i, b in enumerate(data):
            for k in range(min(order, i) + 1):
                own = out.setdefault(data[i - k : i], {})
                own[b] = own.get(b, 0) + 1
    return out


@pytest.mark.parametrize("order", [1, 4])
def test_exact_code_lengths(spark, order, monkeypatch):
    monkeypatch.setattr(ppm, "_STEP", 37)  # rows reach over steps
    r = random.Random(order)
    word = {"aa": "abcd é", "bb": "cdef ñ"}
    rows = [(i, "".join(r.choice(word[lang]) for _ in range(r.randrange(0, 60))), lang) for i in range(60) for lang in word]
    m = ppm.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order=order)
    trees = {lang: tree([t for _, t, x in rows if x == lang], order) for lang in word}
    asked = ["", "a", "abcabc", "zzz é", "fed" * 50, "ñ", "x"] + [t for _, t, _ in rows[:20]]
    got = m.score(*utf8(pa.array(asked)))
    for text, bits in zip(asked, got, strict=True):
        assert np.allclose(bits, [plain_code_length(trees[x], order, text.encode()) for x in ("aa", "bb")], rtol=1e-5, atol=1e-3)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = ppm.predict(docs, ppm.train_packed(docs.where(~ppm.held_out(F.col("doc_id"))))).where(ppm.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    assert len(out) > 20
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_packed_model_is_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = ppm.train_packed(docs)
    texts = [r.text for r in docs.where("text is not null").limit(30).collect()]
    m = ppm.train(docs)
    bits = m.score(*utf8(pa.array(texts)))
    found = {r.text: r.lang_pred for r in ppm.predict(docs, packed).collect()}
    assert all(found[t] == m.languages[b.argmin()] for t, b in zip(texts, bits, strict=True) if any(c.isalpha() for c in t))
    assert {r.lang_pred for r in ppm.predict(docs, ppm.train_packed(docs.limit(0))).collect()} == {"und"}


def test_sample_is_bounded(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit("x").alias("lang"))
    m = ppm.train(rows, order=0, docs_per_language=100)
    few = ppm.train(rows, order=0, docs_per_language=100)
    assert m.languages == ["x"] and np.array_equal(m.cost[0], few.cost[0])


def test_rare_languages_keep_their_trees(spark):
    r = random.Random(3)
    word = {"aa": "abcdefgh", "bb": "klmnopqr", "cc": "stuvwxyz"}
    rows = [(i, "".join(r.choice(word[lang]) for _ in range(200)), lang) for lang, n in (("aa", 60), ("bb", 60), ("cc", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small = ppm.train(df, bytes_per_language=2000)
    packed = ppm.train_packed(df, bytes_per_language=2000)
    asked = spark.createDataFrame([(1, "zyx tuv wst"), (2, "abc fgh")], "doc_id long, text string")
    assert [x.lang_pred for x in ppm.predict(asked, packed).orderBy("doc_id").collect()] == ["cc", "aa"]
    alone = ppm.train(df.where("lang = 'cc'"), bytes_per_language=2000)
    data = utf8(pa.array([t for _, t, lang in rows if lang == "cc"]))
    assert np.allclose(small.score(*data)[:, 2], alone.score(*data)[:, 0])


def test_bytes_are_bounded_by_whole_texts(spark):
    rows = [(i, "ab" * 50, "aa") for i in range(30)] + [(99, "z" * 5000, "aa"), (None, "q" * 3000, "bb")]
    m = ppm.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order=0, bytes_per_language=1000)
    # ten texts of aa, without the one that is too long; bb has no other
    assert np.allclose(m.score(*utf8(pa.array(["a"])))[:, 0], log2(1002 / 500))
    assert np.allclose(m.score(*utf8(pa.array(["q"])))[:, 1], log2(3001 / 3000))


def test_nulls_repeats_clashes_empty(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, None, "en", "s"), (2, "", "en", None), (3, "123 !?", "en", None), (4, "abc", None, None), (None, "abc abc", "en", "x"), (4, "abc", None, None)]
    df = spark.createDataFrame(rows, schema)
    out = ppm.predict(df, ppm.train_packed(df)).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in out) == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert all((r.score == 0) == (r.lang_pred == "und") for r in out)
    empty = ppm.train_packed(df.limit(0))
    assert {r.lang_pred for r in ppm.predict(df, empty).collect()} == {"und"}
    assert ppm.predict(df.limit(0), empty).count() == 0
    odd = df.withColumnsRenamed({"score": "Score"}).withColumn("LANG_PRED", F.lit("x"))
    assert ppm.predict(odd, ppm.train_packed(df)).columns == ["doc_id", "text", "lang", "lang_pred", "score"]


def test_labels_are_bounded(spark):
    rows = [(i, "the same words " * 3, "en") for i in range(9)] + [(100 + i, "die gleichen worte " * 3, "de") for i in range(5)] + [(200 + i, "x", f"dirty {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert ppm.train(df, most_languages=3).languages == ["de", "dirty 0", "en"]


def test_texts_of_no_known_language_cost_more_than_bytes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ppm.train_packed(docs)
    odd = spark.createDataFrame([("zzz qqq xxxx",), ("\u65e5\u672c\u8a9e\u306e\u30c6\u30ad\u30b9\u30c8",), ("\u041f\u0440\u0438\u0432\u0435\u0442 \u043a\u0430\u043a \u0434\u0435\u043b\u0430",)], "text string")
    assert all(r.bits_per_byte > ppm.NO_MODEL for r in ppm.predict(odd, model, with_bits=True).collect())
    assert ppm.predict(docs, model, with_bits=True).where(F.col("bits_per_byte") > ppm.NO_MODEL).count() == 0
