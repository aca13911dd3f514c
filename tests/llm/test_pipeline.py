from collections import Counter

import corpus_pipeline as cp
import duckdb
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as spans
from test_near_dup import brute as groups

from quarry.llm import queries


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = cp.language_id(spark, docs, sf_dir)
    assert kept.columns == columns and kept.count() >= 0.95 * docs.where(F.col("text").rlike(r"\p{L}")).count()

    rows = {r.doc_id: r.text for r in docs.collect()}
    one = cp.near_duplicates(spark, docs, sf_dir)
    assert one.columns == columns
    assert sorted(r.doc_id for r in one.collect()) == [d for d, (_, _, own) in groups(list(rows.items()), 5).items() if own]

    clean = cp.decontamination(spark, docs, sf_dir)
    hits = spans(list(rows.items()), [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    assert clean.columns == columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, (n, h, _) in hits.items() if not (h and 20 * h >= n))

    mixed = cp.mixing(spark, docs, sf_dir).collect()
    assert all(r.taken == r.size * r.times > 0 and r.text == rows[r.doc_id] for r in mixed)


def test_texts_of_no_known_language_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(-i, t, None, None, len(t)) for i, t in enumerate(["zzz qqq xxxx", "\u65e5\u672c\u8a9e\u306e\u30c6\u30ad\u30b9\u30c8", "\u041f\u0440\u0438\u0432\u0435\u0442 \u043a\u0430\u043a \u0434\u0435\u043b\u0430"], 1)]
    kept = cp.language_id(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), sf_dir)
    assert kept.where("doc_id < 0").count() == 0 and kept.count() == cp.language_id(spark, docs, sf_dir).count()


def test_run_chains_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(str, docs.collect())) == sorted(map(str, cp.run(spark, sf_dir).collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rep int, Score string, kept string"
WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
OWN = [" ".join(f"{w}{x}" for w in WORDS) for x in "abcdefgh"]
ODD = [
    (5, OWN[0], "en", "s", 1, "x", 1, "t", None), (5, OWN[1], "en", "s", 1, "x", 1, "t", None), (1, OWN[0], "en", "t", 1, None, 1, "t", None),  # an id with two texts, one a copy
    (7, OWN[2], "en", "s", 1, "x", 1, "t", None), (7, OWN[2], "en", "s", 1, "x", 1, "t", None), (7, OWN[2], "en", "r", 1, "x", 1, "t", None),  # repeated rows
    (None, OWN[3], "en", "s", 1, "x", 1, "t", None), (None, OWN[4], "en", None, 1, "x", 1, "t", None), (None, OWN[2], "en", "s", 1, "x", 1, "t", None),  # null ids
    (-4, OWN[5], "en", "s", 1, "x", 1, "t", None), (3, OWN[5], "en", "s", 1, "x", 1, "t", None), (8, None, "en", "s", 0, None, None, None, None),
    (9, "", None, "s", 0, None, None, None, None), (9, "", None, "s", 0, None, None, None, None),
]


def test_no_row_is_lost_or_repeated(spark, tmp_path):
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    spark.createDataFrame([(1, OWN[1] + " more"), (2, OWN[4])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = lambda df: sorted(map(str, df.collect()))
    expect = lambda keep: rows(spark.createDataFrame(keep, SCHEMA))

    assert rows(cp.language_id(spark, docs, "")) == expect([r for r in ODD if r[1]])
    one = cp.near_duplicates(spark, docs, "")
    kept = [ODD[2], ODD[1], ODD[6], ODD[7], ODD[9], ODD[11], ODD[12]]
    assert one.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in one.collect()) == sorted((r[0] or 0, r[1] or "") for r in [*kept, ODD[3]])
    assert {str(r) for r in one.collect()} <= set(rows(docs))
    bad = {OWN[4]}  # thirteen words of the other item are more than the text has
    assert rows(cp.decontamination(spark, docs, str(tmp_path))) == expect([r for r in ODD if r[1] not in bad])

    mixed = cp.mixing(spark, docs, "").collect()
    assert len({x.lower() for x in mixed[0].asDict()}) == len(mixed[0]) and "Score" in mixed[0].asDict()
    key = lambda r: (r.doc_id, r.text, r.source)
    have = Counter((r[0], r[1], r[3]) for r in ODD)
    taken = Counter(map(key, mixed))
    assert all(taken[k] <= have[k] for k in taken) and all(r.taken == 12 * r.times and r.times in (1, 2) for r in mixed)
    assert sum(r.taken for r in mixed) == pytest.approx(1.5 * 12 * sum(bool(r[1]) for r in ODD), abs=24)
    assert any(r.doc_id is None for r in mixed)


def test_stages_chain_over_odd_and_empty_rows(spark, sf_dir):
    for part in (ODD, []):
        docs = spark.createDataFrame(part, SCHEMA)
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "mixing" or out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.isEmpty() == (not part)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == sorted(str(r) for r in con.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall())
