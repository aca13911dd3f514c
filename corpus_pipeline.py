"""Four stages over ``documents``, each written and read again before the next.

1. language ID: documents without a recognised language go;
2. near duplicates (five words, similarity 0.8): one document of each group stays;
3. decontamination: documents that the benchmark contaminates go;
4. mixing: how often, and so how many words of, each document the mix takes.

Stages decide on rows, not on ids: a row is known by a digest of all its columns,
so null ids are ids like any other, and rows that share an id but not the text
are judged apart. Further columns travel along. An empty table gives an empty
table in every stage.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm import cube_mix, decontaminate, near_dup, ppm
from quarry.scratch import materialize, release, settle

#: No SQL twin: trained language models and hashed sampling are not SQL.
ORACLE_SQL = None
_ROW = "__row"


def _known(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for each row: its id, null last, then a digest of all columns; equal keys are equal rows."""
    rest = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != "text"], F.col("text").isNull().alias("__null")))
    digest = F.md5(F.concat(rest, F.lit("\n"), F.coalesce("text", F.lit(""))))
    id_ = F.col("doc_id").cast("long")
    low = F.lit(-(2**63)).cast("long")  # without its sign bit, so that bytes sort as numbers do
    number: Column = F.coalesce(F.concat(F.lit("00"), F.lpad(F.hex(id_.bitwiseXOR(low)), 16, "0")), F.lit("01"))
    return docs.withColumn(_ROW, F.unhex(F.concat(number, digest)))


def _one_each(docs: DataFrame, again: DataFrame) -> DataFrame:
    """Each row of ``docs`` once; ``again`` holds the keys that occur more often."""
    if again.isEmpty():
        return docs
    once = docs.join(again, _ROW, "left_semi").groupBy(_ROW).agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return docs.join(again, _ROW, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def _repeated(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy(_ROW).count().where("count > 1").select(_ROW), "repeated")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose language is recognised; texts of a word or two that several languages share stay too.

    A null text, or one without a letter, goes, and one that costs its likeliest
    language more than ten bits a byte, where bytes without any model cost
    eight: it is in none of the languages learned. Repeated rows are judged alike and all
    stay or go. Without any labelled row no language is known and all go.
    """
    model = ppm.train_packed(docs)
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # whatever the columns are called
    found = ppm.predict(docs.withColumnsRenamed(plain), model, text_col=plain["text"], with_bits=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.3) & (F.col("bits_per_byte") <= ppm.NO_MODEL)).select(*[F.col(p).alias(c) for c, p in plain.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: the one with the smallest doc_id, null last.

    Rows with a null or blank text are no one's copies and stay, but equal rows
    are one document in any case. Of rows with one id the texts decide: copies
    are one, different texts stay.
    """
    known = _known(docs)
    found = materialize(near_dup.near_duplicates(known, k=5, similarity=0.8, id_col=_ROW).select(_ROW, "kept"), "groups")
    gone = materialize(found.where(~F.col("kept")).select(_ROW).distinct(), "copies")
    left = known.join(gone, _ROW, "left_anti")
    return _one_each(left, _repeated(found.where("kept"))).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows of which matching benchmark windows cover a twentieth of the words or more.

    A null or blank text has no words and stays; repeated rows all stay or go.
    """
    known = _known(docs)
    found = decontaminate.overlaps(known, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, id_col=_ROW)
    gone = materialize(found.where(decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select(_ROW).distinct(), "contaminated")
    return known.join(gone, _ROW, "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with ``size, source_size, target, taken`` (words) and ``times``, how often.

    Every row counts and is sampled by itself, repeated ones and those with a
    null id or source too; texts without words are never taken. Columns of
    ``docs`` with one of the new names are replaced.
    """
    known = _known(docs)
    mixed = materialize(cube_mix.mix(known, weights=[3, 1, 2], share=1.5, most=2.0, id_col=_ROW).where("taken > 0"), "mixed")
    new = [c for c in mixed.columns if c != _ROW] + ["times"]
    rest = [c for c in known.columns if c.lower() not in new]
    rows = _one_each(known.select(rest), _repeated(mixed)).join(mixed, _ROW)
    return rows.withColumn("times", (F.col("taken") / F.col("size")).cast("int")).drop(_ROW)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(partial(stage, spark, docs, sf_dir), name)
        if before is not first:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
