"""Phrase collocation mining by best-first branch-and-bound growth.

Phrases grow by a word at a time. The counts of what is known so far bound what
may still come: a phrase of three words scores at most ``f(first two) / f(first)``
and at most ``f(last two) / f(last)``. Each round opens, in every language, the
part of the frontier whose bound reaches a score ``floor``, and counts it in one
pass over the corpus. Floors fall from round to round until every language has
its ``top`` surviving phrases, ties included, at or above its floor: then nothing
below can change them.

Counts are exact: words are coded by their bytes in each block of text, and only
distinct phrases of a block leave Python, to be summed by Spark. What decides
whether an occurrence is worth counting is sent as bit maps of fixed size; a
wrong bit costs a few counts that are not needed and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.bytesview import slices
from quarry.llm.wordcodes import Block, blocks, dense
from quarry.scratch import materialize, release

BITS = 24
_PRIME = 1_000_003
_SALTS = 64
_BAND = 1000
WHOLE = 1_000_000

BREAKS = np.zeros(256, dtype=bool)
BREAKS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
WORD = ~BREAKS
WORD[[9, 32]] = False

#: Of one round: bit maps of pairs that may open a phrase, that may close one, and whose survival is asked; and of all frequent pairs.
Maps = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class _Words:
    """A block's words, equal ones of a language under one number."""

    def __init__(self, block: Block, lang_of_row: np.ndarray, langs: list[bytes]):
        size = len(block.words)
        found, self.word, self.count = dense(lang_of_row[block.row] * size + block.code, len(langs) * size)
        self.lang = found // size
        self.text = [block.words[i] for i in (found % size).tolist()]
        self.crc = np.array([crc32(langs[g] + b"\n" + w) for g, w in zip(self.lang.tolist(), self.text, strict=True)], dtype=np.int64)
        self.joined = (block.row[1:] == block.row[:-1]) & (block.stretch[1:] == block.stretch[:-1])

    def singles(self):
        return self.lang, self.text, self.count

    def pairs(self, frequent: np.ndarray):
        ok = _has(frequent, self.crc & (len(frequent) * 8 - 1))[self.word]
        at = np.flatnonzero(self.joined & ok[:-1] & ok[1:])
        n = len(self.text)
        keys, _, count = dense(self.word[at] * n + self.word[at + 1], n * n)
        a, b = keys // n, keys % n
        return self.lang[a], [self.text[x] + b" " + self.text[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], count

    def triples(self, now: Maps, before: list[Maps]):
        crc = self.crc[self.word]
        slot = (crc[:-1] * _PRIME + crc[1:]) & (len(now[0]) * 8 - 1)
        at = np.flatnonzero(self.joined[:-1] & self.joined[1:])
        left, right = slot[at], slot[at + 1]

        def asked(maps: Maps) -> np.ndarray:
            opens, closes, survives, frequent = maps
            return (_has(opens, left) & _has(closes, right)) | (_has(frequent, left) & _has(frequent, right) & (_has(survives, left) | _has(survives, right)))

        want = asked(now)
        for maps in before:
            want &= ~asked(maps)
        at = at[want]
        n = len(self.text)
        heads, head, _ = dense(self.word[at] * n + self.word[at + 1], n * n)
        keys, _, count = dense(head * n + self.word[at + 2], max(1, len(heads)) * n)
        h, c = heads[keys // n], keys % n
        a, b = h // n, h % n
        return self.lang[a], [b" ".join((self.text[x], self.text[y], self.text[z])) for x, y, z in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)], count


def _counted(docs: DataFrame, size: int, sent, earlier: list) -> DataFrame:
    """``lang, phrase, n`` of phrases of ``size`` words; ``sent`` and ``earlier`` are broadcast bit maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                coded = part.column("lang").dictionary_encode()
                langs = [x.encode() if isinstance(x, str) else x for x in coded.dictionary.to_pylist()]
                lang_of_row = coded.indices.to_numpy().astype(np.int64)
                for block in blocks(part.column("text"), WORD, BREAKS, fold=True):
                    words = _Words(block, lang_of_row, langs)
                    if size == 1:
                        lang, text, n = words.singles()
                    elif size == 2:
                        lang, text, n = words.pairs(sent.value)
                    else:
                        lang, text, n = words.triples(sent.value, [x.value for x in earlier])
                    if len(text):
                        names = pa.DictionaryArray.from_arrays(pa.array(lang), coded.dictionary).cast(coded.dictionary.type)
                        yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(text, pa.binary()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    found = docs.mapInArrow(run, "lang string, phrase binary, n long")
    return found.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))


def _slot(bits: int, *words: Column) -> Column:
    """The bit of a word or a pair, as :class:`_Words` works it out."""
    crc = [F.crc32(F.concat(F.col("lang"), F.lit("\n"), w)) for w in words]
    return (crc[0] if len(crc) == 1 else crc[0] * _PRIME + crc[1]).bitwiseAND((1 << bits) - 1)


def _bit_map(slots: DataFrame, bits: int) -> np.ndarray:
    """``slots(slot)`` as packed bits, put together by the executors; as long as ``bits`` says, whatever the input."""
    at = F.col("slot") + 1
    rows = slots.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b")).toArrow()
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for k, b in zip(rows.column("k").to_pylist(), rows.column("b").to_pylist(), strict=True):
        part = np.frombuffer(b, dtype=np.uint8)[: len(out) - (k - 1) * 4096]
        out[(k - 1) * 4096 : (k - 1) * 4096 + len(part)] = part
    return out


def score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1,000,000 a^2 / (left right))`` in exact decimals; counts below 10^15."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(WHOLE).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right))


def _share(a: Column, whole: Column) -> Column:
    return F.call_function("div", a.cast("decimal(15,0)") * WHOLE, whole.cast("decimal(15,0)"))


def _floors(bands: DataFrame, wanted: int) -> DataFrame:
    """``lang, floor``: the highest multiple of a band that ``wanted`` phrases reach, else 0, from ``bands(lang, band, n)``: a thousand rows a language."""
    down = Window.partitionBy("lang").orderBy(F.desc("band"))
    run = bands.withColumn("so_far", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    reached = run.groupBy("lang").agg(F.max(F.when(F.col("so_far") >= wanted, F.col("band"))).alias("band"))
    return reached.select("lang", F.coalesce(F.col("band") * _BAND, F.lit(0)).alias("floor"))


def _bands(scored: DataFrame) -> DataFrame:
    return scored.groupBy("lang", F.floor(F.col("score") / _BAND).alias("band")).agg(F.count("*").alias("n"))


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with ``rank``; parts of a language are cut to that length before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def _pairs_scored(pairs: DataFrame, words: DataFrame) -> DataFrame:
    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    p = pairs.select("lang", "phrase", F.col("n").alias("a"), first.alias("first"), last.alias("last"))
    p = p.join(words.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    p = p.join(words.select("lang", F.col("phrase").alias("last"), F.col("n").alias("r")), ["lang", "last"])
    return p.select("lang", "phrase", "first", "last", "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))


def _triples_scored(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    head, tail = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)
    t = triples.select("lang", "phrase", F.col("n").alias("a"), head.alias("head"), tail.alias("tail"))
    t = t.join(pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("f_head"), F.col("l").alias("f_first")), ["lang", "head"])
    t = t.join(pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("f_tail"), F.col("r").alias("f_last")), ["lang", "tail"])
    cut = lambda left, right: F.struct(score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))
    one, two = cut("f_first", "f_tail"), cut("f_head", "f_last")
    t = t.withColumn("cut", F.when(one.getField("score") <= two.getField("score"), one).otherwise(two))
    return t.select("lang", "phrase", "head", "tail", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, *, top: int = 2000, least: int = 10, inside: int = 50, first: int | None = None, bits: int = BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per language the ``top`` phrases of two or three words: ``lang, rank, phrase, a, l, r, n, score``.

    Texts have A-Z in lower case and are cut at ``. , ; : ! ?`` and line ends;
    words lie between spaces and tabs. ``a`` counts all occurrences of a phrase,
    ``l`` and ``r`` those of its two parts at the cut that scores lowest (the
    earlier of equal cuts), ``n`` all words of the language. Phrases that occur
    less than ``least`` times are none; one that lies in a longer phrase with
    ``inside`` percent of its count or more is left out. Order: score, then
    ``a``, both descending, then the phrase.

    ``first`` is how many pairs of a language the first round asks about (twice
    ``top``, if not given); it changes the work, not the result. Null texts are
    empty, a null language is ``und``, repeated rows count again, an empty table
    gives no rows, further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    send = spark.sparkContext.broadcast
    vocabulary = materialize(_counted(rows, 1, None, []), "words")
    words = vocabulary.where(F.col("n") >= least)
    frequent = send(_bit_map(words.select(_slot(bits, F.col("phrase")).alias("slot")), bits))
    pairs = materialize(_pairs_scored(_counted(rows, 2, frequent, []).where(F.col("n") >= least), words), "pairs")
    slots = pairs.withColumn("slot", _slot(bits, F.col("first"), F.col("last")))
    all_pairs = _bit_map(slots, bits)
    bands = materialize(_bands(pairs), "bands")

    wanted, closed, triples, sent, written = first or 2 * top, None, None, [], []
    while True:
        floors = _floors(bands, wanted)
        if closed is not None:
            floors = closed.select("lang", "floor").unionByName(floors.join(closed, "lang", "left_anti"))
        floors = materialize(floors, "floors")
        asked = slots.join(floors, "lang")
        opens, closes = _share(F.col("a"), F.col("l")) >= F.col("floor"), _share(F.col("a"), F.col("r")) >= F.col("floor")
        maps = tuple(_bit_map(asked.where(c), bits) for c in (opens, closes, F.col("score") >= F.col("floor"))) + (all_pairs,)
        before, now = list(sent), send(maps)
        sent.append(now)
        grown = materialize(_triples_scored(_counted(rows, 3, now, before).where(F.col("n") >= least), pairs), "triples")
        written.append(grown)
        triples = grown if triples is None else triples.unionByName(grown)
        around = triples.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        left = pairs.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
        columns = ["lang", "phrase", "a", "l", "r", "score"]
        found = left.select(columns).unionByName(triples.select(columns)).join(floors, "lang").where(F.col("score") >= F.col("floor"))
        found = materialize(found, "found")
        settled = floors.join(found.groupBy("lang").count(), "lang", "left").where((F.col("floor") == 0) | (F.col("count") >= top))
        closed = materialize(settled.select("lang", "floor"), "closed")
        if floors.join(closed, "lang", "left_anti").isEmpty():
            break
        release(found)
        wanted *= 4
    # what cannot be among the first goes before ranks are given
    last = _floors(_bands(found), top).withColumnRenamed("floor", "last")
    best = _best(found.drop("floor").join(last, "lang").where(F.col("score") >= F.col("last")), top)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    whole = materialize(best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases")
    release(vocabulary, pairs, bands, found, *written)
    return whole
