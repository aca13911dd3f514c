"""Language identification by prediction by partial matching.

For each language a byte context tree of variable order holds frozen counts.
A byte seen after the longest known context costs ``-log2(count / (n + t))``
bits, where ``n`` is the context's total and ``t`` its number of distinct bytes;
else the escape, ``-log2(t / (n + t))``, is paid and the next shorter context
asked; below order 0 every byte costs 8 bits; contexts without counts are
passed without cost. The sum over a text is its exact code length under that
language, and the shortest code wins.

Costs of every context-and-byte in any tree are worked out once, for all
languages, so scoring a text is a table lookup per byte.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.bytesview import slices, utf8

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = 1 << 19


class _Table:
    """Open-addressing hash table from 64-bit keys to row numbers."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)
        todo, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == _EMPTY
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]], self.rows[slot[put]] = keys[todo[put]], todo[put]
            left = np.ones(len(todo), dtype=bool)
            left[put] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; -1 if it has none."""
        slot = self._slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.rows[slot], np.int32(-1))
        open_ = np.flatnonzero((have != keys) & (have != _EMPTY))
        at = slot[open_]
        while len(open_):
            at = (at + 1) & self.mask
            have = self.keys[at]
            hit = have == keys[open_]
            out[open_[hit]] = self.rows[at[hit]]
            more = ~hit & (have != _EMPTY)
            open_, at = open_[more], at[more]
        return out


@dataclass
class Model:
    """Frozen trees: per order the contexts-and-bytes, packed in integers, with a cost per language."""

    languages: list[str]
    order: int
    grams: list[_Table] = field(default_factory=list)
    cost: list[np.ndarray] = field(default_factory=list)
    contexts: list[_Table] = field(default_factory=list)
    escape: list[np.ndarray] = field(default_factory=list)

    def costs(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of each key after the ``k`` bytes before it, per language."""
        if k < 0:
            return np.full((len(keys), len(self.languages)), 8, dtype=np.float32)
        row = self.grams[k].find(keys)
        out = self.cost[k][row]
        missing = np.flatnonzero(row < 0)
        if len(missing):
            below = keys[missing]
            ctx = self.contexts[k].find(below >> np.uint64(8))
            escape = np.where((ctx >= 0)[:, None], self.escape[k][ctx], np.float32(0))
            out[missing] = escape + self.costs(below & np.uint64((1 << (8 * k)) - 1), k - 1)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row under each language, in bits."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for at in range(0, len(data), _STEP):
            stop = min(at + _STEP, len(data))
            lead = min(at, self.order)
            raw = data[at - lead : stop].astype(np.uint64)
            keys = np.zeros(stop - at, dtype=np.uint64)
            for j in range(self.order, -1, -1):
                keys <<= np.uint64(8)
                low = lead - j
                keys[max(0, -low) :] |= raw[max(low, 0) : max(low + stop - at, 0)]
            bits = self.costs(keys, self.order)
            r0, r1 = np.searchsorted(offsets, [at, stop - 1], side="right") - 1
            for j in range(self.order):  # the first bytes of a row have shorter contexts
                early = offsets[r0 : r1 + 1] + j
                early = early[(early >= at) & (early < np.minimum(offsets[r0 + 1 : r1 + 2], stop))] - at
                bits[early] = self.costs(keys[early] & np.uint64((1 << (8 * (j + 1))) - 1), j)
            total = np.zeros((stop - at + 1, bits.shape[1]))
            np.cumsum(bits, axis=0, dtype=np.float64, out=total[1:])
            edge = np.clip(offsets[r0 : r1 + 2], at, stop) - at
            out[r0 : r1 + 1] += total[edge[1:]] - total[edge[:-1]]
        return out


def build(languages: list[str], order: int, lang: np.ndarray, k: np.ndarray, key: np.ndarray, count: np.ndarray) -> Model:
    """Trees from rows of (language number, order, packed context and byte, count)."""
    m, n_lang = Model(languages, order), len(languages)
    for o in range(order + 1):
        here = k == o
        keys, inv = np.unique(key[here], return_inverse=True)
        n = np.zeros((len(keys), n_lang))
        np.add.at(n, (inv, lang[here]), count[here])
        ctx, cinv = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, distinct = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
        np.add.at(total, cinv, n)
        np.add.at(distinct, cinv, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0)
            own = np.log2((total + distinct)[cinv] / n)
        m.contexts.append(_Table(ctx))
        m.escape.append(np.vstack([escape, np.zeros((1, n_lang))]).astype(np.float32))
        below = m.costs(keys & np.uint64((1 << (8 * o)) - 1), o - 1)
        cost = np.where(n > 0, own, escape[cinv] + below)
        m.grams.append(_Table(keys))
        m.cost.append(np.vstack([cost, np.zeros((1, n_lang))]).astype(np.float32))
    return m


def _gram_counts(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(data) <= k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    keys = np.zeros(len(data) - k, dtype=np.uint64)
    for j in range(k + 1):
        keys = (keys << np.uint64(8)) | data[j : len(data) - k + j].astype(np.uint64)
    whole = np.ones(len(keys), dtype=bool)
    for j in range(1, k + 1):  # grams that reach over a row's end
        over = offsets[1:-1] - j
        whole[over[(over >= 0) & (over < len(keys))]] = False
    return np.unique(keys[whole], return_counts=True)


def _counts(rows: DataFrame, *, order: int = 4, docs_per_language: int = 1000, bytes_per_language: int = 4 << 20, most_languages: int = 256, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> tuple[list[str], int, DataFrame | None]:
    """Languages, order and counts ``lang, k, gram, n`` of a bounded sample of labelled rows.

    The bounds hold for each language by itself: ``docs_per_language`` whole
    texts of ``bytes_per_language`` together, taken by the smallest hash of id
    and text; a language of longer texts only gives one. All that the sample
    holds is counted. Learned are the ``most_languages`` labels with most rows
    (equal ones by name), so that a column with very many dirty labels makes no
    larger model. Rows with a null text or language are left out; without any
    the model knows no language.
    """
    d = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    common = d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    n = {r.lang: r["count"] for r in common.collect()}
    languages = sorted(n)
    if not languages:
        return [], order, None
    d = d.where(F.col("lang").isin(languages))
    # a share of each language by hash first, a little too many, so that the exact cut sees a small table only
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, (1.5 * docs_per_language + 50) / n[lang]))])
    place = (F.xxhash64("id", "text").cast("double") / 2.0**64) + 0.5
    d = d.withColumn("place", place).where(F.col("place") <= share[F.col("lang")])
    by = Window.partitionBy("lang").orderBy(F.octet_length("text") > bytes_per_language, "place", "id", "text")
    d = d.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= docs_per_language)
    d = d.withColumn("held", F.sum(F.octet_length("text").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d = d.where((F.col("held") <= bytes_per_language) | (F.col("nth") == 1))
    # few languages would make few tasks
    d = d.repartition("lang", F.pmod("nth", F.lit(16)))
    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                langs = np.array([number[x] for x in part.column("lang").to_pylist()])
                for lang in np.unique(langs):
                    data, offsets = utf8(part.filter(pa.array(langs == lang)).column("text"))
                    for k in range(order + 1):
                        keys, c = _gram_counts(data, offsets, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), lang, dtype=np.int32)), pa.array(np.full(len(keys), k, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "k", "gram", "n"])

    grams = d.select("lang", "text").mapInArrow(run, "lang int, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    return languages, order, grams


def _packed(languages: list[str], order: int, counts: pa.Table) -> bytes:
    """Counts as compressed bytes, a few for each entry."""
    lang, k, gram, n = (counts.column(c).to_numpy() for c in ("lang", "k", "gram", "n"))
    at = np.lexsort((gram, k, lang))
    # neighbours in this order differ little
    fields = [lang[at].astype(np.int32), k[at].astype(np.int8), np.diff(gram[at], prepend=np.int64(0)), n[at].astype(np.int64)]
    return pickle.dumps((languages, order, [(x.dtype.str, len(x), pa.compress(x.tobytes(), codec="zstd", asbytes=True)) for x in fields]))


def unpack(packed: bytes) -> Model:
    """The trees of a packed model."""
    languages, order, fields = pickle.loads(packed)
    if not fields:
        return Model([], order)
    lang, k, gram, n = (np.frombuffer(pa.decompress(x, length * np.dtype(kind).itemsize, codec="zstd"), dtype=kind) for kind, length, x in fields)
    return build(languages, order, lang, k, np.cumsum(gram, dtype=np.int64).view(np.uint64), n)


_unpacked: dict[bytes, Model] = {}


def _held(packed: bytes, name: bytes) -> Model:
    """The model of that name, unpacked once in a worker process."""
    if name not in _unpacked:
        _unpacked.clear()
        _unpacked[name] = unpack(packed)
    return _unpacked[name]


def train_packed(rows: DataFrame, **bounds) -> bytes:
    """Fit trees on a bounded sample (see :func:`_counts` for the bounds and their defaults); its counts come back packed by one task."""
    languages, order, counts = _counts(rows, **bounds)
    if counts is None:
        return pickle.dumps(([], order, []))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):  # what a bounded sample of each language holds
            yield pa.RecordBatch.from_arrays([pa.array([_packed(languages, order, pa.Table.from_batches(got))])], ["model"])

    made = counts.coalesce(1).mapInArrow(pack, "model binary").collect()
    return bytes(made[0].model) if made else pickle.dumps(([], order, []))


def train(rows: DataFrame, **bounds) -> Model:
    """As :func:`train_packed`, with the trees made here."""
    return unpack(train_packed(rows, **bounds))


#: Bits a byte above which a text is in none of the languages: a byte costs 8 without any model, the rest is for keys, names and numbers in short texts.
NO_MODEL = 10.0


def predict(docs: DataFrame, model: bytes, *, text_col: str = "text", with_bits: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` under a packed model.

    The whole text is scored. ``score`` is the share of the winner when each
    language weighs two to the power of minus its code length; ties go to the
    language first in order. A null text, or one without a letter, or a model
    without languages gives ``und`` with score 0. The score compares known
    languages only: a text in none of them has a winner too. ``with_bits`` adds
    ``bits_per_byte``, the winner's code length, which tells such texts (see
    ``NO_MODEL``). Columns of these names in
    ``docs``, in any case, are replaced; no other column is looked at. Every row
    gives a row, repeats too; an empty table gives none.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample of each language
    name = hashlib.blake2b(model, digest_size=16).digest()
    new = ["lang_pred", "score", *(["bits_per_byte"] if with_bits else [])]
    rest = [c for c in docs.columns if c.lower() not in new]
    asked = docs.select(*rest, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _held(sent.value, name)
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                langs, score, each = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part))
                ask = part.column("__letters").to_pylist()
                if m.languages and any(ask):
                    data, offsets = utf8(part.column(text_col))
                    bits = m.score(data, offsets)
                    each = bits.min(axis=1) / np.maximum(np.diff(offsets), 1)
                    best = bits.argmin(axis=1)
                    weight = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                    langs = [m.languages[b] if a else "und" for a, b in zip(ask, best.tolist(), strict=True)]
                    score = np.where(ask, 1 / weight, 0.0)
                kept = [part.column(c) for c in rest]
                made = [pa.array(langs, pa.string()), pa.array(score), pa.array(each)]
                yield pa.RecordBatch.from_arrays([*kept, *made[: len(new)]], [*rest, *new])

    schema = asked.drop("__letters").schema.add("lang_pred", "string").add("score", "double")
    if with_bits:
        schema = schema.add("bits_per_byte", "double")
    return asked.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """Whether an id belongs to the held-out quarter."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))
