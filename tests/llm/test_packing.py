"""Packing: tokens as the library gives them, places without gaps, and the search against all packings."""

import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as files
import pyarrow as pa
import pytest

from quarry.llm import packing, queries

PATH = files.path("word_bpe_49k.json")


def tokens(text):
    return [*packing._tokenizer(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def fewest(lengths, capacity):
    """By trying every place for every piece."""
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += lengths[i]
                go(i + 1, bins)
                bins[j] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_the_fewest_sequences(seed):
    draw = random.Random(seed)
    for _ in range(25):
        lengths = [draw.randint(1, 30) for _ in range(draw.randint(0, 9))]
        counts = Counter(lengths)
        found = packing.pack_counts(counts, 30)
        used = Counter()
        for filling, times in found:
            assert sum(filling) <= 30 and times > 0
            for x in filling:
                used[x] += times
        assert used == counts
        assert packing.least_bins(counts, 30) <= fewest(lengths, 30) == sum(n for _, n in found)


def test_search_beats_best_fit():
    for lengths, few in (([27, 29, 31, 31, 37, 39, 41, 42, 42, 58], 4), ([9, 9, 10, 12, 27, 35, 35, 45, 56, 59], 3)):
        counts = Counter(lengths)
        assert sum(n for _, n in packing.best_fit(counts, 100)) == few + 1
        assert sum(n for _, n in packing.pack_counts(counts, 100)) == few


def test_large_counts_reach_the_bound_closely():
    draw = np.random.default_rng(5)
    counts = {int(x): int(n) for x, n in zip(*np.unique(np.clip(np.exp(draw.normal(6, 1.2, 200_000)).astype(int), 1, 2048), return_counts=True))}
    assert sum(n for _, n in packing.pack_counts(counts, 2048, steps=400)) <= packing.least_bins(counts, 2048) * 1.001


def whole(packed, capacity):
    held = {}
    for r in packed:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_places_with_hot_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKS", 7)
    rows = [(i, 5 if i % 3 else i % 10 + 1, "x") for i in range(400)] + [(None, 10, "y"), (3, 5, "x"), (3, 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, length int, Offset string").repartition(6)
    got = packing.pack(df, capacity=10).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.length) for r in got) == Counter(r[:2] for r in rows)
    assert whole(got, 10) == sum(n for _, n in packing.pack_counts(Counter(r[1] for r in rows), 10))


def test_lengths_out_of_range(spark):
    with pytest.raises(ValueError, match="lengths"):
        packing.pack(spark.createDataFrame([(1, 11)], "id long, length int"), capacity=10)


def test_tokens_are_the_librarys(spark):
    draw = random.Random(3)
    odd = ["", None, " ", "Hello, World's 123 don't", "<|endoftext|> a<|startoftext|>b <|endoftext|", "ΑΣ Σ σ ΌΣΟΣ", "é ́x", "日本語テキスト", "a b c\u0085d\x0be", "İstanbul ǅ", "😀😀 x", "\x00\x1f y", "it'S WE'LL"]
    alphabet = list("abzAZ'019 \t\n\r\x0b\x0c.,!<|>éÉß̧́ ΣςИй中😀‍") + ["<|endoftext|>", "'re"]
    odd += ["".join(draw.choices(alphabet, k=draw.randint(1, 60))) for _ in range(400)]
    odd += ["word " * 9000, "x" * 5000, "ab" * 40 + " " + "ü" * 3000]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    for capacity in (2048, 50):
        want = Counter()
        for i, t, _ in rows:
            ids = np.array(tokens(t), dtype="<u4")
            for p in range(0, len(ids), capacity):
                part = ids[p : p + capacity]
                want[i, p // capacity, p, len(part), part.tobytes()] += 1
        got = packing.pieces(df, PATH, capacity=capacity).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == want


def test_blocks_add_up():
    texts = ["one two three " * 30, None, "", "four", "x" * 100 + " y"]
    for limit in (1, 16, 1 << 20):
        real = packing.blocks
        try:
            packing.blocks = lambda *a, **k: real(*a, **(k | {"limit": limit}))
            ids, at = packing._tokens(pa.array(texts), packing._Ids(PATH), 0)
        finally:
            packing.blocks = real
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tokens(t) for t in texts]


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 9)) for i in range(40)], "doc_id long, text string")
    cut = packing.pieces(docs, PATH, capacity=20)
    packed = packing.pack(cut, capacity=20)
    kept = {(r.sequence_id, r.offset): bytes(r.ids) for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(v for (s, _), v in sorted(kept.items()) if s == r.sequence_id) and len(r.ids) == 4 * r.length <= 80


def test_whole_query(spark, sf_dir):
    got = queries.op13_pack_sequences(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {}
    for i, t in texts.items():
        ids = np.array(tokens(t), dtype="<u4")
        for p in range(0, len(ids), 2048):
            want[i, p // 2048] = (p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert whole(got, 2048) == -(-sum(n for _, n, _ in want.values()) // 2048)


def test_empty_table(spark):
    cut = packing.pieces(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert packing.pack(cut.select("doc_id", "length")).collect() == []


def test_parts_of_words_are_encoded_once():
    stems = ["word", "naïveté", "straße", "x", "über"]
    texts = [f"{a}{end}{b.upper()} {a.title()}{end} {end}{b}7" for a in stems for b in stems for end in (".", "...", "12", "$$$", ",-", "!?")]
    ids = packing._Ids(PATH)
    found, at = packing._tokens(pa.array(texts), ids, 0)
    assert [found[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tokens(t) for t in texts]
    assert set(ids.new) == {p.encode() for p in [*stems, "strasse", ".", "...", "$$$", ",-", "!?", *"127"]}


def test_parts_beside_odd_characters():
    draw = random.Random(8)
    some = [*"azAZ09'<.,!-_$|\x0b\x00\x7f", "é", "É", "ß", "×", "÷", "²", "µ", "Ÿ", "ÿ", "ẞ", "̀", "̌", "J", "中", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'RE", " ", "\n"]
    texts = ["".join(draw.choices(some, k=draw.randint(1, 12))) for _ in range(3000)]
    for limit in (16, 1 << 20):
        real = packing.blocks
        try:
            packing.blocks = lambda *a, **k: real(*a, **(k | {"limit": limit}))
            ids, at = packing._tokens(pa.array(texts), packing._Ids(PATH), 0)
        finally:
            packing.blocks = real
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tokens(t) for t in texts]


@pytest.mark.parametrize("added", [False, True])
def test_vocabulary_that_does_not_keep_parts_apart(tmp_path, added):
    with open(PATH) as f:
        rules = json.load(f)
    if added:
        rules["added_tokens"][0]["content"] = "Word"
    else:
        rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+"
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rules))
    ids = packing._Ids(str(path))
    assert not ids.plain
    texts = ["Ab12, c.d", "déjà-vu", "word Word"]
    got, at = packing._tokens(pa.array(texts), ids, 0)
    want = [[*packing._tokenizer(str(path)).encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
