import random

import public_tokenizers as files
from tokenizers import Tokenizer

from quarry.llm import token_counts as tc

JSON, RANKS = files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken")


def truth(texts):
    t = Tokenizer.from_file(JSON)
    return [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_same_as_library_on_awkward_texts():
    r = random.Random(5)
    pools = ["abc '’sst\n\t  \r", "éüß ñç¡¿\xa0\x85\u00ad", "日本語 🙂\u200d한글 ١٢", "<|endoftext|> x", "0123456789 .,;!?-_'"]
    texts = ["", " ", "  a", "a  b ", "it's we'll I'D", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "\x00\x1c\x1f\x0b\x0c", "a\u2003b", "ǅ Ⅷ ½"]
    texts += ["".join(r.choice(r.choice(pools)) for _ in range(r.randrange(200))) for _ in range(300)]
    assert tc.counts(texts, JSON, RANKS, files.PATTERN) == truth(texts)
    assert tc.counts(texts, JSON) == truth(texts)


def test_pieces_add_up():
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdeé'.,1 ") for _ in range(r.randrange(1, 9))) for _ in range(9000))
    assert "".join(tc.pieces(text, 500)) == text
    assert tc.counts([text], JSON, RANKS, files.PATTERN, piece=500) == truth([text])
    solid = "x1" * 4000
    assert list(tc.pieces(solid, 100)) == [solid]


def test_whole_table_against_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in tc.count_tokens(docs, JSON, ranks=RANKS, pattern=files.PATTERN).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {k: v.n_tokens for k, v in rows.items()} == dict(zip(texts, truth(list(texts.values())), strict=True))
    assert all(rows[k].n_bytes == len(t.encode()) for k, t in texts.items())


def test_nulls_repeats_empty(spark):
    schema = "doc_id long, text string, n_tokens string"
    df = spark.createDataFrame([(1, None, "clash"), (None, "a b", None), (2, "", "x"), (2, "", "x")], schema)
    out = tc.count_tokens(df, JSON)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out.collect()) == [(False, 1, 0, 0), (False, 2, 0, 0), (False, 2, 0, 0), (True, 0, 3, 2)]
    assert tc.count_tokens(df.limit(0), JSON).count() == 0
