import random
from datetime import datetime
from functools import partial

import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions import bpe, text as tx
from quarry.operators import chunking, embedding, ingest
from quarry.sources import tables

def now():
    return F.lit("2024-01-01").cast("timestamp")


def values(df):
    return [tuple(r) for r in df.collect()]


def test_suffixes(spark):
    cases = {"d/a.txt": ".txt", "A.PDF": ".pdf", ".txt": "", "a.": "", "..txt": ".txt", "y.tar.gz": ".gz", "x.d/y": "", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert dict(values(df.select("n", tx.suffix(F.col("n"))))) == cases


def test_bytes_to_text(spark):
    rows = [(b"\xc3\xa9",), (b"\xe9",), (b"a\r\nb\rc\n",), (b"",), (None,)]
    df = spark.createDataFrame(rows, "c binary").select(tx.decode_bytes(F.col("c")).alias("t"))
    assert [r.t for r in df.collect()] == ["é", "é", "a\nb\nc\n", "", None]


def test_embedding_text(spark):
    df = spark.createDataFrame([([1.0, 2.5],)], "v array<float>").select(tx.embedding_to_text(F.col("v")).alias("t"))
    assert df.first().t == "[1.0, 2.5]"
    assert list(spark.createDataFrame([("[1,2.5]",)], "t string").select(tx.embedding_from_text(F.col("t")).alias("v")).first().v) == [1.0, 2.5]


def reference_chunks(tokens, size, overlap):
    out, start = [], 0
    while start < len(tokens):
        end = min(start + size, len(tokens))
        out.append(tokens[start:end])
        if end == len(tokens):
            break
        start = end - overlap
    return out


@pytest.mark.parametrize(("size", "overlap"), [(800, 200), (7, 3), (5, 0), (2, 1)])
def test_chunks_as_the_loop(spark, size, overlap):
    counts = [0, 1, size - 1, size, size + 1, 2 * size - overlap, 2 * size - overlap + 1, 5 * size]
    texts = {i: " ".join(f"w{j}" for j in range(n)) for i, n in enumerate(counts)} | {90: "  lead\n\ttail  \n", 91: " \n", 92: None}
    df = chunking.chunk(spark.createDataFrame(list(texts.items()), "id int, text string"), max_tokens=size, overlap=overlap)
    toks = dict(values(spark.createDataFrame(list(texts.items()), "id int, text string").select("id", tx.tokens(F.col("text")))))
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, r.chunk_index)):
        got.setdefault(r.id, []).append((r.text, r.n_tokens))
    for i, t in texts.items():
        assert "".join(toks[i]) == (t or "")  # lossless
        assert got.get(i, []) == [("".join(c), len(c)) for c in reference_chunks(toks[i], size, overlap)]


def test_byte_pair_chunks_as_the_loop(spark):
    files = pytest.importorskip("public_tokenizers")
    ranks, pattern = files.path("byte_bpe_50k.tiktoken"), files.PATTERN
    enc = bpe.encoding(ranks, pattern)
    texts = {1: "Hello world, " * 9, 2: "日本語のテキスト🙂 " * 6, 3: "", 4: None, 5: "x", 6: "<|endoftext|> is text\n\n\ttabs"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    for size, overlap in ((7, 3), (5, 0), (800, 200)):
        got = {}
        for r in sorted(chunking.chunk_bytes(df, partial(bpe.token_ends, ranks=ranks, pattern=pattern), max_tokens=size, overlap=overlap).collect(), key=lambda r: (r.id, r.chunk_index)):
            got.setdefault(r.id, []).append((r.text, r.n_tokens))
        for i, t in texts.items():
            assert got.get(i, []) == [(enc.decode(c), len(c)) for c in reference_chunks(enc.encode_ordinary(t or ""), size, overlap)]


def test_chunk_totals(spark):
    df = spark.createDataFrame([(n, "w " * n) for n in (0, 1, 7, 8, 11, 12, 100)], "n int, text string")
    want = {r.n: (r.c, r.t) for r in chunking.chunk(df, max_tokens=7, overlap=3).groupBy("n").agg(F.count("*").alias("c"), F.sum("n_tokens").alias("t")).collect()}
    got = {r.n: (r.n_chunks, r.chunk_tokens) for r in chunking.chunk_totals(df, tx.token_count(F.col("text")), max_tokens=7, overlap=3).collect()}
    assert got == {0: (0, 0)} | want


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        chunking.chunk(spark.createDataFrame([], "id int, text string"), max_tokens=5, overlap=5)


def test_packing():
    assert chunking.pack_counts([5, 30, 4, 4], 10) == [(0, 1, 0, 9), (1, 1, 1, 9), (2, 1, 2, 9), (3, 1, 3, 3), (4, 0, 0, 5), (4, 2, 0, 4), (5, 3, 0, 4)]
    r = random.Random(0)
    for _ in range(200):
        counts, limit = [r.randrange(0, 30) for _ in range(r.randrange(12))], r.randrange(2, 20)
        out = chunking.pack_counts(counts, limit)
        sums, seen = {}, {}
        for b, i, _, n in out:
            sums[b] = sums.get(b, 0) + n
            seen[i] = seen.get(i, 0) + n
        assert all(v <= limit for v in sums.values()) and seen == dict(enumerate(counts))


def test_batches_do_not_depend_on_partitions(spark):
    rows = [(d, i, (d * 7 + i * 13) % 25) for d in range(20) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id int, chunk_index int, n_tokens int")
    one, eight = (sorted(values(chunking.token_batches(df.repartition(n), limit=20))) for n in (1, 8))
    assert one == eight and {(r[0], r[2]) for r in one} == {(d, i) for d, i, _ in rows}


def test_embed_checks_width(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "text string")
    rows = embedding.embed(df, width=16).collect()
    assert [len(r.embedding) for r in rows] == [16] * 3 and sum(x * x for x in rows[0].embedding) == pytest.approx(1)
    with pytest.raises(Exception, match="embedder gave"):
        embedding.embed(df, lambda: lambda texts: [[0.0]] * len(texts), width=16).collect()


def picky():
    """A function made here, so that workers need not import this module."""

    def make():
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no " + next(t for t in texts if "bad" in t))
            return [[1.0, 0.0]] * len(texts)

        return model

    return make


def test_groups_stay_within_the_budget(spark):
    assert embedding.token_groups([], 10, 3) == [] and embedding.token_groups([4, 4, 4, 99, 1, 1, 1, 1], 10, 3) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)]
    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(sum(len(t.split()) for t in texts) > 10)
        return [[0.0]] * len(texts)

    df = spark.createDataFrame([("a b c " * (i % 3 + 1),) for i in range(40)], "text string").coalesce(1)
    assert embedding.embed(df, lambda: model, width=1, budget=10).count() == 40 and seen.value == 0


def test_a_fault_stays_with_its_text(spark):
    df = spark.createDataFrame([("a",), ("bad 1",), ("b",), ("bad 2",)], "text string").coalesce(1)
    rows = embedding.embed(df, picky(), width=2, errors=True).collect()
    assert [(r.text, r.embedding, r.error) for r in rows] == [("a", [1.0, 0.0], None), ("bad 1", None, "RuntimeError: no bad 1"), ("b", [1.0, 0.0], None), ("bad 2", None, "RuntimeError: no bad 2")]
    with pytest.raises(Exception, match="no bad 1"):
        embedding.embed(df, picky(), width=2).collect()


def test_event_checks(spark):
    ok = '{"bucket":"b","name":"n","generation":%s}'
    cases = {
        ok % "5": ("accepted", None), '{"data":%s}' % (ok % '"0"'): ("accepted", None), ok % "0": ("rejected", "missing generation"), ok % '"x"': ("rejected", "generation is not an integer"), ok % '"1_0"': ("rejected", "generation is not an integer"),
        "[1]": ("rejected", "not an object"), "nope": ("rejected", "not an object"), '{"data":7}': ("rejected", "not an object"), '{"name":"n","generation":1}': ("rejected", "missing bucket"), '{"bucket":"b","name":"","generation":1}': ("rejected", "missing name"),
        '{"bucket":"b","name":"n","generation":"5","x":{"generation":0}}': ("accepted", None), '{"x":1,"data":null,"bucket":"b","name":"n","generation":1}': ("rejected", "not an object"), ok % "0.0": ("rejected", "missing generation"), ok % "false": ("rejected", "missing generation"), ok % "null": ("rejected", "missing generation"),
        '{"bucket":"c","name":"n","generation":1}': ("ignored", "other bucket"), '{"bucket":"b","name":"n"}': ("rejected", "missing generation"),
    }
    df = ingest.check_events(spark.createDataFrame([(k,) for k in cases], "value string"), "b")
    assert {r.value: (r.outcome, r.reason) for r in df.collect()} == cases


def objects(spark, rows):
    return spark.createDataFrame(rows, "path string, generation long, metadata map<string,string>, text string, pages array<struct<page:int,header:string,body:string>>, failure string")


def test_batch_ingest_and_rerun(spark):
    pages = [(1, None, "a"), (2, None, ""), (3, None, None), (4, None, "b")]
    objs = objects(spark, [
        ("g/a.txt", 1, {"originalfilename": "My file"}, "one two", None, None), ("g/b.pdf", 1, {}, None, pages, None), ("g/c.bin", 1, {"originalfilename": ""}, None, None, None), ("g/none", 1, {}, "x", None, None),
        ("g/e.txt", 1, {}, "", None, None), ("g/f.pdf", 1, {}, None, None, "ValueError: bad"), ("g/a.txt", 1, {"originalfilename": "My file"}, "one two", None, None), ("g/old.txt", 1, {}, "new", None, None), ("g/old.txt", 2, {}, "new", None, None),
    ])
    known = spark.createDataFrame([("k", "old.txt", "g/old.txt", None, 1, datetime(2024, 1, 1), "Failed", "x")], schemas.REGISTRY)
    reg, chunks, results = ingest.run_batch(objs, known, spark.createDataFrame([], schemas.CHUNKS), now(), max_tokens=5, overlap=1)
    got = {(r.original_path, r.generation): (r.filename, r.status, r.error_message) for r in reg.collect()}
    assert got == {
        ("g/a.txt", 1): ("My file", "Ready", None), ("g/b.pdf", 1): ("b.pdf", "Ready", None), ("g/c.bin", 1): ("c.bin", "Failed", "ValueError: Unsupported file type: .bin"), ("g/e.txt", 1): ("e.txt", "Ready", None),
        ("g/f.pdf", 1): ("f.pdf", "Failed", "ValueError: bad"), ("g/old.txt", 1): ("old.txt", "Failed", "x"), ("g/old.txt", 2): ("old.txt", "Ready", None),
    }
    assert sorted(r.text for r in chunks.collect()) == ["a b", "new", "one two"]
    vectors = {r.text: list(r.embedding) for r in chunks.collect()}
    assert vectors == {t: v.tolist() for t, v in zip(vectors, embedding.hashing_embedder(list(vectors)), strict=True)}
    assert tuple(ingest.summary(results, chunks).first()) == (4, 2, 3)
    again = ingest.run_batch(objs, reg, chunks, now(), max_tokens=5, overlap=1)
    assert sorted(map(str, again[0].collect())) == sorted(map(str, reg.collect())) and sorted(map(str, again[1].collect())) == sorted(map(str, chunks.collect()))


def test_embedding_faults_fail_their_document_only(spark):
    objs = objects(spark, [("g/a.txt", 1, {}, "fine text here", None, None), ("g/b.txt", 1, {}, "one two bad three", None, None), ("g/c.bin", 1, {}, None, None, None)])
    old = spark.createDataFrame([], schemas.REGISTRY), spark.createDataFrame([], schemas.CHUNKS)
    reg, chunks, results = ingest.run_batch(objs, *old, now(), max_tokens=2, overlap=0, embedder=picky(), width=2)
    assert sorted((r.original_path, r.status, r.error_message) for r in reg.collect()) == [("g/a.txt", "Ready", None), ("g/b.txt", "Failed", "RuntimeError: no  bad three"), ("g/c.bin", "Failed", "ValueError: Unsupported file type: .bin")]
    assert sorted(r.text for r in chunks.collect()) == [" here", "fine text"] and tuple(ingest.summary(results, chunks).first()) == (1, 2, 2)


def test_messages_again_change_nothing(spark):
    kind = "task_id string, title string, content string, ts timestamp"
    old = spark.createDataFrame([], schemas.REGISTRY), spark.createDataFrame([], schemas.CHUNKS)
    m = spark.createDataFrame([("1", None, "some text", None), ("2", "T", "", None), ("3", "B", "a bad one", None)], kind)
    reg, chunks = ingest.run_messages(m, *old, embedder=picky(), width=2)
    assert sorted((r.original_path, r.status, r.error_message) for r in reg.collect()) == [("text://1", "Ready", None), ("text://2", "Failed", "No content provided"), ("text://3", "Failed", "RuntimeError: no a bad one")]
    more = spark.createDataFrame([("1", None, "other", None), ("2", "T", "now with text", None), ("4", None, "x", None)], kind)
    reg2, chunks2 = ingest.run_messages(more, reg, chunks, embedder=picky(), width=2)
    assert {r.original_path: r.status for r in reg2.collect()} == {"text://1": "Ready", "text://2": "Failed", "text://3": "Failed", "text://4": "Ready"}
    assert sorted(r.text for r in chunks2.collect()) == ["some text", "x"]


def test_failures_touch_registered_rows_only(spark):
    reg = spark.createDataFrame([("1", "f", "p", None, 1, None, "Processing", None)], schemas.REGISTRY)
    out = ingest.apply_results(reg, spark.createDataFrame([("1", "Failed", "E: m", None), ("2", "Failed", "E: n", None)], "id string, status string, error_message string, processed_path string"))
    assert [(r.id, r.status, r.error_message) for r in out.collect()] == [("1", "Failed", "E: m")]


def test_messages(spark):
    m = spark.createDataFrame([("1", None, "some text", None), ("2", "T", "", None), ("3", "", None, None), ("1", None, "some text", None)], "task_id string, title string, content string, ts timestamp")
    rows, chunks = ingest.process_messages(m)
    assert sorted((r.original_path, r.filename, r.status, r.error_message) for r in rows.collect()) == [("text://1", "Untitled", "Ready", None), ("text://2", "T", "Failed", "No content provided"), ("text://3", "Untitled", "Failed", "No content provided")]
    assert chunks.count() == 1


def test_delete_with_ownership(spark):
    docs = spark.createDataFrame([("a", "u"), ("b", "v")], "id string, user_id string")
    kids = spark.createDataFrame([("a",), ("a",), ("b",)], "doc_id string")
    out, left, children = ingest.delete_owned(docs, spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "u")], "target_id string, user_id string"), kids)
    assert sorted((r.target_id, r.outcome) for r in out.collect()) == [("a", 200), ("b", 403), ("c", 404)]
    assert values(left) == [("b", "v")] and values(children) == [("b",)]


def test_page_answers(spark):
    b = spark.createDataFrame([("d", 5, '```json\n[{"page": 2, "body": "y"}, {"body": "n"}]\n```'), ("d", 0, '[{"page":1,"header":"h","body":"x"}]'), ("e", 0, '{"page":1}'), ("f", 0, "[]")], "doc_id string, start_page int, raw_json string")
    got = {r.doc_id: (r.failed, [(p.page, p.body) for p in r.pages]) for r in ingest.renumber_pages(b).collect()}
    assert got == {"d": (False, [(1, "x"), (7, "y"), (None, "n")]), "e": (True, []), "f": (False, [])}


def test_objects_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"caf\xe9\r\nx")
    (tmp_path / "in/a.txt#2").write_bytes("second é".encode())
    (tmp_path / "in/empty.txt").write_bytes(b"")
    (tmp_path / "in/long.txt").write_bytes(bytes(range(97, 123)) * 5)
    (tmp_path / "in/never.txt").write_bytes(b"not asked for")
    (tmp_path / "in/never.txt").chmod(0)
    names = [("in/a.txt", 1), ("in/a.txt", 2), ("in/gone.txt", 1), ("in/empty.txt", 1), ("in/long.txt", 1), ("in", 1)]
    manifest = spark.createDataFrame([(p, g, {"k": f"{p}{g}"}) for p, g in names], "path string, generation long, metadata map<string,string>").repartition(3)
    for piece in (7, 26, 8 << 20):
        found, rejected = tables.read_objects(spark, str(tmp_path), manifest, piece_bytes=piece)
        got = {(r.path, r.generation): (r.text, r.length, r.metadata["k"]) for r in tables.with_text(found).collect()}
        assert got == {("in/a.txt", 1): ("café\nx", 7, "in/a.txt1"), ("in/a.txt", 2): ("second é", 9, "in/a.txt2"), ("in/empty.txt", 1): ("", 0, "in/empty.txt1"), ("in/long.txt", 1): (bytes(range(97, 123)).decode() * 5, 130, "in/long.txt1")}
        assert sorted((r.path, r.reason) for r in rejected.collect()) == [("in", "object not found"), ("in/gone.txt", "object not found")]
    sizes = [len(r.content) for r in tables.read_pieces(str(tmp_path), tables.find_objects(str(tmp_path), manifest).where("path = 'in/long.txt'"), 50).orderBy("piece").collect()]
    assert sizes == [50, 50, 30]


def test_page_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [(1, "h", "é")]), ("b", [])], "doc_id string, pages array<struct<page:int,header:string,body:string>>")
    tables.write_page_json(df, str(tmp_path / "p"))
    assert sorted(map(str, tables.read_page_json(spark, str(tmp_path / "p")).collect())) == sorted(map(str, df.collect()))
    assert "é" in "".join(p.read_text() for p in (tmp_path / "p").glob("*.json"))


def test_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(f"d{i}", 0, "old", None) for i in range(50)], schemas.CHUNKS)
    tables.overwrite_touched(df, path, 8)
    tables.overwrite_touched(df.where("doc_id in ('d1')").withColumn("text", F.lit("new")).unionByName(df.where(tables.touched_bucket(F.col("doc_id"), 8) == tables.touched_bucket(F.lit("d1"), 8)).where("doc_id <> 'd1'")), path, 8)
    back = spark.read.parquet(path)
    assert back.count() == 50 and back.where("text = 'new'").count() == 1
