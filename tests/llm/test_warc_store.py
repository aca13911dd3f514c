import gzip
import hashlib

import pyarrow.fs as pafs

from quarry.llm import warc_store as ws
from quarry.scratch import scratch_path

SCHEMA = "page_id long, url string, html string"


def brute(pages):
    body = {}
    out = []
    for p, _, h, *_ in pages:
        data = (h or "").encode()
        if len(data) >= 100 and p is not None:
            body[data] = min(body.get(data, p), p)
    for p, _, h, *_ in pages:
        data = (h or "").encode()
        first = body.get(data)
        again = first is not None and p is not None and first < p
        out.append((p if p is not None else -1, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert got(ws.round_trip(df)) == brute([tuple(r) for r in df.select("page_id", "url", "html").collect()])


def test_edges(spark):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5
    rows = [(1, "u", None), (2, None, ""), (3, "a\r\nb é", tricky), (4, "u", tricky), (9, "x", "é" * 60), (8, "x", "é" * 60), (5, "u", "small"), (6, "u", "small"), (None, "n", tricky), (7, "u", tricky), (7, "u", tricky), (10, "long", "0123456789é" * 70000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", offset int, data string")
    assert got(ws.round_trip(df, chunk_bytes=1000)) == brute(rows)
    assert ws.round_trip(df.limit(0)).count() == 0


def test_chunk_table_and_files(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i * 50)) for i in range(6)] + [(9, "http://h/9", "<p>3</p>" * 150)]
    path = scratch_path(spark, "t")
    manifest = ws.write_archives(ws.chunk_rows(ws.plan_records(spark.createDataFrame(rows, SCHEMA)), 64), path)
    table = ws.read_chunks(manifest, chunk_bytes=64).orderBy("page_id", "chunk_no").collect()
    whole = {p: h.encode() for p, _, h in rows}
    for page in whole:
        own = [r for r in table if r.page_id == page]
        if own[0].record_type == "revisit":
            assert (page, own[0].refers_to, own[0].header_bytes) == (9, 3, len(whole[9]))
            continue
        assert b"".join(r.data for r in own) == whole[page]
        assert [r.chunk_no for r in own] == list(range(len(own))) and all(len(r.data) <= 64 for r in own)
        for r in own:  # digests are carried from chunk to chunk
            assert r.digest_so_far == hashlib.sha256(whole[page][: r.bytes_so_far]).hexdigest()
        assert [r.last for r in own] == [False] * (len(own) - 1) + [True]
    fs, base = pafs.FileSystem.from_uri(path)
    raw = b"".join(gzip.decompress(fs.open_input_file(f.path).read()) for f in fs.get_file_info(pafs.FileSelector(base)))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
