"""Queries over ``documents``: chunks, events, ingest, and the knowledge-base list."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry import schemas
from quarry.functions import bpe, text as tx
from quarry.operators import chunking, embedding, ingest, library_view
from quarry.operators.ingest import latest
from quarry.scratch import scratch_path
from quarry.sources import tables
from quarry.streaming import ingest as stream

TOK = r"'[ \t\n\r\f]*[^ \t\n\r\f]+|[ \t\n\r\f]+$'"
EPOCH = "timestamp '2024-01-01 00:00:00'"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def c2_chunk_summary(spark, sf_dir):
    c = chunking.chunk_totals(docs(spark, sf_dir).select("doc_id", "text"), tx.token_count(F.col("text")))
    return c.where("n_chunks > 0").groupBy("doc_id").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("chunk_tokens").alias("chunk_tokens"))


def _chunks_sql(size: int, step: int) -> str:
    return f"""
t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {TOK}) AS k FROM documents),
c AS (SELECT doc_id, k, len(k) AS n, CASE WHEN len(k) = 0 THEN 0 WHEN len(k) <= {size} THEN 1 ELSE 1 + CAST(ceil((len(k) - {size}) / {step}.0) AS INT) END AS m FROM t),
e AS (SELECT doc_id, k, n, unnest(range(m)) AS i FROM c WHERE m > 0),
chunks AS (SELECT doc_id, CAST(i AS INT) AS chunk_index, array_to_string(k[i * {step} + 1 : i * {step} + {size}], '') AS text, CAST(least({size}, n - i * {step}) AS INT) AS n_tokens FROM e)
"""


_CHUNKS_SQL = _chunks_sql(800, 600)


def c2_chunks(spark, sf_dir):
    return chunking.chunk(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "chunk_index", "n_tokens", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


def c3_token_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.token_count(F.col("text")).alias("n_tokens"))


def _byte_pairs():
    """Token ends under a public vocabulary on this machine."""
    import public_tokenizers as files

    return partial(bpe.token_ends, ranks=files.path("byte_bpe_50k.tiktoken"), pattern=files.PATTERN)


def _byte_pair_chunks(spark, sf_dir, **sizes):
    return chunking.chunk_bytes(docs(spark, sf_dir).select("doc_id", "text"), _byte_pairs(), **sizes)


def c2_chunks_byte_pairs(spark, sf_dir):
    return _byte_pair_chunks(spark, sf_dir).select("doc_id", "chunk_index", "n_tokens", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


def c3_token_count_byte_pairs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(_byte_pairs()(F.col("text"))).alias("n_tokens"))


def c4_token_batches_byte_pairs(spark, sf_dir):
    return chunking.token_batches(_byte_pair_chunks(spark, sf_dir))


def _lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "body"))


def c1_pages_to_text(spark, sf_dir):
    return chunking.page_rows_to_text(_lines(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


def p5_p6_page_json(spark, sf_dir):
    """Lines as pages in JSON answers of five pages each; every seventh answer is no JSON."""
    page = F.struct((F.col("pos") % 5 + 1).alias("page"), F.lit("h").alias("header"), "body")
    b = _lines(spark, sf_dir).groupBy("doc_id", (F.floor(F.col("pos") / 5) * 5).cast("int").alias("start_page")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", page.alias("p")))), lambda x: x.p)).alias("j"))
    raw = F.when((F.col("doc_id") % 7 == 3) & (F.col("start_page") == 0), F.lit("Sorry, no pages")).otherwise(F.concat(F.lit("```json\n"), "j", F.lit("\n```")))
    r = ingest.renumber_pages(b.select("doc_id", "start_page", raw.alias("raw_json")))
    return r.select("doc_id", "failed", F.size("pages").alias("n_pages"), F.aggregate("pages", F.lit(0).cast("long"), lambda s, p: s + p.page).alias("page_sum"), F.md5(chunking.pages_to_text(F.col("pages"))).alias("text_md5"))


def c4_token_batches(spark, sf_dir):
    c = chunking.chunk(docs(spark, sf_dir).select("doc_id", "text"), max_tokens=400, overlap=100)
    return chunking.token_batches(c, limit=300)


def c5_embed(spark, sf_dir):
    """The numbers of all vectors that are not zero."""
    e = embedding.embed(chunking.chunk(docs(spark, sf_dir).select("doc_id", "text")))
    return e.select("doc_id", "chunk_index", F.posexplode("embedding").alias("i", "v")).where("v <> 0").select("doc_id", "chunk_index", "i", F.col("v").cast("double").alias("v"))


SUFFIXES = "element_at(array('.txt', '.pdf', '.DOCX', '.bin', ''), cast(doc_id % 5 + 1 as int))"


def objects(spark, sf_dir) -> DataFrame:
    """Raw objects that documents stand in for: ``path, name, generation, metadata, text, pages, failure``."""
    d = docs(spark, sf_dir)
    name = F.concat(F.lit("uploads/"), "doc_id", F.lit("-"), F.coalesce("source", F.lit("none")), F.expr(SUFFIXES))
    d = d.select("doc_id", name.alias("name"), (F.col("doc_id") % 3).cast("long").alias("generation"), "text", F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("originalfilename"), F.concat(F.lit("Original "), "doc_id"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("page"), F.lit(None).cast("string").alias("header"), x.alias("body")))
    kind = ingest.route(tx.suffix(F.col("name")))
    return d.select("doc_id", F.concat(F.lit("gs://raw/"), "name").alias("path"), "name", "generation", "metadata", F.when(kind == "text", F.coalesce("text", F.lit(""))).alias("text"), F.when(kind == "pages", lines).alias("pages"), F.lit(None).cast("string").alias("failure"))


def registry(spark, sf_dir) -> DataFrame:
    """Every fourth object is known already, in any status."""
    o = objects(spark, sf_dir).where("doc_id % 4 = 0")
    return o.select(
        ingest.document_id(F.col("path"), F.col("generation")).alias("id"), tx.display_name(F.col("path"), F.col("metadata")).alias("filename"), F.col("path").alias("original_path"), F.lit(None).cast("string").alias("processed_path"),
        "generation", F.expr(EPOCH).alias("created_at"), F.expr("element_at(array('Ready', 'Failed', 'Processing'), cast(doc_id / 4 % 3 + 1 as int))").alias("status"), F.lit(None).cast("string").alias("error_message"),
    )


_OBJECTS_SQL = """
n AS (SELECT doc_id, text, 'uploads/' || doc_id || '-' || coalesce(source, 'none') || (['.txt', '.pdf', '.DOCX', '.bin', ''])[doc_id % 5 + 1] AS name, doc_id % 3 AS generation FROM documents),
o AS (SELECT doc_id, text, 'gs://raw/' || name AS path, name, generation, lower((['.txt', '.pdf', '.DOCX', '.bin', ''])[doc_id % 5 + 1]) AS suffix,
      CASE WHEN doc_id % 2 = 0 THEN 'Original ' || doc_id ELSE split_part(name, '/', -1) END AS filename FROM n)
"""


def p1_storage_events(spark, sf_dir):
    o = objects(spark, sf_dir)
    e = F.to_json(F.struct(F.when(F.col("doc_id") % 11 == 0, "other").otherwise("raw").alias("bucket"), F.when(F.col("doc_id") % 13 != 0, F.col("name")).alias("name"), F.when(F.col("doc_id") % 17 == 0, "x1").otherwise(F.col("generation").cast("string")).alias("generation")))
    nested, null_data = F.concat(F.substring(e, F.lit(1), F.length(e) - 1), F.lit(',"x":{"generation":0}}')), F.concat(F.lit('{"x":1,"data":null,'), F.substring(e, F.lit(2), F.length(e)))
    value = F.when(F.col("doc_id") % 19 == 0, F.lit("[1]")).when(F.col("doc_id") % 29 == 0, null_data).when(F.col("doc_id") % 23 == 0, nested).when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"data":'), e, F.lit("}"))).otherwise(e)
    return ingest.check_events(o.select("doc_id", value.alias("value")), "raw").groupBy("outcome", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def p2_p3_p4_routes(spark, sf_dir):
    o = objects(spark, sf_dir)
    s = tx.suffix(F.col("path"))
    return o.select("doc_id", s.alias("suffix"), ingest.route(s).alias("route"), tx.display_name(F.col("path"), F.col("metadata")).alias("filename"))


def j1_known_versions(spark, sf_dir):
    o = objects(spark, sf_dir)
    new, known = ingest.split_known(o.unionByName(o).drop("metadata", "pages"), registry(spark, sf_dir))
    return new.select("doc_id", F.lit("new").alias("reason")).unionByName(known.select("doc_id", "reason"))


def j2_register(spark, sf_dir):
    new = objects(spark, sf_dir)
    return ingest.register(new, F.expr(EPOCH)).select("id", "filename", "original_path", "generation", "status")


def _ingested(spark, sf_dir):
    empty = spark.createDataFrame([], schemas.CHUNKS)
    return ingest.run_batch(objects(spark, sf_dir).drop("doc_id"), registry(spark, sf_dir), empty, F.expr(EPOCH))


def c6_ingest_registry(spark, sf_dir):
    rows, _, _ = _ingested(spark, sf_dir)
    return rows.select("original_path", "generation", "filename", "status", F.coalesce("error_message", F.lit("")).alias("error_message"), F.col("processed_path").isNotNull().alias("has_pages"))


#: Places of a vector's numbers that are not zero, with their signs, added up: checks the whole vector in one exact number.
PLACES = "aggregate(embedding, named_struct('i', 0L, 's', 0L), (a, v) -> named_struct('i', a.i + 1, 's', a.s + (a.i + 1) * cast(signum(v) as bigint)), a -> a.s)"


def j3_ingest_chunks(spark, sf_dir):
    _, chunks, _ = _ingested(spark, sf_dir)
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.expr(PLACES)).alias("places"))


def _picky():
    """An embedder that refuses texts with a word of ten letters or more."""

    def model(texts: list[str]):
        for t in texts:
            if long := re.search("[A-Za-z]{10}", t):
                raise ValueError(f"cannot embed a word of {len(long[0])} letters")
        return embedding.hashing_embedder(texts)

    return model


def j4_failures(spark, sf_dir):
    """What failed, and how many chunks came of the documents that did not, with an embedder that raises on some texts."""
    empty = spark.createDataFrame([], schemas.CHUNKS)
    known = registry(spark, sf_dir)
    rows, chunks, _ = ingest.run_batch(objects(spark, sf_dir).drop("doc_id"), known, empty, F.expr(EPOCH), embedder=_picky)
    failed = rows.where("error_message is not null").groupBy("error_message").agg(F.count("*").alias("n"))
    return failed.unionByName(chunks.agg(F.lit("chunks").alias("error_message"), F.count("*").alias("n")))


def a1_ingest_summary(spark, sf_dir):
    _, chunks, results = _ingested(spark, sf_dir)
    return ingest.summary(results, chunks)


def c7_text_messages(spark, sf_dir):
    d = docs(spark, sf_dir)
    m = d.select(F.concat(F.lit("t"), "doc_id").alias("task_id"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Title "), "doc_id")).alias("title"), F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("content"), F.expr(EPOCH).alias("ts"))
    empty = spark.createDataFrame([], schemas.REGISTRY), spark.createDataFrame([], schemas.CHUNKS)
    once = ingest.run_messages(m.unionByName(m), *empty)
    rows, chunks = ingest.run_messages(m, *once)  # redelivered: nothing changes
    n = chunks.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_chunks"), F.sum(F.expr(PLACES)).alias("places"))
    return rows.join(n, "id", "left").select("original_path", F.coalesce("places", F.lit(0)).cast("long").alias("places"), "filename", "status", F.coalesce("error_message", F.lit("")).alias("error_message"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))


def s2_decode_bytes(spark, sf_dir):
    """Texts stored as UTF-8, or as Latin-1 for odd documents whose characters allow it, read back."""
    latin = (F.col("doc_id") % 2 == 1) & F.col("text").rlike(r"(?s)^[\x00-\xFF]*$")
    raw = docs(spark, sf_dir).select("doc_id", F.when(latin, F.encode(F.when(latin, F.col("text")), "ISO-8859-1")).otherwise(F.col("text").cast("binary")).alias("content"))
    return raw.select("doc_id", F.md5(tx.decode_bytes(F.col("content"))).alias("text_md5"))


def s1_raw_objects(spark, sf_dir):
    """Texts stored as files, read back by a manifest with one file too many: how often each line occurs, and what is rejected."""
    root = scratch_path(spark, "objects")
    docs(spark, sf_dir).where("text is not null").select(F.coalesce("source", F.lit("none")).alias("source"), "text").write.option("maxRecordsPerFile", 1000).partitionBy("source").text(root)
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", root.rsplit("/", 1)[1] + "/(.*)$", 1).alias("path"))
    manifest = names.unionByName(spark.range(1).select(F.lit("gone.txt").alias("path"))).withColumns({"generation": F.lit(1).cast("long"), "metadata": F.create_map().cast("map<string,string>")})
    found, rejected = tables.read_objects(spark, root, manifest)
    lines = tables.with_text(found).select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy(F.md5("line").alias("line")).agg(F.count("*").alias("n")).unionByName(rejected.groupBy(F.col("reason").alias("line")).agg(F.count("*").alias("n")))


def s3_page_json(spark, sf_dir):
    """Lines as pages, written as JSON and read back."""
    page = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("page"), F.lit("h").alias("header"), x.alias("body")))
    path = scratch_path(spark, "page-json")
    tables.write_page_json(docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), page.alias("pages")), path)
    return tables.read_page_json(spark, path).select("doc_id", F.size("pages").alias("n_pages"), F.md5(F.array_join(F.transform("pages", lambda p: F.concat_ws("|", p.page, p.header, p.body)), "\n")).alias("pages_md5"))


def t7_streaming_ingest(spark, sf_dir):
    """Events for all objects in two runs of a stream: the registry, its chunks, and what was rejected.

    Each event comes twice, after one of the same name and generation in another
    bucket and one with the number 0. Every fourth comes in the second run only,
    years late by its time, with all others once more; every tenth has an event
    beside it whose object is gone.
    """
    objs, root = objects(spark, sf_dir), scratch_path(spark, "stream")

    def event(bucket, name, generation):  # as JSON; the number 0 is no generation, the text is one
        return F.to_json(F.struct(F.lit(bucket).alias("bucket"), name.alias("name"), generation.alias("generation")))

    own = event("raw", F.col("name"), F.col("generation").cast("string"))
    foreign, number = event("other", F.col("name"), F.col("generation").cast("string")), event("raw", F.col("name"), F.lit(0))
    gone = F.when(F.col("doc_id") % 10 == 0, event("raw", F.concat(F.lit("gone/"), "name"), F.col("generation") + 1))
    late = F.col("doc_id") % 4 == 3
    for part, rows in enumerate((F.when(late, F.array(foreign, number, gone)).otherwise(F.array(foreign, number, own, own, gone)), F.array(own, own, gone))):
        values = objs.select(F.explode(rows).alias("value"), F.when(late, F.lit("2019-01-01")).otherwise(F.lit("2024-01-01")).cast("timestamp").alias("ts"))
        values.where("value is not null").write.mode("append").parquet(f"{root}/events/part={part}")
        events = spark.readStream.schema("value string, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{root}/events")
        stream.ingest_stream(events, objs.drop("doc_id", "path"), f"{root}/out", "raw", buckets=8, merge_after=1).awaitTermination()
    made = stream.Tables.at(spark, f"{root}/out", buckets=8)
    n = made.chunks.read().groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_chunks"), F.sum(F.expr(PLACES)).alias("places"))
    rows = made.registry.read().join(n, "id", "left").select("original_path", "generation", "filename", "status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("places", F.lit(0)).alias("places"))
    refused = made.rejected.read().select(F.col("path").alias("original_path"), "generation", "reason").distinct()
    zero = F.lit(0).cast("long")
    return rows.unionByName(refused.select("original_path", "generation", F.col("reason").alias("filename"), F.lit("Rejected").alias("status"), zero.alias("n_chunks"), zero.alias("places")))


# the knowledge-base list


def items(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    at = F.expr("date_format(timestamp_seconds(1704067200 + doc_id * 3600), \"yyyy-MM-dd'T'HH:mm:ss\")")
    return d.select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("id"), (F.col("doc_id") % 7).alias("user_id"), F.expr("'File ' || doc_id || element_at(array('.pdf', '.txt', ''), cast(doc_id % 3 + 1 as int))").alias("name"),
        F.when(F.col("doc_id") % 4 == 0, "text").otherwise("document").alias("type"), at.alias("date_added"), F.expr("element_at(array('Ready', 'Processing', 'Failed', 'Uploading'), cast(doc_id % 4 + 1 as int))").alias("status"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("gs://raw/"), "doc_id")).alias("uri"), F.coalesce("text", F.lit("")).alias("upload_error"), F.expr("timestamp_seconds(1704067200 + doc_id * 3600)").alias("created_at"),
    )


_ITEMS_SQL = """
i AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, doc_id, doc_id % 7 AS user_id, 'File ' || doc_id || (['.pdf', '.txt', ''])[doc_id % 3 + 1] AS name,
      CASE WHEN doc_id % 4 = 0 THEN 'text' ELSE 'document' END AS type, (['Ready', 'Processing', 'Failed', 'Uploading'])[doc_id % 4 + 1] AS status,
      CASE WHEN doc_id % 5 <> 0 THEN 'gs://raw/' || doc_id END AS uri, coalesce(text, '') AS upload_error,
      TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INT)) AS created_at FROM documents)
"""


def j7_merge_uploads(spark, sf_dir):
    i = items(spark, sf_dir)
    nums = F.regexp_replace("id", "^d0*(?=[0-9])", "").cast("long")
    return library_view.merge_uploads(i.where(nums % 3 != 0), i.where((nums % 3 == 0) | (nums % 2 == 0))).select("id", "status", "date_added")


def a2_pending(spark, sf_dir):
    return library_view.pending(items(spark, sf_dir)).agg(F.count("*").alias("n_pending"))


def a2_status_counts(spark, sf_dir):
    return library_view.status_counts(items(spark, sf_dir))


def a4_newest_documents(spark, sf_dir):
    return latest(items(spark, sf_dir), "user_id", [F.desc("created_at"), F.asc("id")], 50).select("user_id", "id", "position")


def a10_pages(spark, sf_dir):
    return library_view.paged(items(spark, sf_dir)).select("user_id", "id", "page_no", "total_pages")


def a10_page_clamped(spark, sf_dir):
    return library_view.page(items(spark, sf_dir), 10_000).select("user_id", "id", "page_no")


def a11_newest_first(spark, sf_dir):
    return library_view.newest_first(items(spark, sf_dir)).select("id", "date_added")


def p7_object_names(spark, sf_dir):
    d = docs(spark, sf_dir)
    name = F.when(F.col("doc_id") % 9 != 0, F.concat("text", F.lit("é (1).pdf")))
    return d.select("doc_id", tx.upload_object_name(name, F.col("doc_id")).alias("object_name"))


def p8_pasted_names(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.pasted_file_name(F.col("text")).alias("file_name"))


def p12_previews(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *[tx.preview(F.col("text"), n).alias(f"preview_{n}") for n in (50, 30, 20)])


def p13_display(spark, sf_dir):
    return library_view.display(items(spark, sf_dir)).select("id", "label", "day", "error")


def j5_delete_documents(spark, sf_dir):
    i = items(spark, sf_dir)
    nums = F.regexp_replace("id", "^d0*(?=[0-9])", "").cast("long")
    asked = i.where(nums % 6 == 0).select(F.when(nums % 12 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("target_id"), F.when(nums % 18 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"))
    children = i.select(F.col("id").alias("doc_id"))
    outcome, left, kids = ingest.delete_owned(i, asked, children)
    return outcome.groupBy("outcome").agg(F.count("*").alias("n")).unionByName(left.agg(F.lit(1).alias("outcome"), F.count("*").alias("n"))).unionByName(kids.agg(F.lit(2).alias("outcome"), F.count("*").alias("n")))


QUERIES = {f.__name__: f for f in (
    c2_chunk_summary, c2_chunks, c3_token_count, c2_chunks_byte_pairs, c3_token_count_byte_pairs, c4_token_batches_byte_pairs, s1_raw_objects, s3_page_json, t7_streaming_ingest, c1_pages_to_text, p5_p6_page_json, c4_token_batches, c5_embed, p1_storage_events, p2_p3_p4_routes, j1_known_versions, j2_register,
    s2_decode_bytes, c6_ingest_registry, j3_ingest_chunks, j4_failures, a1_ingest_summary, c7_text_messages, j7_merge_uploads, a2_pending, a2_status_counts, a4_newest_documents, a10_pages, a10_page_clamped,
    a11_newest_first, p7_object_names, p8_pasted_names, p12_previews, p13_display, j5_delete_documents,
)}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _places_sql(rows: str, key: str) -> str:
    """``key, n`` by place ``i`` in a vector, from ``rows(key..., text)``."""
    return f"""
pw AS (SELECT {key}, unnest(regexp_extract_all({_FOLD.format("text")}, '[^ \t\n\r\f\x0B]+')) AS w FROM {rows}),
ph AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM pw),
places AS (SELECT {key}, CAST(h % 768 AS INT) AS i, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS BIGINT) AS n FROM ph GROUP BY ALL HAVING n <> 0)
"""


_INGEST_SQL = f"""WITH {_OBJECTS_SQL},
k AS (SELECT *, regexp_extract_all(CASE WHEN suffix = '.txt' THEN coalesce(text, '') ELSE coalesce(array_to_string([x for x in string_split(text, chr(10)) if x <> ''], ' '), '') END, {TOK}) AS toks FROM o),
r AS (SELECT *, len(toks) AS n, doc_id % 4 = 0 AS known, CASE WHEN suffix = '.bin' THEN 'Failed' ELSE 'Ready' END AS done,
      CASE WHEN len(toks) = 0 THEN 0 WHEN len(toks) <= 800 THEN 1 ELSE 1 + CAST(ceil((len(toks) - 800) / 600.0) AS INT) END AS m FROM k)
"""

ORACLES = {
    "c2_chunk_summary": f"WITH {_CHUNKS_SQL} SELECT doc_id, count(*) AS n_chunks, CAST(sum(n_tokens) AS BIGINT) AS chunk_tokens FROM chunks GROUP BY doc_id",
    "c2_chunks": f"WITH {_CHUNKS_SQL} SELECT doc_id, chunk_index, n_tokens, md5(text) AS text_md5, CAST(length(text) AS INT) AS n_chars FROM chunks",
    "c3_token_count": f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), {TOK})) AS INT) AS n_tokens FROM documents",
    "c1_pages_to_text": "WITH t AS (SELECT doc_id, array_to_string([x for x in string_split(coalesce(text, ''), chr(10)) if x <> ''], ' ') AS text FROM documents) SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INT) AS n_chars FROM t",
    "p5_p6_page_json": """WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, doc_id % 7 = 3 AS failed FROM documents),
      p AS (SELECT doc_id, failed, CASE WHEN failed THEN l[6:] ELSE l END AS kept, len(l) AS n FROM t)
      SELECT doc_id, failed, CAST(len(kept) AS INT) AS n_pages, CAST(n * (n + 1) / 2 - CASE WHEN failed THEN least(n, 5) * (least(n, 5) + 1) / 2 ELSE 0 END AS BIGINT) AS page_sum, md5(array_to_string([x for x in kept if x <> ''], ' ')) AS text_md5 FROM p""",
    "p1_storage_events": f"""WITH {_OBJECTS_SQL},
      e AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 OR doc_id % 29 = 0 THEN 'not an object' WHEN doc_id % 13 = 0 THEN 'missing name' WHEN doc_id % 17 = 0 THEN 'generation is not an integer' WHEN doc_id % 11 = 0 THEN 'other bucket' ELSE '' END AS reason FROM o)
      SELECT CASE reason WHEN '' THEN 'accepted' WHEN 'other bucket' THEN 'ignored' ELSE 'rejected' END AS outcome, reason, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM e GROUP BY 1, 2""",
    "p2_p3_p4_routes": f"WITH {_OBJECTS_SQL} SELECT doc_id, suffix, CASE suffix WHEN '.txt' THEN 'text' WHEN '.pdf' THEN 'pages' WHEN '.docx' THEN 'pages' WHEN '' THEN 'none' ELSE 'unsupported' END AS route, filename FROM o",
    "j1_known_versions": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN (['Ready', 'Failed', 'Processing'])[doc_id // 4 % 3 + 1] ELSE 'new' END AS reason FROM documents",
    "j2_register": f"WITH {_OBJECTS_SQL} SELECT sha256(path || '|' || generation) AS id, filename, path AS original_path, generation, 'Processing' AS status FROM o WHERE suffix <> ''",
    "c6_ingest_registry": _INGEST_SQL + """SELECT path AS original_path, generation, filename, CASE WHEN known THEN (['Ready', 'Failed', 'Processing'])[doc_id // 4 % 3 + 1] ELSE done END AS status,
      CASE WHEN NOT known AND done = 'Failed' THEN 'ValueError: Unsupported file type: .bin' ELSE '' END AS error_message, NOT known AND suffix IN ('.pdf', '.docx') AS has_pages FROM r WHERE known OR suffix <> ''""",
    "j3_ingest_chunks": _INGEST_SQL + f""", x AS (SELECT sha256(path || '|' || generation) AS doc_id, toks, unnest(range(m)) AS i FROM r WHERE NOT known AND suffix IN ('.txt', '.pdf', '.docx') AND m > 0),
      y AS (SELECT doc_id, i AS chunk, array_to_string(toks[i * 600 + 1 : i * 600 + 800], '') AS text FROM x), {_places_sql("y", "doc_id, chunk")},
      z AS (SELECT doc_id, CAST(sum((i + 1) * sign(n)) AS BIGINT) AS places FROM places GROUP BY doc_id)
      SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, coalesce(any_value(places), 0) AS places FROM y LEFT JOIN z USING (doc_id) GROUP BY doc_id""",
    "j4_failures": _INGEST_SQL + """, x AS (SELECT path, generation, m, array_to_string(toks, '') AS text FROM r WHERE NOT known AND suffix IN ('.txt', '.pdf', '.docx')), b AS (SELECT *, regexp_matches(text, '[A-Za-z]{10}') AS bad FROM x)
      SELECT 'ValueError: Unsupported file type: .bin' AS error_message, count(*) AS n FROM r WHERE NOT known AND suffix = '.bin' HAVING count(*) > 0
      UNION ALL SELECT 'ValueError: cannot embed a word of 10 letters', count(*) FROM b WHERE bad HAVING count(*) > 0 UNION ALL SELECT 'chunks', CAST(coalesce(sum(m) FILTER (NOT bad), 0) AS BIGINT) FROM b""",
    "a1_ingest_summary": _INGEST_SQL + "SELECT count(*) FILTER (done = 'Ready') AS processed_count, count(*) FILTER (done = 'Failed') AS failed_count, CAST(sum(CASE WHEN done = 'Ready' THEN m ELSE 0 END) AS BIGINT) AS total_chunks FROM r WHERE NOT known AND suffix <> ''",
    "c4_token_batches": f"""WITH RECURSIVE {_chunks_sql(400, 300)},
      r AS (SELECT DISTINCT doc_id, CAST(-1 AS INT) AS i, 0 AS n, 0 AS sent, 0 AS used, 0 AS grp, false AS closed, 0 AS base FROM chunks
        UNION ALL SELECT r.doc_id, c.chunk_index, c.n_tokens,
          CASE WHEN c.n_tokens > 300 THEN r.sent + (c.n_tokens + 298) // 299 WHEN r.used > 0 AND r.used + c.n_tokens > 300 THEN r.sent + 1 ELSE r.sent END,
          CASE WHEN c.n_tokens > 300 THEN r.used WHEN r.used + c.n_tokens > 300 THEN c.n_tokens ELSE r.used + c.n_tokens END,
          CASE WHEN c.n_tokens <= 300 AND r.used > 0 AND r.used + c.n_tokens > 300 THEN r.grp + 1 ELSE r.grp END,
          c.n_tokens <= 300 AND r.used > 0 AND r.used + c.n_tokens > 300, r.sent
        FROM r JOIN chunks c ON c.doc_id = r.doc_id AND c.chunk_index = r.i + 1),
      g AS (SELECT doc_id, grp - 1 AS grp, base AS batch_no FROM r WHERE closed UNION ALL SELECT doc_id, max(grp), max(sent) FROM r GROUP BY doc_id),
      big AS (SELECT doc_id, base, i, n, unnest(range((n + 298) // 299)) AS p FROM r WHERE i >= 0 AND n > 300)
      SELECT r.doc_id, CAST(g.batch_no AS INT) AS batch_no, r.i AS chunk_index, 0 AS piece_no, CAST(r.n AS INT) AS n_tokens FROM r JOIN g USING (doc_id, grp) WHERE r.i >= 0 AND r.n <= 300
      UNION ALL SELECT doc_id, CAST(base + p AS INT), i, CAST(p AS INT), CAST(least(299, n - p * 299) AS INT) FROM big""",
    "c5_embed": f"""WITH {_CHUNKS_SQL}, {_places_sql("chunks", "doc_id, chunk_index")}, s AS (SELECT doc_id, chunk_index, sum(n * n) AS s FROM places GROUP BY ALL)
      SELECT doc_id, chunk_index, i, CAST(CAST(n / sqrt(CAST(s AS DOUBLE)) AS FLOAT) AS DOUBLE) AS v FROM places JOIN s USING (doc_id, chunk_index)""",
    "s1_raw_objects": """WITH l AS (SELECT unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS l FROM documents WHERE text IS NOT NULL)
      SELECT md5(l) AS line, count(*) AS n FROM l WHERE l <> '' GROUP BY 1 UNION ALL SELECT 'object not found', 1""",
    "s3_page_json": """WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
      SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len(l) AS INT) AS n_pages, md5(array_to_string([(i - 1) || '|h|' || l[i] for i in range(1, len(l) + 1)], chr(10))) AS pages_md5 FROM t""",
    "t7_streaming_ingest": _INGEST_SQL + f""", x AS (SELECT path, generation, toks, unnest(range(m)) AS i FROM r WHERE suffix IN ('.txt', '.pdf', '.docx') AND m > 0),
      y AS (SELECT path, generation, i AS chunk, array_to_string(toks[i * 600 + 1 : i * 600 + 800], '') AS text FROM x), {_places_sql("y", "path, generation, chunk")},
      z AS (SELECT path, generation, CAST(sum((i + 1) * sign(n)) AS BIGINT) AS places FROM places GROUP BY ALL)
      SELECT path AS original_path, generation, filename, done AS status, CAST(CASE WHEN done = 'Ready' THEN m ELSE 0 END AS BIGINT) AS n_chunks, coalesce(places, 0) AS places FROM r LEFT JOIN z USING (path, generation) WHERE suffix <> ''
      UNION ALL SELECT 'gs://raw/gone/' || name, generation + 1, 'object not found', 'Rejected', 0, 0 FROM o WHERE doc_id % 10 = 0""",
    "s2_decode_bytes": "SELECT doc_id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_md5 FROM documents",
    "c7_text_messages": f"""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN coalesce(text, '') ELSE '' END AS text FROM documents), k AS (SELECT doc_id, text, regexp_extract_all(text, {TOK}) AS toks, len(toks) AS n FROM m),
      c AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN n <= 800 THEN 1 ELSE 1 + CAST(ceil((n - 800) / 600.0) AS INT) END AS m FROM k), x AS (SELECT doc_id, toks, unnest(range(m)) AS i FROM c WHERE m > 0),
      y AS (SELECT doc_id, i AS chunk, array_to_string(toks[i * 600 + 1 : i * 600 + 800], '') AS text FROM x), {_places_sql("y", "doc_id, chunk")}, z AS (SELECT doc_id, CAST(sum((i + 1) * sign(n)) AS BIGINT) AS places FROM places GROUP BY doc_id)
      SELECT 'text://t' || doc_id AS original_path, CASE WHEN doc_id % 3 <> 0 THEN 'Title ' || doc_id ELSE 'Untitled' END AS filename, CASE WHEN text = '' THEN 'Failed' ELSE 'Ready' END AS status, CASE WHEN text = '' THEN 'No content provided' ELSE '' END AS error_message,
      CAST(m AS BIGINT) AS n_chunks, coalesce(places, 0) AS places FROM c LEFT JOIN z USING (doc_id)""",
    "j7_merge_uploads": f"""WITH {_ITEMS_SQL}, l AS (SELECT * FROM i WHERE doc_id % 3 <> 0), u AS (SELECT * FROM i WHERE (doc_id % 3 = 0 OR doc_id % 2 = 0) AND status = 'Uploading' AND uri IS NOT NULL AND uri NOT IN (SELECT uri FROM l WHERE uri IS NOT NULL))
      SELECT id, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS date_added FROM (SELECT * FROM l UNION ALL SELECT * FROM u)""",
    "a2_pending": f"WITH {_ITEMS_SQL} SELECT count(*) AS n_pending FROM i WHERE status IN ('Processing', 'Uploading')",
    "a2_status_counts": f"WITH {_ITEMS_SQL} SELECT status, count(*) AS n FROM i GROUP BY status",
    "a4_newest_documents": f"WITH {_ITEMS_SQL} SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS INT) AS position FROM i QUALIFY position <= 50",
    "a10_pages": f"WITH {_ITEMS_SQL} SELECT user_id, id, CAST(ceil(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) / 10.0) AS INT) AS page_no, CAST(ceil(count(*) OVER (PARTITION BY user_id) / 10.0) AS INT) AS total_pages FROM i",
    "a10_page_clamped": f"WITH {_ITEMS_SQL}, p AS (SELECT user_id, id, CAST(ceil(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) / 10.0) AS INT) AS page_no, CAST(ceil(count(*) OVER (PARTITION BY user_id) / 10.0) AS INT) AS t FROM i) SELECT user_id, id, page_no FROM p WHERE page_no = greatest(1, least(10000, t))",
    "a11_newest_first": f"WITH {_ITEMS_SQL} SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS date_added FROM i ORDER BY created_at DESC, id",
    "p7_object_names": "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 AND text IS NOT NULL THEN 'uploads/' || md5(CAST(doc_id AS VARCHAR)) || '-' || regexp_replace(text || 'é (1).pdf', '[^a-zA-Z0-9._-]', '_', 'g') END AS object_name FROM documents",
    "p8_pasted_names": "WITH t AS (SELECT doc_id, substr(regexp_replace(trim(text), '[^a-zA-Z0-9_-]', '_', 'g'), 1, 50) AS s FROM documents) SELECT doc_id, CASE WHEN s = '' THEN 'pasted-text' ELSE s END || '.txt' AS file_name FROM t",
    "p12_previews": "SELECT doc_id, " + ", ".join(f"CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '...' ELSE text END AS preview_{n}" for n in (50, 30, 20)) + " FROM documents",
    "p13_display": f"WITH {_ITEMS_SQL} SELECT id, CASE WHEN type = 'document' THEN 'Doc (' || upper(split_part(name, '.', -1)) || ')' ELSE 'Text' END AS label, strftime(created_at, '%Y-%m-%d') AS day, CASE WHEN length(upload_error) > 50 THEN substr(upload_error, 1, 50) || '...' ELSE upload_error END AS error FROM i",
    "j5_delete_documents": f"""WITH {_ITEMS_SQL}, q AS (SELECT id, CASE WHEN doc_id % 12 = 0 THEN 404 WHEN doc_id % 18 = 0 THEN 403 ELSE 200 END AS outcome FROM i WHERE doc_id % 6 = 0), l AS (SELECT count(*) AS n FROM i WHERE id NOT IN (SELECT id FROM q WHERE outcome = 200))
      SELECT outcome, count(*) AS n FROM q GROUP BY outcome UNION ALL SELECT 1, n FROM l UNION ALL SELECT 2, n FROM l""",
}
