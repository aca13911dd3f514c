"""Storage events, routing by file type, and the idempotent registry of documents and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry import schemas
from quarry.functions.text import display_name, suffix
from quarry.operators.chunking import chunk, pages_to_text
from quarry.operators.embedding import Embedder, embed
from quarry.scratch import materialize


def check_events(events: DataFrame, bucket: str, value_col: str = "value") -> DataFrame:
    """Validate JSON storage events, plain or under ``data``.

    Adds ``bucket, name, generation, outcome`` (accepted, ignored, rejected) and
    ``reason``. The number 0 is no generation, the text ``"0"`` is one.
    """
    raw = F.col(value_col)
    wrapped = F.array_contains(F.json_object_keys(raw), "data")  # a null under it counts too
    body = F.when(wrapped, F.coalesce(F.get_json_object(raw, "$.data"), F.lit("null"))).otherwise(raw)
    e = events.withColumn("__b", body).withColumn("__v", F.try_parse_json("__b"))
    is_object = F.col("__b").rlike(r"^\s*\{") & F.col("__v").isNotNull()
    text = lambda k: F.get_json_object("__b", f"$.{k}")
    # of the object's own field: numbers and false count as nothing, texts do not
    own = F.expr("try_variant_get(__v, '$.generation', 'variant')")
    zero = F.coalesce((F.schema_of_variant(own) != "STRING") & ((F.expr("try_cast(get_json_object(__b, '$.generation') as double)") == 0) | (text("generation") == "false")), F.lit(False))
    number = F.when(text("generation").rlike(r"^[+-]?[0-9]+$"), F.expr("try_cast(get_json_object(__b, '$.generation') as bigint)"))
    missing = lambda k: F.coalesce(text(k), F.lit("")) == ""
    reason = (
        F.when(~F.coalesce(is_object, F.lit(False)), "not an object").when(missing("bucket"), "missing bucket").when(missing("name"), "missing name")
        .when(missing("generation") | zero, "missing generation").when(number.isNull(), "generation is not an integer").when(text("bucket") != bucket, "other bucket")
    )
    outcome = F.when(reason.isNull(), "accepted").when(reason == "other bucket", "ignored").otherwise("rejected")
    return e.select(*events.columns, text("bucket").alias("bucket"), text("name").alias("name"), number.alias("generation"), outcome.alias("outcome"), reason.alias("reason"))


def route(suffix_: Column) -> Column:
    """``text``, ``pages``, ``unsupported``, or ``none`` for a name without a suffix."""
    return F.when(suffix_ == ".txt", "text").when(suffix_.isin(".pdf", ".doc", ".docx"), "pages").when(suffix_ == "", "none").otherwise("unsupported")


def document_id(path: Column, generation: Column) -> Column:
    """An id that depends on the natural key only, so a repeated task makes no second document."""
    return F.sha2(F.concat_ws("|", path, generation.cast("string")), 256)


def split_known(batch: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(new, skipped)``: rows of ``batch(path, generation, ...)`` by whether the registry knows their version.

    Any status skips, with that status as ``reason``: failed versions are not
    retried. Repeats in the batch count once.
    """
    once = batch.dropDuplicates(["path", "generation"])
    known = registry.select(F.col("original_path").alias("path"), "generation", F.col("status").alias("reason")).dropDuplicates(["path", "generation"])
    new = once.join(known, ["path", "generation"], "left_anti").select(batch.columns)
    return new, once.join(known, ["path", "generation"])


def register(new: DataFrame, created_at: Column) -> DataFrame:
    """Registry rows for new documents, in status Processing. Names without a suffix are not registered."""
    null = lambda t: F.lit(None).cast(t)
    r = new.where(route(suffix(F.col("path"))) != "none")
    return r.select(
        document_id(F.col("path"), F.col("generation")).alias("id"), display_name(F.col("path"), F.col("metadata")).alias("filename"), F.col("path").alias("original_path"),
        null("string").alias("processed_path"), "generation", created_at.alias("created_at"), F.lit("Processing").alias("status"), null("string").alias("error_message"),
    )


def apply_results(registry: DataFrame, results: DataFrame) -> DataFrame:
    """Registry after ``results(id, status, error_message, processed_path)``; only rows it holds change, failures keep their message."""
    r = results.select("id", F.col("status").alias("__s"), F.col("error_message").alias("__e"), F.col("processed_path").alias("__p"), F.lit(True).alias("__hit")).dropDuplicates(["id"])
    j, hit = registry.join(r, "id", "left"), F.col("__hit").isNotNull()
    j = j.withColumns({"status": F.when(hit, F.col("__s")).otherwise(F.col("status")), "error_message": F.when(hit, F.when(F.col("__s") == "Ready", None).otherwise(F.col("__e"))).otherwise(F.col("error_message"))})
    j = j.withColumn("processed_path", F.when(hit & (F.col("__s") == "Ready"), F.col("__p")).otherwise(F.col("processed_path")))
    return j.select(registry.columns)


def replace_chunks(chunks: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of touched documents (``doc_id``) go, the new ones come."""
    return chunks.join(touched.select("doc_id").distinct(), "doc_id", "left_anti").select(chunks.columns).unionByName(new.select(chunks.columns))


def delete_owned(table: DataFrame, requests: DataFrame, children: DataFrame, *, key: str = "id", child_key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deletes asked by ``requests(target_id, user_id)``: ``(outcomes, table, children)``.

    404 for a missing row, 403 for another owner's, else 200, and the row goes with its children.
    """
    owner = table.select(F.col(key).alias("target_id"), F.col("user_id").alias("__owner"), F.lit(True).alias("__there"))
    outcome = requests.join(owner, "target_id", "left").select("target_id", "user_id", F.when(F.col("__there").isNull(), 404).when(~F.col("user_id").eqNullSafe(F.col("__owner")), 403).otherwise(200).alias("outcome"))
    gone = outcome.where("outcome = 200").select("target_id").distinct()
    return (
        outcome, table.join(gone, table[key] == gone["target_id"], "left_anti"),
        children.join(gone, children[child_key] == gone["target_id"], "left_anti"),
    )


def parse_pages(raw: Column) -> Column:
    """Extracted pages from a model's JSON answer, with or without a code fence; null if it is no list of pages."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?s)^\s*```json\s*", ""), r"(?s)\s*```\s*$", "")
    return F.when(bare.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(bare, schemas.PAGE_ARRAY))


def renumber_pages(batches: DataFrame) -> DataFrame:
    """``doc_id, pages, failed`` from page batches ``(doc_id, start_page, raw_json)``.

    Page numbers are moved by the batch's start; a batch that does not parse fails its document.
    """
    p = batches.withColumn("pages", parse_pages(F.col("raw_json")))
    moved = F.transform("pages", lambda x: F.struct((x.page + F.col("start_page")).alias("page"), x.header.alias("header"), x.body.alias("body")))
    p = p.select("doc_id", "start_page", moved.alias("pages"))
    lists = F.array_sort(F.collect_list(F.struct("start_page", "pages")))
    return p.groupBy("doc_id").agg(F.max(F.col("pages").isNull()).alias("failed"), F.flatten(F.transform(lists, lambda b: F.coalesce(b.pages, F.array().cast(schemas.PAGE_ARRAY)))).alias("pages"))


def embedded_chunks(texts: DataFrame, *, max_tokens: int = 800, overlap: int = 200, embedder: Callable[[], Embedder] | None = None, width: int = 768) -> tuple[DataFrame, DataFrame]:
    """``(chunks, faults)`` of ``texts(doc_id, text)``: chunks with their vectors, as the chunk table holds them, and ``doc_id, error_message`` of the documents on which the embedder raised.

    Such a document has no chunks; all others go on. The vectors are written
    once, as both results need them.
    """
    made = embed(chunk(texts, max_tokens=max_tokens, overlap=overlap), embedder, width=width, errors=True)
    made = materialize(made.select("doc_id", "chunk_index", "text", "embedding", "error"), "embedded")
    faults = made.where("error is not null").groupBy("doc_id").agg(F.min_by("error", "chunk_index").alias("error_message"))
    return made.drop("error").join(faults, "doc_id", "left_anti"), faults


def with_faults(results: DataFrame, faults: DataFrame) -> DataFrame:
    """``results`` in which the documents of ``faults`` have failed with its message."""
    j = results.join(faults.select(F.col("doc_id").alias("id"), F.col("error_message").alias("__fault")), "id", "left")
    bad = F.col("__fault").isNotNull()
    j = j.withColumns({"status": F.when(bad, "Failed").otherwise(F.col("status")), "error_message": F.coalesce("__fault", "error_message")})
    return j.select(results.columns)


def process(documents: DataFrame, **making) -> tuple[DataFrame, DataFrame]:
    """``(results, chunks)`` of loaded documents ``(id, path, text, pages, failure)``.

    Text files bring ``text``, others ``pages``. Unsupported types and failed
    extractions fail, as does a document whose text the embedder raises on; an
    empty text is Ready without chunks. ``making``: what :func:`embedded_chunks`
    takes.
    """
    kind = route(suffix(F.col("path")))
    d = documents.withColumn("__kind", kind)
    text = F.when(F.col("__kind") == "text", F.col("text")).when(F.col("__kind") == "pages", pages_to_text(F.col("pages")))
    unsupported = F.concat(F.lit("ValueError: Unsupported file type: "), suffix(F.col("path")))
    error = F.when(F.col("__kind") == "unsupported", unsupported).when((F.col("__kind") == "pages") & F.col("pages").isNull(), F.coalesce("failure", F.lit("ValueError: no pages"))).otherwise(F.col("failure"))
    d = d.select("id", "path", "__kind", text.alias("text"), error.alias("error_message"))
    processed = F.when((F.col("__kind") == "pages") & F.col("error_message").isNull(), F.concat(F.lit("processed/"), F.col("id"), F.lit(".json")))
    results = d.select("id", F.when(F.col("error_message").isNull(), "Ready").otherwise("Failed").alias("status"), "error_message", processed.alias("processed_path"))
    chunks, faults = embedded_chunks(d.where("error_message is null").select(F.col("id").alias("doc_id"), "text"), **making)
    return with_faults(results, faults), chunks


def process_messages(messages: DataFrame, **making) -> tuple[DataFrame, DataFrame]:
    """``(registry rows with results, chunks)`` of text messages ``(task_id, title, content, ts)``. Empty content fails."""
    path = F.concat(F.lit("text://"), F.col("task_id"))
    empty = F.coalesce("content", F.lit("")) == ""
    m = messages.select(
        document_id(path, F.lit(0)).alias("id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("filename"), path.alias("original_path"), F.lit(None).cast("string").alias("processed_path"),
        F.lit(0).cast("long").alias("generation"), F.col("ts").alias("created_at"), F.when(empty, "Failed").otherwise("Ready").alias("status"), F.when(empty, "No content provided").alias("error_message"), F.col("content").alias("text"),
    ).dropDuplicates(["original_path", "generation"])
    chunks, faults = embedded_chunks(m.where("status = 'Ready'").select(F.col("id").alias("doc_id"), "text"), **making)
    return with_faults(m.drop("text"), faults), chunks


def run_messages(messages: DataFrame, registry: DataFrame, chunks: DataFrame, **making) -> tuple[DataFrame, DataFrame]:
    """``(registry, chunks)`` after taking in text messages; a message the registry knows, in any status, changes nothing."""
    known = registry.where("generation = 0 and original_path like 'text://%'").select(F.substring("original_path", 8, 1 << 30).alias("task_id"))
    rows, made = process_messages(messages.join(known, "task_id", "left_anti").select(messages.columns), **making)
    return registry.unionByName(rows), replace_chunks(chunks, rows.select(F.col("id").alias("doc_id")), made)


def summary(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: ``processed_count, failed_count, total_chunks``."""
    r = results.agg(F.count_if(F.col("status") == "Ready").alias("processed_count"), F.count_if(F.col("status") == "Failed").alias("failed_count"))
    return r.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("total_chunks"))))  # two one-row aggregates


def ingest_loaded(new: DataFrame, created_at: Column, **making) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(registry rows, chunks, results)`` of ``new(path, generation, metadata, text, pages, failure)``, each version once and none known."""
    loaded = new.withColumn("id", document_id(F.col("path"), F.col("generation"))).where(route(suffix(F.col("path"))) != "none")
    results, made = process(loaded, **making)
    return apply_results(register(new, created_at), results), made, results


def ingest_new(objects: DataFrame, registry: DataFrame, created_at: Column, **making) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`ingest_loaded`, of those ``objects`` the registry does not know."""
    return ingest_loaded(split_known(objects, registry)[0], created_at, **making)


def run_batch(objects: DataFrame, registry: DataFrame, chunks: DataFrame, created_at: Column, **making) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(registry, chunks, results)`` after ingesting ``objects``. A rerun changes nothing. ``making``: what :func:`embedded_chunks` takes."""
    rows, made, results = ingest_new(objects, registry, created_at, **making)
    touched = results.where("status = 'Ready'").select(F.col("id").alias("doc_id"))
    return registry.unionByName(rows), replace_chunks(chunks, touched, made), results


def latest(rows: DataFrame, by: str, order: list[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows of each ``by`` in the given order (all for None), with ``position`` from 1."""
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked if n is None else ranked.where(F.col("position") <= n)
