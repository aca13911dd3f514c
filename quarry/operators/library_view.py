"""The knowledge-base list: merged uploads, status counts, paging, display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.text import file_type, preview


def merge_uploads(items: DataFrame, uploading: DataFrame) -> DataFrame:
    """``items`` and those uploads in progress whose object the list does not know yet, newest first."""
    pending = uploading.where((F.col("status") == "Uploading") & F.col("uri").isNotNull()).join(items.select("uri").where("uri is not null").distinct(), "uri", "left_anti")
    return newest_first(items.unionByName(pending.select(items.columns)))


def newest_first(items: DataFrame) -> DataFrame:
    """By ``date_added`` (dates and full times), latest first, ties by id."""
    return items.orderBy(F.try_to_timestamp("date_added").desc_nulls_last(), "id")


def pending(items: DataFrame) -> DataFrame:
    return items.where(F.col("status").isin("Processing", "Uploading"))


def status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(F.count("*").alias("n"))


def paged(items: DataFrame, *, by: str = "user_id", order: list[Column] | None = None, size: int = 10) -> DataFrame:
    """Rows with ``page_no`` (from 1) and ``total_pages`` of their owner's list."""
    w = Window.partitionBy(by)
    n = F.row_number().over(w.orderBy(*(order or [F.desc("created_at"), F.asc("id")])))
    return items.withColumns({"page_no": F.ceil(n / size).cast("int"), "total_pages": F.ceil(F.count("*").over(w) / size).cast("int")})


def page(items: DataFrame, number: int, *, by: str = "user_id", order: list[Column] | None = None, size: int = 10) -> DataFrame:
    """One page of each owner's list; a number outside the list is moved to its nearest page."""
    p = paged(items, by=by, order=order, size=size)
    return p.where(F.col("page_no") == F.greatest(F.lit(1), F.least(F.lit(number), F.col("total_pages"))))


def display(items: DataFrame, limit: int = 50) -> DataFrame:
    """``label`` (type of a document or Text), ``day`` and a cut ``error`` for each item."""
    kind = file_type(F.col("name"))
    label = F.when(F.col("type") == "document", F.concat(F.lit("Doc ("), F.coalesce(F.nullif(kind, F.lit("")), F.lit("?")), F.lit(")"))).otherwise("Text")
    return items.withColumns({"label": label, "day": F.element_at(F.split("date_added", "T"), 1), "error": preview(F.col("upload_error"), limit)})
