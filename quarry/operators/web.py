"""Main content of captured pages by selector with fallbacks, and what follows from captures."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.text import is_web_url, preview, scraped_file_name
from quarry.operators.ingest import document_id, embedded_chunks, replace_chunks, summary, with_faults
from quarry.scratch import materialize

NOT_FOUND = "Content element not found"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style"))
_REFERENCE = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")

Selector = tuple[str, str, str]
#: Fallbacks in order: tag, attribute, value; an empty part matches anything (fixed values).
FALLBACKS: list[Selector] = [("main", "", ""), ("article", "", ""), ("div", "class", "content"), ("body", "", "")]


def selector(short: str) -> Selector:
    """``.x`` a class, ``#x`` an id, else a tag."""
    if short[:1] == ".":
        return "", "class", short[1:]
    return ("", "id", short[1:]) if short[:1] == "#" else (short.lower(), "", "")


def site(primary: str, fallbacks: list[Selector] | None = None) -> list[Selector]:
    """The selectors of a site in the order they are tried."""
    return [selector(primary), *(FALLBACKS if fallbacks is None else fallbacks)]


def fits(wanted: Selector, tag: str, attrs: dict[str, str | None]) -> bool:
    name, attr, value = wanted
    if name and name != tag:
        return False
    if not attr:
        return True
    have = attrs.get(attr) or ""
    return value in have.split() if attr == "class" else value == have


class _Reader(HTMLParser):
    """Text nodes, and for each selector the range of them inside its first match."""

    def __init__(self, selectors: list[Selector]):
        super().__init__(convert_charrefs=True)
        self.selectors, self.texts = selectors, []
        self.spans: dict[int, list[int]] = {}
        self.open: list[tuple[str, list[int]]] = []
        self.names: Counter[str] = Counter()  # of open elements, so that a stray end tag costs no search

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        own = [i for i, s in enumerate(self.selectors) if i not in self.spans and fits(s, tag, given)]
        for i in own:
            self.spans[i] = [len(self.texts), -1]
        if tag in _VOID:
            self._end(own)
        else:
            self.open.append((tag, own))
            self.names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        while self.names[tag]:
            name, own = self.open.pop()
            self.names[name] -= 1
            self._end(own)
            if name == tag:
                break

    def _end(self, own: list[int]) -> None:
        for i in own:
            self.spans[i][1] = len(self.texts)

    def handle_data(self, data: str) -> None:
        if data.strip() and not (self.open and self.open[-1][0] in _HIDDEN):
            self.texts.append(data.strip())


def closed_references(html: str) -> str:
    """``html`` with each ``&`` that begins no character reference with its semicolon written as text."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}", html)


def main_content(html: str | None, selectors: list[Selector], *, closed: bool = False) -> tuple[int | None, str | None]:
    """Number of the first selector that matches, and the visible text of its first match, a text node a line.

    Browsers read ``&amp`` without its semicolon as ``&`` too; with ``closed`` it stays as it is written.
    """
    reader = _Reader(selectors)
    reader.feed(closed_references(html or "") if closed else html or "")
    reader.close()
    for _, own in reader.open:
        reader._end(own)
    if not reader.spans:
        return None, None
    rank = min(reader.spans)
    a, b = reader.spans[rank]
    return rank, "\n".join(reader.texts[a:b])


def _content(html: str | None, selectors: list[Selector], closed: bool) -> tuple[int | None, str | None, str | None]:
    """As :func:`main_content`, with what went wrong: a page that cannot be read leaves the others alone."""
    try:
        rank, text = main_content(html, selectors, closed=closed)
    except Exception as fault:
        return None, None, f"{type(fault).__name__}: {fault}"
    return rank, text, NOT_FOUND if rank is None else None


def extract_content(captures: DataFrame, sites: dict[str, list[Selector]], *, site_col: str | None = None, default: str = "default", closed: bool = False) -> DataFrame:
    """Captures (``url, html``) with ``status`` (ok, error), ``matched`` (selector number), ``content`` and ``error``.

    ``closed``: see :func:`main_content`.
    """
    rest = [c for c in captures.columns if c != "html"]
    rows = captures.select(*rest, "html", (F.col(site_col) if site_col else F.lit(default)).alias("__site"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # a batch may hold 10,000 pages
                part = batch.slice(at, 256)
                found = [_content(h, sites.get(s, sites[default]), closed) for h, s in zip(part.column("html").to_pylist(), part.column("__site").to_pylist(), strict=True)]
                made = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.int32(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *made], [*rest, "matched", "content", "error"])

    read = rows.mapInArrow(run, rows.select(*rest).schema.add("matched", "integer").add("content", "string").add("error", "string"))
    columns = [*rest, "matched", "content", F.when(F.col("matched").isNotNull(), "ok").otherwise("error").alias("status"), "error"]
    return read.select(*columns)


def choose_capture(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per url the first capture if it worked, else the second, else both errors in one message: ``url, status, used, content, error``."""
    a, b = (df.select("url", *[F.col(c).alias(f"{x}_{c}") for c in ("status", "content", "error")]) for df, x in ((first, "a"), (second, "b")))
    j = a.join(b, "url", "full_outer")
    ok_a, ok_b = (F.coalesce(F.col(f"{x}_status") == "ok", F.lit(False)) for x in "ab")
    return j.select(
        "url", F.when(ok_a | ok_b, "ok").otherwise("error").alias("status"), F.when(ok_a, "first").when(ok_b, "second").alias("used"),
        F.when(ok_a, F.col("a_content")).when(ok_b, F.col("b_content")).alias("content"), F.when(~ok_a & ~ok_b, F.concat_ws("; ", "a_error", "b_error")).alias("error"),
    )


def saved_pages(extracted: DataFrame) -> DataFrame:
    """What is saved of the successes: ``url, file_name, body``; rows are keyed by url, as file names of different sites collide."""
    return extracted.where("status = 'ok'").select("url", scraped_file_name(F.col("url")).alias("file_name"), F.concat(F.lit("URL: "), F.col("url"), F.lit("\n\n"), F.col("content")).alias("body"))


def scrape_summary(extracted: DataFrame) -> DataFrame:
    """``status, n, total`` for each status; one row per status."""
    counts = extracted.groupBy("status").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(extracted.agg(F.count("*").alias("total"))))


def content_preview(content: Column, limit: int = 200) -> Column:
    return preview(F.trim(content), limit)


def check_urls(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``reason``: null for http(s) URLs with a host."""
    return urls.withColumn("reason", F.when(F.coalesce(F.trim(url_col), F.lit("")) == "", "empty").when(~is_web_url(F.col(url_col)), "not an http or https URL with a host"))


def page_titles(captures: DataFrame) -> DataFrame:
    """``captures`` with ``title``: the text of the page's title element, else of its first ``h1``; null without both."""
    first = lambda tag: F.regexp_extract("html", rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    plain = lambda raw: F.trim(F.regexp_replace(F.regexp_replace(raw, "<[^>]*>", ""), r"\s+", " "))
    return captures.withColumn("title", F.coalesce(F.nullif(plain(first("title")), F.lit("")), F.nullif(plain(first("h1")), F.lit(""))))


def _version(column: str | None) -> Column:
    return (F.col(column) if column else F.lit(0)).cast("long").alias("generation")


def pages_to_chunks(captures: DataFrame, sites: dict[str, list[Selector]], *, version: str | None = None, closed: bool = False, **making) -> tuple[DataFrame, DataFrame]:
    """``(results, chunks)`` of captured pages, one for each url and ``version``, in the shapes the registry and chunk table take.

    ``results(id, url, generation, title, status, error_message)``; ``version``
    names the column that numbers the captures of a url, without it they are one
    page of version 0. ``closed``: see :func:`main_content`. ``making``: what
    :func:`quarry.operators.ingest.embedded_chunks` takes.
    """
    got = extract_content(page_titles(captures.select("url", _version(version), "html")), sites, closed=closed)
    got = got.groupBy("url", "generation").agg(F.min(F.struct(F.col("status") != "ok", "content", "title", "status", "error")).alias("g")).select("url", "generation", "g.*")  # captures that worked first
    got = materialize(got.withColumn("id", document_id(F.col("url"), F.col("generation"))), "pages")  # read once for results and chunks
    results = got.select("id", "url", "generation", "title", F.when(F.col("status") == "ok", "Ready").otherwise("Failed").alias("status"), F.col("error").alias("error_message"))
    chunks, faults = embedded_chunks(got.where("status = 'ok'").select(F.col("id").alias("doc_id"), F.col("content").alias("text")), **making)
    return with_faults(results, faults), chunks


def registry_rows(results: DataFrame, created_at: Column) -> DataFrame:
    """Registry rows of pages from their :func:`pages_to_chunks` results."""
    return results.select(
        "id", F.coalesce("title", "url").alias("filename"), F.col("url").alias("original_path"), F.lit(None).cast("string").alias("processed_path"),
        "generation", created_at.alias("created_at"), "status", "error_message",
    )


def ingest_pages(captures: DataFrame, sites: dict[str, list[Selector]], registry: DataFrame, chunks: DataFrame, created_at: Column, *, version: str | None = None, **making) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(registry, chunks, summary)`` after taking in captured pages; versions the registry knows are skipped.

    A page is the version 0 of its url, or with ``version`` of the number in that
    column; its title is its file name. ``making``: what :func:`pages_to_chunks`
    takes.
    """
    known = registry.select(F.col("original_path").alias("url"), "generation").distinct()
    new = captures.select("url", _version(version), "html").join(known, ["url", "generation"], "left_anti")
    results, made = pages_to_chunks(new, sites, version="generation", **making)
    rows = registry_rows(results, created_at)
    ready = results.where("status = 'Ready'").select(F.col("id").alias("doc_id"))
    return registry.unionByName(rows), replace_chunks(chunks, ready, made), summary(results, made)
