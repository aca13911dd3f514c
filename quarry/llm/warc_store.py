"""WARC archives as a chunked record table.

A payload is cut into rows of record and chunk number where it is read; the
writer streams them into one gzip member per record, the reader streams them out
again as such rows, and both carry the payload's SHA-256 from chunk to chunk.
Only the cell of the input that holds it is ever as large as a record. Each
writing task names its own file and reports it in a manifest; what a lost
attempt leaves behind is in no manifest and is never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from quarry.spread import copied, deal, hot_parts
from quarry.scratch import materialize, scratch_path

_MANIFEST = "file string, offset long, length long, page_id long"
_EOL = b"\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("file:/", "file:///", 1) if path.startswith(("s3a:", "file:/")) and not path.startswith("file://") else path)


def plan_records(pages: DataFrame, min_dedup_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, refers_to``.

    Of rows with equal payloads of ``min_dedup_bytes`` or more, the one with the
    smallest page_id is the response; the others refer to it.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    # copies are found on numbers and digests alone; no payload moves with those of its copies
    ids = p.where(F.col("payload_bytes") >= min_dedup_bytes).select("page_id", "payload_digest")
    first = ids.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    hot = hot_parts(first, ["payload_digest"])
    again = deal(ids, hot, ["payload_digest"], ["page_id"]).join(copied(first.drop("n"), hot, ["payload_digest"]), ["payload_digest", "part"])
    again = materialize(again.where("refers_to < page_id").select("page_id", "payload_digest", "refers_to").distinct(), "warc-revisits")
    return p.join(again, ["page_id", "payload_digest"], "left")


def chunk_rows(records: DataFrame, chunk_bytes: int = 1 << 18) -> DataFrame:
    """One row per chunk of a payload, in order; a revisit or an empty payload has one empty chunk."""
    own = F.col("refers_to").isNull()
    last = F.when(own, F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk_bytes))).otherwise(F.lit(1)).cast("int") - 1
    rows = records.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    # a chunk is cut as its row is made: one copy of it at a time beside the payload itself
    data = F.when(own, F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return rows.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", "chunk_no", data.alias("data"))


def _head(row: dict, date: str) -> tuple[bytes, int]:
    """WARC and HTTP headers of a record, and the bytes of payload that follow."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    follows = 0 if revisit else row["payload_bytes"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in row["url"]))
    lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", f"WARC-Profile: {_REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + follows}", "", ""]
    return "\r\n".join(lines).encode() + http, follows


def write_archives(chunks: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``chunks`` (in the order of :func:`chunk_rows`) as ``.warc.gz`` files below ``path``; returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(path)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        sink, at, begun, zipper, digest, left, row = None, 0, 0, None, None, 0, None
        done: list[dict] = []
        try:
            for batch in batches:
                chunk, rest = batch.column("data"), batch.drop_columns(["data"])
                for i, number in enumerate(batch.column("chunk_no").to_pylist()):
                    data = chunk[i].as_buffer()
                    if sink is None:
                        sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                    if number == 0:
                        row, begun, zipper, digest = rest.slice(i, 1).to_pylist()[0], at, zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256()
                        head, left = _head(row, date)
                        at += sink.write(zipper.compress(head)) or 0
                        at = sink.tell()
                    digest.update(data)
                    left -= data.size
                    sink.write(zipper.compress(data))
                    if left == 0:
                        if row["refers_to"] is None and digest.hexdigest() != row["payload_digest"]:
                            raise ValueError("chunks of a record are out of order")
                        sink.write(zipper.compress(_EOL * 2) + zipper.flush())
                        at = sink.tell()
                        done.append({"file": f"{path}/{name}", "offset": begun, "length": at - begun, "page_id": row["page_id"]})
        finally:
            if sink is not None:
                sink.close()
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64())])
    return materialize(chunks.mapInArrow(run, _MANIFEST), "warc-manifest")


class _Member:
    """One gzip member of an archive as a stream of bytes."""

    def __init__(self, source: pa.NativeFile, offset: int, length: int, step: int):
        source.seek(offset)
        self.source, self.left, self.step = source, length, step
        self.unzip, self.held = zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate about ``step`` bytes more; false at the end."""
        raw = self.unzip.unconsumed_tail
        if not raw:
            raw = self.source.read(min(self.left, self.step))
            self.left -= len(raw)
        if not raw:
            return False
        self.held += self.unzip.decompress(raw, self.step)
        return True

    def until(self, mark: bytes) -> bytes:
        while (end := self.held.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record ends inside its headers")
        head, self.held = self.held[:end], self.held[end + len(mark) :]
        return head

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        if len(self.held) < n:
            raise ValueError("a record is shorter than it says")
        out, self.held = self.held[:n], self.held[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def read_chunks(manifest: DataFrame, *, chunk_bytes: int = 1 << 18, with_data: bool = True) -> DataFrame:
    """The archives of a manifest, read back as a chunked record table.

    ``page_id, url, record_type, refers_to, header_digest, header_bytes,
    chunk_no, data, bytes_so_far, digest_so_far`` (SHA-256 of the payload up to
    and with this chunk) and ``last``. A revisit has one row without data.
    """
    spark = manifest.sparkSession
    total = manifest.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, int(total >> 26) + 1)
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("header_digest", pa.string()), ("header_bytes", pa.int64()),
        ("chunk_no", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()),
    ])

    def number(urn: str) -> int | None:
        digits = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def chunks(source: pa.NativeFile, offset: int, length: int) -> Iterator[dict]:
        m = _Member(source, offset, length, chunk_bytes)
        head = _fields(m.until(_EOL * 2))
        http = m.until(_EOL * 2)
        payload = int(_fields(http)["content-length"])
        revisit = head["warc-type"] == "revisit"
        left = int(head["content-length"]) - len(http) - 4
        row = {
            "page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
            "refers_to": number(head["warc-refers-to"]) if revisit else None, "header_digest": head["warc-payload-digest"].removeprefix("sha256:"), "header_bytes": payload,
        }
        digest, seen, no = hashlib.sha256(), 0, 0
        while True:
            data = m.take(min(left, chunk_bytes))
            left -= len(data)
            seen += len(data)
            digest.update(data)
            yield row | {"chunk_no": no, "data": data if with_data else None, "bytes_so_far": seen, "digest_so_far": digest.hexdigest(), "last": left == 0}
            no += 1
            if not left:
                break
        if m.take(4) != _EOL * 2:
            raise ValueError("a record does not end where it says")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, out, held = None, None, [], 0
        for batch in batches:
            for at in batch.to_pylist():
                if at["file"] != name:
                    if source is not None:
                        source.close()
                    fs, inner = _open(at["file"])
                    name, source = at["file"], fs.open_input_file(inner)
                for row in chunks(source, at["offset"], at["length"]):
                    out.append(row)
                    held += len(row["data"] or b"") + 200
                    if held > (4 << 20):
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, held = [], 0
        if source is not None:
            source.close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    spread = manifest.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, header_digest string, header_bytes long, chunk_no int, data binary, bytes_so_far long, digest_so_far string, last boolean")


def round_trip(pages: DataFrame, *, min_dedup_bytes: int = 100, chunk_bytes: int = 1 << 18) -> DataFrame:
    """Write every page as a WARC record, read the archives back, and report each record.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A null
    html is an empty payload; a null url is left out of the record; a row with a
    null page_id is always a response; repeated rows give a record each (equal
    page_ids never refer to each other); an empty table gives no rows; further
    columns are ignored.
    """
    spark = pages.sparkSession
    manifest = write_archives(chunk_rows(plan_records(pages, min_dedup_bytes), chunk_bytes), scratch_path(spark, "warc"))
    last = read_chunks(manifest, chunk_bytes=chunk_bytes, with_data=False).where("last")
    whole = F.col("record_type") == "response"
    # a revisit holds the size and digest of the payload it repeats in its headers
    return last.select(
        "page_id", F.when(whole, F.col("bytes_so_far")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("digest_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
