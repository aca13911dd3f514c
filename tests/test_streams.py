import base64
import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import ingest, web
from quarry.sources.versions import Versions
from quarry.streaming import ingest as stream, queue, state, tasks
from quarry.streaming.keylog import KeyedLog

T0 = datetime(2024, 1, 1)
EVENT = "value string, ts timestamp"


def test_envelopes_and_routes(spark):
    body = json.dumps({"task_id": "1", "task_type": "text_processing", "input_data": {"content": "é"}})
    wrap = lambda data, **more: json.dumps({"message": {"data": data, **more}})
    rows = [body, wrap(base64.b64encode(body.encode()).decode(), attributes={"a": "b"}), wrap("%%%"), "{", wrap(base64.b64encode(b"\xff").decode()), '{"task_type":"file_processing"}', '{"task_type":"zzz"}', '{"task_type":"url_processing"}', "[]", None]
    out = [(r.route, r.error) for r in queue.route(queue.decode(spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1))).collect()]
    bad = ("none", "invalid message")
    assert out == [("text", None), ("text", None), bad, bad, bad, ("none", "file_processing is not yet implemented"), ("none", "unknown task type: zzz"), ("urls", None), bad, bad]
    got = queue.decode(spark.createDataFrame([(rows[1],)], "value string")).first()
    assert json.loads(got.input_data) == {"content": "é"} and got.attributes == {"a": "b"}


def files(spark, tmp_path, batches, schema, name="in"):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))


def test_ingest_stream_equals_batch(spark, tmp_path):
    ev = lambda n, g: (json.dumps({"bucket": "raw", "name": n, "generation": g}), T0 + timedelta(minutes=g))
    batches = [[ev("a.txt", 1), ev("b.pdf", 1), ev("a.txt", 1)], [ev("a.txt", 1), ev("a.txt", 2), ev("c.bin", 1)], [ev("b.pdf", 1), ev("gone.txt", 1)]]
    kind = "name string, generation long, metadata map<string,string>, text string, pages array<struct<page:int,header:string,body:string>>, failure string"
    objects = spark.createDataFrame([("a.txt", 1, {}, "one two three", None, None), ("a.txt", 2, {}, "four", None, None), ("b.pdf", 1, {}, None, [(1, None, "p")], None), ("c.bin", 1, {}, None, None, None)], kind)
    root = str(tmp_path / "out")
    q = stream.ingest_stream(files(spark, tmp_path, batches, EVENT), objects, root, "raw", max_tokens=2, overlap=0)
    q.awaitTermination()
    flat = spark.createDataFrame([e for b in batches for e in b], EVENT)
    want = ingest.run_batch(stream.events_with_content(flat, objects, "raw"), spark.createDataFrame([], schemas.REGISTRY), spark.createDataFrame([], schemas.CHUNKS), F.lit(T0), max_tokens=2, overlap=0)
    pick = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    made = stream.Tables.at(spark, root)
    reg, chunks = made.registry.before(10**9), made.chunks.before(10**9)
    assert pick(reg, "id", "status") == pick(want[0], "id", "status") and reg.count() == 4
    assert pick(chunks, "doc_id", "chunk_index", "text") == pick(want[1], "doc_id", "chunk_index", "text")
    assert pick(made.rejected.before(10**9), "path", "generation", "reason") == [("gs://raw/gone.txt", 1, "object not found")]


KIND = "name string, generation long, metadata map<string,string>, text string, pages array<struct<page:int,header:string,body:string>>, failure string"


def said(name, generation, bucket="raw"):
    return json.dumps({"bucket": bucket, "name": name, "generation": generation})


def ran(spark, tmp_path, batches, objects, **given):
    """The tables after one run of the stream for each list of ``(value, ts)`` events."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        events = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stream.ingest_stream(events, objects[min(i, len(objects) - 1)], str(tmp_path / "out"), "raw", buckets=4, max_tokens=2, overlap=0, **given).awaitTermination()
    return stream.Tables.at(spark, str(tmp_path / "out"), buckets=4)


def test_only_accepted_events_use_up_a_key(spark, tmp_path):
    """Another bucket's event and a rejected one first, then the valid ones; one long after all others by its time."""
    objects = spark.createDataFrame([(f"{x}.txt", 1, {}, x, None, None) for x in "abc"], KIND)
    old = T0 - timedelta(days=900)
    first = [(said("a.txt", 1, "other"), T0), (said("b.txt", 0), T0), (said("b.txt", "1x"), T0), (said("x.txt", 1, "other"), T0 + timedelta(days=30))]
    made = ran(spark, tmp_path, [first, [(said("a.txt", 1), T0), (said("b.txt", 1), T0), (said("c.txt", 1), old)], [(said("c.txt", 1), old), (said("a.txt", 1), T0)]], [objects])
    assert sorted((r.original_path, r.status) for r in made.registry.read().collect()) == [(f"gs://raw/{x}.txt", "Ready") for x in "abc"]
    assert made.chunks.read().count() == 3 and made.rejected.read().count() == 0


def test_embedding_faults_of_a_stream(spark, tmp_path):
    def picky():
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[1.0]] * len(texts)

        return model

    objects = spark.createDataFrame([("a.txt", 1, {}, "fine", None, None), ("b.txt", 1, {}, "one two bad", None, None)], KIND)
    made = ran(spark, tmp_path, [[(said("a.txt", 1), T0), (said("b.txt", 1), T0)]], [objects], embedder=picky, width=1)
    assert sorted((r.original_path, r.status, r.error_message) for r in made.registry.read().collect()) == [("gs://raw/a.txt", "Ready", None), ("gs://raw/b.txt", "Failed", "RuntimeError: no")]
    assert [r.text for r in made.chunks.read().collect()] == ["fine"]


def test_object_that_comes_later(spark, tmp_path):
    none = spark.createDataFrame([], KIND)
    there = spark.createDataFrame([("a.txt", 1, {}, "one", None, None)], KIND)
    event = [(said("a.txt", 1), T0), (said("a.txt", 1), T0)]
    made = ran(spark, tmp_path, [event, event, event], [none, there])
    assert [(r.path, r.reason, r.batch) for r in made.rejected.read().collect()] == [("gs://raw/a.txt", "object not found", 0)]
    assert [(r.original_path, r.status, r.batch) for r in made.registry.read().collect()] == [("gs://raw/a.txt", "Ready", 1)]


def test_redelivery_after_the_retention_meets_the_registry(spark, tmp_path):
    """The key is forgotten at once, so only the registry can stop the repeats."""
    objects = spark.createDataFrame([("a.txt", 1, {}, "one", None, None)], KIND)
    made = ran(spark, tmp_path, [[(said("a.txt", 1), T0)]] * 3, [objects], retention=timedelta(milliseconds=1))
    assert made.registry.read().count() == 1 and made.chunks.read().count() == 1


def test_once_forgets_after_the_retention(spark, tmp_path):
    import time

    def keys(i, retention):
        spark.createDataFrame([("k", False), ("k", False), ("m", True), ("m", True)], "k string, missing boolean").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        rows = spark.readStream.schema("k string, missing boolean").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = queue.drop_redelivered(rows, keys=("k",), retention=retention, unless="missing")
        state.start(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")), spark, None).awaitTermination()
        found = [r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        return found.count("k"), found.count("m")

    assert keys(0, timedelta(seconds=1)) == (1, 2)
    time.sleep(1.5)
    assert keys(1, timedelta(days=7)) == (2, 4)
    assert keys(2, timedelta(days=7)) == (2, 6)


def test_dead_letters_of_a_stream(spark, tmp_path):
    """Once, on the fifth failure; successes do not count, and a forgotten key starts anew."""
    import time

    def letters(i, rows, retention=timedelta(days=7)):
        spark.createDataFrame(rows, "task_id string, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        deliveries = spark.readStream.schema("task_id string, ok boolean").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = queue.dead_letters(deliveries, retention=retention)
        state.start(out.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")), spark, None).awaitTermination()
        return sorted((r.task_id, r.attempts) for r in spark.read.schema("task_id string, attempts long").json(str(tmp_path / "out")).collect())

    assert letters(0, [("a", False)] * 4 + [("b", False)] * 6 + [("c", True)] * 9) == [("b", 5)]
    assert letters(1, [("a", False), ("a", None), ("b", False)], timedelta(seconds=1)) == [("a", 5), ("b", 5)]
    time.sleep(1.5)
    assert letters(2, [("z", True)]) == [("a", 5), ("b", 5)]
    assert letters(3, [("a", False)] * 5) == [("a", 5), ("a", 5), ("b", 5)]


def test_log_reads_touched_buckets_and_merges(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), schemas.REJECTED, ["path", "generation"], buckets=8, merge_after=2)
    rows = lambda *names: spark.createDataFrame([(n, 1, "r") for n in names], schemas.REJECTED)
    assert log.read().count() == 0 and log.before(5, rows("a")).count() == 0
    for batch in range(3):
        assert not log.merge(batch)
        log.write(rows(*[f"p{batch}-{i}" for i in range(40)]), batch)
    log.write(rows("p2-0", "late"), 2)  # a repeated batch replaces what it wrote
    near = rows("p1-7")
    found = log.before(9, near)
    files = lambda df: {r[0].rsplit("/", 2)[1] for r in df.select(F.input_file_name()).distinct().collect()}
    assert len(files(found)) == 1 and found.where("path = 'p1-7'").count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    before = sorted(r.path for r in log.before(3).collect())
    log.write(rows("cut short"), 3)  # of a batch that died; it runs again after the merge
    assert log.merge(3) and sorted(r.path for r in log.before(9).collect()) == before and len(before) == 82
    log.write(rows("new"), 3)
    assert sorted(r.path for r in log.before(9).collect()) == sorted([*before, "new"]) and {r.batch for r in log.read().select("batch").distinct().collect()} == {2, 3}
    assert len(files(log.before(9, near))) == 1


def test_versions_survive_a_failed_write(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    assert table.read("x long").count() == 0
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.range(3))
    with pytest.raises(Exception, match="half-way"):
        table.replace(spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).alias("id")))
    assert table.read().count() == 3
    (tmp_path / "t/_versions/000000000001").write_bytes(b"")  # a writer that died before it named its folder
    assert table.read().count() == 3
    reader = table.read()
    assert table.replace(spark.range(5)) == 2 and table.read().count() == 5 and reader.count() == 3
    table.replace(spark.range(6))
    assert [n for n, _ in table.log()] == [2, 3] and table.read().count() == 6


def test_status_stream_equals_batch(spark, tmp_path):
    schema = "task_id string, status string, error string, ts timestamp, seq long"
    batches = [[("t", "processing", None, T0, 1), ("u", "processing", None, T0, 1)], [("t", "failed", "e", T0 + timedelta(1), 2)], [("t", "completed", None, T0 + timedelta(1), 3)]]
    q = queue.current_status(files(spark, tmp_path, batches, schema)).writeStream.outputMode("complete").format("memory").queryName("status").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("status").select("task_id", "status", "error").collect()))
    assert got == [("t", "completed", None), ("u", "processing", None)]
    assert got == sorted(map(tuple, queue.current_status(spark.createDataFrame([r for b in batches for r in b], schema)).select("task_id", "status", "error").collect()))


def test_dead_letters(spark, tmp_path):
    d = spark.createDataFrame([("a", False)] * 5 + [("b", False)] * 4 + [("b", True)], "task_id string, ok boolean")
    live, dead = queue.split_dead(d)
    assert [tuple(r) for r in dead.collect()] == [("a", 5)] and [r.task_id for r in live.collect()] == ["b"]
    src = files(spark, tmp_path, [[("x", T0)], [("y", T0)]], "value string, ts timestamp")
    queue.write_dead_letters(src, str(tmp_path / "dead"), str(tmp_path / "cp"), every=None).awaitTermination()
    assert sorted(r.value for r in spark.read.json(str(tmp_path / "dead")).collect()) == ["x", "y"]


def test_dead_letters_roll_by_bytes(spark, tmp_path):
    rows = [("é" * (i % 50), i) for i in range(300)] + [("x" * 5000, 1000)]
    path = str(tmp_path / "dead")
    for again in range(2):  # a repeated batch replaces its files
        src = files(spark, tmp_path, [rows], "value string, n long") if not again else src
        queue.write_dead_letters(src, path, str(tmp_path / f"cp{again}"), every=None, prefix="gone", suffix=".jsonl", most_bytes=1000).awaitTermination()
        found = sorted((tmp_path / "dead").iterdir())
        assert all(re.fullmatch(r"gone-0{10}-\d{5}-\d{5}\.jsonl", f.name) for f in found) and len(found) > 10
        long = [f for f in found if f.stat().st_size > 1000]
        assert len(long) == 1 and long[0].read_text().count("\n") == 1
        assert all(a.stat().st_size + len(b.read_bytes().split(b"\n")[0]) + 1 > 1000 for a, b in zip(found, found[1:]) if a.name[:16] == b.name[:16])
        assert sorted((r.value, r.n) for r in spark.read.schema("value string, n long").json(path).collect()) == sorted(rows)


def test_routes_reach_handlers(spark, tmp_path):
    seen = []
    src = files(spark, tmp_path, [[('{"task_id":"1","task_type":"text_processing"}', T0), ('{"task_id":"2","task_type":"url_processing"}', T0)]], EVENT)
    handlers = {"text": lambda df, n: seen.append(("text", [r.task_id for r in df.collect()])), "urls": lambda df, n: seen.append(("urls", [r.task_id for r in df.collect()]))}
    queue.run_routes(queue.route(queue.decode(src)), handlers, str(tmp_path / "cp")).awaitTermination()
    assert seen == [("text", ["1"]), ("urls", ["2"])]


def test_task_stream_equals_batch(spark, tmp_path):
    """Texts, urls, odd and broken tasks, redelivered ones among them: registry, chunks and status are those of one batch."""
    say = lambda task, kind, **data: json.dumps({"task_id": task, "task_type": kind, "input_data": data})
    page = lambda body: f"<html><title>T</title><article>{body}</article></html>"
    captures = spark.createDataFrame([("http://a/1", page("one two three")), ("http://a/2", "<p>no content</p>"), ("http://a/3", page("x")), ("http://a/9", page("nobody asks"))], "url string, html string")
    sites = {"default": web.site(".main-content", [("article", "", "")])}
    first = [say("t1", "text_processing", content="a b c", title="Mine"), say("t2", "text_processing"), say("u1", "url_processing", urls=["http://a/1", " http://a/2 ", "http://gone/"]), "{broken"]
    second = [say("t1", "text_processing", content="other"), say("t2", "text_processing", content="late"), say("u1", "url_processing", urls=["http://a/1", "http://a/2", "http://gone/"]), say("u2", "url_processing", urls=["http://a/1", "http://a/3"]), say("f", "file_processing"), say("u3", "url_processing")]
    given = {"max_tokens": 2, "overlap": 0, "width": 4}
    for i, rows in enumerate((first, second)):
        spark.createDataFrame([(v, T0 + timedelta(minutes=i)) for v in rows], EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        messages = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        tasks.task_stream(messages, captures, sites, str(tmp_path / "out"), buckets=4, merge_after=1, **given).awaitTermination()
    made = tasks.TaskTables.at(spark, str(tmp_path / "out"), buckets=4)
    flat = spark.createDataFrame([(v, T0) for v in first + second[3:]], EVENT)
    rows, chunks, status = tasks.take_in(queue.route(queue.decode(flat)), captures, sites, spark.createDataFrame([], schemas.REGISTRY), **given)
    pick = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert pick(made.registry.read(), "original_path", "filename", "status", "error_message") == pick(rows, "original_path", "filename", "status", "error_message")
    assert pick(made.chunks.read(), "doc_id", "chunk_index", "text") == pick(chunks, "doc_id", "chunk_index", "text")
    now = pick(queue.current_status(made.status.read()), "task_id", "status", "error")
    assert now == pick(queue.current_status(status), "task_id", "status", "error")
    assert now == [("f", "failed", "file_processing is not yet implemented"), ("t1", "completed", None), ("t2", "failed", "No content provided"), ("u1", "completed", None), ("u2", "completed", None), ("u3", "completed", None)]
    counts = {r.task_id: r.result for r in made.status.read().where("seq = 1 and result is not null").collect()}
    assert counts == {"u1": '{"processed_count":1,"failed_count":2}', "u2": '{"processed_count":2,"failed_count":0}', "u3": '{"processed_count":0,"failed_count":0}'}
