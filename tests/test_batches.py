"""Texts of a batch become Python's a few at a time, however many rows a batch holds."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import embedding, web


class Seen:
    """A frame that hands its Python function one batch and keeps what it yields."""

    def __init__(self, df, batch):
        self.df, self.batch = df, batch

    def __getattr__(self, name):
        return getattr(self.df, name)

    def drop(self, *names):
        return self

    def select(self, *columns):
        return Seen(self.df.select(*columns), self.batch) if any(isinstance(c, str) and c == "html" for c in columns) else self.df.select(*columns)

    def mapInArrow(self, run, schema):
        self.made.extend(run(iter([self.batch])))
        return self.df.mapInArrow(run, schema)


def test_large_batches(spark):
    n = 3000
    Seen.made = []
    pages = spark.createDataFrame([("u", "<main>t</main>")], "url string, html string")
    batch = pa.RecordBatch.from_pydict({"url": ["u"] * n, "html": [f"<main>t{i}</main>" for i in range(n - 1)] + [None], "__site": ["default"] * n})
    assert web.extract_content(Seen(pages, batch), {"default": web.site("main")}).first().content == "t"
    assert max(map(len, Seen.made)) <= 256 and sum(map(len, Seen.made)) == n
    content = [t for b in Seen.made for t in b.column("content").to_pylist()]
    assert content == [f"t{i}" for i in range(n - 1)] + [None]
    Seen.made = []
    texts = spark.createDataFrame([(1, "a b")], "id int, text string")
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(n), pa.int32()), "text": ["a b c"] * (n - 1) + [None]})
    assert len(embedding.embed(Seen(texts, batch), errors=True).first().embedding) == 768
    assert max(map(len, Seen.made)) <= 256 and sum(map(len, Seen.made)) == n
    assert np.allclose([sum(x * x for x in b.column("embedding")[0].as_py()) for b in Seen.made], 1)


def test_texts_of_a_stream_are_not_held_in_memory(spark, tmp_path, monkeypatch):
    from quarry.streaming import tasks

    monkeypatch.setattr("pyspark.sql.DataFrame.persist", lambda self, *a: (_ for _ in ()).throw(AssertionError("held in memory")))
    body = '{"task_id":"a","task_type":"text_processing","input_data":{"content":"x y"}}'
    spark.range(1).select(F.concat(F.lit('{"message":{"data":"'), F.base64(F.encode(F.lit(body), "UTF-8")), F.lit('"}}')).alias("value"), F.lit("2024-01-01").cast("timestamp").alias("ts")).write.parquet(f"{tmp_path}/in")
    pages = spark.createDataFrame([], "url string, html string")
    tasks.task_stream(spark.readStream.schema("value string, ts timestamp").parquet(f"{tmp_path}/in"), pages, {"default": web.site("main")}, f"{tmp_path}/out", buckets=2).awaitTermination()
    made = tasks.TaskTables.at(spark, f"{tmp_path}/out", buckets=2)
    assert [r.text for r in made.chunks.read().collect()] == ["x y"]
    assert sorted(r.status for r in made.status.read().collect()) == ["completed", "processing"]
