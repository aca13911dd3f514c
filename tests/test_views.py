from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import scratch
from quarry.functions import text as tx
from quarry.operators import chats, library_view, mapping, retrieval, web
from quarry.plans import vectors, web_pages
from quarry.sources import tables

T0 = datetime(2024, 1, 1)
MSG = "chat_id string, id string, sender string, text string, timestamp timestamp"


def msgs(spark, rows):
    return spark.createDataFrame([(c, str(i), s, t, T0 + timedelta(minutes=i)) for i, (c, s, t) in enumerate(rows)], MSG)


def test_titles_and_activity(spark):
    m = msgs(spark, [("a", "bot", "hello"), ("a", "user", "x" * 50), ("b", "user", "y" * 51), ("c", "user", "New Chat"), ("c", "user", "hi"), ("d", "bot", "only"), ("a", "bot", "late")])
    assert {r.chat_id: r.title for r in chats.titles(m).collect()} == {"a": "x" * 50, "b": "y" * 50 + "...", "c": "hi", "d": "New Chat"}
    rooms = spark.createDataFrame([(c, T0) for c in "abcde"], "id string, created_at timestamp")
    at = lambda by: {r.id: int((r.last_activity - T0).total_seconds() // 60) for r in chats.activity(m, rooms, by).collect()}
    assert at("user") == {"a": 1, "b": 2, "c": 4, "d": 0, "e": 0} and at("any") == {"a": 6, "b": 2, "c": 4, "d": 5, "e": 0}


def test_pairs_and_last(spark):
    m = msgs(spark, [("a", "user", "q1"), ("a", "user", "q2"), ("a", "bot", "r2"), ("a", "bot", "r3"), ("b", "bot", "x")])
    assert [(r.question, r.answer) for r in chats.pairs(m).collect()] == [("q2", "r2")]
    assert {r.chat_id: r.message_id for r in chats.last_shown(m).collect()} == {"a": "1", "b": "4"}


def test_newest_limit(spark):
    df = spark.createDataFrame([("u", f"{i:03}", T0 + timedelta(minutes=i // 2)) for i in range(80)], "user_id string, id string, updated_at timestamp")
    got = [r.id for r in chats.newest(df).orderBy("position").collect()]
    assert len(got) == 50 and got[:3] == ["078", "079", "076"]
    assert chats.newest(df, n=None).count() == 80


def test_uploads_and_pages(spark):
    schema = "id string, user_id string, status string, uri string, date_added string, created_at timestamp"
    items = spark.createDataFrame([("1", "u", "Ready", "g1", "2024-01-02", T0)], schema)
    up = spark.createDataFrame([("2", "u", "Uploading", "g1", "2024-01-03", T0), ("3", "u", "Uploading", "g2", "2024-01-02T05:00:00", T0), ("4", "u", "Uploading", None, "2024-01-03", T0), ("5", "u", "Error", "g9", "2024-01-03", T0)], schema)
    assert [r.id for r in library_view.merge_uploads(items, up).collect()] == ["3", "1"]
    many = spark.createDataFrame([(f"{i:02}", "u", "Ready", None, None, T0 + timedelta(days=i)) for i in range(23)], schema)
    ask = lambda n: [r.id for r in library_view.page(many, n).orderBy(F.desc("created_at")).collect()]
    assert len(ask(1)) == 10 and ask(3) == ask(99) == ["02", "01", "00"] and ask(0) == ask(1)


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.pasted_file_name(F.lit(" a b/c "))) == "a_b_c.txt" and one(tx.pasted_file_name(F.lit(" "))) == "pasted-text.txt" and one(tx.pasted_file_name(F.lit("x" * 60))) == "x" * 50 + ".txt"
    assert one(tx.upload_object_name(F.lit("é a.pdf"), F.lit(1))).endswith("-__a.pdf") and one(tx.upload_object_name(F.lit(""), F.lit(1))) is None
    assert one(tx.url_lines(F.lit(" a \n\n b\r\na"))) == ["a", "b", "a"]
    assert one(tx.scraped_file_name(F.lit("http://h/d/p.html"))) == "p.txt"
    assert [one(tx.is_web_url(F.lit(u))) for u in ("http://h", "HTTPS://h/x?y", "http:///x", "ftp://h", "h", "http://h /x")] == [True, True, False, False, False, False]


@pytest.mark.parametrize("values", [24, 4_000_000])
def test_vector_search_blocks(spark, monkeypatch, values):
    monkeypatch.setattr(retrieval, "BLOCK_VALUES", values)
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 8))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 8)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(i, "general_qa", x[i].tolist()) for i in range(12)], "query_id long, query_type string, embedding array<float>")
    twin = q.crossJoin(c.withColumnRenamed("embedding", "e")).select("query_id", "chunk_id", retrieval.cosine(F.col("embedding"), F.col("e")).alias("s")).where("s >= 0.5")
    want = {}
    for t in sorted(twin.collect(), key=lambda t: (t.query_id, -t.s)):
        want.setdefault(t.query_id, []).append(t.chunk_id)
    got = {}
    for t in sorted(retrieval.vector_search(q, c, limit=3).collect(), key=lambda t: (t.query_id, t.rank)):
        got.setdefault(t.query_id, []).append(t.chunk_id)
    assert got == {k: v[:3] for k, v in want.items()}


def test_standardise_and_pca(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 5)) * [1, 5, 2, 0, 3] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    z = np.array([r.embedding for r in mapping.standardise(df).orderBy("vec_id").collect()])
    s = x.std(axis=0)
    s[3] = 1
    assert np.allclose(z, (x - x.mean(axis=0)) / s)
    got = np.array([r.coords for r in mapping.pca(df).orderBy("vec_id").collect()])
    u, d, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = u[:, :3] * d[:3] * np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])
    assert np.allclose(got, want)
    assert mapping.pca(df.limit(1)).first().coords == [0.0]


def test_tiles_do_not_change_neighbours(spark):
    x = np.random.default_rng(2).normal(size=(50, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, mapping.knn_graph(df, k=5, tile=t).collect())) for t in (1000, 9))
    assert one == many


def test_neighbours_are_those_of_all_pairs(spark, monkeypatch):
    """Equal vectors, zeros, ids as texts, lists longer than the table, and blocks and tiles of any size."""
    monkeypatch.setattr(mapping, "_TILE", 16)
    r = np.random.default_rng(7)
    x = r.normal(size=(70, 5))
    x[10:40] = x[3]
    x[50] = 0
    names = [f"v{i}" for i in r.permutation(70)]
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = np.round(1 - u @ u.T, 9) + 0.0
    np.fill_diagonal(d, 0)
    df = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)], "vec_id string, embedding array<double>")
    for k, own, tile in ((6, True, 25), (6, False, 25), (100, True, None), (1, False, 70)):
        others = {a: sorted((d[i, j], names[j] != a, names[j]) for j in range(70) if own or i != j)[:k] for i, a in enumerate(names)}
        want = sorted((a, n, dist, rank) for a, best in others.items() for rank, (dist, _, n) in enumerate(best, 1))
        got = sorted(map(tuple, mapping.knn_graph(df, k=k, include_self=own, tile=tile).collect()))
        assert [(a, n, r) for a, n, _, r in got] == [(a, n, r) for a, n, _, r in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_all_pairs_shuffle_no_vector_twice(spark):
    """What travels must not grow with the number of tiles, as disk would with the square of the rows."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(2).normal(size=(60, 6)))], "vec_id long, embedding array<double>")
    plan = mapping.knn_graph(df, k=5, tile=10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CoGroup" not in plan


def test_fuzzy_weights_read_written_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mapping, "_BLOCK_VALUES", 10 * 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(2).normal(size=(40, 6)))], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    weights = vectors.QUERIES["v5_fuzzy_weights"](spark, str(tmp_path))
    assert "CoGroup" not in weights._jdf.queryExecution().executedPlan().toString()
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = ({(int(a), int(b)): w for a, b, w in f[["a", "b", "weight"]].itertuples(index=False)} for f in (weights.toPandas(), duck.sql(vectors.ORACLES["v5_fuzzy_weights"]).df()))
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in got)


def test_lsh_graph_finds_most(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(20, 16))[r.integers(0, 20, 300)] + 0.2 * r.normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    exact, found = ({(t.vec_id, t.neighbour) for t in g.collect()} for g in (mapping.knn_graph(df, k=5, include_self=False), mapping.knn_graph_lsh(df, k=5)))
    assert len(exact & found) > 0.9 * len(exact)


def test_descent_finds_most_with_hubs_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mapping, "_MEET", 8)
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(20, 16))[r.integers(0, 20, 400)] + 0.5 * r.normal(size=(400, 16)), r.normal(size=(200, 16))])
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>")
    exact = {(t.vec_id, t.neighbour): t.distance for t in mapping.knn_graph(df, k=6).collect()}
    got = mapping.knn_descent(df, k=6).collect()
    found = {(t.vec_id, t.neighbour): t.distance for t in got}
    assert len(exact.keys() & found.keys()) > 0.95 * len(exact)
    assert all(abs(found[p] - exact[p]) < 1e-8 for p in exact.keys() & found.keys())
    assert len(found) == len(got) == 6 * 600 and all(t.neighbour == t.vec_id for t in got if t.rank == 1)
    assert sorted(map(tuple, mapping.knn_descent(df.repartition(3), k=6).collect())) == sorted(map(tuple, got))


def test_descent_on_the_given_vectors(spark, sf_dir):
    exact, found = ({(t.vec_id, t.neighbour) for t in vectors.QUERIES[q](spark, sf_dir).collect()} for q in ("v4_neighbours", "v4_neighbour_descent"))
    assert len(exact & found) >= 0.9 * len(exact) and len(found) == len(exact)


def test_layout_by_levels_over_the_descent(spark, monkeypatch):
    monkeypatch.setattr(mapping, "_COARSEST", 60)
    monkeypatch.setattr(mapping, "_EXACT", 0)
    r = np.random.default_rng(3)
    x = r.normal(size=(8, 32))[r.integers(0, 8, 400)] * 3 + r.normal(size=(400, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    c = np.array([row.coords for row in mapping.layout(df).orderBy("vec_id").collect()])
    near = lambda m: np.argsort(((m[:, None] - m[None]) ** 2).sum(axis=2), axis=1)[:, 1:16]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    kept = np.mean([len(set(a) & set(b)) for a, b in zip(near(u), near(c), strict=True)])
    print("kept by levels", kept)
    assert c.shape == (400, 3) and np.isfinite(c).all() and kept > 4


def test_layout_keeps_no_vectors_and_sends_no_table(spark, monkeypatch):
    """What stays written behind a map are keys and places, and joins shuffle what grows with the rows however small Spark takes it to be."""
    monkeypatch.setattr(mapping, "_COARSEST", 60)
    monkeypatch.setattr(mapping, "_BLOCK_VALUES", 100 * 16)
    held, plans = {}, []

    def noted(df, tag):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        out = scratch.materialize(df, tag)
        held[out.scratch_path] = df.columns
        return out

    monkeypatch.setattr(mapping, "materialize", noted)
    monkeypatch.setattr(mapping, "release", lambda *tables: [held.pop(t.scratch_path, scratch.release(t)) for t in tables])
    x = np.random.default_rng(8).normal(size=(250, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        out = mapping.layout(df)
        plans.append(out._jdf.queryExecution().sparkPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert out.count() == 250 and [c for c in held.values() if {"v", "weight"} & set(c)] == []
    sent = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert sent and [line for line in sent if "__bucket" not in line] == []


def test_layout_of_a_graph_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(mapping, "_COARSEST", 3)
    x = np.repeat(np.eye(12), 20, axis=0) + 0.001 * np.random.default_rng(1).normal(size=(240, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    c = np.array([row.coords for row in mapping.layout(df).orderBy("vec_id").collect()])
    assert c.shape == (240, 3) and np.isfinite(c).all()


def test_weights(spark):
    d = np.array([0.1, 0.2, 0.4, 0.9])
    w = mapping.smooth(d, 4)
    assert w[0] == 1 and w.sum() == pytest.approx(2, abs=1e-6) and (np.diff(w) <= 0).all()
    g = spark.createDataFrame([(1, 2, 0.1, 1), (1, 3, 0.5, 2), (2, 1, 0.1, 1), (2, 3, 0.3, 2), (3, 2, 0.3, 1), (3, 1, 0.5, 2)], "vec_id long, neighbour long, distance double, rank int")
    e = {(r.a, r.b): r.weight for r in mapping.fuzzy_weights(g, 3).collect()}
    assert set(e) == {(1, 2), (1, 3), (2, 3)} and all(0 < x <= 1 for x in e.values()) and e[1, 2] == 1


def test_layout_keeps_neighbours(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.normal(size=(8, 32))[r.integers(0, 8, 400)] * 3 + r.normal(size=(400, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = mapping.map_all(df)
    c = np.array([(r.x, r.y, r.z) for r in out.orderBy("vec_id").collect()])
    assert np.abs(c).max() == pytest.approx(10)
    near = lambda m: np.argsort(((m[:, None] - m[None]) ** 2).sum(axis=2), axis=1)[:, 1:16]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    kept = np.mean([len(set(a) & set(b)) for a, b in zip(near(u), near(c), strict=True)])
    chance = np.mean([len(set(a) & set(b)) for a, b in zip(near(u), near(r.normal(size=c.shape)), strict=True)])
    assert kept > 4 * chance
    assert np.allclose(c, np.array([(r.x, r.y, r.z) for r in mapping.map_all(df.repartition(5)).orderBy("vec_id").collect()]))
    assert mapping.map_all(df.limit(0)) is None
    few = mapping.map_all(df.limit(5)).collect()
    assert len(few) == 5
    path = str(tmp_path / "coords")
    assert tables.write_coordinates(out, path) and not tables.write_coordinates(None, path) and tables.read_coordinates(spark, path).count() == 400


def test_layout_places_a_small_group_beside_a_large_one(spark):
    r = np.random.default_rng(5)
    # the small groups are the rows that any sample of 2,000 by this hash leaves out
    last = [row.id for row in spark.range(2624).orderBy(F.xxhash64("id", F.lit(42)), "id").collect()][-24:]
    group = np.zeros(2624, dtype=int)
    group[last[:12]], group[last[12:]] = 1, 2
    x = np.eye(16)[group] * 6 + 0.3 * r.normal(size=(2624, 16))
    one, two = np.flatnonzero(group == 0)[:2]
    x[two] = x[one]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    c = np.array([row.coords for row in mapping.layout(df).orderBy("vec_id").collect()])
    assert c.shape == (len(x), 3) and (c[one] == c[two]).all() and len(np.unique(c, axis=0)) == len(x) - 1
    for g in (1, 2):
        for i in np.flatnonzero(group == g):
            near = np.argsort(((c - c[i]) ** 2).sum(axis=1))[1:6]
            assert (group[near] == g).mean() >= 0.8


def test_scaling(spark):
    df = spark.createDataFrame([(1, [1.0, -4.0]), (2, [0.0, 2.0])], "vec_id long, coords array<double>")
    assert sorted(map(tuple, mapping.scale(df).collect())) == [(1, 2.5, -10.0, 0.0), (2, 0.0, 5.0, 0.0)]
    assert list(mapping.scale(df.select("vec_id", F.array(F.lit(0.0)).alias("coords"))).first()) == [1, 0.0, 0.0, 0.0]


def test_main_content():
    page = "<html><body><nav>n</nav><div class='x content'><p> a <b>b</b></p><script>s</script><!-- c --><style>t</style>c</div><article>art</article></body></html>"
    assert web.main_content(page, web.site(".x")) == (0, "a\nb\nc")
    assert web.main_content(page, web.site("#none")) == (2, "art")
    assert web.main_content(page.replace("article", "section"), web.site("main")) == (3, "a\nb\nc")
    assert web.main_content("<p>t</p>", [("article", "", "")]) == (None, None) and web.main_content(None, web.site("p")) == (None, None)
    assert web.main_content("<div id=a><img class=x>q</div>", web.site("#a")) == (0, "q")


def test_references_without_a_semicolon():
    page = "<article><h1>a &amp</h1>b &amp; &#39;x&#x41; &copy &am<p title='?a=1&lt=2'>&quot</p>&bogus; &ampx; R&D &</article>"
    assert web.main_content(page, web.site("article"), closed=True) == (0, "a &amp\nb & 'xA &copy &am\n&quot\n&bogus; &ampx; R&D &")
    assert web.main_content(page, web.site("article")) == (0, "a &\nb & 'xA © &am\n\"\n&bogus; &x; R&D &")


@pytest.mark.parametrize("name", ["h1_h2_main_content", "h3_site_selectors", "s6_saved_pages"])
def test_cut_references_as_in_sql(spark, tmp_path, name):
    html = "<title>t</title><article><h1>one &amp</h1>two &amp; three &quot</article>"
    duck = duckdb.connect()
    duck.execute(f"copy (select * from (values (1, 'http://h/a.html', '{html}'), (2, 'http://h/b', '{html}')) t(page_id, url, html)) to '{tmp_path}/pages.parquet'")
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    got, want = web_pages.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.sql(web_pages.ORACLES[name]).df()
    assert sorted(map(tuple, got[list(want)].values.tolist())) == sorted(map(tuple, want.values.tolist()))


@pytest.mark.parametrize("name", ["h4_pages_to_chunks", "h4_summary"])
def test_pages_of_one_url_as_in_sql(spark, tmp_path, name):
    """Pages 1, 2 and 3 are of one url, as are 9 (known) and 10, and 7 (failed) and 8."""
    text = lambda *words: "<title>t &amp</title><article>" + " ".join(words) + "</article>"
    long = [f"w{i % 97}" for i in range(1500)]
    pages = [(1, "u1", text(*long)), (2, "u1", text("w1", "w2", "x &amp")), (3, "u1", text(*long, "y")), (9, "u9", text("a")), (10, "u9", text("b", "c")), (7, "u7", text("d")), (8, "u7", text("e")), (11, "u11", text("f", "g")), (4, "u4", "<title>z</title><article></article>")]
    duck = duckdb.connect()
    duck.execute("create table pages(page_id bigint, url varchar, html varchar)")
    duck.executemany("insert into pages values (?, ?, ?)", pages)
    duck.execute(f"copy pages to '{tmp_path}/pages.parquet'")
    got, want = web_pages.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.sql(web_pages.ORACLES[name]).df()
    assert sorted(map(tuple, got[list(want)].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_captures(spark):
    a = spark.createDataFrame([("u1", "ok", "A", None), ("u2", "error", None, "e1"), ("u3", "error", None, "e2")], "url string, status string, content string, error string")
    b = spark.createDataFrame([("u2", "ok", "B", None), ("u3", "error", None, "e3"), ("u4", "ok", "D", None)], a.schema)
    assert sorted((r.url, r.status, r.content, r.error) for r in web.choose_capture(a, b).collect()) == [("u1", "ok", "A", None), ("u2", "ok", "B", None), ("u3", "error", None, "e2; e3"), ("u4", "ok", "D", None)]
    assert {r.status: (r.n, r.total) for r in web.scrape_summary(a).collect()} == {"ok": (1, 3), "error": (2, 3)}
    assert [tuple(r) for r in web.saved_pages(a).collect()] == [("u1", "u1", "URL: u1\n\nA")]
