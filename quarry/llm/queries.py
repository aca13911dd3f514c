"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import centroids, chat_windows, cross_polytope, cube_mix, decontaminate, html_density, near_dup, packing, phrases, ppm, token_counts, url_filters, warc_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_windows.digest(chat_windows.windows(turns.unionByName(planted), budget=1024, history=256))


def op2_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, k=5)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.round_trip(_table(spark, sf_dir, "pages"), min_dedup_bytes=100)


def op4_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix(_table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, most=2.0)


def op5_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(_table(spark, sf_dir, "pages"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched over two years against three lists derived from the hosts and paths among them."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("timestamp_seconds(1672531200 + pmod(page_id * 37, 730) * 86400)"))
    seen = pages.select(F.regexp_extract("url", url_filters.HOST, 1).alias("host"), F.regexp_extract("url", url_filters.PATH, 1).alias("path")).where("host <> ''")
    number = "cast(conv(substring(md5({}), 1, 6), 16, 10) as bigint)"
    day = "timestamp_seconds(1672531200 + ({}) * 86400)"
    hosts = seen.select("host").distinct().withColumn("c", F.expr(number.format("host")))
    paths = seen.select(F.concat("host", F.regexp_extract("path", "^/[^/]+", 0)).alias("value")).where("value like '%/%'").distinct().withColumn("c", F.expr(number.format("value")))

    def dated(df: DataFrame, name: str, kind: str, value: str, action: str, when: str) -> DataFrame:
        return df.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), F.expr(value).alias("value"), F.lit(action).alias("action"), F.expr(day.format(when)).alias("at"))

    spam, legal, paused = hosts.where("c % 5 = 0"), hosts.where("c % 7 = 1"), paths.where("c % 3 = 0")
    entries = dated(spam, "spam", "domain", "host", "add", "c % 300")
    entries = entries.unionByName(dated(spam.where("c % 2 = 0"), "spam", "domain", "host", "remove", "c % 300 + 120"))
    entries = entries.unionByName(dated(spam.where("c % 4 = 0"), "spam", "domain", "host", "add", "c % 300 + 300"))
    entries = entries.unionByName(dated(legal, "legal", "host", "host", "add", "c % 500"))
    entries = entries.unionByName(dated(paused, "paused", "prefix", "value", "add", "c % 400")).unionByName(dated(paused, "paused", "prefix", "value", "remove", "c % 400 + 200"))
    found = url_filters.active_lists(captures, entries)
    return found.select("page_id", "url", "host", F.array_join("lists", ",").alias("lists"), "blocked")


def op7_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op8_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ppm.train_packed(docs.where(~ppm.held_out(F.col("doc_id"))))
    found = ppm.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", ppm.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), k=2, similarity=0.8)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    n = token_counts.count_tokens(
        _table(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), ranks=files.path("byte_bpe_50k.tiktoken"), pattern=files.PATTERN
    )
    return n.withColumn("over_limit", F.col("n_tokens") > 1024)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(centroids.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256, salt="2:"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), top=2000, least=10, inside=50)


def op13_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    cut = packing.pieces(_table(spark, sf_dir, "documents"), files.path("word_bpe_49k.json"), capacity=2048, end=0)
    return packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


QUERIES = {f.__name__: f for f in (op1_chat_windows, op2_winnowing_decontamination, op3_warc_round_trip, op4_cube_mix, op5_html_density, op6_url_filters, op7_cross_polytope_search, op8_ppm_language_id, op9_minhash_near_dup, op10_token_counts, op11_centroid_clusters, op12_collocations, op13_pack_sequences)}

_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"

_OP6 = f"""
WITH p AS (SELECT DISTINCT page_id, url, page_id * 37 % 730 AS day, rtrim(lower({_HOST}), '.') AS host, {_PATH} AS path FROM pages),
raw AS (SELECT {_HOST} AS host, {_PATH} AS path FROM pages WHERE {_HOST} <> ''),
h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS c FROM (SELECT DISTINCT host FROM raw)),
x AS (SELECT value, CAST('0x' || substr(md5(value), 1, 6) AS BIGINT) AS c FROM (SELECT DISTINCT host || regexp_extract(path, '^/[^/]+', 0) AS value FROM raw) WHERE value LIKE '%/%'),
e AS (
  SELECT 'spam' AS list, 'domain' AS kind, lower(host) AS value, 1 AS act, c % 300 AS day FROM h WHERE c % 5 = 0
  UNION ALL SELECT 'spam', 'domain', lower(host), 0, c % 300 + 120 FROM h WHERE c % 5 = 0 AND c % 2 = 0
  UNION ALL SELECT 'spam', 'domain', lower(host), 1, c % 300 + 300 FROM h WHERE c % 5 = 0 AND c % 4 = 0
  UNION ALL SELECT 'legal', 'host', lower(host), 1, c % 500 FROM h WHERE c % 7 = 1
  UNION ALL SELECT 'paused', 'prefix', lower(split_part(value, '/', 1)) || substr(value, strpos(value, '/')), 1, c % 400 FROM x WHERE c % 3 = 0
  UNION ALL SELECT 'paused', 'prefix', lower(split_part(value, '/', 1)) || substr(value, strpos(value, '/')), 0, c % 400 + 200 FROM x WHERE c % 3 = 0),
m AS (
  SELECT p.page_id, p.url, e.list, e.kind, e.value, arg_max(e.act, e.day * 2 + e.act) AS act FROM p JOIN e ON e.day <= p.day AND p.host <> '' AND (
    (e.kind = 'host' AND p.host = e.value) OR (e.kind = 'domain' AND (p.host = e.value OR ends_with(p.host, '.' || e.value)))
    OR (e.kind = 'prefix' AND starts_with(p.host || '/' || array_to_string([s for s in string_split(p.path, '/') if s <> ''], '/') || '/', e.value || '/')))
  GROUP BY ALL),
l AS (SELECT page_id, url, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists FROM m WHERE act = 1 GROUP BY ALL)
SELECT p.page_id, p.url, p.host, coalesce(l.lists, '') AS lists, l.lists IS NOT NULL AS blocked FROM p LEFT JOIN l ON l.page_id = p.page_id AND l.url = p.url
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP2 = f"""
WITH d AS (SELECT DISTINCT doc_id, text, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1 : i + 13], ' ') AS g FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, text, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT doc_id, text, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.text, g.i, g.n, win.item_id FROM g JOIN win ON g.n = win.n AND g.g = win.g),
pos AS (SELECT doc_id, text, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, text, i + unnest(range(n)) AS p FROM (SELECT DISTINCT doc_id, text, i, n FROM hit)) GROUP BY ALL),
its AS (SELECT doc_id, text, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY ALL)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id AND d.text = pos.text LEFT JOIN its ON d.doc_id = its.doc_id AND d.text = its.text
"""

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS page FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN page < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page < page_id THEN page END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""

_OP9 = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i + 1 : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reach) AS c FROM r GROUP BY node) m USING (doc_id)
"""

_ESC = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), '#', chr(92) || 'h'), '</turn>', chr(92) || 'l/turn>')"

_OP1 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
a AS (
  SELECT *, (strlen(text) + 3) // 4 + 4 AS tokens, 14 + length({_ESC.format("role")}) + length(replace(role, ':', '::')) - length(role) + length({_ESC.format("text")}) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
b AS (
  SELECT *, CAST(sum(tokens) OVER w AS BIGINT) AS stop, min(CASE WHEN role = 'system' THEN pos END) OVER w AS sp FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
c AS (SELECT b.*, b.stop - b.tokens AS start, greatest(1, 768 - least(coalesce(s.tokens, 0), 512)) AS q, s.chars AS sys_chars FROM b LEFT JOIN a s ON s.conv_id = b.conv_id AND s.pos = b.sp),
d AS (SELECT *, start // q AS k, stop > (start // q + 1) * q AS x FROM c),
e AS (SELECT *, lag(pos) OVER w IS NULL OR (coalesce(sp, 0), k, x) IS DISTINCT FROM (coalesce(lag(sp) OVER w, 0), lag(k) OVER w, lag(x) OVER w) AS opens FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
s AS (SELECT conv_id, pos, start, sys_chars, coalesce(sp < pos, false) AS with_system FROM e WHERE opens),
parts AS (
  SELECT conv_id, sum(chars) AS chars FROM e GROUP BY conv_id
  UNION ALL SELECT conv_id, sum(sys_chars) FROM s WHERE with_system GROUP BY conv_id
  UNION ALL SELECT e.conv_id, sum(e.chars) FROM e JOIN s ON s.conv_id = e.conv_id AND s.pos > e.pos AND s.start - e.start BETWEEN 1 AND 256 WHERE e.sp IS NULL OR e.sp <> e.pos GROUP BY e.conv_id),
f AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM parts GROUP BY conv_id),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
         coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss, count(*) FILTER (opens) AS n_windows FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_windows FROM f JOIN g USING (conv_id)
"""

_OP12 = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM d)),
x AS (SELECT lang, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM (SELECT lang, id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM p) WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, 1 AS k, x AS g, count(*) AS f FROM x GROUP BY ALL UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM x WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM x WHERE z IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (
  SELECT c.lang, c.g, c.k, c.a, j, l.f AS l, r.f AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.k = c.j AND l.g = array_to_string(c.w[1 : c.j], ' ') JOIN f r ON r.lang = c.lang AND r.k = c.k - c.j AND r.g = array_to_string(c.w[c.j + 1 :], ' ')),
s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
held AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, array_to_string(w[1:2], ' ') AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
left_over AS (SELECT s.* FROM s LEFT JOIN held ON s.k = 2 AND held.lang = s.lang AND held.g = s.g WHERE held.a IS NULL OR 100 * held.a < 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase, a, l, r, n, score FROM left_over JOIN n USING (lang) QUALIFY rank <= 2000
"""


def _op11(k: int, rounds: int) -> str:
    """Every round as a table of its own; sums below 2^53 are exact in doubles."""
    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS cluster, q AS c FROM v QUALIFY cluster < {k})"""]
    near = "SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT row, cluster, list_inner_product(q, q) + list_inner_product(c, c) - 2 * list_inner_product(q, c) AS d FROM v, c{}) GROUP BY row"
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        steps.append(f"""m{i} AS MATERIALIZED (SELECT cluster, list(m ORDER BY i) AS m FROM (SELECT cluster, i, floor(sum(x) / count(*)) AS m FROM (SELECT cluster, unnest(q) AS x, unnest(range(64)) AS i FROM a{i} JOIN v USING (row)) GROUP BY ALL) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(rounds)})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (row) JOIN c{rounds} USING (cluster)"""


ORACLES: dict[str, str] = {"op1_chat_windows": _OP1, "op2_winnowing_decontamination": _OP2, "op3_warc_round_trip": _OP3, "op6_url_filters": _OP6, "op9_minhash_near_dup": _OP9, "op11_centroid_clusters": _op11(40, 5), "op12_collocations": _OP12}
