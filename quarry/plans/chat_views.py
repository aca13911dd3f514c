"""Queries over ``conversations`` as chats of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import chats, ingest


def messages(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role <> 'system'")
    return c.select(
        F.concat(F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"), F.col("conv_id").alias("chat_id"), (F.col("conv_id") % 17).alias("user_id"),
        F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("role") == "assistant", "bot").otherwise("user").alias("sender"), F.expr("timestamp_seconds(1704067200 + (conv_id * 1000 + turn) * 60)").alias("timestamp"),
    )


def chat_rows(spark, sf_dir):
    m = messages(spark, sf_dir)
    c = m.groupBy("chat_id").agg(F.min("user_id").alias("user_id"), F.min("timestamp").alias("created_at"))
    return c.select(F.col("chat_id").alias("id"), "user_id", "created_at")


def a3_newest_chats(spark, sf_dir):
    act = chats.activity(messages(spark, sf_dir), chat_rows(spark, sf_dir)).withColumnRenamed("last_activity", "updated_at")
    return chats.newest(act).select("user_id", "id", "position")


def a5_messages_in_order(spark, sf_dir):
    return chats.in_order(messages(spark, sf_dir)).select("chat_id", "id", "position")


def a6_titles(spark, sf_dir):
    return chats.titles(messages(spark, sf_dir))


def _activity(by):
    def query(spark, sf_dir):
        a = chats.activity(messages(spark, sf_dir), chat_rows(spark, sf_dir), by)
        return a.select("id", F.unix_timestamp("last_activity").alias("last_activity"))

    return query


def a8_pairs(spark, sf_dir):
    return chats.pairs(messages(spark, sf_dir)).select("chat_id", "question_id", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


def a9_last_shown(spark, sf_dir):
    return chats.last_shown(messages(spark, sf_dir))


def j6_delete_chats(spark, sf_dir):
    c = chat_rows(spark, sf_dir)
    asked = c.where("id % 3 = 0").select(F.when(F.col("id") % 6 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("target_id"), F.when(F.col("id") % 9 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"))
    outcome, left, kids = ingest.delete_owned(c, asked, messages(spark, sf_dir), child_key="chat_id")
    return outcome.groupBy("outcome").agg(F.count("*").alias("n")).unionByName(left.agg(F.lit(1).alias("outcome"), F.count("*").alias("n"))).unionByName(kids.agg(F.lit(2).alias("outcome"), F.count("*").alias("n")))


QUERIES = {f.__name__: f for f in (a3_newest_chats, a5_messages_in_order, a6_titles, a8_pairs, a9_last_shown, j6_delete_chats)}
QUERIES |= {"a7_activity_user": _activity("user"), "a7_activity_any": _activity("any")}

_M = """WITH m AS (SELECT lpad(CAST(conv_id AS VARCHAR), 9, '0') || '-' || lpad(CAST(turn AS VARCHAR), 6, '0') AS id, conv_id AS chat_id, conv_id % 17 AS user_id, coalesce(text, '') AS text,
  CASE WHEN role = 'assistant' THEN 'bot' ELSE 'user' END AS sender, 1704067200 + (conv_id * 1000 + turn) * 60 AS ts FROM conversations WHERE role <> 'system'),
  c AS (SELECT chat_id AS id, min(user_id) AS user_id, min(ts) AS created, max(ts) FILTER (sender = 'user') AS last_user, max(ts) AS last_any FROM m GROUP BY chat_id)
"""
ORACLES = {
    "a3_newest_chats": _M + "SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(last_user, created) DESC, id) AS INT) AS position FROM c QUALIFY position <= 50",
    "a5_messages_in_order": _M + "SELECT chat_id, id, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY ts, id) AS INT) AS position FROM m",
    "a6_titles": _M + """, f AS (SELECT chat_id, arg_min(text, id) AS t FROM m WHERE sender = 'user' AND text <> 'New Chat' GROUP BY chat_id), t AS (SELECT c.id AS chat_id, coalesce(f.t, 'New Chat') AS t FROM c LEFT JOIN f ON f.chat_id = c.id)
      SELECT chat_id, CASE WHEN length(t) > 50 THEN substr(t, 1, 50) || '...' ELSE t END AS title FROM t""",
    "a7_activity_user": _M + "SELECT id, coalesce(last_user, created) AS last_activity FROM c",
    "a7_activity_any": _M + "SELECT id, last_any AS last_activity FROM c",
    "a8_pairs": _M + ", w AS (SELECT *, lead(sender) OVER q AS ns, lead(text) OVER q AS nt FROM m WINDOW q AS (PARTITION BY chat_id ORDER BY ts, id)) SELECT chat_id, id AS question_id, md5(text) AS question_md5, md5(nt) AS answer_md5 FROM w WHERE sender = 'user' AND ns = 'bot'",
    "a9_last_shown": _M + "SELECT chat_id, coalesce(arg_max(id, id) FILTER (sender = 'user'), max(id)) AS message_id FROM m GROUP BY chat_id",
    "j6_delete_chats": _M + """, q AS (SELECT id, CASE WHEN id % 6 = 0 THEN 404 WHEN id % 9 = 0 THEN 403 ELSE 200 END AS outcome FROM c WHERE id % 3 = 0)
      SELECT outcome, count(*) AS n FROM q GROUP BY outcome UNION ALL SELECT 1, (SELECT count(*) FROM c WHERE id NOT IN (SELECT id FROM q WHERE outcome = 200)) UNION ALL SELECT 2, (SELECT count(*) FROM m WHERE chat_id NOT IN (SELECT id FROM q WHERE outcome = 200))""",
}
