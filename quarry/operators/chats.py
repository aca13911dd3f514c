"""Chats and messages per user: order, titles, activity, pairs and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarry.functions.text import preview
from quarry.operators.ingest import latest

DEFAULT_TITLE = "New Chat"


def newest(rows: DataFrame, *, user_col: str = "user_id", time_col: str = "updated_at", id_col: str = "id", n: int | None = 50) -> DataFrame:
    """The ``n`` newest rows of each user (all for None), newest first, ties by id."""
    return latest(rows, user_col, [F.desc(time_col), F.asc(id_col)], n)


def in_order(messages: DataFrame) -> DataFrame:
    """Messages with their ``position`` in the chat by time, ties by id."""
    return latest(messages, "chat_id", [F.asc("timestamp"), F.asc("id")], None)


def titles(messages: DataFrame, limit: int = 50) -> DataFrame:
    """``chat_id, title``: the first user text that is not the default title, cut to ``limit``, else the default."""
    fits = (F.col("sender") == "user") & (F.col("text") != DEFAULT_TITLE)
    first = F.min_by("text", F.when(fits, F.struct("timestamp", "id")))
    return messages.groupBy("chat_id").agg(preview(F.coalesce(first, F.lit(DEFAULT_TITLE)), limit).alias("title"))


def activity(messages: DataFrame, chats: DataFrame, by: str = "user") -> DataFrame:
    """``chats`` with ``last_activity``: time of the latest message of the user (or of any sender), else created_at."""
    if by not in ("user", "any"):
        raise ValueError("by is 'user' or 'any'")
    last = messages.where((F.col("sender") == "user") if by == "user" else F.lit(True)).groupBy("chat_id").agg(F.max("timestamp").alias("__last"))
    j = chats.join(last, chats["id"] == last["chat_id"], "left")
    return j.select(*[chats[c] for c in chats.columns], F.coalesce("__last", chats["created_at"]).alias("last_activity"))


def pairs(messages: DataFrame) -> DataFrame:
    """``chat_id, question_id, question, answer``: user messages directly followed by a bot message."""
    w = Window.partitionBy("chat_id").orderBy("timestamp", "id")
    nxt = messages.select("chat_id", "id", "sender", "text", F.lead("sender").over(w).alias("next_sender"), F.lead("text").over(w).alias("answer"))
    return nxt.where("sender = 'user' and next_sender = 'bot'").select("chat_id", F.col("id").alias("question_id"), F.col("text").alias("question"), "answer")


def last_shown(messages: DataFrame) -> DataFrame:
    """``chat_id, message_id``: the last user message, or the last message of a chat without one."""
    at = F.struct("timestamp", "id")
    return messages.groupBy("chat_id").agg(F.coalesce(F.max_by("id", F.when(F.col("sender") == "user", at)), F.max_by("id", at)).alias("message_id"))
