"""URL filters whose lists change over time, as an as-of join in DataFrame functions.

Dated list entries become validity intervals. A capture is expanded to the keys
that could list it (its host and the host's parent domains, its path prefixes).
Captures and the ends of intervals of a key are put in one order of time, and
each capture takes the last state before it. Keys with many captures are dealt
to parts, each with its own copy of the key's intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.scratch import materialize
from quarry.spread import copied, deal, hot_parts, listed

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
#: Captures of a key that meet its intervals in one group.
PART = 256
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, kind, value, valid_from, valid_to`` (null: still valid), disjoint for a key, from ``list, kind, value, action, at``.

    Hosts and domains have no case; of a prefix only the host has none.

    ``action`` is ``add`` or ``remove``; repeats change nothing; of both at one
    time ``add`` counts. Rows with a null key, time or another action are left out.
    """
    cased = F.concat(F.lower(F.regexp_extract("value", "^[^/]*", 0)), F.regexp_extract("value", "(?s)/.*", 0))
    value = F.when(F.col("kind") == "prefix", cased).otherwise(F.lower("value"))
    e = entries.select("list", "kind", value.alias("value"), "action", "at").where(F.col("action").isin("add", "remove")).dropna()
    e = e.groupBy("list", "kind", "value", "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    by = Window.partitionBy("list", "kind", "value").orderBy("at")
    e = e.withColumn("was", F.coalesce(F.lag("on").over(by), F.lit(0))).where(F.col("on") != F.col("was"))  # only what changes the state
    e = e.withColumn("valid_to", F.lead("at").over(by)).where("on = 1")
    return e.select("list", "kind", "value", F.col("at").alias("valid_from"), "valid_to")


def keys(url: Column) -> Column:
    """All ``kind, value`` that can list a URL: host, the domains it lies under (itself too), and prefixes at path segments."""
    h = host(url)
    labels = F.split(h, r"\.", -1)
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n - i + 1), ".").alias("value")))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/", -1), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(h, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")).alias("value")))
    prefixes = F.when(F.size(segments) > 0, prefixes).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    own = F.array(F.struct(F.lit("host").alias("kind"), h.alias("value")))
    return F.when(h != "", F.array_distinct(F.concat(own, domains, prefixes))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))


def active_lists(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """Per distinct ``(id, url, fetch time)``: ``host``, ``lists`` (names active then, sorted) and ``blocked``.

    An entry holds from its time on, up to but without its removal. Captures
    with a null or relative URL or a null time match nothing; exact repeats give
    one row; an empty list table blocks nothing; further columns are ignored.
    """
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(at_col).alias("at"))
    iv = materialize(intervals(entries), "intervals")  # read for its keys, its ends and their copies
    ends = iv.select("list", "kind", "value", F.col("valid_from").alias("at"), F.lit(True).alias("on"))
    ends = ends.unionByName(iv.where("valid_to is not null").select("list", "kind", "value", F.col("valid_to").alias("at"), F.lit(False).alias("on")))
    names = iv.select("kind", "value", "list").distinct()
    # only keys that some list has; the rest goes before anything is shuffled
    asked = listed(c.where("at is not null").select("id", "url", "at", F.explode(keys(F.col("url"))).alias("key")).select("id", "url", "at", "key.kind", "key.value"), names, ["kind", "value"])
    hot = hot_parts(asked.groupBy("kind", "value").agg(F.count("*").alias("n")), ["kind", "value"], PART)
    asked = deal(asked, hot, ["kind", "value"], ["id", "url", "at"]).join(copied(names, hot, ["kind", "value"]), ["kind", "value", "part"])
    line = asked.select("list", "kind", "value", "part", "at", F.lit(True).alias("asks"), F.lit(None).cast("boolean").alias("on"), "id", "url")
    line = line.unionByName(copied(ends, hot, ["kind", "value"]).withColumn("asks", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy("kind", "value", "list", "part").orderBy("at", "asks", "on").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = line.withColumn("active", F.last("on", ignorenulls=True).over(upto)).where("asks and active").select("id", "url", "at", "list")
    rows = c.select("id", "url", "at", F.lit(None).cast("string").alias("list")).unionByName(hits)
    out = rows.groupBy("id", "url", "at").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(at_col), host(F.col("url")).alias("host"), "lists", (F.size("lists") > 0).alias("blocked"))
