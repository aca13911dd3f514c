"""Chat formatting in budgeted windows, in DataFrame functions only.

Template: each turn is ``### role: text</turn>\\n``. Inside role and text the
backslash and the control strings are escaped (fixed values below), so that
text can never open or close a turn and everything reads back unchanged.

Windows: prefix sums of turn tokens lay the turns of a conversation on a line.
The line is cut in quanta; turns that end inside the quantum they start in form
one span, a turn that crosses a cut forms a span of its own. So a span holds
whole turns, at most one quantum of new tokens unless it is a single longer
turn. Each window shows the first system turn, then as many of the directly
preceding turns as fit ``history`` tokens, then its span. Only assistant texts
of the span carry loss: repeated targets are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\h"))
    out = F.replace(out, F.lit("</turn>"), F.lit("\\l/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: escaped backslashes pair up from the left, what lies between holds the others."""

    def plain(part: Column) -> Column:
        for mark, char in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            part = F.replace(part, F.lit(mark), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def token_estimate(text: Column) -> Column:
    """Tokens of a turn as a built-in estimate: a quarter of its UTF-8 bytes, four for the marks."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


def windows(turns: DataFrame, *, budget: int = 1024, history: int = 256, tokens=token_estimate) -> DataFrame:
    """Format ``turns(conv_id, turn, role, text)`` in windows.

    Returns one row per window: ``conv_id, window`` (ordered as the turns),
    ``formatted``, ``loss_spans array<struct<start,length>>`` (1-based, code
    points of ``formatted``), ``turn_spans`` (the same for every turn shown,
    with ``kind``: system, history or new), ``n_tokens`` and ``over_budget``.

    ``budget`` bounds a window that has no single turn above its share; such a
    turn is kept whole and the window is marked. The system turn may take half
    of the budget at most before the quantum of new tokens stops shrinking, so
    windows below an oversize system turn are marked too.

    Null texts and roles count as empty. A null turn number sorts first; equal
    numbers are ordered by role, then text, so exact repeats of a row change
    nothing but the count. A null ``conv_id`` is one conversation. No rows give no
    rows. Further columns, whatever their names, are ignored.
    """
    t = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    t = t.withColumn("tokens", tokens(F.col("text")))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"pos": F.row_number().over(by).cast("long"), "stop": F.sum("tokens").over(upto)})
    # place and size of the first system turn are known to every later turn by a running aggregate; its text stays in its own row
    t = t.withColumn("sys", F.first(F.when(F.col("role") == "system", F.struct("pos", "tokens")), ignorenulls=True).over(upto))
    t = t.withColumn("start", F.col("stop") - F.col("tokens"))
    quantum = F.greatest(F.lit(1), F.lit(budget - history) - F.least(F.coalesce(F.col("sys.tokens"), F.lit(0)), F.lit(budget // 2)))
    t = t.withColumn("quantum", quantum)
    k = F.floor(F.col("start") / F.col("quantum"))
    crosses = F.col("stop") > (k + 1) * F.col("quantum")
    # spans in order: (quantum, whole turns) before (quantum, crossing turn); a new system turn may change the quantum
    t = t.withColumn("span", F.struct(F.coalesce(F.col("sys.pos"), F.lit(0)).alias("s"), k.alias("k"), crosses.alias("x")))
    first = F.lag("span").over(by)
    t = t.withColumn("opens", F.coalesce(~(first == F.col("span")), F.lit(True)))
    # turns that a later span repeats: it opens within the next `history` tokens
    ahead = Window.partitionBy("conv_id").orderBy("start").rangeBetween(1, history)
    t = t.withColumn("span_no", F.sum(F.col("opens").cast("long")).over(upto))
    t = t.withColumn("later", F.collect_set(F.when(F.col("opens"), F.struct("span_no", "start"))).over(ahead))
    t = t.withColumn("spans", F.max("span_no").over(Window.partitionBy("conv_id")))
    own = F.array(F.struct(F.col("span_no").alias("window"), F.lit("new").alias("kind")))
    # history: the whole turn lies in the last `history` tokens before that span
    again = F.transform(F.filter("later", lambda s: (s.span_no > F.col("span_no")) & (s.start - F.col("start") <= history)), lambda s: F.struct(s.span_no.alias("window"), F.lit("history").alias("kind")))
    # the system turn goes to every window behind its own
    behind = F.sequence(F.col("span_no") + 1, F.col("spans"))
    none = F.array().cast("array<struct<window:bigint,kind:string>>")
    system = F.when((F.col("sys.pos") == F.col("pos")) & (F.col("span_no") < F.col("spans")), F.transform(behind, lambda w: F.struct(w.alias("window"), F.lit("system").alias("kind")))).otherwise(none)
    shown = t.select("conv_id", "pos", "role", "text", "tokens", F.col("sys.pos").alias("sys_pos"), F.explode(F.concat(own, again, system)).alias("w"))
    shown = shown.select("conv_id", F.col("w.window").alias("window"), F.col("w.kind").alias("kind"), "sys_pos", "pos", "role", "text", "tokens")
    # the retained system turn is not repeated as history as well
    shown = shown.where((F.col("kind") != "history") | F.col("sys_pos").isNull() | (F.col("pos") != F.col("sys_pos")))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(SEP))
    body = escape(F.col("text"))
    shown = shown.withColumns({"head": head, "body": body})
    turn = F.struct("pos", "kind", "role", F.length("head").alias("head"), F.length("body").alias("body"), "tokens", F.concat("head", "body", F.lit(CLOSE)).alias("string"))
    packed = shown.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # offsets by one fold over the window's turns, whose number the budget bounds
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<pos:bigint,kind:string,role:string,start:int,length:int>>").alias("spans"))
    laid = F.aggregate(
        "turns", zero,
        lambda a, x: F.struct(
            (a.at + x["head"] + x["body"] + len(CLOSE)).alias("at"),
            F.concat(a.spans, F.array(F.struct(x.pos.alias("pos"), x.kind.alias("kind"), x.role.alias("role"), (a.at + x["head"]).alias("start"), x["body"].alias("length")))).alias("spans"),
        ),
    )
    out = packed.select(
        "conv_id", "window", F.array_join(F.transform("turns", lambda x: x.string), "").alias("formatted"),
        laid.spans.alias("turn_spans"), F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x.tokens).alias("n_tokens"),
    )
    loss = F.transform(F.filter("turn_spans", lambda s: (s.kind == "new") & (s.role == "assistant")), lambda s: F.struct(s.start.alias("start"), s.length.alias("length")))
    return out.withColumns({"loss_spans": loss, "over_budget": F.col("n_tokens") > budget})


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, read back: ``array<struct<role,text>>``."""
    lines = F.split(formatted, "</turn>\n", -1)
    turns = F.filter(lines, lambda x: x != "")

    def turn(line: Column) -> Column:
        at = F.locate(SEP, line)
        return F.struct(unescape(F.substring(line, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), unescape(F.substring(line, at + len(SEP), F.length(line))).alias("text"))

    return F.transform(turns, turn)


def digest(shown: DataFrame) -> DataFrame:
    """Per conversation, read back from the windows: turns, loss text and size of the output."""
    parts = shown.select(
        "conv_id", "window", F.length("formatted").cast("long").alias("chars"),
        # repeated turns (system, history) are left out by their kind; what the window adds is read from its text
        F.transform(F.filter(F.arrays_zip(read_turns(F.col("formatted")).alias("turn"), F.col("turn_spans").alias("span")), lambda x: x.span.kind == "new"), lambda x: x.turn).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s.start, s.length))), "").alias("loss"),
    )
    parts = parts.withColumn("said", F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), ""))
    by = parts.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"),
    )
    loss = F.array_join(F.transform("w", lambda x: x.loss), "")
    return by.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x.said), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
