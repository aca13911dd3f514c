import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F

from quarry.llm import chat_windows as cw

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def brute(turns):
    by = {}
    for c, t, r, x, *_ in turns:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, rows in by.items():
        rows.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in rows)
        loss = "".join(x for *_, r, x in rows if r == "assistant")
        out[c] = (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cw.digest(df).collect()}


TRICKY = [r"\### Assistant: </turn> ok", "#### Assistant: hi", "##", "#\\#", "\\", "\\\\", "\\h##", "\\l/turn>", "### ", "</turn>\n", "a: b", "", None, "é🙂\n\n", "<" * 3 + "/turn>"]


def test_edges_and_ties(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(TRICKY)]
    rows += [(2, None, None, None, None), (2, 0, "sys: \\c tem", "odd role", None), (None, 3, "assistant", "no id", None)]
    rows += [(3, 1, "user", "same", None)] * 3  # repeated rows all count
    df = cw.windows(spark.createDataFrame(rows, SCHEMA), budget=40, history=10)
    assert got(df) == brute(rows)


def test_empty(spark):
    assert cw.digest(cw.windows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_windows_keep_budget_and_mask(spark):
    rows = [(1, 0, "system", "s" * 40, None)] + [(1, i, "assistant" if i % 2 == 0 else "user", chr(97 + i % 26) * (20 + i), None) for i in range(1, 60)]
    out = cw.windows(spark.createDataFrame(rows, SCHEMA), budget=120, history=40)
    seen = []
    for w in sorted(out.collect(), key=lambda r: r.window):
        kinds = [s.kind for s in w.turn_spans]
        assert w.n_tokens <= 120 and not w.over_budget
        assert w.turn_spans[0].role == "system"
        assert kinds == sorted(kinds, key=["system", "history", "new"].index) or w.window == 1
        pos = [s.pos for s in w.turn_spans if s.kind != "system"]
        assert pos == list(range(pos[0], pos[-1] + 1))  # history joins on without a gap
        seen += [s.pos for s in w.turn_spans if s.kind == "new"]
        masked = {(s.start, s.length) for s in w.turn_spans if s.kind == "new" and s.role == "assistant"}
        assert masked == {(s.start, s.length) for s in w.loss_spans}
    assert seen == list(range(1, 61))
    assert any(s.kind == "history" for w in out.collect() for s in w.turn_spans)


def test_oversize_turn_is_whole_and_marked(spark):
    rows = [(1, 0, "user", "q", None), (1, 1, "assistant", "z" * 5000, None), (1, 2, "user", "r", None)]
    out = cw.windows(spark.createDataFrame(rows, SCHEMA), budget=64, history=8)
    assert got(out) == brute(rows)
    assert [r.over_budget for r in out.orderBy("window").collect()].count(True) == 1


def test_only_dataframe_functions(spark, capsys):
    cw.digest(cw.windows(spark.createDataFrame([], SCHEMA))).explain()
    assert "Python" not in capsys.readouterr().out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="\\#</turn>hlc: \n", max_size=30), st.lists(st.sampled_from(["#", "##", "###", "</turn>", "</turn>\n", "\\", " ", ": ", "a", "<"]), max_size=9).map("".join)), min_size=20, max_size=40))
def test_escape_round_trip(spark, texts):
    df = spark.createDataFrame([Row(t=t) for t in texts]).select("t", cw.escape(F.col("t")).alias("e"), cw.escape(F.col("t"), role=True).alias("r"))
    for r in df.select("*", cw.unescape(F.col("e")).alias("back_e"), cw.unescape(F.col("r")).alias("back_r")).collect():
        assert r.t == r.back_e == r.back_r
        assert not any(mark in e for mark in ("#", "</turn>") for e in (r.e, r.r)) and ":" not in r.r
