import random
from datetime import datetime, timedelta

from quarry.llm import url_filters as uf

T0 = datetime(2024, 1, 1)
CAP, ENT = "page_id long, url string, fetched_at timestamp", "list string, kind string, value string, action string, at timestamp"


def brute(captures, entries):
    out = {}
    for p, url, at in captures:
        lists = set()
        if url and "://" in url and at is not None:
            rest = url.split("://", 1)[1]
            net = rest.replace("?", "/").replace("#", "/").split("/", 1)[0]
            host = net.rsplit("@", 1)[-1].split(":")[0].lower().rstrip(".")
            path = rest.split("#")[0].split("?")[0].partition("/")[2]
            parts = [x for x in path.split("/") if x]
            state = {}
            for lst, kind, value, action, when in sorted(entries, key=lambda e: (e[4], e[3] == "add")):
                if when <= at:
                    a, slash, b = value.partition("/")
                    state[lst, kind, a.lower() + slash + b if kind == "prefix" else value.lower()] = action == "add"
            for (lst, kind, value), on in state.items():
                hit = kind == "host" and host == value or kind == "domain" and (host == value or host.endswith("." + value)) or kind == "prefix" and any(host + "/" + "/".join(parts[: i + 1]) == value for i in range(len(parts)))
                if on and hit and host:
                    lists.add(lst)
        out[p] = sorted(lists)
    return out


def got(df):
    return {r.page_id: r.lists for r in df.collect()}


def test_against_brute_force(spark):
    r = random.Random(2)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "ba.com"]
    urls = [f"{r.choice(['http', 'HTTPS'])}://{r.choice(['', 'u:p@', ''])}{r.choice(hosts).upper()}{r.choice(['', ':80', '.'])}{r.choice(['', '/', '/p', '/p/q/', '/P/q?x=/p', '#p'])}" for _ in range(300)]
    caps = [(i, u, T0 + timedelta(days=r.randrange(60))) for i, u in enumerate(urls)]
    keys = [("domain", "a.com"), ("domain", "x.a.com"), ("host", "b.org"), ("host", "a.com"), ("prefix", "B.org/p"), ("prefix", "x.a.com/p/q"), ("prefix", "b.org/P")]
    ents = [(f"l{r.randrange(3)}", *r.choice(keys), r.choice(["add", "remove"]), T0 + timedelta(days=r.randrange(60))) for _ in range(80)]
    assert got(uf.active_lists(spark.createDataFrame(caps, CAP), spark.createDataFrame(ents, ENT))) == brute(caps, ents)


def test_hot_domain_is_split(spark, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(uf, "PART", 20)
    caps = [(i, f"http://h{i % 50}.a.com/x", T0 + timedelta(days=r.randrange(60))) for i in range(400)]
    ents = [("l", "domain", "a.com", r.choice(["add", "remove"]), T0 + timedelta(days=r.randrange(60))) for _ in range(30)]
    assert got(uf.active_lists(spark.createDataFrame(caps, CAP), spark.createDataFrame(ents, ENT))) == brute(caps, ents)


def test_interval_ends(spark):
    day = lambda n: T0 + timedelta(days=n)
    ents = [("l", "host", "h", "add", day(1)), ("l", "host", "h", "add", day(2)), ("l", "host", "h", "remove", day(5)), ("l", "host", "h", "remove", day(7)), ("l", "host", "h", "add", day(7)), ("l", "host", "H", "other", day(8))]
    iv = uf.intervals(spark.createDataFrame(ents, ENT)).collect()
    assert sorted((r.valid_from, r.valid_to) for r in iv if r.valid_to) == [(day(1), day(5))] and [r.valid_from for r in iv if not r.valid_to] == [day(7)]
    caps = [(i, "http://h/", day(i)) for i in range(9)]
    assert sorted(i for i, x in got(uf.active_lists(spark.createDataFrame(caps, CAP), spark.createDataFrame(ents, ENT))).items() if x) == [1, 2, 3, 4, 7, 8]


def test_nulls_repeats_clashes_empty(spark, capsys):
    caps = spark.createDataFrame([(1, None, T0, "x"), (2, "http://h/a", None, "x"), (3, "relative/h", T0, "x"), (4, "http://h", T0, "x"), (4, "http://h", T0, "x"), (None, "http://h", T0, "x")], CAP + ", list string")
    ents = spark.createDataFrame([("l", "host", "h", "add", T0), ("l", "host", None, "add", T0), (None, "host", "h", "add", T0)], ENT)
    out = uf.active_lists(caps, ents)
    assert sorted((r.page_id or 0, r.lists, r.blocked) for r in out.collect()) == [(0, ["l"], True), (1, [], False), (2, [], False), (3, [], False), (4, ["l"], True)]
    assert uf.active_lists(caps.limit(0), ents).count() == 0 and uf.active_lists(caps, ents.limit(0)).where("blocked").count() == 0
    out.explain()
    assert "Python" not in capsys.readouterr().out
