import html
import re

import pytest

from quarry.llm import html_density as hd

P = "Some words of an article that go on for quite a while, as real text does, and then a bit more. "


def test_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r.page_id: r for r in hd.extract(df).collect()}
    assert len(rows) == df.count()
    for r in df.collect():  # these pages mark their article; what stands in it, block by block
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|div|ul|li|article)\b[^>]*>", inner)]
        assert rows[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert rows[r.page_id].n_chars == len(rows[r.page_id].text)


def page(body):
    return f"<html><head><title>T</title><style>x</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        f"<div id=top class='site-header'>Head <a href=/>home</a></div><div><h2>Title</h2><p>{P}</p><p>short</p><p>{P}</p></div><div class='cookie-notice'>{P}</div>",
        f"<ul><li><a>menu one</a><li><a>menu two</a><li><a>three</a></ul><div><h2>Title</h2><p>{P}<p>short<p>{P}</div><div id=comments><p>{P}</p><p>{P}</p></div>",
        f"<header>H</header><main><h2>Title</h2><p>{P}</p><form>x<input></form><p>short</p><aside>{P}</aside><p>{P}</p><script>if(a<b){{}}</script></main><footer>{P}</footer>",
        f"<div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div><table><tr><td><h2>Title</h2><p>{P}</p><p>short</p><p>{P}</p></td><td class=sidebar>{P}</td></tr></table>",
        f"<article><header><h2>Title</h2></header><p>{P}</p><div>short</div><div class='ad'>{P}</div><div role=navigation>go</div><div hidden>x</div><p>{P}</p></article>",
        f"<nav id=main-nav><a>x</a></nav><div class='page with-sidebar'><div class=article-header><h2>Title</h2></div><div class=entry><p>{P}</p><p>short</p><p>{P}</p></div><div class=post-footer>{P}</div></div><div class=sideBar><p>{P}</p></div>",
        f"<div class='wrap nav-open'><article><h2>Title</h2><p>{P}</p><p>short</p><p>{P}</p></article></div>",
        f"<div><section><h2>Title</h2><p>{P}</p></section><section><p>short</p><p>{P}</p></section></div><div class=share-bar><a>f</a></div>",
    ],
)
def test_article_without_the_rest(body):
    assert hd.main_text(page(body)) == "\n\n".join(["Title", P.strip(), "short", P.strip()])


BODY = f"<h2>Title</h2><p>{P}</p><p>short</p><p>{P}</p>"


@pytest.mark.parametrize(
    "body",
    [
        f"<form id=aspnetForm><input type=hidden value=x><div id=main-menu><a>x</a></div><div>{BODY}<select><option>no</select></div><div id=comments><p>{P}</p></div></form>",
        f"<form><fieldset><div>{BODY}</div></fieldset></form><div>{P}</div>",
        f"<div class='post category-legal'>{BODY}</div><div class=sidebar>{P}</div>",
        f"<div class='story social-issues'>{BODY}</div><div>left over</div>",
        f"<div class='post comments-open'>{BODY}</div><div class=comments><p>{P * 9}</p></div>",
        f"<div class=category-legal>{BODY}</div><div>left over</div>",
        f"<div class=newsletter>{BODY}</div>",
    ],
)
def test_forms_and_names_are_no_veto(body):
    assert hd.main_text(page(body)) == "\n\n".join(["Title", P.strip(), "short", P.strip()])


def test_forms_and_threads_without_the_article_stay_out():
    both = f"<div>{BODY}</div><form><p>Write</p><input></form><div class=comments-area><p>{P * 5}</p></div><div id=cookie-consent><h2>Cookies</h2><p>{P * 5}</p></div>"
    assert hd.main_text(page(both)) == "\n\n".join(["Title", P.strip(), "short", P.strip()])
    assert hd.main_text(page("<form>user <input> <button>go</button></form>")) == ""


@pytest.mark.parametrize("name", ["legal-analysis", "login-howto", "cookie-recipe", "related-work", "social-issues", "ad-hoc-query", "menuPlanning"])
def test_a_word_in_a_name_drops_no_prose(name):
    inner = f"<h2>Title</h2><p>{P}</p><div class={name}><p>short</p></div><p>{P}</p>"
    for body in (f"<article>{inner}</article>", f"<div>{inner}</div>"):
        assert hd.main_text(page(body)) == "\n\n".join(["Title", P.strip(), "short", P.strip()])


def test_comments_marked_as_articles_stay_out():
    comment = f"<article class=comment><p>{P}</p></article>"
    for body in (f"<article>{BODY}{comment}{comment}</article>", f"{comment}<div>{BODY}</div>", f"<article class='post'>{BODY}</article>{comment}{comment}", f"<article>{BODY}</article><div class=comment-list><article id=comment-12><p>{P}</p></article></div>"):
        assert hd.main_text(page(body)) == "\n\n".join(["Title", P.strip(), "short", P.strip()])


C = "I do not agree with a word of this, and I have read it twice over to be sure of that. " * 4
TALK = [
    "<div class=discussion>" + f"<div class=msg><p>{C}</p></div>" * 12 + "</div>",
    "<ol class=thread>" + f"<li><p>{C}</p></li>" * 12 + "</ol>",
    f"<div class=talk><div class=msg><p>{P}</p></div></div>",
]


@pytest.mark.parametrize("talk", TALK)
def test_threads_behind_an_article_stay_out(talk):
    for body in (f"<article>{BODY}</article>{talk}", f"<main><article>{BODY}</article>{talk}</main>"):
        assert hd.main_text(page(body)) == "\n\n".join(["Title", P.strip(), "short", P.strip()])


@pytest.mark.parametrize("line", ["<b><a href=/u>Ann Lee</a></b>", "<div>Ann Lee <time>1 May</time></div>"])
def test_threads_told_by_their_writers(line):
    talk = f"<div class=talk>{f'<div class=msg>{line}<p>{C}</p></div>' * 5}</div>"
    assert hd.main_text(page(f"<div>{BODY}</div>{talk}")) == "\n\n".join(["Title", P.strip(), "short", P.strip()])


def test_rows_of_prose_that_are_no_thread_stay():
    text = "\n\n".join(["Title", P.strip(), "short", P.strip()])
    asked = f"<div class=qa><p>And what came then?</p><p>{P}</p></div>" * 4
    parts = f"<div class=part><h2>Next</h2><p>{P}</p></div>" * 3
    more = f"\n\nAnd what came then?\n\n{P.strip()}" * 4
    assert hd.main_text(page(f"<div>{BODY}{asked}</div>")) == text + more
    assert hd.main_text(page(f"<article>{BODY}{asked}</article>")) == text + more
    assert hd.main_text(page(f"<div>{BODY}{parts}</div>")) == text + f"\n\nNext\n\n{P.strip()}" * 3


def test_sibling_articles_are_one():
    both = f"<nav>n</nav><div><article><h2>Title</h2><p>{P}</p></article><article class='part legal'><p>short</p><p>{P}</p></article><article class=promo><p>{P}</p></article></div>"
    assert hd.main_text(page(both)) == "\n\n".join(["Title", P.strip(), "short", P.strip()])


def test_formulas_stay_in_their_sentence():
    formula = "<math><mrow><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mn>4</mn></mrow><annotation>x^2=4</annotation></math>"
    assert hd.main_text(page(f"<article><p>{P}If {formula} holds.</p></article>")) == P + "If x2=4 holds."
    assert hd.main_text(page(f"<article><p>{P}Here <svg><path d=x></svg>is<script>1</script> <button>b</button>one.</p></article>")) == P + "Here is one."


def test_lists_of_links_in_the_article_stay():
    links = "".join(f"<li><a href=/{i}>Source {i}</a></li>" for i in range(4))
    kept = "\n\n".join(f"Source {i}" for i in range(4))
    table = "<table>" + "".join(f"<tr><td><a>cell {i}</a></td></tr>" for i in range(3)) + "</table>"
    text = hd.main_text(page(f"<article><ul>{links}</ul><h2>Title</h2><p>{P}</p><ul>{links}</ul>{table}<p>{P}</p><ol>{links}</ol><ul class=nav-links>{links}</ul></article>"))
    assert text == "\n\n".join(["Title", P.strip(), kept, "cell 0\n\ncell 1\n\ncell 2", P.strip(), kept])


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""), ("   ", ""), ("just text &amp; more &lt;b&gt;", "just text & more <b>"), ("<p>a<br>b</p>", "a b"), ("<p>a < b and c</p>", "a < b and c"),
        ("<p>x <!-- no --> y</p>", "x y"), ("<p>&eacute;&#233;&#xe9; &nbsp; z", "ééé z"), ("<script>x", ""), ("<!-- open", ""), ("<p>a</p><p>a</p>", "a\n\na"),
        ("<p title='a>b'>q</p>", "q"), ("<p class=\"x>unclosed</p>", "unclosed"), ("</p></div>t", "t"),
    ],
)
def test_small_and_broken(source, text):
    assert hd.main_text(source) == text


def test_deep_and_long_pages_stay_linear():
    deep = "<div>" * 20000 + P + "</x>" * 20000
    assert hd.main_text(deep) == P.strip()
    assert len(hd.main_text(page(f"<article>{'<p>' + P + '</p>'}</article>" * 3000))) > 0
    assert hd.main_text(page(f"<div>{BODY}</div>" + f"<div class=m><a>Ann</a><p>{P}</p></div>" * 20000)).startswith("Title")


def test_nulls_repeats_clashes_empty(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>a</p>", "t"), (None, "u", "<p>a</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in hd.extract(df).collect()) == [(0, "a", 1), (0, "a", 1), (1, "", 0)]
    assert hd.extract(df.limit(0)).count() == 0
