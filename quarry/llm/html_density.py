"""Main text of web pages by composite text density.

Every node of the page's tree gets a density: its characters per tag, adjusted
by how many of them stand in links, against the same shares of the body. The
sum of its children's densities says how much dense content a node holds
together. The node with the largest sum sets a threshold, the smallest density
on its path up to the body; in every part of the page that reaches the
threshold the node with the largest sum is content, and the smallest subtree
around all content is the article. Parts that say by tag or role that they are
menus, notices and the like never count. A form, or a class or id that says so,
is evidence only: such a part counts all the same if it holds a heading or
paragraphs and most of the page's text outside links, and a name that merely
holds such a word (``legal-analysis``) counts against a part of links only.
Reader comments are told by shape as well, whatever their boxes are called:
elements of the same tag and first class in a row behind the article, without
larger headings, are a thread (see :func:`_drop_threads`).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bytesview import slices

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"'>]|\Z)", re.I)
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

# Element names and naming habits of web pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that stand inside a line, shown or not: they end no block.
FLOWING = INLINE | frozenset("script style noscript template iframe object embed svg canvas button select option optgroup datalist input textarea audio video map area picture source track output progress meter label slot math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split())
NEVER = frozenset("head script style noscript template iframe object embed svg canvas annotation annotation-xml nav footer aside button select option datalist input textarea dialog menu audio video map title".split())
FORMS = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
ALWAYS = frozenset("ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup paywall comment comments commentlist disqus reply replies respond breadcrumb breadcrumbs pagination pager".split())
PARTS = frozenset("sidebar sidebars aside nav navbar navbars navigation menu menus masthead footer related recommended recommendations share sharing social widget widgets toolbar login search skip alert copyright legal tags adslot adunit adcontainer outbrain taboola".split())
CONTENT = frozenset("article content main post entry story body text".split())
#: Last words of names that say what kind of box it is, not what is in it.
BOXES = frozenset("area articles backdrop background bar big block body bottom box button buttons card cards closed cloud col column container content copy counter cta desktop dropdown embed entry feed first fixed float form frame full global group header heading headline hero holder horizontal icon icons image info inline inner item items large left level link links list long main message mobile module more nested network networks next now open outer pane panel parent placeholder policy popup post posts prev previous primary prompt rail reading region right row second secondary section side single sized skin slot small square sticky stories story strip stub subtitle tab tabs teaser text thread thumb thumbnail tile title toggle tools tooltip top trail trigger unit vertical view visible wide wrap wrapper zone".split())
MODIFIERS = frozenset("with has no without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = frozenset("table ul ol dl select div section article body main td th blockquote".split())


# How an element speaks against itself, and the share of the page's text outside links that outweighs it.
HINT, WEAK, STRONG, NEVER_COUNTS = 1, 2, 3, 4
SHARE = {WEAK: 0.5, STRONG: 0.9}
#: So many characters directly in one element are a paragraph without ``p``.
PARAGRAPH = 80
#: A line of at most so many characters may name the writer of a comment.
BYLINE = 80
#: Elements that hold a comment each.
ENTRIES = frozenset("div li section article dd tr".split())


def _names_mark(names: list[str], declared: bool = False) -> int:
    """What an element's classes and ids together say against it.

    ``post-header`` and ``with-sidebar`` say nothing. A name made of noise words
    (``sidebar``), or that ends in a word of ALWAYS or in a box of one
    (``comment-list``), is strong; one that ends in another noise word or its
    box (``category-legal``) weak; any other name with such a word
    (``legal-analysis``, ``cookie-recipe``) a hint. Beside a name that says
    content (``post``) only names made of words of ALWAYS count. Of a
    ``declared`` article only names with words of ALWAYS do.
    """
    mark, plain, content = 0, 0, False
    for name in names:
        order = [x.lower() for x in _PART.findall(name)]
        words, end = set(order), [x for x in order if not x.isdigit()][-1:]
        joined = "".join(c for c in name.lower() if c.isalpha())
        if words & MODIFIERS:
            continue
        boxed = end and (end[0] in BOXES or len(end[0]) == 1)
        if words & ALWAYS or joined in ALWAYS:
            if words <= ALWAYS or joined in ALWAYS:
                mark = plain = STRONG
            else:
                mark = max(mark, STRONG if boxed or end[0] in ALWAYS else WEAK if end[0] in PARTS else HINT)
        elif declared:
            continue
        elif words & PARTS or joined in PARTS:
            mark = max(mark, STRONG if words <= PARTS or joined in PARTS else WEAK if boxed or end[0] in PARTS else HINT)
        elif words & CONTENT:
            content = True
        elif "header" in words:
            mark = max(mark, WEAK if end == ["header"] or boxed else HINT)
    return plain if content else mark


class Page:
    """A page's tree in document order: a node's subtree is the index range up to ``end``."""

    def __init__(self, text: str, names: bool = True):
        self.names = names  # whether classes, ids and a form's share of the page tell noise
        self.tag, self.parent, self.end, self.noise = ["#page"], [-1], [0], [False]
        self.mark, self.named = [0], [0]  # against the element itself; by its names alone
        self.kind = [""]  # the first class
        self.runs: list[tuple[int, int, str]] = []  # node, block, text
        self.block = 0
        self.count: dict[str, int] = {}  # of open elements by name
        open_: list[int] = [0]
        at, n = 0, len(text)
        while at < n:
            lt = text.find("<", at)
            m = _TOKEN.match(text, lt) if lt >= 0 else None
            while lt >= 0 and m is None:  # a bare < is text
                lt = text.find("<", lt + 1)
                m = _TOKEN.match(text, lt) if lt >= 0 else None
            stop = lt if lt >= 0 else n
            if stop > at:
                self.runs.append((open_[-1], self.block, html.unescape(text[at:stop])))
            if m is None:
                break
            at = m.end()
            if m.group().startswith("<![CDATA["):
                self.runs.append((open_[-1], self.block, m.group()[9:].removesuffix("]]>")))
                continue
            name = (m.group(2) or m.group(5) or "").lower()
            if not name:
                continue
            if m.group(1) or m.group(4):
                self._close(open_, name)
                continue
            attrs = m.group(3) if m.group(2) else m.group(6)
            self._open(open_, name, attrs or "")
            if name in RAW:
                shut = re.compile(f"</{name}(?=[\\s/>])", re.I).search(text, at)
                stop = shut.start() if shut else n
                if name in ("xmp", "textarea", "title"):
                    self.runs.append((open_[-1], self.block, html.unescape(text[at:stop])))
                at = stop
        for node in open_:
            self.end[node] = len(self.tag)
        self._judge()

    def _judge(self) -> None:
        """Noise by all marks: what never counts, and other marks that no text outweighs."""
        n, up = len(self.tag), self.parent
        never, link = [False] * n, [False] * n
        for i in range(1, n):
            never[i] = never[up[i]] or self.mark[i] == NEVER_COUNTS
            link[i] = link[up[i]] or self.tag[i] == "a"
        self.sizes = [0 if never[node] else len("".join(text.split())) for node, _, text in self.runs]
        self.plain = plain = [0] * n  # characters outside links
        linked = [0] * n
        for (node, _, _), size in zip(self.runs, self.sizes, strict=True):
            (linked if link[node] else plain)[node] += size
        self.prose = prose = [x >= PARAGRAPH for x in plain]  # holds a heading or a paragraph
        for i in range(n - 1, 0, -1):
            if not never[i]:
                prose[i] = prose[i] or plain[i] > 0 and (self.tag[i] == "p" or self.tag[i] in HEADINGS)
                plain[up[i]] += plain[i]
                linked[up[i]] += linked[i]
                prose[up[i]] = prose[up[i]] or prose[i]
        for i in range(1, n):
            mark = self.mark[i]
            stays = mark == 0 or prose[i] and (not self.names or (linked[i] <= plain[i] if mark == HINT else plain[i] > SHARE.get(mark, 1) * plain[0]))
            self.noise.append(never[i] or self.noise[up[i]] or not stays)

    def _shut(self, open_: list[int]) -> None:
        node = open_.pop()
        self.end[node] = len(self.tag)
        self.count[self.tag[node]] -= 1
        if self.tag[node] not in FLOWING and not self.count.get("svg"):
            self.block += 1

    def _close(self, open_: list[int], name: str) -> None:
        if not self.count.get(name):
            return
        for i in range(len(open_) - 1, 0, -1):
            if self.tag[open_[i]] == name:
                while len(open_) > i:
                    self._shut(open_)
                return
            if name in INLINE and self.tag[open_[i]] in SCOPE:
                return

    def _open(self, open_: list[int], name: str, attrs: str) -> None:
        ends = ("p",) if name in CLOSES_P else CLOSES.get(name, ())
        if ends:
            for i in range(len(open_) - 1, 0, -1):
                tag = self.tag[open_[i]]
                if tag in ends:
                    while len(open_) > i:
                        self._shut(open_)
                    if name not in ("tr", "tbody", "tfoot"):
                        break
                elif tag in SCOPE:
                    break
        if name == "br":
            self.runs.append((open_[-1], self.block, " "))
        node, up = len(self.tag), open_[-1]
        self.tag.append(name)
        self.parent.append(up)
        self.end.append(node + 1)
        self._mark(name, attrs)
        if name not in FLOWING and not self.count.get("svg"):
            self.block += 1
        if name not in VOID:
            open_.append(node)
            self.count[name] = self.count.get(name, 0) + 1

    def _mark(self, name: str, attrs: str) -> None:
        mark, named, kind = WEAK if name in FORMS else 0, 0, ""
        if name in NEVER or name == "header" and not (self.count.get("article") or self.count.get("main")):
            mark = NEVER_COUNTS
        elif attrs and name not in ("html", "body", "main", "header"):
            names = []
            for m in _ATTR.finditer(attrs):
                key, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "")
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    mark = NEVER_COUNTS
                elif key == "role":
                    mark = max(mark, NEVER_COUNTS if value.lower() in ROLES else WEAK if value.lower() == "form" else 0)
                elif key in ("class", "id"):
                    names += value.split()
                    kind = next(iter(value.split()), "") if key == "class" else kind
            named = _names_mark(names, declared=name == "article")
            mark = max(mark, named if self.names else 0)
        self.mark.append(mark)
        self.named.append(named)
        self.kind.append(kind)


def densities(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Composite text density of every node, and the sum over its children."""
    n = len(page.tag)
    parent = page.parent
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    inside_link = [False] * n
    for i in range(1, n):
        inside_link[i] = inside_link[parent[i]] or page.tag[i] == "a"
    for (node, _, _), size in zip(page.runs, page.sizes, strict=True):
        if not page.noise[node]:
            chars[node] += size
            if inside_link[node]:
                link_chars[node] += size
    for i in range(n - 1, 0, -1):
        if page.noise[i]:
            continue
        up = parent[i]
        chars[up] += chars[i]
        link_chars[up] += link_chars[i]
        tags[up] += tags[i] + 1
        link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    page.chars, page.link_chars, page.link_tags = chars, link_chars, link_tags
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    share = link_chars[body] / max(chars[body], 1)
    density, total = np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        c, t, lc, lt = chars[i], max(tags[i], 1), link_chars[i], link_tags[i]
        if c and not page.noise[i]:
            base = log(c / max(c - lc, 1) * lc + share * c + e)
            density[i] = c / t * log(max(c / max(lc, 1) * t / max(lt, 1), 1.0 + 1e-9)) / log(max(base, 1.0 + 1e-9)) if base > 1 + 1e-9 else c / t * log(max(c * t, e))
        if i:
            total[parent[i]] += density[i]
    return density, total


def article(page: Page) -> int:
    """The node whose subtree is the article; -1 if the page has no text."""
    density, total = densities(page)
    if not density.any():
        return -1
    total = np.where(density > 0, total, -1.0)
    # a page whose text stands in one node without element children
    total = np.where((total == 0) & (density > 0), density * 1e-6, total)
    body = next((i for i, t in enumerate(page.tag) if t == "body"), 0)
    best, least = int(total.argmax()), np.inf
    i = best
    while i >= 0:
        least = min(least, density[i])
        if i == body:
            break
        i = page.parent[i]
    marked, i = [], body
    while i < page.end[body]:
        if density[i] >= least and density[i] > 0:
            marked.append(i + int(total[i : page.end[i]].argmax()))
            i = page.end[i]
        else:
            i += 1
    root = marked[0] if marked else best
    for m in marked[1:]:
        while not root <= m < page.end[root]:
            root = page.parent[root]
    # an element that declares the article may hold its title and short paragraphs too, if it adds no lists of links
    up = root
    while up > 0:
        if page.tag[up] in ("article", "main") and page.link_chars[up] - page.link_chars[root] <= 0.5 * (page.chars[up] - page.chars[root]):
            return up
        up = page.parent[up]
    return _with_title(page, root, body)


def _parts(page: Page, root: int) -> list[int]:
    """The article, and what stands beside it as a further part: article elements of prose with few links and no less than a fifth of its text."""
    if root <= 0 or page.tag[root] != "article":
        return [root]
    own = lambda i: page.parent[i] == page.parent[root] and page.tag[i] == "article" and not page.noise[i] and page.prose[i]
    return [i for i in range(page.parent[root] + 1, page.end[page.parent[root]]) if i == root or own(i) and page.link_chars[i] <= 0.2 * page.chars[i] and page.chars[i] >= 0.2 * page.chars[root]]


def _with_title(page: Page, root: int, body: int) -> int:
    """The nearest node around ``root`` that adds the title, if it adds little else and few links."""
    titled = lambda i: any(page.tag[j] in ("h1", "h2") and page.chars[j] and not page.noise[j] for j in range(i, page.end[i]))
    if titled(root):
        return root
    up = root
    while up != body and page.parent[up] >= 0:
        up = page.parent[up]
        more, links = page.chars[up] - page.chars[root], page.link_chars[up] - page.link_chars[root]
        if more > max(200, 0.3 * page.chars[root]) or links > 0.5 * more:
            return root
        if more and titled(up):
            return up
    return root


def _drop_threads(page: Page) -> None:
    """Makes noise of what shape and place tell to be reader comments.

    A row of entries is elements of one parent with the same tag and, but for
    list items, the same class, none of them holding a heading up to ``h3``.
    Where one element alone declares itself an article of prose, rows of two or
    more behind it are a thread, and so is a part behind it that has no such
    heading and less text than the article. On pages without a declared article
    a row of three or more is one if prose comes before it and each entry begins
    with a short line that ends no sentence and holds a ``time`` or a link.
    """
    n, up, tag = len(page.tag), page.parent, page.tag
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    inside = [False] * n  # an article
    tops = []
    for i in range(1, n):
        inside[i] = inside[up[i]] or tag[up[i]] == "article"
        if tag[i] == "article" and not page.noise[i] and page.prose[i] and not inside[i]:
            tops.append(i)
    if len(tops) > 1:
        return
    heads, times = [0] * (n + 1), [0] * (n + 1)  # before each node
    for i in range(n):
        heads[i + 1] = heads[i] + (tag[i] in ("h1", "h2", "h3"))
        times[i + 1] = times[i] + (tag[i] == "time")
    first = [len(page.runs)] * n  # of the runs within a node, which follow each other
    before = [0]  # characters of prose before a run
    for at, ((node, _, _), size) in enumerate(zip(page.runs, page.sizes, strict=True)):
        first[node] = min(first[node], at)
        before.append(before[-1] + (size if page.prose[node] and not page.noise[node] else 0))
    for i in range(n - 1, 0, -1):
        first[up[i]] = min(first[up[i]], first[i])

    def signed(i: int) -> bool:
        line, block, linked = "", None, False
        for at in range(first[i], len(page.runs)):
            node, b, text = page.runs[at]
            if not i <= node < page.end[i] or block is not None and b != block:
                break
            if text.strip():
                block, line = b, line + text
                linked = linked or tag[node] == "a"
                if len(line) > 4 * BYLINE:
                    return False
        line = " ".join(line.split())
        return 0 < len(line) <= BYLINE and len(line) < page.plain[i] and line[-1] not in ".!?:;" and (linked or times[page.end[i]] > times[i])

    groups: dict[tuple[int, str, str], list[int]] = {}
    for i in range(body + 1, page.end[body] if body else n):
        behind = not inside[i] and (i >= page.end[tops[0]] if tops else True)
        if behind and tag[i] in ENTRIES and (page.kind[i] or tag[i] in ("li", "dd")) and page.plain[i] and not page.noise[i]:
            groups.setdefault((up[i], tag[i], page.kind[i]), []).append(i)
    drop = []
    for row in groups.values():
        if any(heads[page.end[i]] > heads[i] for i in row):
            continue
        if len(row) >= 2 if tops else len(row) >= 3 and before[first[row[0]]] >= PARAGRAPH and all(signed(i) for i in row):
            drop += row
    if tops:
        top, i = tops[0], page.end[tops[0]]
        while i < (page.end[body] if body else n):
            if tag[i] not in INLINE and heads[page.end[i]] == heads[i] and page.plain[i] < page.plain[top] and not page.noise[i]:
                drop.append(i)
                i = page.end[i]
            else:
                i += 1
    for i in drop:
        if not page.noise[i]:
            page.noise[i : page.end[i]] = [True] * (page.end[i] - i)


def _drop_menus(page: Page, root: int) -> None:
    """Lists and tables of links that their names or a place ahead of any heading or paragraph mark as menus."""
    i, begun = root + 1, False
    while i < page.end[root]:
        links = page.tag[i] in ("ul", "ol", "dl", "table") and page.link_tags[i] >= 3 and page.link_chars[i] > 0.8 * page.chars[i]
        if links and (page.named[i] or not begun and not page.prose[i]):
            page.noise[i : page.end[i]] = [True] * (page.end[i] - i)
            i = page.end[i]
        else:
            begun = begun or not page.noise[i] and (page.tag[i] in HEADINGS and page.chars[i] > 0 or page.tag[i] == "p" and page.plain[i] > 0)
            i += 1


def main_text(source: str) -> str:
    """Blocks of the article in page order, joined by an empty line."""
    page = Page(source)
    _drop_threads(page)
    root = article(page)
    if root < 0 and any(0 < x < NEVER_COUNTS for x in page.mark):  # names or forms hid all there is
        page = Page(source, names=False)
        root = article(page)
    if root < 0:
        return ""
    blocks: dict[int, list[str]] = {}
    inside = [False] * len(page.tag)
    for part in _parts(page, root):
        _drop_menus(page, part)
        inside[part : page.end[part]] = [True] * (page.end[part] - part)
    for node, block, text in page.runs:
        if inside[node] and not page.noise[node]:
            blocks.setdefault(block, []).append(text)
    return "\n\n".join(t for b in sorted(blocks) if (t := " ".join("".join(blocks[b]).split())))


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) of each row's main text.

    Whole pages are read, at most a few MB of them at a time. A null or blank
    page, or one without an article, gives an empty text; broken markup is
    closed as browsers do; repeated rows give a row each; an empty table gives
    no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__html", 2 << 20):
                texts = [main_text(x) if x else "" for x in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    rows = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    return rows.mapInArrow(run, rows.drop("__html").schema.add("text", "string").add("n_chars", "long"))
