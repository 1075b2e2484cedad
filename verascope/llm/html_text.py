"""HTML extraction by minimum cut: text blocks become content or boilerplate together.

A page becomes a sequence of text blocks with the elements they stand in. A logistic classifier of tags, class and id
words, link density, length and wording, fitted on labelled pages, gives each block log-odds of being content: capacities
to the terminals. Smoothness edges tie blocks that follow one another, the less the more containers lie between them, and
blocks of one container even when something stands between them. Max-flow finds the minimum cut; its source side is
the main text.
"""

from __future__ import annotations

import math
import random
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verascope.llm.tokens import portions

_PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:"[^"]*+"|'[^']*+'|[^>"']++)*+)>"""
    r"""|</?[a-zA-Z][^>]*>?|(?P<text>[^<]++|<)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text.
SKIPPED = frozenset("script style noscript template title svg math iframe object audio video canvas select textarea datalist".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("article main section div nav aside footer header form ul ol dl table body blockquote details dialog figure menu fieldset".split())
#: Start tags that end an open element of these names.
ENDS = {
    "li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
} | {t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()}

#: Words of names for parts that are no content even where they hold prose, for parts that hold controls and links, and for content.
ASIDE_WORDS = frozenset(
    "banner footer sidebar sidebars aside widget widgets related recommended recommendations promo promotion promoted ad ads adv advert adverts advertisement advertising adsense sponsor sponsored "
    "sponsors cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter comment comments commentlist reply replies respond disqus discussion reactions feedback "
    "copyright disclaimer outbrain taboola trending popular teaser hidden".split()
)
CONTROL_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar subscribe subscription signup login register search share sharing social legal privacy toolbar pagination pager "
    "paging toc skip rail".split()
)
CONTENT_WORDS = frozenset("article content post entry story main body text prose".split())
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "dialog": "aside", "alert": "aside", "menu": "nav", "main": "article", "article": "article"}
KINDS = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "fieldset": "form", "label": "form", "dialog": "aside", "article": "article", "main": "article"}
#: What an element may stand in: kinds of elements, and names.
ABOVE = ("article", "nav", "header", "head_of_article", "footer", "aside", "form", "aside_name", "control_name", "content_name", "mixed_name")
NAMED = ABOVE.index("aside_name")
TAGS = ("p", "h1", "h2", "li", "quote", "cell")
FEATURES = ("bias", *ABOVE, *TAGS, "length", "links", "links_in_article", "sentence", "wording", "prose", "prose_in_control")
#: Words that turn a name into a statement about the page: "with-sidebar" stands around content.
_STATES = frozenset("with has no without open closed enabled disabled".split())
_BOILERPLATE_START = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved|cookies?\b|subscribe\b|sign (?:up|in)\b|share (?:this|on)\b|advertisement\b)", re.I)
_SENTENCE_END = re.compile(r"[.!?…](?:\s|$)")


@dataclass(frozen=True)
class Costs:
    """Weights of FEATURES, and of the edges: between neighbours, what each container between them leaves of it, and between blocks of one container."""

    weights: tuple[float, ...]
    follows: float = 1.6
    per_container: float = 0.45
    same_container: float = 0.8


@dataclass
class _Element:
    tag: str
    above: tuple[int, ...]
    hidden: bool
    container: int


@dataclass
class Block:
    text: str
    tag: str
    above: tuple[int, ...]
    link_chars: int
    chars: int
    container: int


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    link: int = 0


_NOTHING = (0,) * len(ABOVE)


def _names(value: str) -> str | None:
    """What a class or an id says: content, controls, something beside the content, or several of them."""
    words = {w.lower() for w in _NAME_PART.findall(value)}
    if words & _STATES:
        return None
    aside, control, content = (bool(words & known) for known in (ASIDE_WORDS, CONTROL_WORDS, CONTENT_WORDS))
    if aside:
        return "aside_name"
    if control:
        return "mixed_name" if content else "control_name"
    return "content_name" if content else None


def _stands_in(tag: str, attrs: str, parent: _Element | None) -> tuple[tuple[int, ...], bool]:
    """What text in the element stands in, and whether it is not shown."""
    above, hidden = (parent.above, parent.hidden) if parent else (_NOTHING, False)
    found = []
    kind = KINDS.get(tag)
    if kind == "header" and above[0]:
        kind = "head_of_article"
    if attrs.strip(" /"):
        for m in _ATTRIBUTE.finditer(attrs):
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name in ("class", "id") and tag not in ("body", "html"):
                found += [_names(x) for x in value.split()]
            elif name == "role":
                kind = ROLES.get(value.strip().lower(), kind)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    new = {ABOVE.index(x) for x in (kind, *found) if x}
    return (tuple(int(i in new or v) for i, v in enumerate(above)) if new else above), hidden


class _Stack(list[_Element]):
    """Open elements; the greatest place of a tag, of a container and of what is no inline element are at hand."""

    def __init__(self) -> None:
        self.places: dict[str, list[int]] = {}

    def _groups(self, tag: str) -> Iterator[str]:
        yield tag
        if tag not in INLINE:
            yield "(block)"
        if tag in CONTAINERS:
            yield "(container)"

    def open(self, e: _Element) -> None:
        for g in self._groups(e.tag):
            self.places.setdefault(g, []).append(len(self))
        self.append(e)

    def place(self, tag: str) -> int:
        held = self.places.get(tag)
        return held[-1] if held else -1

    def cut(self, k: int) -> None:
        while len(self) > k:
            for g in self._groups(self.pop().tag):
                self.places[g].pop()


def blocks(html: str) -> tuple[list[Block], list[int]]:
    """The text blocks of a page in order, white space collapsed and character references decoded; and the container around each container."""
    out: list[Block] = []
    stack = _Stack()
    now = _Open()
    around = [0]
    links = 0
    at, n = 0, len(html)

    def close_block() -> None:
        nonlocal now
        if now.parts:
            text = " ".join(unescape("".join(now.parts)).split())
            edge = stack[-1] if stack else None
            if text and not (edge and edge.hidden):
                k = stack.place("(block)")
                out.append(Block(text, stack[k].tag if k >= 0 else "", edge.above if edge else _NOTHING, now.link, len(text), edge.container if edge else 0))
            now = _Open()

    while at < n:
        m = _PIECE.match(html, at)
        at = m.end()
        text = m["text"] if m["text"] is not None else m["cdata"]
        if text is not None:
            now.parts.append(text)
            if links:
                now.link += len(text.strip())
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if tag in VOID:
                if tag == "br":
                    now.parts.append(" ")
                continue
            if tag not in INLINE:
                close_block()
            k = stack.place(tag)
            # an inline element does not end outside its block
            if k >= 0 and (tag not in INLINE or k > stack.place("(block)")):
                stack.cut(k)
            if tag == "a":
                links = max(0, links - 1)
            continue
        if tag in SKIPPED or tag in RAW:
            if tag not in INLINE:
                close_block()
            if not m["attrs"].endswith("/") or tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "br":
                now.parts.append(" ")
            elif tag not in INLINE:
                close_block()
            continue
        if tag not in INLINE:
            close_block()
            links = 0
            if ended := ENDS.get(tag):
                k = max(map(stack.place, ended))
                if k > stack.place("(container)"):
                    stack.cut(k)
        elif tag == "a":
            links += 1
        parent = stack[-1] if stack else None
        above, hidden = _stands_in(tag, m["attrs"], parent)
        container = parent.container if parent else 0
        if tag in CONTAINERS:
            around.append(container)
            container = len(around) - 1
        stack.open(_Element(tag, above, hidden, container))
    close_block()
    return out, around


def features(b: Block, names: bool = True) -> list[float]:
    """The FEATURES of a block; without names, class and id words count for nothing."""
    above = b.above if names else b.above[:NAMED] + (0,) * (len(ABOVE) - NAMED)
    links = min(1.0, b.link_chars / max(1, b.chars))
    sentence = bool(_SENTENCE_END.search(b.text))
    prose = sentence and b.chars >= 80 and links < 0.4
    inside = above[0] or above[ABOVE.index("content_name")]
    control = above[ABOVE.index("control_name")] or above[ABOVE.index("mixed_name")]
    tag = {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "dd": "li", "dt": "li", "blockquote": "quote", "pre": "quote", "figcaption": "quote", "td": "cell", "th": "cell"}.get(b.tag, b.tag)
    return [
        1.0, *above, *(float(tag == t) for t in TAGS), min(6.0, math.log2(1 + b.chars / 20)) / 3, links * (not inside), links * bool(inside), float(sentence),
        float(bool(_BOILERPLATE_START.match(b.text))), float(prose), float(bool(prose and control)),
    ]


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Pages of the common layouts. Words c0 ... stand in content and b0 ... outside it; the names of some parts mislead."""
    r = random.Random(seed)
    pick = r.choice

    def prose(mark: str, lo: int = 1, hi: int = 5) -> str:
        return " ".join(" ".join(f"{mark}{r.randrange(10 ** r.randint(1, 7))}" for _ in range(r.randint(4, 16))) + pick(".....!?") for _ in range(r.randint(lo, hi)))

    def words(mark: str, lo: int = 1, hi: int = 6) -> str:
        return " ".join(f"{mark}{r.randrange(10 ** r.randint(1, 7))}" for _ in range(r.randint(lo, hi)))

    def link(mark: str) -> str:
        return f"<a href=x>{words(mark, 1, 5)}</a>"

    def wrap(kind: str, inner: str) -> str:
        name, _, label = kind.partition(".")
        return f'<{name} {pick(("class", "id"))}="{label}">{inner}</{name}>' if label else f"<{name}>{inner}</{name}>"

    def content_part() -> str:
        return pick([lambda: f"<p>{prose('c')}</p>"] * 8 + [
            lambda: f"<h2>{words('c', 2, 7)}</h2>", lambda: "<ul>" + "".join(f"<li>{prose('c', 1, 2)}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote>{prose('c')}</blockquote>",
            lambda: f"<p>{prose('c', 1, 2)} {link('c')} {prose('c', 1, 2)}</p>", lambda: f"<p>{words('c', 2, 9)}</p>", lambda: f"<table><tr><td>{words('c')}</td><td>{words('c')}</td></tr></table>",
            lambda: f"<div>{prose('c')}</div>", lambda: wrap("div." + pick(("story-search", "article-share", "text-menu", "post-toc", "search", "toolbar", "main-register")), f"<p>{prose('c', 3, 6)}</p>"),
            lambda: wrap("section." + pick(("part", "chapter", "post-text", "x1")), f"<h3>{words('c')}</h3><p>{prose('c')}</p>"),
        ])()

    def inner_part() -> str:
        return pick([
            lambda: wrap("div." + pick(("advert", "ad", "sponsored", "promo-box")), pick((words("b", 2, 6), prose("b", 1, 2), f"<p>{prose('b', 1, 2)}</p>"))), lambda: wrap("div." + pick(("share", "social-share", "post-share")), link("b") * 3),
            lambda: "<form><label>b1</label><input><button>b2</button></form>", lambda: wrap("aside" + pick(("", ".related", ".box")), f"<p>{prose('b', 1, 3)}</p>{link('b')}"),
            lambda: wrap("div." + pick(("newsletter", "subscribe-box")), f"<p>Subscribe {words('b')}.</p><button>b3</button>"), lambda: "<footer>" + words("b") + link("b") + "</footer>", lambda: f"<nav>{link('b') * 3}</nav>",
        ])()

    def outer_part() -> str:
        lists = lambda: "<ul>" + "".join(f"<li>{link('b')}</li>" for _ in range(r.randint(2, 7))) + "</ul>"
        return pick([
            lambda: f"<nav>{lists()}</nav>", lambda: wrap("div." + pick(("menu", "main-nav", "breadcrumbs", "topbar")), lists()), lambda: wrap("div." + pick(("ad", "ads", "advertisement")), prose("b", 1, 3)),
            lambda: wrap("div." + pick(("sidebar", "sidebar-left", "widget", "related-posts", "article-sidebar")), f"<p>{prose('b', 1, 4)}</p>" + lists()), lambda: wrap("aside", f"<p>{prose('b', 1, 4)}</p>"),
            lambda: wrap("div." + pick(("cookieNotice", "notice", "consent")), f"We use cookies. {prose('b', 1, 2)}"), lambda: f"<div>{link('b')} | {link('b')} | {link('b')}</div>", lambda: lists(),
            lambda: wrap(pick(("section", "div")) + "." + pick(("comments", "comment-list", "discussion")), f"<h3>{words('b')}</h3>" + "".join(f"<div><p>{prose('b', 1, 4)}</p></div>" for _ in range(r.randint(1, 4)))),
            lambda: "<form><label>b4</label><input><button>b5</button></form>", lambda: f"<p>{words('b', 1, 4)}</p>",
        ])()

    pages = []
    for _ in range(n):
        parts = [f"<h1>{words('c', 2, 8)}</h1>"] + [content_part() for _ in range(r.randint(2, 12))]
        for _ in range(r.choice((0, 0, 1, 2))):
            parts.insert(r.randrange(1, len(parts) + 1), inner_part())
        if r.random() < 0.3:
            parts[0] = f"<header>{parts[0]}<p>{words('c', 2, 5)}</p></header>"
        body = wrap(pick(("article", "article", "article.post", "main", "div.content", "div.post-content", "div.story-body", "div.entry", "div", "section.text")), "".join(parts))
        if r.random() < 0.3:
            body = wrap("div." + pick(("page-with-sidebar", "wrap", "main", "content")), body)
        before, after = ([outer_part() for _ in range(r.randint(0, 4))] for _ in range(2))
        top = pick(("", f"<header><h1>{words('b', 1, 3)}</h1>{link('b')}</header>", wrap("div.header", link("b") * 2)))
        end = pick(("", f"<footer>&copy; {words('b', 1, 12)}.</footer>", wrap("div.footer", f"<p>Copyright {words('b')}</p>" + link("b")), f"<footer><p>{prose('b', 1, 2)}</p></footer>"))
        pages.append("<body>" + top + "".join(before) + body + "".join(after) + end)
    return pages


def fit(pages: list[str] | None = None, marks: str = r"\bc\d", ridge: float = 3.0, rounds: int = 12) -> Costs:
    """A ridge logistic regression (Newton steps) on the blocks of labelled pages: a block is content if its text holds `marks`."""
    found = [b for page in (labelled_pages() if pages is None else pages) for b in blocks(page)[0]]
    y = np.array([bool(re.search(marks, b.text)) for b in found], float)
    x = np.array([features(b) for b in found])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (y - p) - ridge * w
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return Costs(tuple(float(v) for v in w))


@cache
def fitted() -> Costs:
    """The costs from the built-in labelled pages."""
    return fit()


def leaning(b: Block, c: Costs, names: bool = True) -> float:
    """Log-odds that a block is content."""
    return sum(v * w for v, w in zip(features(b, names), c.weights, strict=True) if v)


FAR = 6


def _steps(a: int, b: int, around: list[int]) -> int:
    """Containers between two containers, FAR at most. A container has a greater number than the one around it."""
    steps = 0
    while a != b and steps < FAR:
        if a > b:
            a = around[a]
        else:
            b = around[b]
        steps += 1
    return steps


def edges(found: list[Block], around: list[int], c: Costs) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours in page order by what lies between them, and each block with the one before it in its container."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            steps = _steps(found[i - 1].container, b.container, around)
            if steps < FAR:
                out.append((i - 1, i, c.follows * c.per_container**steps))
        if b.container in last:
            out.append((last[b.container], i, c.same_container))
        last[b.container] = i
    return out


#: Blocks of a page from which on those that no cut can flip are fixed before the flow.
MANY = 1000


def min_cut(unary: list[float], pairs: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node labelled true gains its unary, and each pair of different labels costs its weight.

    Max-flow (Dinic) finds them. On long pages nodes whose leaning outweighs all their edges, which keep their own label in
    every least cut, go first and pull their neighbours; the flow decides the rest.
    """
    n = len(unary)
    u, near = list(unary), [dict() for _ in range(n)]
    for a, b, w in pairs:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n if n > MANY else 0))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(u[i]) >= sum(near[i].values()):
            label[i] = u[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                u[j] += w if label[i] else -w
                queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, side in zip(left, _source_side(left, u, near), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _source_side(nodes: list[int], u: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic on the nodes with terminals; true where the residual graph still reaches from the source."""
    index = {x: k for k, x in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    graph: list[list[list]] = [[] for _ in range(len(nodes) + 2)]  # [to, capacity, index of the reverse edge]

    def add(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append([b, forth, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for k, x in enumerate(nodes):
        add(s, k, max(u[x], 0.0), 0.0)
        add(k, t, max(-u[x], 0.0), 0.0)
        for y, w in near[x].items():
            if index[y] > k:
                add(k, index[y], w, w)
    tiny = 1e-12
    while True:
        level = [-1] * len(graph)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for b, cap, _ in graph[a]:
                if cap > tiny and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[t] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        used = [0] * len(graph)
        path: list[list] = []
        a = s
        while True:
            if a == t:
                flow = min(e[1] for e in path)
                for e in path:
                    e[1] -= flow
                    graph[e[0]][e[2]][1] += flow
                path, a = [], s
                continue
            while used[a] < len(graph[a]):
                e = graph[a][used[a]]
                if e[1] > tiny and level[e[0]] == level[a] + 1:
                    break
                used[a] += 1
            else:
                if not path:
                    break
                e = path.pop()
                a = graph[e[0]][e[2]][0]
                used[a] += 1
                continue
            path.append(e)
            a = e[0]


#: Added to every block's log-odds on a page that would have no content otherwise.
BARE = 4.0


def main_text(html: str | None, costs: Costs | None = None) -> str:
    """The main text. If class and id words leave none, they mislead, and tags alone are judged; if these leave none, too, the page
    is a bare one, and every block without a strong sign of boilerplate counts."""
    costs = costs or fitted()
    found, around = blocks(html or "")
    ties = edges(found, around, costs)
    for names, shift in ((True, 0.0), (False, 0.0), (True, BARE)):
        chosen = min_cut([leaning(b, costs, names) + shift for b in found], ties)
        if any(chosen):
            break
    return " ".join(b.text for b, keep in zip(found, chosen, strict=True) if keep)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", costs: Costs | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty html give an empty text, as do pages without shown text. A null page_id or url stays null; repeated rows
    stay; an empty table gives no row. Pages may have any length. Of equally cheap cuts the one with the least content
    counts. Other columns are not read, so their names may clash.
    """
    costs = costs or fitted()
    source = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 2):
            texts = [main_text(h, costs) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
