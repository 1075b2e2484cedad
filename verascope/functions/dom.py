"""A small element tree over the standard parser, for extraction rules that need selectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from verascope.functions import references

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Fixed values, of the HTML standard: elements that end an open paragraph, and those inside of which a paragraph is still open.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark nobr q ruby s samp small span strike strong sub sup time tt u var".split())
_SIMPLE = re.compile(r"([\w-]*)((?:[.#][\w-]+|\[[^\]]+\])*)$")
_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:(\*?=)\"?([^\"\]]*)\"?)?\]")


class Node:
    """An element with attributes and children, which are elements or text."""

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.children: list[Node | str] = []
        #: The paragraph that is open here.
        self.paragraph: Node | None = self if tag == "p" else up.paragraph if up and tag in _INLINE else None

    def walk(self) -> Iterator[Node]:
        """Elements below, in page order; a loop over a stack, as pages nest deeply."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Node):
                yield child
                stack.append(iter(child.children))

    def strings(self) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                yield child
            else:
                stack.append(iter(child.children))

    def text(self, separator: str = "") -> str:
        """Stripped, non-empty strings joined."""
        return separator.join(s for s in (x.strip() for x in self.strings()) if s)

    def matches(self, selector: str) -> bool:
        m = _SIMPLE.match(selector)
        if not m or m[1] and m[1] != self.tag:
            return False
        for kind, name, attr, op, value in _PART.findall(m[2]):
            if kind == "." and name not in self.attrs.get("class", "").split() or kind == "#" and name != self.attrs.get("id"):
                return False
            if attr and (attr not in self.attrs or op == "=" and self.attrs[attr] != value or op == "*=" and value not in self.attrs[attr]):
                return False
        return True

    def find(self, *selectors: str) -> Node | None:
        """The first element that matches any of the selectors."""
        return next((n for n in self.walk() if any(n.matches(s) for s in selectors)), None)

    def drop(self, *selectors: str) -> None:
        gone = {id(n): n for n in self.walk() if any(n.matches(s) for s in selectors)}
        for up in {id(n.up): n.up for n in gone.values() if n.up}.values():
            up.children = [c for c in up.children if id(c) not in gone]


class _Builder(HTMLParser):
    def __init__(self, sign: str) -> None:
        super().__init__(convert_charrefs=True)
        self.sign = sign
        self.root = self.now = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_P and self.now.paragraph:
            # also below a bold word left open: its text would count twice, with it and alone
            self.now = self.now.paragraph.up or self.root
        elif tag == "li" and self.now.tag == tag:
            self.now = self.now.up or self.root
        node = Node(tag, {k: (v or "").replace(self.sign, "&") for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in _VOID:
            self.now = node

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.now
        while node and node.tag != tag:
            node = node.up
        if node and node.up:
            self.now = node.up

    def handle_data(self, data: str) -> None:
        self.now.children.append(data.replace(self.sign, "&"))


def parse(html: str) -> Node:
    text, sign = references.marked(html)
    b = _Builder(sign)
    b.feed(text)
    b.close()
    return b.root


#: Selectors of article bodies in the order they are tried, and what is removed first.
NEWS_BODIES = ("article", '[itemprop="articleBody"]', ".article-body", ".story-body", ".article__body", ".post-content", ".entry-content", "main", "#main-content")
NEWS_NOISE = ("script", "style", "nav", "footer", "header", "aside", "figure", "form", "noscript", "iframe")
ARCHIVE_BODIES = ("article", "main", '[role="main"]', ".article-body", ".story-body", ".entry-content", ".post-content", "#content", "#main-content")
ARCHIVE_NOISE = ("#wm-ipp-base", "#wm-ipp", ".wb-autocomplete-suggestion", "script", "style", "nav", "footer", "header", "aside", "iframe", "noscript", ".ad", ".advertisement")
PROFILE_BODIES = ("article", ".reader-article-content", ".prose", '[class*="article"]')


def article_body(html: str | None, bodies: tuple[str, ...] = NEWS_BODIES, noise: tuple[str, ...] = NEWS_NOISE, least: int = 80, separator: str = "\n") -> str:
    """The text of the first body of `least` characters or more; else paragraphs of over 40 characters. Too short: empty."""
    root = parse(html or "")
    root.drop(*noise)
    for selector in bodies:
        found = root.find(selector)
        if found and len(text := found.text(separator)) >= least:
            return text
    text = "\n".join(t for n in root.walk() if n.tag == "p" and len(t := n.text()) > 40)
    return text if len(text) >= least else ""


def profile_body(html: str | None) -> str:
    """As on a professional network: a body of 100 characters, else the page's description."""
    root = parse(html or "")
    for selector in PROFILE_BODIES:
        found = root.find(selector)
        if found and len(text := found.text(" ")) >= 100:
            return text
    meta = root.find('meta[property="og:description"]')
    return meta.attrs.get("content", "").strip() if meta else ""
