"""A small document tree from the standard library's HTML tokeniser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: a start tag ends open ones of the second set, up to one of the third
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
_IN_HEAD = frozenset("title meta link base script style noscript template".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def above(self) -> Iterator[Node]:
        """The elements that hold this one, nearest first."""
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def pieces(self, without: frozenset[str] = frozenset()) -> Iterator[str]:
        """Texts below in order, leaving out some elements' own."""
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in without:
                stack += reversed(node.children)

    def text(self, without: frozenset[str] = frozenset()) -> str:
        return "".join(self.pieces(without))

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.open = [self.root]

    def _end_open(self, which: set[str] | frozenset[str], limit: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in limit:
                return
            if self.open[i].tag in which:
                del self.open[i:]
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and (had := next((n for n in self.open if n.tag == tag), None)):
            for name, value in attrs:
                had.attrs.setdefault(name, value or "")
            return
        if tag in _CLOSES_P:
            self._end_open({"p"}, {"table", "td", "th", "button"})
        if tag in _ENDS:
            self._end_open(*_ENDS[tag])
        if tag not in _IN_HEAD and tag not in ("html", "head") and self.open[-1].tag == "head":
            self.open.pop()
        known: dict[str, str] = {}
        for name, value in attrs:
            known.setdefault(name, value or "")
        node = Node(tag, known, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and any(n.tag in ("svg", "math") for n in self.open[:-1]):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.open.pop()
        self.open[-1].children.append(data)


def read(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def body_of(root: Node) -> Node:
    """The body; where no tag opens one, all that is not of the head."""
    found = next((n for n in root.walk() if n.tag == "body"), None)
    if found is not None:
        return found
    holder = next((n for n in root.children if isinstance(n, Node) and n.tag == "html"), root)
    out = Node("body", {}, holder)
    out.children = [c for c in holder.children if isinstance(c, str) or c.tag not in ("head", *_IN_HEAD)]
    return out


def clean(text: str) -> str:
    """Spaces in a row are one, none at the ends; a no-break space is a space."""
    return re.sub(r"[\s﻿]+", " ", text).strip()
