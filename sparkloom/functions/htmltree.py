"""A small HTML tree on the standard tokenizer: void elements, implied end tags, raw text, stray end tags ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: Elements that an equal (or sibling) start tag ends, and the ancestors beyond which that has no effect.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
_SCOPE = frozenset("table td th caption html body object template".split())


class Node:
    """An element: ``children`` are nodes and strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below this one in document order, without recursion."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.children)
        return "".join(out)

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def classes(self) -> list[str]:
        return re.split(r"\s+", self.attrs.get("class", "").strip())


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("#root")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_P:
            self._close({"p"}, _SCOPE)
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.top)
        self.top.children.append(node)
        if tag not in VOID:
            self.top = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # In HTML a slash ends only void elements.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.top
        while node.parent is not None and node.tag != tag:
            if tag not in ("html", "body", "table") and node.tag in ("td", "th", "table") and tag not in ("tr", "tbody", "thead", "tfoot"):
                return
            node = node.parent
        if node.parent is not None:
            self.top = node.parent

    def handle_data(self, data: str) -> None:
        self.top.children.append(data)

    def _close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """End the outermost open element of ``tags`` that is not beyond an element of ``stop``."""
        node, found = self.top, None
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                found = node
            node = node.parent
        if found is not None and found.parent is not None:
            self.top = found.parent


def parse(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


def body_of(root: Node) -> Node:
    return next((n for n in root.walk() if n.tag == "body"), root)
