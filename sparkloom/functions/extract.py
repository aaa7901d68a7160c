"""Extraction of prose from pages as typed blocks, and of title, excerpt, links and probes."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom import config
from sparkloom.functions import htmltree, urlparse
from sparkloom.functions.htmltree import Node

ANCHOR = "struct<label:string,href:string>"
BLOCK = f"struct<kind:string,level:int,ordered:boolean,header:boolean,text:string,html:string,cells:array<string>,cells_html:array<string>,anchors:array<{ANCHOR}>>"
CLEAN = f"title string, content_html string, blocks array<{BLOCK}>, text string, excerpt string, truncated boolean, content_root string, failure string, canonical_href string, probe_length int, mount boolean"
# Elements without prose, page furniture, and the tags that make blocks.
_NOISE = frozenset("script style noscript template iframe svg img picture".split())
_FURNITURE, _ROLES, _HIDDEN = frozenset(("nav", "footer", "aside")), frozenset(("navigation", "banner", "contentinfo")), frozenset(("sr-only", "visually-hidden"))
_KINDS = {**{f"h{k}": "heading" for k in range(1, 7)}, "li": "listItem", "blockquote": "quote", "pre": "code", "dt": "term", "dd": "definition",
          **dict.fromkeys(("p", "figcaption", "address", "summary", "caption", "td", "th"), "paragraph")}
_STRUCTURE = frozenset("table thead tbody tfoot tr ul ol dl".split())
_DESKTOP = re.compile(r"(?:sm|md|lg|xl|2xl):(?:block|flex|grid|inline|inline-block|inline-flex|table|contents|list-item)")
_BOOTSTRAP = re.compile(r"d-(?:sm|md|lg|xl|xxl)-(?:block|flex|inline|inline-block|inline-flex|grid|inline-grid|table|table-row|table-cell)")
_SPACE = re.compile(r"\s+")


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def escape(text: str) -> str:
    return html.escape(text, quote=True).replace("&#x27;", "&#39;")


def is_desktop_only(node: Node) -> bool:
    names = node.classes()
    return ("hidden" in names and any(map(_DESKTOP.fullmatch, names))) or ("d-none" in names and any(map(_BOOTSTRAP.fullmatch, names)))


def _words(text: str) -> Counter[str]:
    return Counter(w for w in re.findall(r"[a-z0-9]+", text.lower()) if len(w) > 2)


def prune(root: Node) -> None:
    """Remove what is no prose: noise, furniture, hidden texts, twins for wide screens, galleries of cards."""
    gone = []
    for node in list(root.walk()):
        if node.tag in _NOISE or node.tag in _FURNITURE or node.attrs.get("role") in _ROLES or _HIDDEN & set(node.classes()) or (node.tag == "header" and any(n.tag == "nav" for n in node.walk())):
            gone.append(node)
    for node in gone:
        node.drop()
    body = htmltree.body_of(root)
    outermost: list[Node] = []
    for node in list(root.walk()):
        if is_desktop_only(node) and not any(a in outermost for a in node.ancestors()):
            outermost.append(node)
    for node in outermost:
        own = _words(node.text())
        whole = _words(body.text()) if own else Counter()
        if sum(whole[w] > n for w, n in own.items()) >= config.TWIN_SHARE * len(own):
            node.drop()
    for node in list(root.walk()):
        if "grid" in node.classes() and any(n.tag == "a" and "card--default" in n.classes() for n in node.walk()):
            node.drop()


def content_root(root: Node) -> tuple[Node, str]:
    """First main, article or role=main with text (only the first match of each is looked at), else the body."""
    tests = (("main", lambda n: n.tag == "main"), ("article", lambda n: n.tag == "article"), ("role-main", lambda n: n.attrs.get("role") == "main"))
    for name, test in tests:
        node = next(filter(test, root.walk()), None)
        if node is not None and node.text().strip():
            return node, name
    return htmltree.body_of(root), "body"


def resolve(raw: str | None, base: urlparse.Url | None) -> str | None:
    """Absolute web link without a fragment, or None."""
    href = (raw or "").strip()
    if not href or href.startswith("#") or re.match(r"(?:javascript|mailto|tel|data):", href, re.IGNORECASE):
        return None
    url = urlparse.parse(href, base)
    return url.href() if url is not None and url.scheme in ("http", "https") else None


class _Run:
    """A block in the making: the inline text that belongs to it, in order of its start."""

    def __init__(self, kind: str, level: int | None = None, ordered: bool | None = None) -> None:
        self.kind, self.level, self.ordered = kind, level, ordered
        self.text: list[str] = []
        self.html: list[str] = []
        self.anchors: list[tuple[str, str]] = []
        self.cells: list[_Run] | None = None
        self.header: bool | None = None

    def block(self) -> dict[str, Any] | None:
        if self.cells is not None:
            cells = [squeeze("".join(c.text)) for c in self.cells]
            if not any(cells):
                return None
            anchors = [a for c in self.cells for a in c.anchors]
            return _block("row", header=self.header, cells=cells, cells_html=[squeeze("".join(c.html)) for c in self.cells], anchors=anchors)
        text = squeeze("".join(self.text))
        return _block(self.kind, level=self.level, ordered=self.ordered, text=text, html=squeeze("".join(self.html)), anchors=self.anchors) if text else None


def _block(kind: str, *, anchors: list[tuple[str, str]], **fields: Any) -> dict[str, Any]:
    empty = dict.fromkeys(("level", "ordered", "header", "text", "html", "cells", "cells_html"))
    return {"kind": kind, **empty, **fields, "anchors": [{"label": a, "href": b} for a, b in anchors]}


class _Walker:
    """One pass over the tree: each text belongs to the nearest enclosing block, or to the loose run between blocks.

    The work is a stack of steps (enter an element, leave it), so depth is no limit.
    """

    def __init__(self, base: urlparse.Url | None) -> None:
        self.base, self.runs, self.loose = base, [], None

    def _loose(self) -> _Run:
        if self.loose is None:
            self.loose = _Run("paragraph")
            self.runs.append(self.loose)
        return self.loose

    def blocks(self, root: Node) -> list[dict[str, Any]]:
        # A step: (node or text, owner or None for the loose run, in an ordered list, spaced: cell text).
        todo: list[tuple[Any, _Run | None, bool, bool]] = [(c, None, False, False) for c in reversed(root.children)]
        while todo:
            item, owner, ordered, spaced = todo.pop()
            if callable(item):
                item()
                continue
            if isinstance(item, str):
                run = owner or self._loose()
                run.text.append(item)
                run.html.append(escape(item))
                continue
            tag = item.tag
            children = lambda own, ordr=ordered, sp=spaced, node=item: [(c, own, ordr, sp) for c in reversed(node.children)]
            if spaced:
                owner.text.append(" ")
                owner.html.append(" ")
                if tag == "br":
                    continue
                todo += self._link(item, owner, children(owner)) if tag == "a" else children(owner)
            elif tag == "tr":
                self.loose = None
                row = _Run("row")
                row.cells, cells = [], [c for c in item.children if isinstance(c, Node) and c.tag in ("td", "th")]
                row.header = any(c.tag == "th" for c in cells)
                self.runs.append(row)
                for cell in cells:
                    row.cells.append(_Run("cell"))
                for cell, run in reversed(list(zip(cells, row.cells))):
                    todo += [(c, run, ordered, True) for c in reversed(cell.children)]
            elif tag in _STRUCTURE:
                self.loose = None
                todo.append((self._end_loose, None, False, False))
                todo += children(None, tag == "ol" if tag in ("ul", "ol") else ordered)
            elif tag in _KINDS:
                self.loose = None
                kind = _KINDS[tag]
                run = _Run(kind, int(tag[1]) if kind == "heading" else None, ordered if kind == "listItem" else None)
                self.runs.append(run)
                todo.append((self._end_loose, None, False, False))
                todo += children(run)
            elif tag == "br":
                if owner is not None:
                    owner.text.append(" ")
                    owner.html.append(" ")
            elif tag == "a":
                run = owner or self._loose()
                todo += self._link(item, run, children(run))
            else:
                todo += children(owner)
        return [b for b in (r.block() for r in self.runs) if b is not None]

    def _end_loose(self) -> None:
        self.loose = None

    def _link(self, node: Node, run: _Run, inner: list[Any]) -> list[Any]:
        """Steps of a link: its opening now, its label once its text is known."""
        href = resolve(node.attrs.get("href"), self.base)
        at = len(run.text)
        if href:
            run.html.append(f'<a href="{escape(href)}">')

        def close() -> None:
            if href:
                label = squeeze("".join(run.text[at:]))
                if label:
                    run.anchors.append((label, href))
                run.html.append("</a>")

        return [(close, None, False, False), *inner]


def dedup_blocks(blocks: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Keep the first of equal long texts of a kind."""
    seen: set[tuple[str, str]] = set()
    out = []
    for b in blocks:
        text = block_text(b)
        if len(text) >= config.BLOCK_DEDUP_CHARS:
            if (b["kind"], text) in seen:
                continue
            seen.add((b["kind"], text))
        out.append(b)
    return out


def block_text(b: dict[str, Any]) -> str:
    return " ".join(b["cells"]) if b["cells"] is not None else b["text"]


def _open_html(group: list[dict[str, Any]]) -> str:
    first = group[0]
    if first["kind"] == "heading":
        return f"<h{first['level']}>{first['html']}</h{first['level']}>"
    if first["kind"] == "listItem":
        name = "ol" if first["ordered"] else "ul"
        return f"<{name}>{''.join(f'<li>{b["html"]}</li>' for b in group)}</{name}>"
    if first["kind"] == "row":
        rows = []
        for b in group:
            cell = "th" if b["header"] else "td"
            rows.append(f"<tr>{''.join(f'<{cell}>{c}</{cell}>' for c in b['cells_html'])}</tr>")
        return f"<table>{''.join(rows)}</table>"
    if first["kind"] in ("term", "definition"):
        return f"<dl>{''.join(f'<dt>{b["html"]}</dt>' if b['kind'] == 'term' else f'<dd>{b["html"]}</dd>' for b in group)}</dl>"
    name = {"quote": "blockquote", "code": "pre"}.get(first["kind"], "p")
    return f"<{name}>{first['html']}</{name}>"


def grouped(blocks: list[dict[str, Any]]) -> list[list[dict[str, Any]]]:
    """Runs of list items of one order, of rows, and of terms and definitions; every other block by itself."""
    def family(b: dict[str, Any]) -> Any:
        return {"listItem": ("list", b["ordered"]), "row": "row", "term": "dl", "definition": "dl"}.get(b["kind"])

    out: list[list[dict[str, Any]]] = []
    for b in blocks:
        if out and family(b) is not None and family(out[-1][-1]) == family(b):
            out[-1].append(b)
        else:
            out.append([b])
    return out


def serialise(blocks: list[dict[str, Any]], cap: int = config.CONTENT_CAP) -> tuple[list[dict[str, Any]], str, bool]:
    """Blocks that fit, their fragment, and whether something was cut. Whole groups are kept; a first group that is too long by itself is cut inside its text, rows excepted."""
    kept: list[dict[str, Any]] = []
    parts: list[str] = []
    used = 0
    for group in grouped(blocks):
        part = _open_html(group)
        if used + len(part) + 1 > cap:
            if not kept and group[0]["cells"] is None:
                text = group[0]["text"][: max(0, cap - 64)]
                kept = [{**group[0], "text": text, "html": escape(text), "anchors": []}]
                parts = [_open_html(kept)]
            return kept, "\n".join(parts), True
        used += len(part) + 1
        kept += group
        parts.append(part)
    return kept, "\n".join(parts), False


def _meta(root: Node) -> tuple[str | None, str | None, str | None, str | None]:
    """og:title, title, description and canonical link."""
    og = title = description = og_description = canonical = None
    for n in root.walk():
        if n.tag == "title" and title is None:
            title = squeeze(n.text()) or None
        elif n.tag == "meta":
            content = n.attrs.get("content", "").strip() or None
            name, prop = n.attrs.get("name", "").lower(), n.attrs.get("property", "").lower()
            og = og or (content if prop == "og:title" else None)
            description = description or (content if name == "description" else None)
            og_description = og_description or (content if prop == "og:description" else None)
        elif n.tag == "link" and canonical is None and n.attrs.get("href") and "canonical" in n.attrs.get("rel", "").lower().split():
            canonical = n.attrs["href"]
    return og, title, description or og_description, canonical


def clean(markup: str | None, page_url: str | None) -> dict[str, Any]:
    """Everything that is extracted from one page; never raises: an error gives an empty result with ``failure``."""
    out: dict[str, Any] = dict.fromkeys(x.split(" ")[0] for x in ("title", "content_html", "blocks", "text", "excerpt", "content_root", "failure", "canonical_href"))
    out |= {"blocks": [], "truncated": False, "probe_length": 0, "mount": False}
    if markup is None or len(markup) < 40:
        return out
    try:
        root = htmltree.parse(markup)
        base = urlparse.parse(page_url)
        texts = [n.text() for name in ("main", "article", "body") for n in [next((x for x in root.walk() if x.tag == name), None)] if n is not None]
        out["probe_length"] = len(squeeze(next((t for t in texts if t), "")))
        out["mount"] = any(n.attrs.get("id") in ("root", "__next", "app") for n in root.walk())
        og, title, description, out["canonical_href"] = _meta(root)
        prune(root)
        top, out["content_root"] = content_root(root)
        blocks = dedup_blocks(_Walker(base).blocks(top))
        out["blocks"], out["content_html"], out["truncated"] = serialise(blocks)
        out["content_html"] = out["content_html"] or None
        out["text"] = "\n".join(map(block_text, out["blocks"])) or None
        heading = next((b["text"] for b in out["blocks"] if b["kind"] == "heading" and b["level"] == 1), None)
        out["title"] = heading or og or title
        out["excerpt"] = description or next((b["text"] for b in out["blocks"] if b["kind"] == "paragraph"), None)
    except Exception as error:  # noqa: BLE001  a page must not end the job
        out |= {"title": None, "content_html": None, "blocks": [], "text": None, "excerpt": None, "truncated": False, "content_root": None, "failure": f"{type(error).__name__}: {error}"[:500]}
    return out


def extract_clean(markup: Column, page_url: Column) -> Column:
    """Clean content of pages, as a struct. Null or short markup gives an empty result."""
    names = [x.strip().split(" ")[0] for x in ("title", "content_html", "blocks", "text", "excerpt", "truncated", "content_root", "failure", "canonical_href", "probe_length", "mount")]

    def apply(pages: pd.Series, addresses: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean(m, u) for m, u in zip(pages, addresses)], columns=names)

    return _vectorised(apply, CLEAN, 2)(markup, page_url)


def _vectorised(apply: Any, kind: str, n: int) -> Any:
    """A pandas UDF made when it is used, as its type is parsed by the running session."""
    apply.__annotations__ = {**{name: pd.Series for name in apply.__code__.co_varnames[:n]}, "return": pd.DataFrame if "," in kind and not kind.startswith("array") else pd.Series}
    return F.pandas_udf(apply, kind)


def links(markup: str | None, page_url: str | None) -> list[str]:
    """Distinct absolute web links of a page in order, without fragments."""
    if not markup:
        return []
    base, seen = urlparse.parse(page_url), {}
    for node in htmltree.parse(markup).walk():
        href = node.attrs.get("href", "").strip() if node.tag == "a" else ""
        if href and not href.startswith(("#", "mailto:", "javascript:")):
            url = urlparse.parse(href, base)
            if url is not None and url.scheme in ("http", "https"):
                seen.setdefault(url.href())
    return list(seen)


def extract_links(markup: Column, page_url: Column) -> Column:
    """Distinct absolute web links of pages, as arrays."""
    def apply(pages: pd.Series, addresses: pd.Series) -> pd.Series:
        return pd.Series([links(m, u) for m, u in zip(pages, addresses)])

    return _vectorised(apply, "array<string>", 2)(markup, page_url)


def heading_paths(blocks: Column) -> Column:
    """For each block, the headings it stands under, outermost first: the last heading of each level not closed by a higher one."""
    start = F.struct(F.array().cast("array<struct<level:int,text:string>>").alias("open"), F.array().cast("array<array<string>>").alias("paths"))

    def step(acc: Column, b: Column) -> Column:
        above = F.filter(acc["open"], lambda h: (b["kind"] != "heading") | (h["level"] < b["level"]))
        here = F.when(b["kind"] == "heading", F.concat(above, F.array(F.struct(b["level"].alias("level"), b["text"].alias("text"))))).otherwise(above)
        return F.struct(here.alias("open"), F.concat(acc["paths"], F.array(F.transform(here, lambda h: h["text"]))).alias("paths"))

    return F.aggregate(blocks, start, step, lambda acc: acc["paths"])
