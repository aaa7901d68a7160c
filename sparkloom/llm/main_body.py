"""Problem 5: the main body of pages, by a suffix array of each host's pages.

The token streams of a host's pages are concatenated line by line, with digits and the host's own name masked.
The suffixes are named by their first tokens by prefix doubling and sorted by name and page, which is the suffix
array up to the length of a run; a run on many distinct pages is boilerplate. Every longer repeated substring
consists of such runs, so nothing is lost by the truncation. A line shorter than a run counts as a whole, and a
dated one also without any two neighbouring words, as its author changes. Lines that repeated runs cover are
removed; of what is left, the unique text in the frame that holds the page's heading is the body. Hosts too
small to show what they repeat are compared by whole lines with all hosts together.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import beside, host_of, small
from sparkloom.session import checkpoint

#: Tokens of a repeated run (a power of two); share of a line that runs must cover.
RUN, COVERED = 8, 0.75
#: A run or line is boilerplate on a host if so many distinct contents, and this share of the host's, have it.
LEAST_PAGES, HOST_SHARE = 3, 0.04
#: Share of all distinct contents, and number of hosts, from which a masked line is boilerplate on hosts with fewer contents than ``SMALL_HOST``.
ALL_SHARE, LEAST_HOSTS = 0.01, 5
SMALL_HOST = int(LEAST_PAGES / HOST_SHARE)
#: Contents of a host that are counted at once; the result does not depend on it.
BLOCK = 1024

# Elements without visible text, without an end tag, that hold others, and that start a new line of text.
_UNSEEN = {"script", "style", "noscript", "template", "head", "title", "iframe", "svg", "textarea", "select", "button"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HOLDERS = {"body", "div", "section", "article", "main", "aside", "nav", "header", "footer", "td", "form"}
_FRAMES = {"aside", "nav", "footer", "form"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "button"}
# Labels of paid inserts.
_INSERT = re.compile(r"\W*(?:advertisement|advertorial|sponsored(?: content)?|ad|anzeige|werbung|publicit[eé]|publicidad|publicidade|広告)\W*", re.IGNORECASE)
_TOKENS = r"<!--.*?(?:-->|$)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({inside}*+)>|\n|[^<\n]+|<"
_MARKUP = re.compile(_TOKENS.format(inside="(?:[^>\"']|\"[^\"]*\"|'[^']*')"), re.DOTALL)
#: For pages with a quotation mark that is never closed: a tag ends at the next bracket.
_PLAIN = re.compile(_TOKENS.format(inside="[^>]"), re.DOTALL)
#: Beyond the last bracket no tag can end.
_REST = re.compile(r"\n|[^\n]+|(?!)()()()")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe")}
_NAME = re.compile(r"(?:class|id|align|width|role|colspan)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+))", re.IGNORECASE)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.IGNORECASE | re.DOTALL)
_TOKEN = re.compile(r"\d{4}-\d{1,2}-\d{1,2}|\d+|[^\W\d_]+")
_DATE = re.compile(r"\d{4}-")
_PARTS = re.compile(r"\s+[|–—·-]\s+")


class Unit:
    """A text between starts of elements: its lines, text, holder, and whether it is a link, a heading or code."""

    __slots__ = ("code", "head", "holder", "lines", "link", "text")

    def __init__(self, holder: int) -> None:
        self.holder, self.lines, self.text, self.link, self.head, self.code = holder, [], [], 0, 0, False


def units_of(page: str) -> tuple[list[Unit], list[tuple[int, str]], int]:
    """Units of a page, its holders (parent, signature), and the holder of its first level-1 heading (-1 without one).

    Elements that begin and end on one line, such as the cells of a row, make one unit, as a line is judged as a whole.
    """
    units: list[Unit] = []
    holders: list[tuple[int, str]] = [(-1, "")]
    stack: list[tuple[str, int]] = []
    here, line, at, heading = 0, 1, 0, -1
    current: Unit | None = None
    links = heads = code = unseen = 0
    broken, markup, last = True, _MARKUP, page.rfind(">")
    while (m := (markup if at <= last else _REST).match(page, at)) is not None:
        if at <= last and markup is _MARKUP and m.group(0) == "<" and at < last and page[at + 1 : at + 2].isalpha():
            markup = _PLAIN
            continue
        tail = at > last
        at = m.end()
        piece = m.group(0)
        tag = m.group(2)
        if tag is None:
            if piece == "\n":
                line += 1
            elif piece[0] == "<" and len(piece) > 1 and not tail:
                line += piece.count("\n")
            elif not unseen and not piece.isspace():
                if current is None or (broken and current.lines[-1] != line) or current.holder != here and current.lines[-1] != line:
                    current = Unit(here)
                    units.append(current)
                if not current.lines or current.lines[-1] != line:
                    if current.lines:
                        current.text.append("\n")
                    current.lines.append(line)
                current.text.append(piece)
                n = len(piece)
                current.link += n if links else 0
                current.head = max(current.head, heads)
                current.code |= code > 0
                broken = False
            continue
        tag, closing = tag.lower(), bool(m.group(1))
        line += piece.count("\n")
        if tag not in _INLINE:
            broken = True
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in ("pre", "code"):
                code = max(0, code - 1)
            elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heads = 0
            elif tag in _UNSEEN:
                unseen = max(0, unseen - 1)
            if tag in _HOLDERS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        here = stack[k][1]
                        del stack[k:]
                        break
        elif tag not in _VOID and not m.group(3).endswith("/"):
            if tag in _RAW_END:
                end = _RAW_END[tag].search(page, at)
                stop = end.end() if end else len(page)
                line += page.count("\n", at, stop)
                at = stop
                continue
            if tag == "a":
                links += 1
            elif tag in ("pre", "code"):
                code += 1
            elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heads = int(tag[1])
                if heads == 1 and heading < 0:
                    heading = here
            elif tag in _UNSEEN:
                unseen += 1
            if tag in _HOLDERS and tag != "body":
                names = " ".join(a or b or c for a, b, c in _NAME.findall(m.group(3))) if m.group(3) else ""
                stack.append((tag, here))
                holders.append((here, f"{tag} {names}".strip()))
                here = len(holders) - 1
    return units, holders, heading


def mask(text: str, brand: frozenset[str]) -> list[str]:
    """Tokens without case: dates and numbers masked, the host's name too."""
    return ["%" if _DATE.match(t) else "#" if t[0].isdigit() else "@" if t in brand else t for t in _TOKEN.findall(text.lower())]


class Lines(dict):
    """``(masked line, key, gap keys, token codes)`` by text and name of the site; forgets all when it is large."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def __missing__(self, of: tuple[str, frozenset[str]]) -> tuple[str, int, list[int], list[int]]:
        if len(self) > 100_000:
            self.clear()
        if len(self.codes) > 1_000_000:
            self.codes.clear()
        words, codes = mask(html.unescape(of[0]), of[1]), self.codes
        for w in words:
            if w not in codes:
                # 15 bits, the same in every process: two runs of eight are hardly ever alike by chance, and a line is known by its key.
                codes[w] = xxhash.xxh3_64_intdigest(w) & 0x7FFF
        line = " ".join(words)
        self[of] = out = line, _digest(line), _gap_keys(words), [codes[w] for w in words]
        return out


def window_names(tokens: np.ndarray, ends: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Names of all runs of ``run`` tokens inside lines that end at ``ends``, and their starts.

    Prefix doubling: the name of 2w tokens is made of the names of both halves, so equal runs have equal names
    wherever they stand, in other blocks too.
    """
    if len(tokens) < run:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    name, width = (tokens.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while width < run:
        name = name[:-width] * np.uint64(0xD6E8FEB86659FD93) + name[width:]
        name ^= name >> np.uint64(32)
        name *= np.uint64(0x9E3779B97F4A7C15)
        width *= 2
    # A start is inside a line if the line's end lies a whole run beyond it.
    starts = np.arange(len(name))
    inside = ends[np.searchsorted(ends, starts, side="right")] - starts >= run
    return name[inside], starts[inside]


def often(names: np.ndarray, contents: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Names with at least ``least`` distinct contents, in order, and how many: the suffixes sorted by name and content."""
    if not len(names):
        return names, np.empty(0, dtype=np.int64)
    order = np.lexsort((contents, names))
    n, c = names[order], contents[order]
    new = np.ones(len(n), dtype=bool)
    new[1:] = (n[1:] != n[:-1]) | (c[1:] != c[:-1])
    found, counts = np.unique(n[new], return_counts=True)
    return found[counts >= least], counts[counts >= least]


class Stream:
    """The lines of a block of a host's contents: the runs in them, and which lines a set of repeated runs covers."""

    def __init__(self, table: pa.Table) -> None:
        self.key = table.column("key").to_numpy().astype(np.int64)
        self.content = table.column("content").to_numpy().astype(np.int64)
        tokens = table.column("tokens").combine_chunks()
        self.size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(self.size)
        self.windows, self.starts = window_names(tokens.flatten().to_numpy(zero_copy_only=False), self.ends)
        row = np.searchsorted(self.ends, self.starts, side="right")
        gaps = table.column("gaps").combine_chunks()
        n_gaps = pc.fill_null(pc.list_value_length(gaps), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # A whole line is a run if it is shorter than one; a dated line without two words is one too.
        short = np.flatnonzero((self.size > 0) & (self.size < RUN))
        self.line_rows = np.concatenate([short, np.repeat(np.arange(len(self.key)), n_gaps)])
        self.lines = np.concatenate([self.key[short], gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)]).view(np.uint64)
        self.names = np.concatenate([self.windows, self.lines])
        self.contents = np.concatenate([self.content[row], self.content[self.line_rows]])

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Keys of the lines that the sorted names ``repeated`` cover."""
        if not len(repeated):
            return np.empty(0, dtype=np.int64)
        starts = self.starts[_among(self.windows, repeated)]
        edge = np.zeros(int(self.ends[-1]) + 1, dtype=np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + RUN, -1)
        upto = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        share = (upto[self.ends] - upto[self.ends - self.size]) / np.maximum(self.size, 1)
        hit = share >= COVERED
        hit[self.line_rows[_among(self.lines, repeated)]] = True
        return np.unique(self.key[hit])


def _among(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return known[at] == names


UNITS = "page_id long, host long, content long, frame long, lines array<int>, body boolean, frames array<long>, page_frames array<long>, key long, gaps array<long>, tokens array<short>, always boolean"
_UNIT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int16()), pa.bool_())
RUNS = "host long, key long, run long, n int"
_RUN_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32())


def _digest(text: str) -> int:
    """64-bit digest as a signed number."""
    code = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
    return code - (1 << 64) if code >> 63 else code


def _gap_keys(tokens: list[str]) -> list[int]:
    """Keys of a dated line with any two or three neighbouring words left out, so that a byline is the same for every author."""
    if "%" not in tokens or len(tokens) > 16:
        return []
    out = []
    for width in (2, 3):
        for k in range(len(tokens) - width + 1):
            if not {"%", "@"} & set(tokens[k : k + width]):
                out.append(_digest(" ".join([*tokens[:k], "_", *tokens[k + width :]])))
    return out


def _inside(top: int, holders: list[tuple[int, str]], closed: list[bool]) -> list[bool]:
    """Which holders belong to ``top``: those below it that no closed one parts from it. A parent precedes its children."""
    inside = [False] * len(holders)
    for k in range(top, len(holders)):
        parent = holders[k][0]
        inside[k] = k == top or (parent >= 0 and inside[parent] and not closed[k])
    return inside


def site_name(title: str, host: str, units: list[Unit]) -> frozenset[str]:
    """Words of the last part of a page's title if it names the site: if they are in the host's name, or the part stands on the page too."""
    parts = _PARTS.split(title)
    named = [w for w in _TOKEN.findall(parts[-1]) if len(w) > 2] if len(parts) > 1 else []
    if not named or all(w in host for w in named) or any(parts[-1] in "".join(u.text).lower() for u in units):
        return frozenset(named)
    return frozenset()


def page_units(page: int, host: str, markup: str, known: Lines) -> list[tuple]:
    """Rows of ``UNITS`` of one page.

    ``body`` tells whether a unit is in the frame of the page's heading. A page without one has ``frames`` (the
    frames that a unit would be in), ``page_frames`` (all of the page), and ``body`` for a host that knows no frame:
    whether the unit is in the frame with most text outside links. Only the first row has ``frame``.
    """
    units, holders, heading = units_of(markup)
    title = _TITLE.search(markup)
    title = html.unescape(title.group(1)).strip().lower() if title else ""
    brand = site_name(title, host, units)
    sizes, linked = [0] * len(holders), [0] * len(holders)
    for u in units:
        sizes[u.holder] += sum(map(len, u.text))
        linked[u.holder] += u.link
    plain = [s.split(" ")[0] not in _FRAMES for _, s in holders]
    # A frame inside the body: a side column, or a box of links.
    closed = [not p or (n > 0 and link > n / 2) for p, n, link in zip(plain, sizes, linked)]
    frame, chains, signatures = None, None, None
    if heading >= 0:
        top = heading
        while holders[top][1].split(" ")[0] == "header" and holders[top][0] >= 0:
            top = holders[top][0]
        inside, frame = _inside(top, holders, closed), _digest(holders[heading][1])
    else:
        weight: Counter[int] = Counter()
        for u in units:
            size = sum(map(len, u.text))
            if plain[u.holder] and u.link < size / 2:
                weight[u.holder] += size
        inside = _inside(max(sorted(weight), key=lambda k: weight[k]), holders, closed) if weight else [False] * len(holders)
        first: dict[int, int] = {}
        for k, (_, s) in enumerate(holders):
            first.setdefault(_digest(s), k)
        own = {k: s for s, k in first.items()}
        chains = []
        for k, (parent, _) in enumerate(holders):
            chains.append(([own[k]] if k in own else []) + ([] if closed[k] or parent < 0 else chains[parent]))
        signatures = list(first)
    rows, longest = [], (0, "")
    for u in units:
        text = "".join(u.text).strip()
        if not text or _INSERT.fullmatch(text):
            continue
        line, key, gaps, codes = known[text, brand]
        if inside[u.holder]:
            longest = max(longest, (len(codes), line))
        rows.append((u, key, gaps, codes))
    # The site's name is no part of the content: a page copied to other sites is the same.
    parts = _PARTS.split(title)
    content, site = _digest("\n".join([*(parts[:-1] or parts), longest[1]])), _digest(host)
    return [
        (page, site, content, frame if k == 0 else None, u.lines, inside[u.holder], chains[u.holder] if chains is not None else None, signatures, key, gaps or None, codes, u.code or u.head == 1)
        for k, (u, key, gaps, codes) in enumerate(rows)
    ]


def _lists(values: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(itertools.chain.from_iterable(values), dtype=np.int64, count=int(ends[-1]))).cast(kind))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Lines()
    names = [x.split()[0] for x in UNITS.split(", ")]
    flat = {names.index("lines"): pa.int32(), names.index("tokens"): pa.int16()}
    for batch in small(batches, 2, 4 << 20):
        rows = [r for page, host, markup in zip(*(batch.column(k).to_pylist() for k in range(3))) for r in page_units(page, host, markup, known)]
        columns = list(zip(*rows)) if rows else [()] * len(_UNIT_TYPES)
        yield pa.RecordBatch.from_arrays([_lists(c, flat[k]) if k in flat else pa.array(c, t) for k, (c, t) in enumerate(zip(columns, _UNIT_TYPES))], names)


def _result(host: int, keys: np.ndarray | None, runs: np.ndarray | None, counts: np.ndarray | None = None) -> pa.Table:
    n = len(keys if keys is not None else runs)
    columns = [pa.array(np.full(n, host, dtype=np.int64)), pa.array(keys) if keys is not None else pa.nulls(n, pa.int64()), pa.array(runs.view(np.int64)) if runs is not None else pa.nulls(n, pa.int64())]
    columns.append(pa.array(counts.astype(np.int32)) if counts is not None else pa.nulls(n, pa.int32()))
    return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, _RUN_TYPES)], names=[x.split()[0] for x in RUNS.split(", ")])


def _whole(table: pa.Table) -> pa.Table:
    """Covered lines of a host that is one block."""
    stream = Stream(table)
    least = max(LEAST_PAGES, int(np.ceil(HOST_SHARE * len(np.unique(stream.content)))))
    return _result(table.column("host")[0].as_py(), stream.covered(often(stream.names, stream.contents, least)[0]), None)


def _local(table: pa.Table) -> pa.Table:
    """Runs that have the host's share of the contents of one block."""
    stream = Stream(table)
    least = max(1, int(np.ceil(HOST_SHARE * len(np.unique(stream.content)))))
    return _result(table.column("host")[0].as_py(), None, often(stream.names, stream.contents, least)[0])


def _count(lines: pa.Table, runs: pa.Table) -> pa.Table:
    """How many contents of a block have each of the host's candidate runs."""
    if not len(lines) or not len(runs):
        return _result(0, np.empty(0, dtype=np.int64), None)
    stream, wanted = Stream(lines), np.unique(runs.column("run").to_numpy().astype(np.int64).view(np.uint64))
    mine = _among(stream.names, wanted)
    return _result(lines.column("host")[0].as_py(), None, *often(stream.names[mine], stream.contents[mine], 1))


def _cover(lines: pa.Table, runs: pa.Table) -> pa.Table:
    if not len(lines) or not len(runs):
        return _result(0, np.empty(0, dtype=np.int64), None)
    repeated = np.unique(runs.column("run").to_numpy().astype(np.int64).view(np.uint64))
    return _result(lines.column("host")[0].as_py(), Stream(lines).covered(repeated), None)


def covered_lines(units: DataFrame, hosts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``host, key`` of the lines of each host that its repeated runs cover, distinct.

    ``units``: ``host, content, key, tokens, gaps``; ``hosts``: ``host, n`` (distinct contents). A host of more
    than ``block`` contents is counted in blocks in two passes: a run that has the host's share of contents has
    that share in some block, so the runs frequent in a block are all candidates; these are counted in every
    block, summed and decided for the whole host. So the result does not depend on the blocks.
    """
    lines = units.select("host", "content", "key", "tokens", "gaps").dropDuplicates(["host", "content", "key"])
    # Only hosts of several blocks are joined; their number is at most that of the contents over the block size.
    large = hosts.where(F.col("n") > block).select("host", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    done = lines.join(large.select("host"), "host", "left_anti").groupBy("host").applyInArrow(_whole, RUNS).select("host", "key")
    if large.isEmpty():
        return done
    many = lines.join(large.select("host", "blocks"), "host").withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")).drop("blocks")
    many = checkpoint(many)
    runs = many.groupBy("host", "block").applyInArrow(_local, RUNS).select("host", "run").distinct()

    def by_block(some: DataFrame) -> DataFrame:
        return some.join(large, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "run")

    counted = many.groupBy("host", "block").cogroup(by_block(runs).groupBy("host", "block")).applyInArrow(_count, RUNS)
    summed = counted.where("run is not null").groupBy("host", "run").agg(F.sum("n").alias("c")).join(large, "host")
    decided = checkpoint(summed.where(F.col("c") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("n") * HOST_SHARE))).select("host", "run"))
    more = many.groupBy("host", "block").cogroup(by_block(decided).groupBy("host", "block")).applyInArrow(_cover, RUNS)
    return done.unionByName(more.select("host", "key")).distinct()


def body_units(pages: DataFrame) -> DataFrame:
    """Rows of ``UNITS`` of all pages, checkpointed."""
    rows = pages.where("page_id is not null and html is not null").select("page_id", F.coalesce(host_of(F.col("origin")), F.lit("")).alias("host"), "html")
    return checkpoint(rows.mapInArrow(_units, UNITS))


def main_body_lines(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """``page_id, line_no`` of the lines of ``html`` that carry text of the main body, distinct.

    Null ids and null ``html`` have no row; a null origin is a host of its own; a page without text has no
    line; a repeated row counts once. Headings of level 1 and code are kept however often they occur. Pages are
    of the same content if their titles, without the host's name, and their longest lines are.
    """
    units = body_units(pages)
    hosts = checkpoint(units.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("n")))
    covered = checkpoint(covered_lines(units, hosts, block))
    # Pages without a heading have the frame that most headings of their host stand in.
    frames = units.where("frame is not null").groupBy("host", "frame").agg(F.count("*").alias("c")).groupBy("host").agg(F.max_by("frame", F.struct("c", "frame")).alias("known"))
    columns = ["page_id", "host", "content", "lines", "key", "gaps", "always"]
    bare = units.where("frames is not null").join(frames, "host", "left")
    bare = bare.where(F.when(F.array_contains("page_frames", F.col("known")), F.array_contains("frames", F.col("known"))).otherwise(F.col("body")))
    body = units.where("frames is null and body").select(*columns).unionByName(bare.select(*columns))
    unique = body.where("not always").join(beside(covered), ["host", "key"], "left_anti")
    # What small hosts cannot show: lines of many hosts. Shares are of all lines; copies of a page are one content.
    n_contents = hosts.agg(F.sum("n").alias("n")).scalar()
    keys = body.select("content", "host", F.explode(F.concat(F.array("key"), F.coalesce("gaps", F.array().cast("array<bigint>")))).alias("key"))
    spread = keys.select("key", "host").distinct().groupBy("key").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= LEAST_HOSTS).select("key")
    common = keys.select("key", "content").distinct().join(spread, "key", "left_semi").groupBy("key").agg(F.count("*").alias("c"))
    common = checkpoint(common.where(F.col("c") >= F.greatest(F.lit(LEAST_HOSTS), n_contents * ALL_SHARE)).select("key"))
    whole = unique.select("page_id", "host", "lines", "key", F.concat(F.array("key"), F.coalesce("gaps", F.array().cast("array<bigint>"))).alias("all_keys"))
    minor = whole.join(beside(hosts.where(F.col("n") >= SMALL_HOST).select("host")), "host", "left_anti")
    drop = minor.select("page_id", F.col("key").alias("line_key"), F.explode("all_keys").alias("key")).join(beside(common), "key", "left_semi").select("page_id", F.col("line_key").alias("key")).distinct()
    kept = whole.join(beside(checkpoint(drop)), ["page_id", "key"], "left_anti").select("page_id", "lines").unionByName(body.where("always").select("page_id", "lines"))
    return kept.select("page_id", F.explode(F.col("lines").cast("array<bigint>")).alias("line_no")).distinct()


def main_body(pages: DataFrame) -> DataFrame:
    """``page_id, n_lines, text``: the lines of each page's main body in order, without tags."""
    lines = main_body_lines(pages).groupBy("page_id").agg(F.array_sort(F.collect_list("line_no")).alias("nos"))
    texts = pages.where("page_id is not null and html is not null").select("page_id", "html").dropDuplicates(["page_id"])
    split = F.split("html", "\n")
    picked = F.transform("nos", lambda k: F.trim(F.regexp_replace(F.regexp_replace(F.get(split, (k - 1).cast("int")), "<[^>]*>", " "), r"\s+", " ")))
    return texts.join(lines, "page_id", "left").select("page_id", F.coalesce(F.size("nos"), F.lit(0)).alias("n_lines"), F.coalesce(F.array_join(picked, "\n"), F.lit("")).alias("text"))

