"""Problem 1: cutting oversized texts into pieces at natural boundaries.

Content-defined chunking. A rolling hash over a short window of characters marks landmarks; each piece
ends at the first landmark past the minimum size, moved to the nearest natural boundary (between blocks,
else sentences, else words) that keeps the piece within the maximum. A landmark and the boundary beside
it depend only on the characters near them, so an edit moves cuts only until the next common landmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import block_text, markup_text, page_text, small

#: Ends of sentences: a closing mark, perhaps a quotation mark or bracket, then white space; or a full-width mark.
SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]+[」』”’]*")
WORD_GAP = re.compile(r"\s+")
#: Characters that the rolling hash looks at.
WINDOW = 16
PIECES = "page_id long, limit_name string, piece_no int, start_at int, end_at int, overlap int, overlap_most int, piece string"


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` characters that end at each position, by doubling."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    width = 1
    while width < WINDOW:
        moved = np.zeros_like(h)
        moved[width:] = h[:-width]
        h = h + moved * np.uint64(pow(0xD6E8FEB86659FD93, width, 1 << 64))
        width *= 2
    return h ^ (h >> np.uint64(32))


def cut_points(text: str, body: int, blocks: list[int] | None = None) -> list[int]:
    """Ends of the bodies of the pieces of ``text``; no body is longer than ``body`` characters.

    ``blocks`` has the positions between blocks (by default, those after a newline).
    """
    n = len(text)
    if n <= body:
        return [n]
    least, target = max(1, body // 3), max(1, body // 4)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    marks = np.flatnonzero(rolling_hash(codes) % np.uint64(target) == 0) + 1
    if blocks is None:
        blocks = [m.end() for m in re.finditer("\n", text)]
    kinds = [np.asarray(x, dtype=np.int64) for x in (blocks, [m.end() for m in SENTENCE.finditer(text)], [m.end() for m in WORD_GAP.finditer(text)])]
    radius, cuts, at = max(1, body // 4), [], 0
    while n - at > body:
        low, high = at + least, at + body
        i = np.searchsorted(marks, low)
        mark = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        close, range_, start = (max(low, mark - radius), min(high, mark + radius)), (low, high), (at + 1, high)
        # Blocks near the landmark, sentences and words there or in the whole range, at last any boundary at all.
        tries = ((0, close), (1, close), (1, range_), (2, close), (2, range_), (0, start), (1, start), (2, start))
        cut = None
        for k, (a, b) in tries:
            inside = kinds[k][np.searchsorted(kinds[k], a) : np.searchsorted(kinds[k], b, side="right")]
            if len(inside):
                cut = int(inside[np.argmin(np.abs(inside - mark))])
                break
        at = mark if cut is None else cut
        cuts.append(at)
    return [*cuts, n]


def usual_overlap(max_size: int, overlap_size: int) -> int:
    """The overlap in force: half of the limit at most, so that every piece has something new."""
    return int(max(0, min(overlap_size, max_size // 2)))


def split_text(text: str, max_size: int, overlap_size: int, blocks: list[int] | None = None) -> list[tuple[int, int, int]]:
    """``(start, end, overlap)`` of each piece; the first ``overlap`` characters repeat the end of the one before.

    The overlap starts at the start of a word where the range holds one. It is at most ``usual_overlap``.
    """
    overlap_size = usual_overlap(max_size, overlap_size)
    out, at = [], 0
    for end in cut_points(text, max_size - overlap_size, blocks):
        start = max(0, at - overlap_size)
        if 0 < start < at and not text[start - 1].isspace():
            gap = WORD_GAP.search(text, start, at)
            start = gap.end() if gap and gap.end() < at else start
        out.append((start, end, at - start))
        at = end
    return out


def oversized(pages: DataFrame, limits: DataFrame) -> DataFrame:
    """Pages, and single blocks of them, that have to be cut at a limit in chars.

    Rows ``limit_name, page_id, block_no`` (-1 for the page), distinct however often a page's row is
    repeated: the items that the splitter cuts into two pieces or more. Null ``blocks``, null limits and null
    page ids give no row; an empty text is never too long. Only items over a limit reach Python.
    """
    texts = F.transform("blocks", block_text)
    page = F.array(F.struct(F.lit(-1).cast("bigint").alias("block_no"), F.array_join(texts, "\n").alias("text"), F.transform(texts, F.char_length).alias("sizes")))
    blocks = F.transform(texts, lambda t, i: F.struct(i.cast("bigint").alias("block_no"), t.alias("text"), F.array(F.char_length(t)).alias("sizes")))
    items = pages.where("page_id is not null and blocks is not null").select("page_id", F.explode(F.concat(page, blocks)).alias("x")).select("page_id", "x.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            many = []
            for text, sizes, most, overlap in zip(*(batch.column(k).to_pylist() for k in (2, 3, 5, 6))):
                many.append(len(pieces_of(text, sizes, most, overlap)))
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(0), batch.column(1), pa.array(many, pa.int32())], ["limit_name", "page_id", "block_no", "n_pieces"])

    over = with_limits(items, limits, F.char_length("text")).select("page_id", "block_no", "text", "sizes", "limit_name", "max_size", "overlap_size")
    found = over.mapInArrow(cut, "limit_name string, page_id long, block_no long, n_pieces int")
    return found.where("n_pieces > 1").select("limit_name", "page_id", "block_no").distinct()


def pieces_of(text: str, sizes: list[int], max_size: int, overlap_size: int) -> list[tuple[int, int, int]]:
    """``split_text`` of a text made of blocks of the given sizes, joined by one character."""
    blocks = (np.cumsum(np.asarray(sizes, dtype=np.int64) + 1)[:-1]).tolist()
    return split_text(text, int(max_size), int(overlap_size), blocks)


def with_limits(rows: DataFrame, limits: DataFrame, size: Column) -> DataFrame:
    """``rows`` once for each limit in chars that ``size`` exceeds, with ``limit_name, max_size, overlap_size``.

    The limits are a small fixed table; they are read once and become literals of the plan, so nothing is joined.
    """
    known = limits.where("unit = 'chars' and max_size > 0 and limit_name is not null").select("limit_name", "max_size", F.coalesce("overlap_size", F.lit(0)).alias("overlap_size")).distinct().orderBy("limit_name").collect()
    items = [F.struct(F.lit(r[0]).alias("limit_name"), F.lit(r[1]).cast("bigint").alias("max_size"), F.lit(r[2]).cast("bigint").alias("overlap_size")) for r in known]
    all_ = F.array(*items) if items else F.lit(None).cast("array<struct<limit_name:string,max_size:bigint,overlap_size:bigint>>")
    return rows.withColumn("lim", F.explode(F.filter(all_, lambda x: x["max_size"] < size))).select(*rows.columns, "lim.*")


def _markup_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 1):
        lines = [markup_text(m) for m in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.string()))], ["page_id", "lines"])


def split_oversized(pages: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every page whose text is longer than a limit in chars, for each such limit.

    Columns ``page_id, limit_name, piece_no`` (from 0), ``start_at, end_at`` (in the page's text),
    ``overlap`` (leading characters that repeat the piece before), ``overlap_most`` (the limit's overlap, or half of
    the limit where that is less), ``piece``. A page without ``blocks`` has
    the visible text of its ``content_html``, one line for each block element. Pages within the limit, pages
    with neither and null ids give no row; a repeated row of a page is left out. Only pages that are too long
    are shuffled (to make them distinct) and handed to Python.
    """
    texts = pages.where("page_id is not null and blocks is not null").select("page_id", page_text(F.col("blocks")).alias("text"), F.transform("blocks", lambda b: F.char_length(block_text(b))).alias("sizes"))
    if "content_html" in pages.columns:
        bare = pages.where("page_id is not null and blocks is null and content_html is not null").select("page_id", "content_html")
        # A page that has blocks in another of its rows is cut by them.
        bare = bare.join(pages.where("blocks is not null").select("page_id"), "page_id", "left_anti").mapInArrow(_markup_lines, "page_id long, lines array<string>")
        texts = texts.unionByName(bare.select("page_id", F.array_join("lines", "\n").alias("text"), F.transform("lines", F.char_length).alias("sizes")))
    texts = with_limits(texts, limits, F.char_length("text")).dropDuplicates(["page_id", "limit_name"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for k, (start, end, overlap) in enumerate(pieces_of(r.text, r.sizes, r.max_size, r.overlap_size)):
                    rows.append((r.page_id, r.limit_name, k, start, end, overlap, usual_overlap(r.max_size, r.overlap_size), r.text[start:end]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])

    return texts.mapInPandas(cut, PIECES)
