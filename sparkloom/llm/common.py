"""Columns and small helpers used by several operators of this folder."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a text: maximal runs of letters and digits of the lower-cased text.
WORD = r"[^\W_]+"


def block_text(block: Column) -> Column:
    """``text`` of a block, or its cells joined by one space where ``text`` is null; null counts as empty."""
    return F.coalesce(block["text"], F.array_join(block["cells"], " "), F.lit(""))


def page_text(blocks: Column) -> Column:
    """Block texts in order, joined by a newline; null where ``blocks`` is null."""
    return F.array_join(F.transform(blocks, block_text), "\n")


def block_lines(pages: DataFrame, *keep: Column) -> DataFrame:
    """One row per block: ``keep``, ``block_no`` (from 0), ``line`` (the block's text).

    Explodes before it builds the text, so the scan reads only ``text`` and ``cells`` of the blocks.
    """
    rows = pages.where(F.col("blocks").isNotNull()).select(*keep, F.posexplode("blocks").alias("block_no", "b"))
    names = [c for c in rows.columns if c not in ("block_no", "b")]
    return rows.select(*names, F.col("block_no").cast("bigint").alias("block_no"), F.coalesce(F.col("b.text"), F.array_join("b.cells", " "), F.lit("")).alias("line"))


def host_of(origin: Column) -> Column:
    """Host of an origin: without scheme, case, a leading ``www.``, and a trailing slash; null stays null."""
    bare = F.regexp_replace(F.lower(F.trim(origin)), r"^[a-z][a-z0-9+.\-]*://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[/?#].*$", ""), r"^www\.", "")


_TAG = re.compile(r"<[^>]*>")
_WORDS = re.compile(WORD)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Codes(dict):
    """64-bit codes of words, the same in every process; forgets all when it has a million, so its size is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


CODES = Codes()


def visible(markup: str) -> str:
    """Visible text: each tag read as a space, entities decoded."""
    end = markup.rfind(">") + 1  # beyond it no tag can end, and each "<" would be followed to the end in vain
    text = _TAG.sub(" ", markup[:end]) + markup[end:]
    return html.unescape(text) if "&" in text else text


_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|head)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.IGNORECASE | re.DOTALL)
_ELEMENT = re.compile(r"</?(?:p|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|thead|tbody|div|section|article|blockquote|pre|figure|figcaption|caption|details|summary|header|footer|nav|main|aside|form|br|hr)\b[^>]*>", re.IGNORECASE)


def markup_text(markup: str) -> list[str]:
    """Visible text of each block element of ``markup`` in order, white space collapsed, without empty ones."""
    markup = _HIDDEN.sub(" ", markup)
    end = markup.rfind(">") + 1  # as in visible()
    parts = (_ELEMENT.sub("\0", markup[:end]) + markup[end:]).split("\0")
    lines = (" ".join(html.unescape(_TAG.sub("", p)).split()) for p in parts)
    return [x for x in lines if x]


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def word_codes(words: list[str]) -> np.ndarray:
    """Codes of words as unsigned 64-bit numbers."""
    codes = CODES
    return np.fromiter((codes[w] for w in words), dtype=np.uint64, count=len(words))


def shingles(codes: np.ndarray, run: int = 5) -> np.ndarray:
    """Codes of the runs of ``run`` words, in order; empty for fewer words."""
    n = len(codes) - run + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = codes[:n].copy()
    for k in range(1, run):
        h = h * _ODD + codes[k : k + n]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


def beside(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` marked for a broadcast if it is counted and has no more than ``most`` rows (of a few numbers each), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class MinHash:
    """Signatures of ``size`` minima, each under its own multiplier."""

    def __init__(self, size: int, seed: int = 7) -> None:
        self.odd = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of 32-bit minima for each set, none of which is empty."""
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        out = np.empty((len(sets), len(self.odd)), dtype=np.uint32)
        for k, odd in enumerate(self.odd):
            out[:, k] = np.minimum.reduceat(((flat * odd) >> np.uint64(32)).astype(np.uint32), starts)
        return out


def small(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``most`` bytes of text in ``column``, so that long texts do not make large work arrays.

    A batch without rows gives none; one text over the limit is a slice by itself.
    """
    for batch in batches:
        if not len(batch):
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            before = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
