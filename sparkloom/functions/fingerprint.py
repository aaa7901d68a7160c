"""Hashes and SimHash of texts, and the banded search for near-duplicates."""

from __future__ import annotations

import itertools

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sparkloom import config

#: White space as scripts of browsers see it.
SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
_TOKEN = re.compile(r"[^\W_]+")
#: Prints of one block that are searched together, about; pairs of one Arrow batch, at least.
CELL, FLUSH = 100_000, 500_000


def html_hash(html: Column) -> Column:
    return F.sha2(html, 256)


def collapsed(text: Column) -> Column:
    """Text with white space (of any script) collapsed and trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def content_hash(text: Column) -> Column:
    return F.sha2(collapsed(text), 256)


def simhash_of(text: str | None, run: int = config.SHINGLE) -> int:
    """SimHash-64 as a signed number. Every occurrence of a run of words votes with the first 8 bytes of its SHA-256; a tie sets the bit; no words give zero."""
    words = _TOKEN.findall((text or "").lower())
    if not words:
        return 0
    n = max(1, min(12, int(run)))
    grams = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    raw = np.frombuffer(b"".join(hashlib.sha256(g.encode("utf-8", "replace")).digest()[:8] for g in grams), dtype=np.uint8)
    ones = np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones >= len(grams)).tobytes(), "big", signed=True)


def simhash(text: Column, run: int = config.SHINGLE) -> Column:
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash_of(t, run) for t in texts], dtype="int64")

    apply.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, "long")(text)


def hex16(print_: Column) -> Column:
    return F.lpad(F.lower(F.hex(print_)), 16, "0")


def from_hex(text: Column) -> Column:
    """Fingerprint from hex in any spelling: prefixed, padded or not; null where it is none."""
    bare = F.lower(F.regexp_replace(F.trim(text), r"^0[xX]", ""))
    return F.when(bare.rlike("^[0-9a-f]{1,16}$"), F.conv(F.lpad(bare, 16, "0"), 16, -10).cast("bigint"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(print_: Column, hamming: int = config.NEAR_HAMMING, agree: int = 1) -> Column:
    """Tables ``(band, value)`` of the 64 bits in ``hamming + agree`` blocks (the first ones take the rest): prints within the distance share one.

    A table has ``agree`` of the blocks, as many of which any two such prints have in common; with more, keys are longer.
    """
    n = hamming + agree
    widths = [64 // n + (k < 64 % n) for k in range(n)]
    blocks, at = [], 64
    for width in widths:
        at -= width
        blocks.append((width, print_ if width == 64 else F.shiftrightunsigned(print_, at).bitwiseAND(F.lit((1 << width) - 1))))
    out = []
    for k, chosen in enumerate(itertools.combinations(blocks, agree)):
        value = chosen[0][1]
        for width, more in chosen[1:]:
            value = F.shiftleft(value, width).bitwiseOR(more)
        out.append(F.struct(F.lit(k).alias("band"), value.alias("value")))
    return F.array(*out)


def blocks_that_agree(n: int, hamming: int, most: int = 4) -> int:
    """How many blocks a key needs so that ``n`` prints fill its values less than once; at most ``most`` of them, as tables multiply."""
    return next((k for k in range(1, most) if 64 * k // (hamming + k) >= max(1, n).bit_length()), most)


def pairs_within(prints: np.ndarray, first: int, hamming: int, agree: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs ``a, b, distance`` of distinct unsigned prints within ``hamming`` bits whose first equal block is ``first``, in parts.

    The blocks are those of ``bands``. For each choice of ``agree`` blocks the prints are sorted by them and compared with
    those that follow with an equal key; a pair belongs to the choice of its first equal blocks, so it is found once.
    """
    n = hamming + agree
    ends = np.cumsum([64 // n + (k < 64 % n) for k in range(n)])
    masks = [np.uint64((1 << 64 - (int(ends[k - 1]) if k else 0)) - (1 << 64 - int(ends[k]))) for k in range(n)]
    blocks = [(int(mask).bit_count(), (prints & mask) >> np.uint64(min(63, 64 - int(end)))) for mask, end in zip(masks, ends)]
    low = np.uint64(max(1, len(prints).bit_length()))
    order, bits = np.arange(len(prints), dtype=np.uint64), (np.uint64(1) << low) - np.uint64(1)
    kept, size = [], 0
    for more in itertools.combinations(range(first + 1, n), agree - 1):
        key = blocks[first][1]
        for k in more:
            key = key << np.uint64(blocks[k][0]) | blocks[k][1]
        # Bits of a key that have no room beside the number of its print only make more candidates.
        ranked = np.sort(key << low | order)
        s, key = prints[ranked & bits], ranked >> low
        at, off = np.flatnonzero(key[1:] == key[:-1]), 1
        while len(at):
            a, b = s[at], s[at + off]
            x = a ^ b
            near = np.flatnonzero(np.bitwise_count(x) <= hamming)
            if len(near):
                a, b, x = a[near], b[near], x[near]
                mine = np.ones(len(x), dtype=bool)
                for k in range((first, *more)[-1] + 1):
                    mine &= ((x & masks[k]) == 0) == (k in (first, *more))
                kept.append((a[mine], b[mine], np.bitwise_count(x[mine]).astype(np.int32)))
                size += int(mine.sum())
                if size >= FLUSH:
                    yield tuple(map(np.concatenate, zip(*kept)))
                    kept, size = [], 0
            off += 1
            at = at[at + off < len(s)]
            at = at[key[at] == key[at + off]]
    if size:
        yield tuple(map(np.concatenate, zip(*kept)))


def near_pairs(prints: DataFrame, hamming: int = config.NEAR_HAMMING, scope: str | None = None) -> DataFrame:
    """Pairs ``id_a < id_b`` of ``prints(id, simhash[, scope])`` within ``hamming`` bits, with their distance.

    Equal prints are one row of the search and are expanded only in the result. Null ids and prints are left out.
    Each print goes to the cells of its first ``hamming + 1`` blocks, as two prints within the distance have one of them in
    common; the other tables are sorted within a cell and never shuffled or broadcast. Keys grow with the number of
    prints, so that buckets do not; cells do so, too, up to the values of a block.
    """
    keys = [scope] if scope else []
    rows = prints.where("id is not null and simhash is not null").select("id", "simhash", *keys).distinct()
    single = rows.select("simhash", *keys).distinct()
    n = single.count()
    agree, cells = blocks_that_agree(n, hamming), max(1, n // CELL)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        band, names = parts[0].column("band")[0].as_py(), ["a", "b", "distance", *keys]
        values = np.concatenate([p.column("simhash").to_numpy() for p in parts]).view(np.uint64)
        for a, b, d in pairs_within(values, band, hamming, agree):
            scopes = [pa.array([parts[0].column(k)[0].as_py()], parts[0].column(k).type).take(pa.array(np.zeros(len(d), dtype=np.int32))) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d), *scopes], names)

    placed = single.select("simhash", *keys, F.explode(F.slice(bands(F.col("simhash"), hamming + agree - 1), 1, hamming + 1)).alias("x"))
    placed = placed.select("simhash", *keys, "x.band", F.pmod("x.value", F.lit(cells)).alias("cell"))
    schema = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("distance", IntegerType()), *(single.schema[k] for k in keys)])
    close = placed.groupBy(*keys, "band", "cell").applyInArrow(search, schema)
    one, two = rows.withColumnsRenamed({"id": "id_1", "simhash": "a"}), rows.withColumnsRenamed({"id": "id_2", "simhash": "b"})
    # Spark takes the pairs for as few as the prints; by that it would broadcast them.
    apart = close.hint("merge").join(one, ["a", *keys]).join(two, ["b", *keys])
    same = one.join(two.withColumnRenamed("b", "a"), ["a", *keys]).where("id_1 < id_2").withColumn("distance", F.lit(0))
    both = apart.select("id_1", "id_2", "distance").unionByName(same.select("id_1", "id_2", "distance"))
    return both.select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"), "distance")
