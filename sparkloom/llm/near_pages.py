"""Problem 4: near-duplicate pages by an LSH forest.

Each page has a signature of 64 min-hashes of its runs of five words, and stands in 24 orders ("trees"), in
each of which the signature's values come in another sequence. Pages that share a prefix in some order are
neighbours there. The prefix is as short as the region allows: one value where few pages share it, more
values, three at most, where many do; what is crowded even then is compared completely, with salt. So 24
trees find a pair at similarity 0.6 with probability 0.997 however crowded its surroundings are. Two bits of
each min-hash sort out most candidates inside the join; the exact overlap of the sets of runs decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import MinHash, shingles, small, visible, word_codes, words_of
from sparkloom.operators.components import connected_components
from sparkloom.session import checkpoint

HASHES, TREES, DEPTHS = 64, 24, (1, 2, 3)
#: A region of more pages than this is split by a longer prefix.
CROWD = 40
#: Parts into which one side of a region is split that is crowded even at the longest prefix.
SALTS = 16
SIGNED = "page_id long, digest binary, prefix array<array<int>>, bits_a long, bits_b long"


def positions(tree: int) -> list[int]:
    """Places of the signature that a tree compares, in its order: first a place of its own, then others."""
    return [(tree + k * 24) % HASHES for k in range(max(DEPTHS))]


def tolerance(similarity: float, hashes: int = HASHES) -> int:
    """Most of the two-bit values that may differ: 3.8 standard deviations beyond what ``similarity`` makes likely."""
    agree = similarity + (1 - similarity) / 4
    return hashes - int(hashes * agree - 3.8 * (hashes * agree * (1 - agree)) ** 0.5)


def bit_words(signature: np.ndarray) -> list[np.ndarray]:
    """The lowest and the second bit of each of the (at most 64) values of each row, as two 64-bit numbers."""
    places = np.uint64(1) << np.arange(signature.shape[1], dtype=np.uint64)
    return [(((signature >> np.uint32(k)) & np.uint32(1)).astype(np.uint64) @ places).view(np.int64) for k in (0, 1)]


def prefixes(signature: np.ndarray, order: np.ndarray) -> pa.ListArray:
    """For each row and each tree of ``order``, the row's values in the tree's order."""
    flat = signature.view(np.int32)[:, order.reshape(-1)].reshape(-1)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, order.shape[1], dtype=np.int32)), pa.array(flat))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(signature) * len(order) + 1, len(order), dtype=np.int32)), inner)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash, order = MinHash(HASHES), np.array([positions(t) for t in range(TREES)])
    for batch in small(batches, 1):
        ids, sets, digests = [], [], []
        for page, markup in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            grams = np.unique(shingles(word_codes(words_of(visible(markup)))))
            if len(grams):
                ids.append(page)
                sets.append(grams)
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
        if not ids:
            continue
        signature = minhash(sets)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), prefixes(signature, order), *map(pa.array, bit_words(signature))], ["page_id", "digest", "prefix", "bits_a", "bits_b"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 1):
        sets = [np.unique(shingles(word_codes(words_of(visible(m))))).view(np.int64) for m in batch.column(1).to_pylist()]
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        values = pa.array(np.concatenate(sets)) if sets else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["page_id", "grams"])


def eligible(pages: DataFrame, accepted: DataFrame, least: int) -> DataFrame:
    """Ids of the pages accepted with at least ``least`` characters, distinct."""
    return accepted.where(F.col("content_length") >= least).select("page_id").where("page_id is not null").distinct()


def _pairs(rows: DataFrame, differ: int, salted: bool) -> DataFrame:
    """Pairs within the regions ``key`` whose bits differ in at most ``differ`` places."""
    left = rows.select("key", F.col("page_id").alias("a"), F.col("bits_a").alias("a1"), F.col("bits_b").alias("a2"))
    right = rows.select("key", F.col("page_id").alias("b"), F.col("bits_a").alias("b1"), F.col("bits_b").alias("b2"))
    on = ["key"]
    if salted:
        left = left.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
        right = right.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        on = ["key", "salt"]
    different = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")).bitwiseOR(F.col("a2").bitwiseXOR(F.col("b2"))))
    return left.join(right, on).where((F.col("a") < F.col("b")) & (different <= differ)).select("a", "b")


def forest_candidates(signed: DataFrame, similarity: float, depths: tuple[int, ...] = DEPTHS, hashes: int = HASHES) -> DataFrame:
    """Candidate pairs ``a < b`` of the forest over ``signed``, distinct; crowded regions go on to the next of ``depths``."""
    todo = signed.select("page_id", "bits_a", "bits_b", F.posexplode("prefix").alias("tree", "values"))
    found, differ = [], tolerance(similarity, hashes)
    for depth in depths:
        keyed = todo.withColumn("key", F.xxhash64("tree", F.slice("values", 1, depth)))
        crowd = keyed.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
        live = checkpoint(keyed.join(crowd, "key").select("key", "page_id", "bits_a", "bits_b", "tree", "values", "crowd"))
        found.append(_pairs(live.where(F.col("crowd") <= CROWD), differ, False))
        todo = live.where(F.col("crowd") > CROWD).select("page_id", "bits_a", "bits_b", "tree", "values")
        if todo.isEmpty():
            break
    else:
        found.append(_pairs(live.where(F.col("crowd") > CROWD), differ, True))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct elements."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def near_pages(pages: DataFrame, accepted: DataFrame, similarity: float = 0.6, least: int = 500) -> tuple[DataFrame, DataFrame]:
    """Links between distinct contents, and who has which content.

    First frame: ``a, b, similarity`` with a < b, representatives whose sets of runs of five words agree in
    at least ``similarity``. Second: ``page_id, representative`` of every eligible page with five words or
    more (equal sets share the least page id). Pages are those of ``accepted`` with ``content_length`` of at
    least ``least`` and non-null ``content_html``; repeated rows count once, null ids not at all.
    """
    pages = pages.where("page_id is not null and content_html is not null").select("page_id", "content_html")
    signed = pages.mapInArrow(_sign, SIGNED).join(eligible(pages, accepted, least), "page_id", "left_semi").dropDuplicates(["page_id"])
    signed = checkpoint(signed)
    least_id = signed.groupBy("digest").agg(F.min("page_id").alias("representative"))
    members = checkpoint(signed.select("page_id", "digest").join(least_id, "digest").select("page_id", "representative"))
    single = signed.join(members.where("page_id = representative").select("page_id"), "page_id", "left_semi")
    pairs = checkpoint(forest_candidates(single, similarity))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("page_id")).distinct()
    grams = pages.join(wanted, "page_id", "left_semi").mapInArrow(_grams, "page_id long, grams array<long>").dropDuplicates(["page_id"])
    left, right = grams.select(F.col("page_id").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("page_id").alias("b"), F.col("grams").alias("gb"))
    checked = pairs.join(left, "a").join(right, "b").select("a", "b", overlap(F.col("ga"), F.col("gb")).alias("similarity"))
    return checked.where(F.col("similarity") >= similarity), members


def near_page_pairs(pages: DataFrame, accepted: DataFrame, similarity: float = 0.6, least: int = 500) -> DataFrame:
    """All pairs of pages at or over ``similarity``: ``page_a < page_b``; equal contents are expanded into pairs."""
    links, members = near_pages(pages, accepted, similarity, least)
    one, two = members.toDF("page_a", "a"), members.toDF("page_b", "b")
    across = links.select("a", "b").join(one, "a").join(two, "b").select(F.least("page_a", "page_b").alias("page_a"), F.greatest("page_a", "page_b").alias("page_b"))
    within = one.join(two.withColumnRenamed("b", "a"), "a").where("page_a < page_b").select("page_a", "page_b")
    return across.unionByName(within)


def near_page_groups(pages: DataFrame, accepted: DataFrame, similarity: float = 0.6, least: int = 500) -> DataFrame:
    """``page_id, representative, class_id, n_links`` of every eligible page with five words or more.

    ``representative`` is the least page with the same set of runs, ``class_id`` the least page of the
    connected class, ``n_links`` the number of other contents the page's content is linked to.
    """
    links, members = near_pages(pages, accepted, similarity, least)
    links = checkpoint(links)
    classes = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    out = members.join(classes.withColumnRenamed("node", "representative"), "representative", "left").join(degree.withColumnRenamed("node", "representative"), "representative", "left")
    return out.select("page_id", "representative", F.coalesce("component", "representative").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
