"""Problem 8: filling fixed-capacity containers by exact-complement hashing.

Items of one size are alike, so the packing is planned on the histogram of sizes (at most one entry per
unit of capacity, whatever the number of items) and then handed out: the items of each size get ranks, and
each rank a slot of the plan. Only the histogram reaches the driver, and only the plan goes back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import checkpoint

Plan = list[tuple[tuple[int, ...], int]]


def _pair(have: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Sizes x <= y with x + y == gap, both in stock; the pair of which most copies can be made."""
    x = np.arange(1, gap // 2 + 1)
    copies = np.minimum(have[x], have[gap - x])
    if gap % 2 == 0 and len(copies):
        copies[-1] = have[gap // 2] // 2
    if not len(copies) or copies.max() <= 0:
        return None
    k = int(copies.argmax())
    return int(x[k]), gap - int(x[k])


def _fill(have: np.ndarray, gap: int, sums: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three sizes in stock that add up to ``gap``. ``sums``: the index of pair sums (may hold used-up ones)."""
    if have[gap] > 0:
        return (gap,)
    if sums[gap] and (two := _pair(have, gap)):
        return two
    for x in np.flatnonzero((have[:gap] > 0) & sums[gap - np.arange(gap)])[::-1].tolist():
        have[x] -= 1
        two = _pair(have, gap - x)
        have[x] += 1
        if two:
            return (x, *two)
    return None


def plan_containers(sizes: dict[int, int], capacity: int) -> Plan:
    """``(sizes in a container, number of such containers)``; every item is in one, none is over capacity.

    First, from the largest size down, containers that are exactly full (a size and the single, pair or
    triple that complements it, in as many copies as the stock allows); then best-fit decreasing for what
    is left. Each step uses up a size or a group of containers, so the plan is as long as the histogram,
    not as the input.
    """
    have = np.zeros(capacity + 1, dtype=np.int64)
    for size, count in sizes.items():
        have[size] += count
    have[0] = 0
    plan: Plan = []
    if have[capacity]:
        plan.append(((capacity,), int(have[capacity])))
        have[capacity] = 0
    for size in range(capacity - 1, 0, -1):
        if not have[size]:
            continue
        some = (have > 0).astype(np.int64)
        spectrum = np.fft.rfft(some, 2 * capacity + 2)
        sums = np.fft.irfft(spectrum * spectrum, 2 * capacity + 2)[: capacity + 1] > 0.5
        while have[size]:
            have[size] -= 1
            rest = _fill(have, capacity - size, sums)
            have[size] += 1
            if rest is None:
                break
            need = Counter((size, *rest))
            copies = min(int(have[s]) // n for s, n in need.items())
            for s, n in need.items():
                have[s] -= n * copies
            plan.append(((size, *rest), copies))
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(capacity + 1, dtype=bool)

    def put(content: tuple[int, ...], gap: int, count: int) -> None:
        if count:
            open_.setdefault(gap, []).append((content, count))
            gaps[gap] = True

    for size in range(capacity, 0, -1):
        left = int(have[size])
        while left:
            fits = np.flatnonzero(gaps[size:])
            if len(fits):
                gap = size + int(fits[0])
                content, count = open_[gap].pop()
                take = min(left, count)
                if count > take:
                    open_[gap].append((content, count - take))
                gaps[gap] = bool(open_[gap])
                put((*content, size), gap - size, take)
                left -= take
            else:
                each = capacity // size
                put((size,) * each, capacity - each * size, left // each)
                put((size,) * (left % each), capacity - left % each * size, int(left % each > 0))
                left = 0
    return plan + [group for gap in sorted(open_) for group in open_[gap]]


def slots(plan: Plan) -> list[tuple[int, int, int, int]]:
    """``(size, first rank, ranks, first container)``: the items of a size, in rank order, to containers in order."""
    used: Counter[int] = Counter()
    out, container = [], 0
    for content, copies in plan:
        for size in content:
            out.append((size, used[size], copies, container))
            used[size] += copies
        container += copies
    return out


def pack(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """Containers of each limit in tokens: ``limit_name, container, doc_id, piece_no, n_tokens, capacity``.

    ``counts``: ``doc_id, n_tokens``, one row per item. Items without tokens (null and empty texts) take no
    room and get no container. An item over capacity is split into full pieces and a rest. Repeated rows are
    items of their own. Null sizes, ids and limits give no row. A size that holds a third of all items is
    ranked by buckets, not in one task.
    """
    spark = counts.sparkSession
    caps = limits.where("unit = 'tokens' and max_size > 0 and limit_name is not null").select("limit_name", F.col("max_size").alias("capacity")).distinct()
    counts = checkpoint(counts.where("doc_id is not null and n_tokens > 0").select("doc_id", "n_tokens"))
    known = [F.struct(F.lit(r["limit_name"]).alias("limit_name"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in caps.orderBy("limit_name").collect()]
    known = F.array(*known) if known else F.lit(None).cast("array<struct<limit_name:string,capacity:bigint>>")
    pieces = counts.select("doc_id", "n_tokens", F.explode(known).alias("x")).select("doc_id", "n_tokens", "x.*")
    number = F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int")
    pieces = pieces.select("limit_name", "capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), number - 1)).alias("piece_no"))
    pieces = pieces.withColumn("size", F.least("capacity", F.col("n_tokens") - F.col("capacity") * F.col("piece_no")))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int"))
    per = pieces.groupBy("limit_name", "capacity", "size", "bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("limit_name", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("limit_name", "size", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    local = Window.partitionBy("limit_name", "size", "bucket").orderBy("doc_id", "piece_no")
    ranked = pieces.withColumn("rank", F.row_number().over(local) - 1).join(offsets, ["limit_name", "size", "bucket"]).withColumn("rank", F.col("rank") + F.col("offset"))
    stock: dict[tuple[str, int], dict[int, int]] = {}
    for row in per.groupBy("limit_name", "capacity", "size").agg(F.sum("c").alias("c")).collect():
        stock.setdefault((row["limit_name"], row["capacity"]), {})[row["size"]] = row["c"]
    lookup = {}
    for (name, capacity), sizes in stock.items():
        by: dict[int, list[tuple[int, int]]] = {}
        for size, first, _, container in slots(plan_containers(sizes, int(capacity))):
            by.setdefault(size, []).append((first, container))
        lookup[name] = {size: tuple(np.array(x, dtype=np.int64) for x in zip(*entries)) for size, entries in by.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            container = np.zeros(len(pdf), dtype=np.int64)
            for (name, size), at in pdf.groupby(["limit_name", "size"]).indices.items():
                first, base = lookup[name][size]
                rank = pdf["rank"].to_numpy()[at]
                k = np.searchsorted(first, rank, side="right") - 1
                container[at] = base[k] + rank - first[k]
            yield pdf.assign(container=container)[["limit_name", "container", "doc_id", "piece_no", "size", "capacity"]]

    placed = ranked.select("limit_name", "capacity", "doc_id", "piece_no", "size", "rank").mapInPandas(place, "limit_name string, container long, doc_id long, piece_no int, size long, capacity long")
    return placed.withColumnRenamed("size", "n_tokens")


def containers(packed: DataFrame) -> DataFrame:
    """``limit_name, container, capacity, fill, n_items, items``; a container holds at most ``capacity`` items."""
    return packed.groupBy("limit_name", "container").agg(
        F.max("capacity").alias("capacity"), F.sum("n_tokens").alias("fill"), F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.struct("doc_id", "piece_no", "n_tokens"))).alias("items")
    )
