"""Aliases, first-wins deduplication and near-duplicate acceptance of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from sparkloom import config
from sparkloom.functions import fingerprint as fp
from sparkloom.operators.components import connected_components
from sparkloom.operators.sequence import in_sequence
from sparkloom.session import checkpoint

DECISION = "site string, seq long, outcome string, kept_seq long, distance int"
#: Rounds over all rows before the rest of a chain is decided in order.
ROUNDS = 4


def last_aliases(learned: DataFrame) -> DataFrame:
    """``variant, rep`` in force after ``learned(seq, variant, rep)``: the last one of each variant; empty and self aliases do not count."""
    real = learned.where("variant is not null and rep is not null and variant != '' and rep != '' and variant != rep")
    return real.groupBy("variant").agg(F.max_by("rep", "seq").alias("rep"))


def resolve_aliases(keys: DataFrame, aliases: DataFrame, hops: int = 16) -> DataFrame:
    """``key, resolved`` for the distinct keys: aliases followed for at most ``hops`` steps; a walk that comes back to a key it saw stops there.

    Steps are joins by key of the keys that still move; the others are done.
    """
    moving = keys.select("key").where("key is not null").distinct().select("key", F.col("key").alias("at"), F.array("key").alias("seen"))
    done = None
    for _ in range(hops):
        step = moving.join(aliases.withColumnRenamed("variant", "at"), "at", "left")
        stop = step.where("rep is null").select("key", F.col("at").alias("resolved"))
        stop = stop.unionByName(step.where("rep is not null and array_contains(seen, rep)").select("key", F.col("at").alias("resolved")))
        done = stop if done is None else done.unionByName(stop)
        moving = checkpoint(step.where("rep is not null and not array_contains(seen, rep)").select("key", F.col("rep").alias("at"), F.concat("seen", F.array("rep")).alias("seen")))
        if moving.isEmpty():
            break
    rest = moving.select("key", F.col("at").alias("resolved"))
    return rest if done is None else done.unionByName(rest)


def redirect_aliases(pages: DataFrame) -> DataFrame:
    """Aliases of redirects: requested key to final key where both are on the scope's site and differ."""
    on_site = F.col("requested_on_site") & F.col("final_on_site")
    return pages.where(on_site & (F.col("requested_key") != F.col("final_key"))).select("seq", F.col("requested_key").alias("variant"), F.col("final_key").alias("rep"))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with ``is_first`` and ``first_of``: the least ``order`` of the rows with the same ``key``. Null keys are each their own.

    The first is an aggregate that is combined before the shuffle, so a key that holds a third of all rows
    is one row of the join's small side and AQE splits its large side.
    """
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_of"))
    out = rows.join(first, key, "left")
    return out.withColumn("first_of", F.coalesce("first_of", order)).withColumn("is_first", F.col(order) == F.col("first_of")).select(*rows.columns, "first_of", "is_first")


def _rejected_in_order(pairs: DataFrame) -> DataFrame:
    """``id`` of the rows of ``pairs(id_a, id_b)`` that an earlier accepted row rejects, each component in order of ``id_b``."""
    kind = pairs.schema["id_b"].dataType
    of = connected_components(pairs, "id_a", "id_b").withColumnRenamed("node", "id_b")

    def decide(rejected: set, row: dict) -> tuple:
        hit = row["id_a"] not in rejected
        if hit:
            rejected.add(row["id_b"])
        return row["id_b"], hit

    decided = in_sequence(pairs.join(of, "id_b"), "component", "id_b", ["component", "id_a", "id_b"], set, decide, f"id {kind.simpleString()}, hit boolean", [to_arrow_type(kind), pa.bool_()])
    return checkpoint(decided.where("hit").select("id").distinct())


def accept_near(rows: DataFrame, hamming: int = config.NEAR_HAMMING, least: int = config.NEAR_CHARS) -> DataFrame:
    """First-wins acceptance over a whole collection: ``id, outcome, kept_id, distance``.

    ``rows``: ``id`` (the order of arrival), ``content_hash``, ``simhash``, ``length``, ``raw_length``. A row is a
    duplicate_content of the first accepted row with its content, else (from ``least`` collapsed characters)
    a near_duplicate of the nearest accepted earlier row within ``hamming`` bits (the least id breaks ties),
    else accepted; only accepted rows of at least ``least`` raw characters join the index. Each of ``ROUNDS`` rounds
    decides all rows whose earlier neighbours are decided; what longer chains leave is decided in order within each component.
    """
    rows = checkpoint(rows.select("id", "content_hash", "simhash", "length", "raw_length"))  # texts are hashed once
    first = rows.groupBy("content_hash").agg(F.min("id").alias("kept"))
    each = checkpoint(rows.join(first, "content_hash").select("id", "kept", "simhash", "length", "raw_length"))
    heads = each.where("id = kept")
    indexed = heads.where(F.col("raw_length") >= least).select("id", "simhash")
    pairs = fp.near_pairs(indexed.select("id", "simhash"), hamming)
    tested = heads.where(F.col("length") >= least).select(F.col("id").alias("id_b"))
    pairs = checkpoint(pairs.join(tested, "id_b", "left_semi"))
    # Undecided rows are those with an earlier neighbour; everyone else is accepted at once.
    todo, rejected, rounds = pairs, None, 0
    while not todo.isEmpty():
        if rounds == ROUNDS:
            rejected = rejected.unionByName(_rejected_in_order(todo))
            break
        rounds += 1
        later = todo.select(F.col("id_b").alias("id")).distinct()
        free = todo.select(F.col("id_a").alias("id")).distinct().join(later, "id", "left_anti")
        free = checkpoint(free)
        hit = checkpoint(todo.join(free.withColumnRenamed("id", "id_a"), "id_a", "left_semi").select(F.col("id_b").alias("id")).distinct())
        rejected = hit if rejected is None else rejected.unionByName(hit)
        # Pairs of a rejected row say nothing more; those of accepted ones are used up.
        rest = todo.join(free.withColumnRenamed("id", "id_a"), "id_a", "left_anti")
        rest = rest.join(hit.withColumnRenamed("id", "id_a"), "id_a", "left_anti").join(hit.withColumnRenamed("id", "id_b"), "id_b", "left_anti")
        todo = checkpoint(rest)
    if rejected is None:
        near = heads.limit(0).select("id", F.lit(0).cast("bigint").alias("kept_id"), F.lit(0).alias("distance"))
    else:
        kept = pairs.join(rejected.withColumnRenamed("id", "id_b"), "id_b", "left_semi").join(rejected.withColumnRenamed("id", "id_a"), "id_a", "left_anti")
        near = kept.groupBy(F.col("id_b").alias("id")).agg(F.min(F.struct("distance", "id_a")).alias("x")).select("id", F.col("x.id_a").alias("kept_id"), "x.distance")
    out = each.join(near, "id", "left")
    outcome = F.when(F.col("id") != F.col("kept"), "duplicate_content").when(F.col("kept_id").isNotNull(), "near_duplicate").otherwise("saved")
    return out.select("id", outcome.alias("outcome"), F.when(F.col("id") != F.col("kept"), F.col("kept")).otherwise(F.col("kept_id")).alias("kept_id"), "distance")


class SiteState:
    """What a site has accepted so far: keys, hashes, canonical groups and fingerprints."""

    def __init__(self, hamming: int = config.NEAR_HAMMING, least: int = config.NEAR_CHARS) -> None:
        self.hamming, self.least = hamming, least
        self.urls: dict[str, int] = {}
        self.html: dict[str, int] = {}
        self.content: dict[str, int] = {}
        self.canonical: dict[str, int] = {}
        self.index: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(hamming + 1)]

    def _bands(self, value: int) -> Iterator[tuple[int, int]]:
        n, at, value = self.hamming + 1, 64, value & (1 << 64) - 1
        for k in range(n):
            width = 64 // n + (k < 64 % n)
            at -= width
            yield k, value >> at & (1 << width) - 1

    def decide(self, row: dict) -> tuple[str, int | None, int | None]:
        """Outcome of a page in arrival order, the page it repeats, and the distance; an accepted page is remembered."""
        own, canonical = row["url_key"], row["canonical_key"]
        if own in self.urls:
            return "duplicate_url", self.urls[own], None
        if row["html_hash"] is not None and row["html_hash"] in self.html:
            return "duplicate_html", self.html[row["html_hash"]], None
        if canonical is not None and canonical != own and (canonical in self.canonical or own in self.canonical):
            return "canonical_alias", self.canonical.get(canonical, self.canonical.get(own)), None
        if row["content_hash"] is not None and row["content_hash"] in self.content:
            return "duplicate_content", self.content[row["content_hash"]], None
        simhash, length = row["simhash"], row["length"] or 0
        if simhash is not None and length >= self.least:
            near = min(((bin((simhash ^ s) & (1 << 64) - 1).count("1"), seq) for k, v in self._bands(simhash) for s, seq in self.index[k].get(v, ())), default=(65, 0))
            if near[0] <= self.hamming:
                return "near_duplicate", near[1], near[0]
        seq = row["seq"]
        if own is not None:
            self.urls[own] = seq
        for key in row["alias_keys"] if row["alias_keys"] is not None else ():
            self.urls.setdefault(key, seq)
        if row["html_hash"] is not None:
            self.html[row["html_hash"]] = seq
        if row["content_hash"] is not None:
            self.content[row["content_hash"]] = seq
        for key in (canonical, own):
            if key is not None:
                self.canonical.setdefault(key, seq)
        if simhash is not None and (row["raw_length"] or 0) >= self.least:
            for k, v in self._bands(simhash):
                self.index[k].setdefault(v, []).append((simhash, seq))
        return "saved", None, None


def dedup_site_pages(pages: DataFrame, hamming: int = config.NEAR_HAMMING, least: int = config.NEAR_CHARS) -> DataFrame:
    """Sequential first-wins deduplication of each site in ``seq`` order: ``site, seq, outcome, kept_seq, distance``.

    Only saved pages register keys, so a page skipped for one reason never shadows a later one. Columns:
    ``site, seq, url_key, alias_keys, html_hash, canonical_key, content_hash, simhash, length, raw_length``. The
    rule is sequential within a site by definition; only keys and hashes, no texts, go to the site's task.
    """
    columns = ["site", "seq", "url_key", "alias_keys", "html_hash", "canonical_key", "content_hash", "simhash", "length", "raw_length"]

    def decide(state: SiteState, row: dict) -> tuple:
        return row["site"], row["seq"], *state.decide(row)

    return in_sequence(pages, "site", "seq", columns, lambda: SiteState(hamming, least), decide, DECISION, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()])


def skip_counters(decisions: DataFrame) -> DataFrame:
    """Pages and skips by reason of each site, all of them in one row, and their sum."""
    reasons = ("duplicate_url", "duplicate_html", "canonical_alias", "duplicate_content", "near_duplicate")
    counted = decisions.groupBy("site").agg(F.count("*").alias("n_pages"), F.count_if(F.col("outcome") == "saved").alias("n_saved"), *(F.count_if(F.col("outcome") == r).alias(f"n_{r}") for r in reasons))
    return counted.withColumn("n_skipped", sum((F.col(f"n_{r}") for r in reasons), F.lit(0)))


def keep_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key (redelivered rows), by an aggregate over the whole row."""
    columns = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("x")).select("x.*")


def islands(rows: DataFrame, group: str, order: str, kind: str) -> DataFrame:
    """Runs of neighbouring rows of one kind: ``group, island, kind, first, n``."""
    by = Window.partitionBy(group).orderBy(order)
    changed = F.coalesce((F.lag(kind).over(by).eqNullSafe(F.col(kind)) == F.lit(False)).cast("int"), F.lit(0))
    numbered = rows.withColumn("island", F.sum(changed).over(by))
    return numbered.groupBy(group, "island", kind).agg(F.min(order).alias("first"), F.count("*").alias("n"))
