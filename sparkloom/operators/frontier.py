"""The frontier of a run: seeds, candidates, merging of discovered links, depth and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom import config
from sparkloom.functions import classify, urls
from sparkloom.operators import admission
from sparkloom.operators.sequence import ranked


def distinct_seeds(seeds: DataFrame) -> DataFrame:
    """Normal seeds of ``run_id, position, raw``: bad ones left out, the first of equal ones (case ignored) kept."""
    rows = seeds.withColumn("seed", urls.seed_url(urls.url_parts(urls.clean_seed(F.col("raw"))))).where("seed is not null")
    first = rows.groupBy("run_id", F.lower("seed").alias("k")).agg(F.min(F.struct("position", "seed")).alias("x"))
    return first.select("run_id", "x.position", "x.seed")


def candidates(offers: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Offered URLs ``site, seq, url`` ready for admission: ``key, tier, section, folder, trap, locale_excluded`` and ``is_repeat``.

    A URL that is no web URL has a null key; the second and later offers of a key in the batch are repeats.
    Keys are resolved through ``aliases(key, resolved)``.
    """
    rows = offers.withColumn("u", urls.url_parts(F.col("url")))
    rows = rows.withColumn("n", urls.url_parts(F.coalesce(urls.locale_normalize(F.col("u")), F.col("url"))))
    rows = rows.select(
        *offers.columns, urls.dedup_key(F.col("n")).alias("key"), urls.normalize(F.col("n")).alias("fetch_url"), classify.path_tier(F.col("n")).alias("tier"), classify.path_section(F.col("n")).alias("section"),
        urls.first_segment(F.col("n")).alias("folder"), classify.trap_rule(F.col("n")).alias("trap"), urls.is_locale_excluded(F.col("u")).alias("locale_excluded"), F.size("n.segments").alias("depth"),
    )
    if aliases is not None:
        rows = rows.join(aliases, "key", "left").withColumn("key", F.coalesce("resolved", "key")).drop("resolved")
    first = rows.where("key is not null").groupBy("site", "key").agg(F.min("seq").alias("first_seq"))
    return rows.join(first, ["site", "key"], "left").withColumn("is_repeat", F.coalesce(F.col("seq") > F.col("first_seq"), F.lit(False))).drop("first_seq")


def initial_frontier(seeds: DataFrame, mapped: DataFrame, caps: dict[str, int] | None = None, max_pages: int | None = None) -> DataFrame:
    """First URLs of each site: its seeds, never refused, then the mapped pages through the quotas, within the budget.

    ``seeds(site, position, url)``, ``mapped(site, url)``; result ``site, place, url, source, outcome`` with places for admitted ones.
    """
    first = candidates(seeds.withColumn("seq", F.col("position").cast("bigint"))).where("not is_repeat")
    rows = candidates(mapped.withColumn("seq", F.xxhash64("url"))).where("key is not null and not locale_excluded and not is_repeat")
    rows = rows.join(first.select("site", "key"), ["site", "key"], "left_anti")
    gated = admission.quota_admission(ranked(rows, "site", admission.admission_order()), caps)
    both = first.select("site", F.lit(0).alias("later"), F.col("position").cast("bigint").alias("o"), "url", F.lit("seed").alias("source"), F.lit("admitted").alias("outcome")).unionByName(gated.select("site", F.lit(1).alias("later"), F.col("rank").cast("bigint").alias("o"), F.col("fetch_url").alias("url"), F.lit("sitemap").alias("source"), "outcome"))
    placed = ranked(both.where("outcome = 'admitted'"), "site", [F.col("later").asc(), F.col("o").asc(), F.col("url").asc()], "place")
    both = placed.unionByName(both.where("outcome != 'admitted'").withColumn("place", F.lit(None).cast("bigint")))
    return both.withColumn("outcome", F.when(F.col("place") > config.budget(max_pages), "budget").otherwise(F.col("outcome"))).select("site", "place", "url", "source", "outcome")


def merge_harvested(frontier: DataFrame, harvested: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Links of a loaded page through the quotas, for sites without a map: ``site, url, outcome``; those in the frontier already are left out."""
    rows = candidates(harvested.select("site", F.col("rank").cast("bigint").alias("seq"), "url")).where("key is not null and not locale_excluded and not is_repeat")
    known = candidates(frontier.select("site", F.xxhash64("url").alias("seq"), "url")).select("site", "key").distinct()
    return admission.quota_admission(ranked(rows.join(known, ["site", "key"], "left_anti"), "site", admission.admission_order()), caps).select("site", F.col("fetch_url").alias("url"), "outcome")


def quota_report(decided: DataFrame) -> DataFrame:
    """Admitted and suppressed URLs by section and gate of ``site, url, section, outcome`` (the last refusal of a URL counts)."""
    return decided.groupBy("site", "section").agg(F.count_if(F.col("outcome") == "admitted").alias("n_admitted"), F.count_if(F.col("outcome") == "section").alias("n_by_section"), F.count_if(F.col("outcome") == "share").alias("n_by_share"))


def link_sources(outcomes: DataFrame) -> DataFrame:
    """Pages whose links are followed: saved ones, and those skipped for their markup, key or canonical link; never shells, empties and repeated contents."""
    return outcomes.where(F.col("outcome").isin("saved", "duplicate_html", "duplicate_url", "canonical_alias"))


def depth_exceeded(parent: Column, max_depth: int | None) -> Column:
    """Whether a link found at depth ``parent`` lies beyond the profile's depth; never without one."""
    return F.lit(False) if max_depth is None else parent + 1 > max_depth


def fetch_order() -> list[Column]:
    """Product and evidence pages found on the way come first, each in order of arrival."""
    return [F.col("forefront").desc(), F.col("seq").asc()]


def needs_browser(has_map: Column, static_links: Column, least: int = 25) -> Column:
    return ~has_map & (static_links < least)
