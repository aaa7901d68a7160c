"""Queries over the tables of a data folder, one per operator family, with SQL for those that SQL can express."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom import config
from sparkloom.functions import classify, extract, urls
from sparkloom.functions import fingerprint as fp
from sparkloom.operators import admission, dedup, frontier, reports, runs
from sparkloom.operators.sequence import ranked
from sparkloom.plans.oracles import ORACLES
from sparkloom.session import Query, local_folder, table
from sparkloom.sources import readers, writers
from sparkloom.streaming import stateful

QUERIES: dict[str, Query] = {}

#: Path prefixes that make the locale and scope rules apply, by the page's id.
PREFIXES = ("/fr", "/en-gb", "/us", "/en", "/legal", "", "")
#: Suffixes that make the trap rules apply, by the page's id.
SUFFIXES = ("/page/2", "/2024/05", "/how-to-start", "/setup-guide", "", "?q=a", "?a=1&b=2&c=3", "?sort=name", "")
CAPS = config.section_caps("templates:2,glossary:1,blog:3,news:3,help:2,tools:2,customers:2,guides:3")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pages by id and URL; a redelivered row counts once."""
    return table(spark, sf_dir, "ingest_pages").select("page_id", "url").distinct()


def _pick(choices: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (by % len(choices) + 1).cast("int"))


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a URL that the rules apply to: a prefix and, on a bare path, a suffix by the page's id."""
    origin, rest = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    pages = _pages(spark, sf_dir).where("page_id is not null")
    return pages.select("page_id", F.concat(origin, _pick(PREFIXES, F.col("page_id")), F.regexp_replace(rest, "/$", ""), _pick(SUFFIXES, F.col("page_id"))).alias("url")).withColumn("u", urls.url_parts(F.col("url")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["page_scope_outcomes"](spark, sf_dir)


@query
def page_scope_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in and out of scope, by site and section."""
    outcome = F.when(urls.is_locale_excluded(F.col("u")), "locale_excluded").when(classify.is_non_content(F.col("u")), "non_content_directory").otherwise("in_scope")
    return _varied(spark, sf_dir).select(urls.hostname_key(F.col("u.host")).alias("site"), urls.section_of(F.col("u")).alias("section"), outcome.alias("outcome")).groupBy("site", "section", "outcome").agg(F.count("*").alias("n_pages"))


def _keyed(spark: SparkSession, sf_dir: str, make: object, name: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "url", make(urls.url_parts(F.col("url"))).alias(name))  # type: ignore[operator]


@query
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, urls.normalize, "normal_url")


@query
def url_dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, urls.dedup_key, "dedup_key")


@query
def url_dedup_key_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, lambda p: urls.dedup_key(p, aggressive=True), "dedup_key")


@query
def url_member_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, urls.member_key, "member_key")


@query
def url_locale_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir).select("page_id", "url", urls.locale_normalize(F.col("u")).alias("locale_url"))


@query
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier, section and trap rule of each page's URL."""
    u = F.col("u")
    return _varied(spark, sf_dir).select("page_id", "url", classify.path_tier(u).alias("tier"), classify.path_section(u).alias("section"), classify.trap_rule(u).alias("trap"))


@query
def composition_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.composition_by_tier(_varied(spark, sf_dir).select(classify.path_tier(F.col("u")).alias("tier")))


@query
def link_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links by whether they stay on the page's site, against the stored flag."""
    links = table(spark, sf_dir, "crawl_links").select("page_id", "from_url", "link_url", "is_same_origin").distinct()
    same = urls.is_same_site(urls.url_parts(F.col("link_url")), urls.url_parts(F.col("from_url")))
    return links.withColumn("same_site", same).groupBy("same_site", "is_same_origin").agg(F.count("*").alias("n_links"))


@query
def link_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and linking pages by the target's host."""
    links = table(spark, sf_dir, "crawl_links").select("page_id", "link_url").distinct()
    host = urls.hostname_key(urls.url_parts(F.col("link_url"))["host"])
    return links.select("page_id", host.alias("host")).groupBy("host").agg(F.count("*").alias("n_links"), F.count_distinct("page_id").alias("n_pages"))


@query
def link_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct link targets that are, and are not, pages of the collection, by member key."""
    keys = table(spark, sf_dir, "crawl_links").select(urls.member_key(urls.url_parts(F.col("link_url"))).alias("k")).distinct()
    known = _pages(spark, sf_dir).select(urls.member_key(urls.url_parts(F.col("url"))).alias("k"), F.lit(True).alias("known")).distinct()
    return keys.join(known, "k", "left").groupBy(F.coalesce("known", F.lit(False)).alias("listed")).agg(F.count("*").alias("n_targets"))


@query
def pages_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ingest_pages").groupBy("page_id").agg(F.max(F.col("html").isNotNull()).alias("has_html"), F.min("origin").alias("origin"))
    return reports.pages_by_origin(rows.select("has_html", urls.origin_key(urls.url_parts(F.col("origin")), F.col("origin")).alias("origin_key")))


@query
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and their characters by kind."""
    rows = table(spark, sf_dir, "ingest_pages").where("blocks is not null").select("page_id", F.posexplode("blocks").alias("block_no", "b"))
    rows = rows.select("page_id", "block_no", F.col("b.kind").alias("kind"), F.coalesce(F.col("b.text"), F.array_join("b.cells", " "), F.lit("")).alias("text")).dropDuplicates(["page_id", "block_no"])
    return rows.groupBy("kind").agg(F.count("*").alias("n_blocks"), F.sum(F.char_length("text")).alias("n_chars"))


@query
def block_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring blocks of one kind, by kind and length."""
    rows = table(spark, sf_dir, "ingest_pages").where("blocks is not null").select("page_id", F.posexplode("blocks").alias("block_no", "b"))
    rows = rows.select("page_id", "block_no", F.col("b.kind").alias("kind")).dropDuplicates(["page_id", "block_no"])
    return dedup.islands(rows, "page_id", "block_no", "kind").groupBy("kind", "n").agg(F.count("*").alias("n_islands"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ingest_pages").where("blocks is not null").groupBy("page_id").agg(F.min("url").alias("url"), F.max(reports.prose_length(F.col("blocks"))).alias("length"))
    u = urls.url_parts(F.col("url"))
    return rows.select("page_id", urls.hostname_key(u["host"]).alias("site"), urls.section_of(u).alias("section"), "length")


@query
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.corpus_summary(_lengths(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query
def corpus_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary_lines(reports.corpus_summary(_lengths(spark, sf_dir)))


@query
def page_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the extractor makes of each page's markup."""
    rows = table(spark, sf_dir, "ingest_pages").select("page_id", "url", "html").where("html is not null").withColumn("c", extract.extract_clean(F.col("html"), F.col("url")))
    return rows.select("page_id", "c.title", "c.excerpt", "c.content_root", F.size("c.blocks").alias("n_blocks"), F.char_length("c.content_html").alias("n_markup"), fp.content_hash(F.col("c.text")).alias("content_hash"), "c.truncated", "c.failure").distinct()


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page in order, with whether they stay on its site."""
    rows = table(spark, sf_dir, "ingest_pages").select("page_id", "url", "html").where("html is not null")
    links = rows.select("page_id", urls.url_parts(F.col("url")).alias("s"), F.posexplode(extract.extract_links(F.col("html"), F.col("url"))).alias("position", "link_url"))
    return links.select("page_id", "position", "link_url", urls.is_same_site(urls.url_parts(F.col("link_url")), F.col("s")).alias("is_same_site")).distinct()


@query
def page_heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of the headings that blocks stand under."""
    blocks = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["heading_level"].alias("level"), b["text"].alias("text")))
    rows = table(spark, sf_dir, "ingest_pages").where("size(blocks) > 0").groupBy("page_id").agg(F.max(blocks).alias("blocks"))
    return rows.select(F.explode(extract.heading_paths(F.col("blocks"))).alias("path")).groupBy(F.size("path").alias("depth")).agg(F.count("*").alias("n_blocks"))


@query
def doc_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fp.content_hash(F.col("text")).alias("content_hash"))


@query
def doc_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, the first one with the same content."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", fp.content_hash(F.col("text")).alias("content_hash"))
    return dedup.first_wins(rows, "content_hash", "doc_id").select("doc_id", "first_of", "is_first")


@query
def doc_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fp.hex16(fp.simhash(F.col("text"))).alias("simhash"))


@query
def doc_near_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-wins acceptance of the documents over the whole collection, at the widest distance."""
    text = fp.collapsed(F.col("text"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), fp.content_hash(F.col("text")).alias("content_hash"), fp.simhash(F.col("text")).alias("simhash"), F.char_length(text).alias("length"), F.char_length("text").alias("raw_length"))
    return dedup.accept_near(rows, hamming=7)


@query
def ledger_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of accepted pages whose stored fingerprints are within three bits."""
    rows = table(spark, sf_dir, "dedup_accepted").where(f"content_length >= {config.NEAR_CHARS}").select(F.col("page_id").alias("id"), fp.from_hex(F.col("simhash")).alias("simhash")).distinct()
    return fp.near_pairs(rows)


@query
def ledger_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that redirects and aliases lead from, and where they lead to."""
    rows = table(spark, sf_dir, "dedup_accepted").select("page_id", "requested_url_key", "final_url_key", "alias_keys")
    learned = rows.select(F.col("page_id").alias("seq"), F.explode(F.concat(F.array("requested_url_key"), F.coalesce("alias_keys", F.array()))).alias("variant"), F.coalesce("final_url_key", "requested_url_key").alias("rep"))
    edges = dedup.last_aliases(learned)
    return dedup.resolve_aliases(edges.select(F.col("variant").alias("key")), edges)


def _ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.keep_latest(table(spark, sf_dir, "dedup_accepted").where("page_id is not null"), "page_id", "accepted_at")
    site = urls.hostname_key(F.regexp_extract("requested_url_key", r"^https?://([^/?#:]+)", 1))
    return rows.select(site.alias("site"), F.col("page_id").alias("seq"), F.coalesce("final_url_key", "requested_url_key").alias("url_key"), "alias_keys", "html_hash", "canonical_key", "content_hash", fp.from_hex(F.col("simhash")).alias("simhash"), F.col("content_length").alias("length"), F.col("content_length").alias("raw_length"))


@query
def dedup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequential rule replayed over the ledger, each site in order of its pages."""
    return dedup.dedup_site_pages(_ledger_rows(spark, sf_dir))


@query
def dedup_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.skip_counters(dedup_outcomes(spark, sf_dir))


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("url is not null and doc_id is not null").select("url").distinct().withColumn("u", urls.url_parts(F.col("url")))
    u = F.col("u")
    return rows.select(urls.hostname_key(u["host"]).alias("site"), "url", classify.path_tier(u).alias("tier"), classify.path_section(u).alias("section"), F.size(u["segments"]).alias("depth"))


@query
def admission_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's whole frontier in admission order, URLs by locale order; `budget_cut` has the budget."""
    rows = _frontier(spark, sf_dir)
    return ranked(rows, "site", admission.admission_order()).select("site", "rank", "url", "tier")


@query
def section_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota outcome of each frontier URL, ties of the order by the URL's bytes."""
    rows = _frontier(spark, sf_dir)
    order = [classify.tier_rank(F.col("tier")).asc(), F.col("depth").asc(), F.col("url").asc()]
    return admission.quota_admission(ranked(rows, "site", order), CAPS).select("site", "rank", "url", "section", "outcome")


@query
def quota_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.quota_report(section_quota(spark, sf_dir))


@query
def initial_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First URLs of each site: its run's seed, then its documents' pages through the quotas, within 30 pages."""
    seeds = table(spark, sf_dir, "crawl_runs").select(urls.seed_url(urls.url_parts(urls.clean_seed(F.col("seed")))).alias("url")).where("url is not null").distinct()
    seeds = seeds.select(urls.hostname_key(urls.url_parts(F.col("url"))["host"]).alias("site"), F.lit(1).alias("position"), "url")
    return frontier.initial_frontier(seeds, _frontier(spark, sf_dir).select("site", "url"), CAPS, 30)


@query
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted URLs of each site within a budget of 20 pages."""
    admitted = section_quota(spark, sf_dir).where("outcome = 'admitted'")
    # A literal bound on the place is a group limit of the window: each partition hands on a site's first 20 only.
    placed = admitted.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("rank")))
    return placed.where(F.col("place") <= config.budget(20)).select("site", F.col("place").cast("bigint").alias("place"), "url")


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "crawl_links").select("page_id", "from_url", "link_url", "is_same_origin").distinct().where("is_same_origin")
    known = _pages(spark, sf_dir).select(urls.member_key(urls.url_parts(F.col("url"))).alias("member"), F.lit(True).alias("listed")).distinct()
    rows = links.withColumns({"u": urls.url_parts(F.col("link_url")), "f": urls.url_parts(F.col("from_url"))})
    u = F.col("u")
    rows = rows.select(urls.hostname_key(F.col("f.host")).alias("site"), "page_id", urls.dedup_key(u).alias("key"), classify.path_tier(u).alias("tier"), classify.path_section(u).alias("section"), urls.first_segment(u).alias("folder"), classify.trap_rule(u).alias("trap"), urls.member_key(u).alias("member"), urls.is_locale_excluded(u).alias("locale_excluded"), "link_url")
    rows = rows.join(known, "member", "left").withColumn("seq", F.row_number().over(Window.partitionBy("site").orderBy("page_id", "link_url")).cast("bigint"))
    return rows.withColumns({"listed": F.coalesce("listed", F.lit(False)), "depth_exceeded": F.lit(False)})


@query
def discovery_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final state of every link offered to a site."""
    return admission.ledger(admission.admit_links(_offers(spark, sf_dir), CAPS, directory=5))


@query
def discovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = _pages(spark, sf_dir).select(urls.url_parts(F.col("url")).alias("u")).select(urls.hostname_key(F.col("u.host")).alias("site"), urls.dedup_key(F.col("u")).alias("key"))
    return admission.discovery_report(discovery_ledger(spark, sf_dir), fetched)


def _stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reject reason of each page from what is stored with it."""
    rows = table(spark, sf_dir, "ingest_pages").groupBy("page_id").agg(
        F.min("url").alias("url"), F.max("status_code").alias("status"), F.min(F.coalesce("robots_allowed", F.lit(True))).alias("robots"),
        F.max(F.coalesce(reports.prose_length(F.col("blocks")), F.lit(0))).alias("length"), F.max(F.octet_length("html")).alias("size"),
    )
    reason = (
        F.when(~F.col("robots"), "robots_disallowed").when(classify.status_outcome(F.col("status")).isNotNull(), classify.status_outcome(F.col("status")))
        .when(F.col("size").isNull() | (F.col("size") < config.VIABLE_BYTES), "requires_javascript").when(F.col("length") < config.PROSE_FLOOR, "extract_empty")
    )
    return rows.select(F.col("page_id").alias("seq"), "url", F.coalesce(F.col("status").cast("string"), F.lit("none")).alias("detail"), reason.alias("reason"))


@query
def reject_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reject_counters(_stateless(spark, sf_dir))


@query
def reject_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rejects of each reason."""
    return reports.reject_samples(_stateless(spark, sf_dir))


@query
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rule that rejects a page, with the extractor's view of its markup."""
    rows = table(spark, sf_dir, "ingest_pages").select("page_id", "url", "final_url", "status_code", "robots_allowed", "html").withColumn("c", extract.extract_clean(F.col("html"), F.coalesce("final_url", "url")))
    rows = rows.withColumns({"u": urls.url_parts(F.coalesce("final_url", "url")), "s": urls.url_parts(F.col("url"))})
    viable = classify.viability(F.col("html"), F.col("c.probe_length"), F.col("c.mount"))
    early = F.when(~F.coalesce("robots_allowed", F.lit(True)), "robots_disallowed")
    late = classify.reject_reason(F.col("u"), F.col("s"), viable, F.col("c.text"), F.lit(True))
    outcome = F.coalesce(early, classify.status_outcome(F.col("status_code")), classify.viability_reject(viable), F.when(F.col("c.failure").isNotNull(), "extract_failed"), late, F.lit("saved"))
    return rows.select("page_id", outcome.alias("outcome")).distinct()


def _outcome_stream(events: DataFrame) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "barren").when((F.col("event_type") == "purchase") & (F.col("value") >= 100), "saved").otherwise("other")
    return events.select((F.col("user_id") % 20).cast("string").alias("run"), F.col("event_id").alias("seq"), outcome.alias("outcome"))


@query
def early_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.early_abort(_outcome_stream(table(spark, sf_dir, "events")))


@query
def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failure_summary(runs.normal_runs(table(spark, sf_dir, "crawl_runs")))


@query
def failure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure report as lines of text; all run records are taken as failed, as in `failure_causes`, for the tables hold few that are."""
    return reports.failure_lines(table(spark, sf_dir, "crawl_runs").distinct(), "data/failures")


@query
def failure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failure_totals(table(spark, sf_dir, "crawl_runs").distinct().where("lower(trim(status)) in ('failed', 'cancelled')"))


@query
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct run records in normal form, with the status in words."""
    return runs.normal_runs(table(spark, sf_dir, "crawl_runs")).select("run_id", urls.seed_url(urls.url_parts(urls.clean_seed(F.col("seed")))).alias("seed"), "crawl_type", "status", reports.status_text(F.col("status")).alias("status_text"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), "pages_saved")


def _presence(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("links_saved") % 3 == 0, "present").when(F.col("links_saved") % 3 == 1, "absent").otherwise("unknown")
    return rows.select("run_id", kind.alias("kind"), F.when(F.col("links_saved") % 2 == 0, "complete").alias("remote_status"))


@query
def run_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.normal_runs(table(spark, sf_dir, "crawl_runs")).withColumns({"written_minutes_ago": F.col("pages_saved").cast("int"), "live": F.col("pages_saved") % 4 == 0})
    return runs.reconcile_orphans(rows, _presence(rows))


@query
def run_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.normal_runs(table(spark, sf_dir, "crawl_runs")).withColumn("live", F.col("pages_saved") % 4 == 0)
    return runs.superseded_runs(rows, _presence(rows))


@query
def indexed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by index state, those without one included."""
    rows = runs.normal_runs(table(spark, sf_dir, "crawl_runs"))
    state = F.when(F.col("pages_saved") % 5 == 0, "indexing").when(F.col("pages_saved") % 5 == 1, "queued").when(F.col("pages_saved") % 5 == 2, "failed").otherwise("indexed")
    states = rows.where(F.col("pages_saved") % 7 != 0).select("run_id", state.alias("state"))
    return reports.indexed_report(rows.select("run_id", F.col("seed").alias("url"), F.col("created_at").alias("finished_at")), states)[0]


@query
def seed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the pages that the collection has of their origins."""
    rows = runs.normal_runs(table(spark, sf_dir, "crawl_runs")).select("run_id", "seed", "status", "pages_saved", urls.origin_key(urls.url_parts(F.col("seed")), F.col("seed")).alias("origin_key"))
    tally = table(spark, sf_dir, "ingest_pages").select("run_id", "page_id", urls.origin_key(urls.url_parts(F.col("origin")), F.col("origin")).alias("origin_key")).groupBy("run_id", "origin_key").agg(F.count_distinct("page_id").alias("n_pages"))
    remote = rows.where(F.col("pages_saved") % 2 == 0).select("run_id", "status", (F.col("pages_saved") + 1).alias("pages_saved"))
    hosts = rows.where(F.col("pages_saved") % 3 == 0).select("run_id", "origin_key", F.col("pages_saved").alias("host_pages"), F.lit(None).cast("bigint").alias("attempted"), F.lit("host stopped").alias("reason"))
    sitemap = rows.groupBy("seed").agg((F.max("pages_saved") * 2).alias("n_paths"))
    return reports.seed_report(rows, remote, hosts, tally, sitemap)


@query
def size_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what a limit of 12,000 bytes lets in, blocks left out."""
    pages = table(spark, sf_dir, "ingest_pages").select("page_id", "origin", "url", "final_url", "html", "content_html", "title", "excerpt", "failure_reason")
    return writers.size_admission(pages, 12_000).select("page_id", "admission", F.col("html").isNotNull().alias("has_html")).distinct()


@query
def link_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of each page's links, at most five links and 400 bytes apart."""
    links = table(spark, sf_dir, "crawl_links").select("page_id", "link_url").distinct().where("page_id is not null and link_url is not null")
    done = writers.batches(links, "page_id", "link_url", F.octet_length("link_url"), most=5, limit=400)
    return done.groupBy("page_id", "batch").agg(F.count("*").alias("n_links"))


@query
def url_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a listing of all pages."""
    return reports.page_of(_pages(spark, sf_dir).where("page_id is not null").groupBy("page_id").agg(F.min("url").alias("url")), [F.col("page_id").asc()], 50, 50)


@query
def sitemap_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps made of all page URLs, one file per site behind an index, loaded again."""
    u = urls.url_parts(F.col("url"))
    pages = _pages(spark, sf_dir).select(u.alias("u"), "url").select(urls.hostname_key(F.col("u.host")).alias("site"), urls.origin_of(F.col("u")).alias("origin"), "url")
    first = pages.groupBy("site").agg(F.min("origin").alias("origin"))
    body = pages.groupBy("site").agg(F.concat(F.lit("<urlset>"), F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("<url><loc>"), F.col("url"), F.lit("</loc></url>")))), ""), F.lit("</urlset>")).alias("body"))
    leaves = first.join(body, "site").select(F.concat("origin", F.lit("/map-1.xml")).alias("sitemap_url"), F.lit(200).alias("status"), "body")
    index = first.select(F.concat("origin", F.lit("/sitemap.xml")).alias("sitemap_url"), F.lit(200).alias("status"), F.concat(F.lit("<sitemapindex><sitemap><loc>"), F.col("origin"), F.lit("/map-1.xml</loc></sitemap></sitemapindex>")).alias("body"))
    roots = first.select("site", F.concat("origin", F.lit("/sitemap.xml")).alias("sitemap_url"))
    return readers.load_sitemaps(roots, index.unionByName(leaves), first.select("site", F.col("origin").alias("seed")))[1]


@query
def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by what a robots file per origin allows; every third origin has none."""
    u = urls.url_parts(F.col("url"))
    pages = _pages(spark, sf_dir).select("page_id", "url", urls.origin_of(u).alias("origin"))
    body = "User-agent: *\nDisallow: /help\nAllow: /help/a\nDisallow: /*?utm\n\nUser-agent: Loom\nDisallow: /help\nAllow: /help/a\nDisallow: /news\n"
    files = pages.select("origin").distinct().select("origin", F.when(F.length("origin") % 3 == 0, 404).otherwise(200).alias("status"), F.lit(body).alias("body"))
    return readers.robots_gate(pages, files, "Loom").groupBy("robots_allowed").agg(F.count("*").alias("n_pages"))


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark, "stream-")
    return os.path.join(base, f"stream-{uuid.uuid4().hex}")


def _run_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Run a stream over what is there and read its result."""
    folder = _folder(spark)
    rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query
def stream_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each user and type of a stream."""
    return _run_stream(spark, stateful.stream_first_wins(_event_stream(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"]))


@query
def stream_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the outcome stream that stop."""
    return _run_stream(spark, stateful.stream_abort(_outcome_stream(_event_stream(spark, sf_dir))))


__all__ = ["ORACLES", "QUERIES", "flagship"]
