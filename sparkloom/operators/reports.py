"""Aggregations and reports over pages, outcomes, runs and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom import config
from sparkloom.functions import classify, urls
from sparkloom.operators.sequence import ranked


def prose_length(blocks: Column) -> Column:
    """Characters of all block texts (cells joined by a space)."""
    size = lambda b: F.coalesce(F.char_length(b["text"]), F.char_length(F.array_join(b["cells"], " ")), F.lit(0)).cast("bigint")
    return F.aggregate(F.transform(blocks, size), F.lit(0).cast("bigint"), lambda a, x: a + x)


def corpus_summary(pages: DataFrame) -> DataFrame:
    """Per site and section: pages, share of the site, upper median of the prose length, thin pages.

    ``pages``: ``site, section, length``, one row per page. The median is taken by rank among the counts of
    distinct lengths, so a large section is combined before the shuffle and never collected.
    """
    counts = pages.groupBy("site", "section", "length").agg(F.count("*").alias("c"))
    by = Window.partitionBy("site", "section")
    upto = F.sum("c").over(by.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumns({"upto": upto, "n": F.sum("c").over(by)})
    middle = F.floor(F.col("n") / 2) + 1
    per = ranked.groupBy("site", "section").agg(
        F.max("n").alias("pages"), F.min(F.when(F.col("upto") >= middle, F.col("length"))).alias("median_prose"),
        F.sum(F.when(F.col("length") < config.THIN_CHARS, F.col("c")).otherwise(0)).alias("thin_pages"),
    )
    return per.withColumn("share", F.col("pages") / F.sum("pages").over(Window.partitionBy("site")))


def summary_lines(summary: DataFrame, top: int = 16) -> DataFrame:
    """The largest sections as text lines, and one line for the rest: ``site, rank, line``."""
    by = Window.partitionBy("site").orderBy(F.desc("pages"), "section")
    ranked = summary.withColumn("rank", F.row_number().over(by))
    shown = ranked.where(F.col("rank") <= top).select("site", "rank", F.format_string("%s: %d pages (%.1f%%), median %d, thin %d", F.col("section"), F.col("pages"), F.col("share") * 100, F.col("median_prose"), F.col("thin_pages")).alias("line"))
    rest = ranked.where(F.col("rank") > top).groupBy("site").agg(F.count("*").alias("n"), F.sum("pages").alias("p"))
    return shown.unionByName(rest.select("site", F.lit(top + 1).alias("rank"), F.format_string("and %d more sections with %d pages", "n", "p").alias("line")))


def reject_counters(outcomes: DataFrame) -> DataFrame:
    """One row with the count of each reject reason, zeros included."""
    return outcomes.agg(*(F.count_if(F.col("reason") == r).alias(r) for r in config.REJECT_REASONS))


def reject_samples(outcomes: DataFrame, n: int = config.SAMPLES) -> DataFrame:
    """The first ``n`` rejects of each reason by ``seq``: ``reason, rank, seq, url, detail``, fit to be shown.

    URLs lose credentials, query and fragment; details are on one line, without secrets, and cut.
    Spark keeps the first ``n`` of each reason in every partition before the shuffle (a group limit of the window).
    """
    rows = outcomes.where("reason is not null")
    placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy("reason").orderBy("seq")))
    kept = placed.where(F.col("rank") <= n)
    return kept.select("reason", "rank", "seq", urls.sample_url(urls.url_parts(F.col("url")), F.col("url")).alias("url"), classify.clean_detail(F.col("detail")).alias("detail"))


def crawl_report(counters: DataFrame, links_stored: Column) -> DataFrame:
    """Policy exclusions apart from failures, as one struct."""
    policy = ("robots_disallowed", "off_site_redirect", "locale_excluded", "non_content_directory", "challenge_page")
    failed = ("requires_javascript", "extract_empty", "request_failed")
    return counters.select(links_stored.alias("links_stored"), F.struct(*policy).alias("excluded_by_policy"), F.struct(*failed).alias("failed"))


def failure_summary(runs: DataFrame) -> DataFrame:
    """Failed runs by cause: ``cause, n_runs, n_pages``; pages of all runs with the cause, the most first."""
    caused = runs.withColumn("cause", classify.failure_cause(F.col("error_summary")))
    return caused.groupBy("cause").agg(F.count("*").alias("n_runs"), F.sum(F.coalesce("pages_saved", F.lit(0))).alias("n_pages"))


def failure_lines(runs: DataFrame, folder: str) -> DataFrame:
    """The failure report as text: ``part, n, line``, to be read in order of ``part`` and ``n``.

    ``runs``: ``run_id, seed, created_at_utc, purged_at_utc, pages_saved, error_summary`` of failed runs, one row each.
    Part 1 has the totals, part 2 the causes (most pages first, then most runs, then by name), part 3 the runs,
    newest first, two lines each; without runs, part 1 says so.
    """
    causes = failure_summary(runs)
    wide = causes.agg(F.max(F.char_length("cause")).alias("wide"))
    totals = failure_totals(runs)
    kept = F.when(F.col("total") > F.col("purged"), F.format_string(", %d not purged", F.col("total") - F.col("purged"))).otherwise("")
    head = F.when(F.col("total") == 0, F.array(F.concat(F.lit("No failure post-mortems in "), F.lit(folder)))).otherwise(F.array(F.format_string("%d failure post-mortem(s) in %s", F.col("total"), F.lit(folder)), F.concat(F.format_string("  %d purged (%d page(s) gone)", "purged", "pages_lost"), kept)))
    first = totals.select(F.lit(1).alias("part"), F.posexplode(head).alias("n", "line")).withColumn("n", F.col("n").cast("bigint") + 1)
    order = F.row_number().over(Window.orderBy(F.desc("n_pages"), F.desc("n_runs"), "cause")).cast("bigint")
    padded = F.rpad("cause", wide.scalar(), " ")
    second = causes.withColumn("n", order).select(F.lit(2).alias("part"), "n", F.format_string("  %s  %3d run(s)  %5d page(s)", padded, F.col("n_runs"), F.col("n_pages")).alias("line"))
    gone = F.when(F.col("purged_at_utc").isNotNull() & (F.trim("purged_at_utc") != ""), "purged    ").otherwise("not purged")
    newest = ranked(runs.withColumn("_all", F.lit(1)), "_all", [F.col("created_at_utc").desc_nulls_last(), F.col("run_id").asc()], "n")
    texts = F.array(F.format_string("  %s  %s  %5d page(s)  %s  %s", F.col("created_at_utc"), gone, F.coalesce("pages_saved", F.lit(0)), F.col("run_id"), F.col("seed")), F.concat(F.lit("      "), classify.failure_cause(F.col("error_summary"))))
    third = newest.select(F.lit(3).alias("part"), F.col("n").alias("run"), F.posexplode(texts).alias("k", "line")).select("part", (F.col("run") * 2 - 1 + F.col("k")).alias("n"), "line")
    return first.unionByName(second).unionByName(third)


def failure_totals(runs: DataFrame) -> DataFrame:
    purged = F.col("purged_at_utc").isNotNull() & (F.trim("purged_at_utc") != "")
    return runs.agg(F.count("*").alias("total"), F.count_if(purged).alias("purged"), F.coalesce(F.sum(F.when(purged, F.coalesce("pages_saved", F.lit(0)))), F.lit(0)).alias("pages_lost"))


def composition_by_tier(pages: DataFrame) -> DataFrame:
    return pages.groupBy("tier").agg(F.count("*").alias("n_pages"))


def pages_by_origin(pages: DataFrame) -> DataFrame:
    return pages.groupBy("origin_key").agg(F.count("*").alias("n_pages"), F.count_if("has_html").alias("n_with_html"))


def completed_label(saved: Column, mapped: Column, status: Column) -> Column:
    """Percent of the mapped pages (capped at 100, halves rounded up), else the status."""
    percent = F.least(F.lit(100), F.floor(saved * 100 / F.least(mapped, F.lit(config.MAX_PAGES)) + 0.5))
    return F.when(mapped > 0, F.concat(percent.cast("int").cast("string"), F.lit("%"))).otherwise(status)


def status_text(status: Column) -> Column:
    return (
        F.when(status == "complete", "finished").when(status == "failed", "stopped by an error").when(status == "cancelled", "stopped by an operator")
        .when(status.isin("pending", "running"), "in progress").otherwise(F.coalesce(status, F.lit("unknown")))
    )


def seed_report(runs: DataFrame, remote: DataFrame, hosts: DataFrame, tally: DataFrame, sitemap: DataFrame) -> DataFrame:
    """One row per run and seed from the local run, the remote snapshot, host rows, page tallies and sitemap counts.

    ``runs(run_id, seed, status, pages_saved)``, ``remote(run_id, status, pages_saved)``,
    ``hosts(run_id, origin_key, host_pages, attempted, reason)``, ``tally(run_id, origin_key, n_pages)``,
    ``sitemap(seed, n_paths)``; ``runs`` has ``origin_key`` too. The remote snapshot wins over the local run; the
    page count is the tally, else the host's, else the attempts, else the run's own.
    """
    far = remote.withColumnsRenamed({"status": "far_status", "pages_saved": "far_saved"})
    rows = runs.join(far, "run_id", "full_outer").join(hosts, ["run_id", "origin_key"], "left").join(tally, ["run_id", "origin_key"], "left").join(sitemap, "seed", "left")
    status, saved = F.coalesce("far_status", "status"), F.coalesce("n_pages", "host_pages", "attempted", "far_saved", "pages_saved", F.lit(0))
    out = rows.select("run_id", "seed", status.alias("status"), saved.alias("n_pages"), F.coalesce("reason", F.when(status == "failed", F.lit("run failed"))).alias("reason"), F.col("n_paths"))
    return out.withColumn("completed", completed_label(F.col("n_pages"), F.col("n_paths"), F.col("status")))


INDEX_RANK = {"indexing": 0, "queued": 1, "failed": 2, "indexed": 3}


def indexed_report(runs: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by index state over all runs, and the runs in the four listed states in report order.

    ``runs(run_id, url, finished_at)``, ``states(run_id, state)``; a run without a state is ``not_indexed``.
    """
    rows = runs.join(states, "run_id", "left").withColumn("state", F.coalesce("state", F.lit("not_indexed")))
    rank = F.create_map(*[F.lit(x) for item in INDEX_RANK.items() for x in item])[F.col("state")]
    listed = rows.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.desc("finished_at"), "url")
    return rows.groupBy("state").agg(F.count("*").alias("n_runs")), listed


def page_of(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page of a listing with ``has_more``; the limit is held to 1..500, the offset to 0 or more."""
    limit, offset = max(1, min(500, limit)), max(0, offset)
    part = rows.orderBy(*order).offset(offset).limit(limit)
    return part.withColumn("has_more", F.count("*").over(Window.partitionBy()) >= limit)


def sitemap_counts(rows: DataFrame) -> DataFrame:
    """Distinct URLs and distinct report paths of ``rows(site, url, path)``."""
    return rows.groupBy("site").agg(F.count_distinct("url").alias("n_urls"), F.count_distinct("path").alias("n_paths"))
