"""Readers: sitemaps, robots files, run records, cached pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkloom import config
from sparkloom.functions import classify, urls
from sparkloom.session import checkpoint

RUN = "run_id string, seed string, crawl_type string, status string, error_summary string, created_at_utc string, purged_at_utc string, pages_saved bigint, links_saved bigint"


def read_json_records(spark: SparkSession, path: str, schema: str = RUN) -> DataFrame:
    """JSON records, one file each, with ``state`` ok or unreadable (an empty or broken file) and the file's path."""
    kind = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    rows = spark.read.schema(kind).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.when(F.col("_corrupt_record").isNotNull(), "unreadable").otherwise("ok").alias("state")).drop("_corrupt_record")


def newest_runs(records: DataFrame) -> DataFrame:
    """Readable records, the newest first."""
    return records.where("state = 'ok' and run_id is not null").orderBy(F.desc("created_at_utc"), "run_id")


def cached_pages(spark: SparkSession, path: str, markup: bool = False) -> DataFrame:
    """Cached pages by key; the markup is read only when asked for."""
    columns = ["key", "url", "blocks"] + ["content_html"] * markup
    return spark.read.parquet(path).where("url is not null").select(*columns)


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """Sitemaps named by robots files ``origin, status, body``: ``origin, position, sitemap_url``."""
    lines = files.where(F.col("status").between(200, 299)).select("origin", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("position", "line"))
    found = lines.withColumn("sitemap_url", F.regexp_extract("line", r"(?i)^\s*sitemap:\s*(\S+)", 1))
    return found.where("sitemap_url != ''").select("origin", "position", "sitemap_url")


def locations(xml: Column) -> Column:
    """``loc`` texts of a sitemap; entities stay as they are."""
    return F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))


def is_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex[\s>]")


def load_sitemaps(roots: DataFrame, files: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of sites' sitemaps, and one row per site about the loading.

    ``roots(site, sitemap_url)``, ``files(sitemap_url, status, body)`` (a file without a row failed), ``scope(site, seed)``.
    First frame: ``site, url, member_key``, distinct, same-site, locale-normalised; empty for a site with a
    failed file. Second: ``site, n_files, n_urls, has_map, failed, truncated``. At most 40 files with content and 50,000
    URLs of a site are used, in order; absent files do not use up the 40. At most twice as many files are put in line;
    indexes may lie in each other to any depth within that. ``truncated`` says that a limit stopped the work.
    """
    most, at = 2 * config.SITEMAP_FILES, Window.partitionBy("site").orderBy("level", "position", "sitemap_url")
    loaded, cut = None, None
    todo = roots.select("site", "sitemap_url", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("position")).dropDuplicates(["site", "sitemap_url"])
    # Ends: each round puts new files in line, and a site has at most ``most``.
    while loaded is None or not todo.isEmpty():
        read = todo.join(files, "sitemap_url", "left").withColumn("kind", classify.fetch_kind(F.col("status")))
        loaded = checkpoint(read if loaded is None else loaded.unionByName(read))
        lined = loaded.groupBy("site").agg(F.count("*").alias("lined"), F.max("level").alias("deepest"))
        newest = loaded.join(lined, "site").where("level = deepest and kind = 'ok'").where(is_index(F.col("body")))
        children = newest.select("site", "lined", "level", F.col("position").alias("up"), F.posexplode(locations(F.col("body"))).alias("p", "sitemap_url"))
        children = children.select("site", "lined", "sitemap_url", (F.col("level") + 1).alias("level"), (F.col("up") * 100_000 + F.col("p")).alias("position"))
        new = children.groupBy("site", "sitemap_url").agg(F.min(F.struct("level", "position", "lined")).alias("x")).select("site", "sitemap_url", "x.*").join(loaded.select("site", "sitemap_url"), ["site", "sitemap_url"], "left_anti")
        placed = checkpoint(new.withColumn("place", F.col("lined") + F.row_number().over(at)))
        over = placed.where(F.col("place") > most).select("site").distinct()
        cut = over if cut is None else cut.union(over).distinct()
        todo = placed.where(F.col("place") <= most).select("site", "sitemap_url", "level", "position")
    cut = cut.withColumn("deep", F.lit(True))
    # A file is read as long as fewer files with content than the limit come before it.
    numbered = loaded.withColumns({"n": F.row_number().over(at), "read_before": F.count_if(F.col("kind") == "ok").over(at.rowsBetween(Window.unboundedPreceding, -1))})
    reached = F.coalesce("read_before", F.lit(0)) < config.SITEMAP_FILES
    used = numbered.where(reached)
    status = numbered.groupBy("site").agg(F.count("*").alias("files"), F.count_if(reached).alias("read"), F.max((F.col("kind") == "failed") & reached).alias("failed"))
    locs = used.where((F.col("kind") == "ok") & ~is_index(F.col("body"))).select("site", "n", F.posexplode(locations(F.col("body"))).alias("p", "loc"))
    locs = locs.join(scope, "site").withColumns({"u": urls.url_parts(F.col("loc")), "s": urls.url_parts(F.col("seed"))})
    own = locs.where(urls.is_same_site(F.col("u"), F.col("s"))).withColumn("l", urls.url_parts(urls.locale_normalize(F.col("u"))))
    pages = own.select("site", "n", "p", urls.normalize(F.col("l")).alias("url"), urls.member_key(F.col("l")).alias("member_key")).where("url is not null")
    first = pages.groupBy("site", "url").agg(F.min(F.struct("n", "p", "member_key")).alias("x")).select("site", "url", "x.member_key", "x.n", "x.p")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("n", "p")))
    kept = ranked.where(F.col("rank") <= config.SITEMAP_URLS).join(status.where("not failed").select("site"), "site", "left_semi")
    counts = ranked.groupBy("site").agg(F.count("*").alias("urls"))
    meta = status.join(counts, "site", "left").join(cut, "site", "left").select(
        "site", F.col("read").alias("n_files"), F.when(F.col("failed"), 0).otherwise(F.least(F.coalesce("urls", F.lit(0)), F.lit(config.SITEMAP_URLS))).alias("n_urls"),
        (~F.col("failed") & (F.coalesce("urls", F.lit(0)) > 0)).alias("has_map"), "failed", ((F.col("files") > F.col("read")) | (F.coalesce("urls", F.lit(0)) > config.SITEMAP_URLS) | F.coalesce("deep", F.lit(False))).alias("truncated"),
    )
    return kept.select("site", "url", "member_key"), meta


def robots_rules(body: str | None, agent: str) -> list[tuple[bool, str]]:
    """``(allow, pattern)`` rules of the group for ``agent``, else of ``*``; agents compare without case, by prefix."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    fresh = False
    for line in (body or "").splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not fresh:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            fresh = True
        elif name in ("allow", "disallow"):
            fresh = False
            if groups and value:
                groups[-1][1].append((name == "allow", value))
        else:
            fresh = False
    own = [rules for agents, rules in groups if agent.lower() in agents]
    return [r for rules in own or [rules for agents, rules in groups if "*" in agents] for r in rules]


def robots_allows(rules: list[tuple[bool, str]], path: str) -> bool:
    """The longest matching pattern decides; a tie allows; no match allows."""
    best = (-1, True)
    for allow, pattern in rules:
        plain = re.escape(pattern.removesuffix("$")).replace(r"\*", ".*") + ("$" if pattern.endswith("$") else "")
        if re.match(plain, path):
            best = max(best, (len(pattern), allow))
    return best[1]


def robots_gate(pages: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """``pages(url, origin)`` with ``robots_allowed``: by the rules for ``agent`` or those for everyone; false without a readable file.

    An absent file (404 or 410) allows everything. Files are joined by origin, each parsed once per batch.
    """
    def apply(kinds: pd.Series, bodies: pd.Series, paths: pd.Series) -> pd.Series:
        known: dict[str | None, tuple] = {}
        out = []
        for kind, body, path in zip(kinds, bodies, paths):
            if kind == "absent":
                out.append(True)
            elif kind != "ok" or path is None:
                out.append(False)
            else:
                if body not in known:
                    known[body] = robots_rules(body, agent), robots_rules(body, "*")
                out.append(any(robots_allows(r, path) for r in known[body]))
        return pd.Series(out, dtype="bool")

    apply.__annotations__ = {"kinds": pd.Series, "bodies": pd.Series, "paths": pd.Series, "return": pd.Series}
    rows = pages.join(files.select("origin", "status", "body"), "origin", "left").withColumn("u", urls.url_parts(F.col("url")))
    path = F.when(F.col("u.ok"), F.concat(F.col("u.path"), F.when(F.col("u.query").isNotNull(), F.concat(F.lit("?"), F.col("u.query"))).otherwise("")))
    return rows.select(*pages.columns, F.pandas_udf(apply, "boolean")(classify.fetch_kind(F.col("status")), F.col("body"), path).alias("robots_allowed"))


def merge_site_maps(seeds: DataFrame, pages: DataFrame, meta: DataFrame) -> DataFrame:
    """URLs of the maps of all seeds of a run, ``run_id, url``, distinct: none if a seed's map failed to load.

    ``seeds(run_id, site)``; ``pages`` and ``meta`` of ``load_sitemaps``.
    """
    failed = seeds.join(meta.where("failed").select("site"), "site", "left_semi").select("run_id").distinct()
    return seeds.join(failed, "run_id", "left_anti").join(pages.select("site", "url"), "site").select("run_id", "url").distinct()


def harvested_links(rows: DataFrame, most: int = 2000) -> DataFrame:
    """Links of one loaded page per site: ``rows(site, position, href, page_url)`` to distinct links of the page's own origin, in order, at most ``most``."""
    parsed = rows.withColumns({"u": urls.url_parts(F.col("href")), "b": urls.url_parts(F.col("page_url"))})
    own = parsed.where(urls.is_web(F.col("u")) & (urls.origin_of(F.col("u")) == urls.origin_of(F.col("b")))).select("site", "position", F.col("u.href").alias("url"))
    first = own.groupBy("site", "url").agg(F.min("position").alias("position"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("position")))
    return ranked.where(F.col("rank") <= most).select("site", "rank", "url")
