from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import urls
from sparkloom.operators import frontier


def test_seeds_and_candidates(spark):
    seeds = spark.createDataFrame([("r", 2, "https://A.com"), ("r", 1, "- a.com/"), ("r", 3, None), ("r", 4, "b.com/X")], "run_id string, position int, raw string")
    assert {(r["position"], r["seed"]) for r in frontier.distinct_seeds(seeds).collect()} == {(1, "https://a.com"), (4, "https://b.com/X")}
    offers = spark.createDataFrame([("s", 1, "https://a.com/en/x?utm_source=1"), ("s", 2, "https://a.com/x"), ("s", 3, "mailto:x"), ("s", 4, "https://a.com/fr/x"), ("s", 5, "https://a.com/old")], "site string, seq long, url string")
    aliases = spark.createDataFrame([("https://a.com/old", "https://a.com/x")], "key string, resolved string")
    got = {r["seq"]: (r["key"], r["is_repeat"], r["locale_excluded"]) for r in frontier.candidates(offers, aliases).collect()}
    assert got == {1: ("https://a.com/x", False, False), 2: ("https://a.com/x", True, False), 3: (None, False, False), 4: ("https://a.com/fr/x", False, True), 5: ("https://a.com/x", True, False)}


def test_initial_frontier(spark):
    seeds = spark.createDataFrame([("s", 1, "https://a.com/fr/home")], "site string, position int, url string")
    mapped = spark.createDataFrame([("s", f"https://a.com/{p}") for p in ("blog/1", "blog/2", "pricing", "zip-codes/1", "fr/x", "fr/home", "about")], "site string, url string")
    rows = {r["url"]: (r["place"], r["outcome"]) for r in frontier.initial_frontier(seeds, mapped, {"zip-codes": 0}, 3).collect()}
    assert rows == {"https://a.com/fr/home": (1, "admitted"), "https://a.com/pricing": (2, "admitted"), "https://a.com/about": (3, "admitted"), "https://a.com/zip-codes/1": (None, "section"), "https://a.com/blog/1": (None, "share"), "https://a.com/blog/2": (None, "share")}
    harvested = spark.createDataFrame([("s", 1, "https://a.com/pricing"), ("s", 2, "https://a.com/new"), ("s", 3, "https://a.com/zip-codes/9")], "site string, rank int, url string")
    got = {r["url"]: r["outcome"] for r in frontier.merge_harvested(mapped, harvested, {"zip-codes": 0}).collect()}
    assert got == {"https://a.com/new": "admitted", "https://a.com/zip-codes/9": "section"}


def test_small_rules(spark):
    df = spark.createDataFrame([("../c", "https://a.com/b/d", "https://www.a.com"), ("https://x.com/", "https://a.com", "https://a.com"), (None, "https://a.com", "https://a.com"), (" ", "https://a.com", "https://a.com")], "h string, p string, s string")
    assert [r[0] for r in df.select(urls.canonical_key(F.col("h"), F.col("p"), urls.url_parts(F.col("s")))).collect()] == ["https://a.com/c", None, None, None]
    rows = spark.createDataFrame([(1, "saved", False), (2, "extract_empty", True), (3, "canonical_alias", True), (4, "duplicate_content", False)], "seq int, outcome string, forefront boolean")
    assert {r["seq"] for r in frontier.link_sources(rows).collect()} == {1, 3}
    assert [r["seq"] for r in rows.orderBy(*frontier.fetch_order()).collect()] == [2, 3, 1, 4]
    assert spark.range(1).select(frontier.depth_exceeded(F.lit(2), 2), frontier.depth_exceeded(F.lit(2), None), frontier.needs_browser(F.lit(False), F.lit(3))).first()[:] == (True, False, True)
