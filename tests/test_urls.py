from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import classify, urlparse, urls


@pytest.mark.parametrize(("raw", "want"), [
    ("HTTP://A.com:80/x y/../z?q=1#f", "http://a.com/z?q=1"), ("https:\\\\a.com\\b", "https://a.com/b"), ("http://münchen.de/è", "http://xn--mnchen-3ya.de/%C3%A8"),
    ("https://u:p@h.com:8443/?", "https://h.com:8443/?"), ("  https://a.com\n/b ", "https://a.com/b"), ("https://a.com/a/./b/%2e%2e/c", "https://a.com/a/c"),
    ("mailto:x@y.z", None), ("//a.com", None), ("", None), (None, None), ("http://a b/", None), ("http://a.com:99999/", None), ("http:///", None),
])
def test_parse(raw, want):
    url = urlparse.parse(raw)
    assert (url and url.href()) == want


@pytest.mark.parametrize(("href", "want"), [("../c?x", "https://a.com/c?x"), ("?q", "https://a.com/b/d?q"), ("//b.com/z", "https://b.com/z"), ("#top", "https://a.com/b/d?k=1"), ("", "https://a.com/b/d?k=1"), ("e", "https://a.com/b/e")])
def test_relative(href, want):
    assert urlparse.parse(href, urlparse.parse("https://a.com/b/d?k=1")).href() == want


def apply(spark, values, make):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.withColumn("p", urls.url_parts(F.col("v"))).orderBy("k").select(make(F.col("p"))).collect()]


def test_normalize_and_keys(spark):
    cases = ["https://A.com/x?utm_source=1&b=2#f", "https://a.com/x?b", "https://a.com/x?GCLID=1", "ftp://a.com/x", None, "not a url", "https://a.com?page=2"]
    assert apply(spark, cases, urls.normalize) == ["https://a.com/x?b=2", "https://a.com/x?b", "https://a.com/x", None, None, None, "https://a.com/?page=2"]
    assert apply(spark, cases[:3], urls.dedup_key) == ["https://a.com/x?b=2", "https://a.com/x?b=", "https://a.com/x"]
    distinct = ["https://www.a.com/x", "https://a.com/x", "http://a.com/x", "https://a.com/X", "https://a.com/x/", "https://a.com/x?b=1&a=2", "https://a.com/x?a=2&b=1"]
    assert len(set(apply(spark, distinct, urls.dedup_key))) == len(distinct)
    same = ["http://www.a.com/X/?b=1&a=2", "https://a.com/x?a=2&b=1", "https://a.com/x/?yclid=7&a=2&b=1"]
    assert len(set(apply(spark, same, lambda p: urls.dedup_key(p, aggressive=True)))) == 1
    assert apply(spark, ["https://www.a.com/b/index.HTML"], lambda p: urls.dedup_key(p, aggressive=True)) == ["https://a.com/b"]
    assert apply(spark, ["https://www.A.com/b/?q=1#x", "https://a.com", "x"], urls.member_key) == ["a.com/b?q=1", "a.com/", None]


def test_locale(spark):
    cases = ["https://a.com/fr/x", "https://a.com/en/x/", "https://a.com/us/x", "https://a.com/en-gb/x", "https://a.com/en-us/x", "https://a.com/about", "https://a.com/", "https://a.com/gb", "https://a.com/pt-br/x", "bad"]
    assert apply(spark, cases, urls.is_locale_excluded) == [True, False, False, True, False, False, False, True, True, False]
    assert apply(spark, cases, urls.locale_normalize) == [None, "https://a.com/x", "https://a.com/us/x", None, "https://a.com/x", "https://a.com/about", "https://a.com/", None, None, None]


def test_seeds(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["- a.com/", " https://a.com/b#c", "1. u:p@a.com/x", "", None])], "k int, v string")
    got = [r[0] for r in df.orderBy("k").select(urls.seed_url(urls.url_parts(urls.clean_seed(F.col("v"))))).collect()]
    assert got == ["https://a.com", "https://a.com/b", "https://a.com/x", None, None]
    keys = [r[0] for r in spark.sql("select array('b','a') s union all select array('a','b')").select(urls.seed_key(F.col("s"))).collect()]
    assert keys[0] == keys[1]


def test_sites(spark):
    df = spark.createDataFrame([("https://www.a.com/x", "https://a.com"), ("http://a.com", "https://a.com"), ("https://b.com", "https://a.com"), (None, "https://a.com")], "a string, b string")
    df = df.select(urls.url_parts(F.col("a")).alias("a"), urls.url_parts(F.col("b")).alias("b"))
    assert [tuple(r) for r in df.select(urls.is_same_site(F.col("a"), F.col("b")), urls.is_on_site(F.col("a"), F.col("b"))).collect()] == [(True, True), (False, True), (False, False), (False, False)]


@pytest.mark.parametrize(("path", "want"), [
    ("/blog/page/3", "pagination"), ("/page/2/", "pagination"), ("/?page=2", "pagination"), ("/?offset=40", "pagination"), ("/page/about-us", None), ("/?p=123", None), ("/?page=intro", None),
    ("/?sort=name", "facet"), ("/?filter[type]=invoice", "facet"), ("/?a=1&b=2&c=3", "facet"), ("/?a=1&b=2", None), ("/search/x", "search"), ("/?q=", "search"), ("/?s=", "search"), ("/features/search", None), ("/?term=", None),
    ("/events/2026-10-04", "calendar"), ("/blog/2024/05", "calendar"), ("/2026", "calendar"), ("/?month=1", "calendar"), ("/2024/05/a-slug", None), ("/features/calendar", None), ("/1099", None),
])
def test_traps(spark, path, want):
    assert apply(spark, [f"https://a.com{path}"], classify.trap_rule) == [want]


def test_tiers_and_sections(spark):
    cases = {
        "/": ("other", ""), "/pricing": ("product", ""), "/products/x": ("product", ""), "/customers/a": ("evidence", "customers"), "/success-stories": ("evidence", "stories"), "/blog/how-to-x": ("editorial", "blog"),
        "/features/how-to": ("editorial", ""), "/integrations/setup-guide": ("product", ""), "/accounting/ar-guide": ("editorial", ""), "/tag/x": ("editorial", "archive"), "/shop/tag": ("other", ""), "/counties/x": ("other", "localities"),
        "/my-blog": ("editorial", "blog"), "/us-sales-tax-rates": ("other", "tax-reference"), "/us-vat-rates": ("other", "tax-reference"), "/about": ("other", ""), "/what-is-x": ("editorial", ""), "/tools/calculator": ("editorial", "tools"),
    }
    got = list(zip(apply(spark, [f"https://a.com{p}" for p in cases], classify.path_tier), apply(spark, [f"https://a.com{p}" for p in cases], classify.path_section)))
    assert dict(zip(cases, got)) == cases


def test_rejects(spark):
    rows = [("https://b.com/x", "https://a.com", None, "x" * 50), ("https://a.com/fr", "https://a.com", None, "x" * 50), ("https://a.com/legal", "https://a.com", None, None), ("https://a.com/x", "https://a.com", "challenge_page", None), ("https://a.com/x", "https://a.com", None, " x "), ("https://a.com/x", "https://a.com", None, "x" * 40)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, f string, s string, v string, t string").orderBy("k")
    got = [r[0] for r in df.select(classify.reject_reason(urls.url_parts(F.col("f")), urls.url_parts(F.col("s")), F.col("v"), F.col("t"), F.lit(True))).collect()]
    assert got == ["off_site_redirect", "locale_excluded", "non_content_directory", "challenge_page", "extract_empty", None]


def test_causes_and_details(spark):
    rows = ["", None, "POST /runs/1/pages/batch → 503 busy", "GET /runs/x → transport: reset", "Application not found", "robots said no", "z" * 99, "links/batch failed"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string").orderBy("k")
    assert [r[0] for r in df.select(classify.failure_cause(F.col("v"))).collect()] == ["no reason recorded", "no reason recorded", "HTTP 503 on pages/batch", "transport failure (no response) on runs", "platform proxy 404 (service not running)", "robots.txt disallowed the crawl", "z" * 80, "links/batch failed"]
    assert spark.sql("select 'a\r\n\tb token: xyz c' v").select(classify.clean_detail(F.col("v"))).first()[0] == "a b token: [redacted] c"
