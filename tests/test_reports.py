from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import reports, runs
from sparkloom.sources import readers, writers


def test_corpus_summary(spark):
    rows = [("a", "hub", n) for n in (100, 7000, 9000)] + [("a", "glossary", n) for n in (600, 700)] + [("a", "pricing", 10), ("b", "x", 5)]
    got = {(r["site"], r["section"]): r for r in reports.corpus_summary(spark.createDataFrame(rows, "site string, section string, length long")).collect()}
    hub = got["a", "hub"]
    assert (hub["pages"], hub["share"], hub["median_prose"], hub["thin_pages"]) == (3, 0.5, 7000, 1) and got["a", "glossary"]["median_prose"] == 700 and got["b", "x"]["share"] == 1.0
    many = spark.createDataFrame([("a", f"s{k:02}", k, 1.0, 1, 0) for k in range(1, 20)], "site string, section string, pages long, share double, median_prose long, thin_pages long")
    lines = reports.summary_lines(many).orderBy("rank").collect()
    assert len(lines) == 17 and lines[0]["line"].startswith("s19: 19 pages") and lines[-1]["line"] == "and 3 more sections with 6 pages"


def test_rejects_and_failures(spark):
    df = spark.createDataFrame([(k, f"u{k}", "d", "request_failed" if k % 2 else None) for k in range(20)], "seq long, url string, detail string, reason string")
    assert reports.reject_counters(df).first()["request_failed"] == 10
    assert [r["seq"] for r in reports.reject_samples(df).orderBy("rank").collect()] == [1, 3, 5, 7, 9]
    failed = spark.createDataFrame([("→ 503 x", 5, None), ("→ 503 y", None, "2025-01-01"), ("", 2, " ")], "error_summary string, pages_saved long, purged_at_utc string")
    assert {r["cause"]: (r["n_runs"], r["n_pages"]) for r in reports.failure_summary(failed).collect()} == {"HTTP 503": (2, 5), "no reason recorded": (1, 2)}
    assert tuple(reports.failure_totals(failed).first()) == (3, 1, 0)


def test_report_joins(spark):
    local = spark.createDataFrame([("r1", "https://a.com", "complete", 10, "https://a.com"), ("r2", "https://b.com", "failed", 3, "https://b.com")], "run_id string, seed string, status string, pages_saved long, origin_key string")
    remote = spark.createDataFrame([("r1", "running", 12)], "run_id string, status string, pages_saved long")
    hosts = spark.createDataFrame([("r2", "https://b.com", None, 4, None)], "run_id string, origin_key string, host_pages long, attempted long, reason string")
    tally = spark.createDataFrame([("r1", "https://a.com", 11)], "run_id string, origin_key string, n_pages long")
    sitemap = spark.createDataFrame([("https://a.com", 22)], "seed string, n_paths long")
    got = {r["run_id"]: r for r in reports.seed_report(local, remote, hosts, tally, sitemap).collect()}
    assert (got["r1"]["status"], got["r1"]["n_pages"], got["r1"]["completed"]) == ("running", 11, "50%") and (got["r2"]["n_pages"], got["r2"]["reason"], got["r2"]["completed"]) == (4, "run failed", "failed")
    rows = spark.createDataFrame([(f"r{k}", f"u{k}", k) for k in range(4)], "run_id string, url string, finished_at int")
    counts, listed = reports.indexed_report(rows, spark.createDataFrame([("r0", "indexed"), ("r1", "queued"), ("r2", "queued")], "run_id string, state string"))
    assert {tuple(r) for r in counts.collect()} == {("indexed", 1), ("queued", 2), ("not_indexed", 1)} and [r["run_id"] for r in listed.collect()] == ["r2", "r1", "r0"]
    page = reports.page_of(spark.range(10).toDF("k"), [F.col("k").asc()], 3, 8).collect()
    assert [r["k"] for r in page] == [8, 9] and not page[0]["has_more"]


def test_run_rules(spark):
    rows = [("live", "running", 99, True), ("notime", "pending", None, False), ("fresh", "running", 14, False), ("nokind", "running", 15, False), ("nostatus", "running", 15, False), ("done", "running", 99, False), ("orphan", "pending", 99, False), ("gone", "running", 99, False), ("complete", "complete", 1, False)]
    df = spark.createDataFrame(rows, "run_id string, status string, written_minutes_ago int, live boolean")
    presence = spark.createDataFrame([("nostatus", "present", None), ("done", "present", "complete"), ("orphan", "present", "running"), ("gone", "absent", None)], "run_id string, kind string, remote_status string")
    got = {r["run_id"]: r["outcome"] for r in runs.reconcile_orphans(df, presence).collect()}
    assert got == {"live": "skipped_live", "notime": "problem", "fresh": "skipped_recent", "nokind": "unknown", "nostatus": "unknown", "done": "skipped_complete", "orphan": "reconciled", "gone": "reconciled"}
    assert runs.superseded_runs(df, presence).first()["outcome"] == "unknown"
    times = spark.createDataFrame([("2025-01-02T03:04:05.678Z",), ("2025-01-02T03:04:05Z",), ("2025-01-02 03:04:05",), ("x",), (None,)], "t string")
    assert [r[0] and r[0].minute for r in times.select(runs.run_time(F.col("t"))).collect()] == [4, 4, 4, None, None]
    events = spark.createDataFrame([("r", 1, "failed", "e", None), ("r", 2, "complete", None, True), ("q", 1, "failed", "e", None)], "run_id string, seq int, status string, error string, content_ready boolean")
    assert {tuple(r) for r in runs.last_status(events).collect()} == {("r", "complete", None, True), ("q", "failed", "e", None)}
    merged = runs.merged_counters(spark.createDataFrame([("r", 1, 5, None), ("r", 2, None, 7), ("r", 3, 6, None)], "run_id string, seq int, a int, b int"), ["a", "b"])
    assert tuple(merged.first()) == ("r", 6, 7)
    slots = spark.createDataFrame([("local", "k", "running"), ("local", "k", "pending"), ("local", "j", "running")], "crawl_type string, seed_key string, status string")
    assert [tuple(r) for r in runs.slot_conflicts(slots).collect()] == [("local:k", 2)]
    answers = spark.createDataFrame([(200, None, None), (404, "application/json", "{}"), (404, "text/html", "<p>"), (None, None, None), (500, None, None)], "s int, c string, b string")
    assert [r[0] for r in answers.select(runs.absence(F.col("s"), F.col("c"), F.col("b"))).collect()] == ["found", "absent", "unreachable", "unreachable", "error"]


def test_sitemaps(spark):
    loc = lambda *u: "<urlset>" + "".join(f"<url><LOC> {x} </LOC></url>" for x in u) + "</urlset>"
    index = lambda *u: "<sitemapindex >" + "".join(f"<loc>{x}</loc>" for x in u) + "</sitemapindex>"
    files = [("r", 200, index("m1", "m2", "r")), ("m1", 200, loc("https://a.com/x", "https://a.com/x/?utm_source=1", "https://b.com/y", "https://a.com/fr/z", "https://www.a.com/en/w")), ("m2", 404, None), ("q", 200, index("q1")), ("q1", 500, None)]
    pages, meta = readers.load_sitemaps(
        spark.createDataFrame([("a", "r"), ("b", "q"), ("c", "none")], "site string, sitemap_url string"), spark.createDataFrame(files, "sitemap_url string, status int, body string"),
        spark.createDataFrame([("a", "https://a.com"), ("b", "https://b.com"), ("c", "https://c.com")], "site string, seed string"),
    )
    assert {(r["site"], r["url"]) for r in pages.collect()} == {("a", "https://a.com/x"), ("a", "https://a.com/x/"), ("a", "https://www.a.com/w")}
    assert {r["site"]: (r["n_files"], r["n_urls"], r["has_map"], r["failed"], r["truncated"]) for r in meta.collect()} == {"a": (3, 3, True, False, False), "b": (2, 0, False, True, False), "c": (1, 0, False, True, False)}
    robots = spark.createDataFrame([("o", 200, "User-agent: *\nSITEMAP:  https://a/s.xml x\nDisallow:"), ("p", 404, "Sitemap: y")], "origin string, status int, body string")
    assert [r["sitemap_url"] for r in readers.robots_sitemaps(robots).collect()] == ["https://a/s.xml"]


def test_sitemap_limits_and_merged_seeds(spark):
    loc = lambda *u: "<urlset>" + "".join(f"<loc>{x}</loc>" for x in u) + "</urlset>"
    index = lambda *u: "<sitemapindex>" + "".join(f"<loc>{x}</loc>" for x in u) + "</sitemapindex>"
    files = [("far0", 200, index("far1"))] + [(f"far{k}", 200, index(f"far{k + 1}")) for k in range(1, 9)] + [("far9", 200, loc("https://far.com/deep"))]
    # Fifty absent files before the one that is there; a hundred children, of which only some come into line.
    files += [("gaps", 200, index(*(f"g{k}" for k in range(50)), "g_ok"))] + [(f"g{k}", 404, None) for k in range(50)] + [("g_ok", 200, loc("https://gaps.com/x"))]
    files += [("wide", 200, index(*(f"w{k}" for k in range(100))))] + [(f"w{k}", 200, loc(f"https://wide.com/{k}")) for k in range(100)] + [("bad", 500, None)]
    sites = ("far", "gaps", "wide", "bad")
    pages, meta = readers.load_sitemaps(
        spark.createDataFrame([(s, "far0" if s == "far" else s) for s in sites], "site string, sitemap_url string"), spark.createDataFrame(files, "sitemap_url string, status int, body string"),
        spark.createDataFrame([(s, f"https://{s}.com") for s in sites], "site string, seed string"),
    )
    found = {r["site"]: (r["n_files"], r["n_urls"], r["failed"], r["truncated"]) for r in meta.collect()}
    assert found == {"far": (10, 1, False, False), "gaps": (52, 1, False, False), "wide": (40, 39, False, True), "bad": (1, 0, True, False)}
    seeds = spark.createDataFrame([("one", "far"), ("one", "gaps"), ("two", "far"), ("two", "bad")], "run_id string, site string")
    assert {tuple(r) for r in readers.merge_site_maps(seeds, pages, meta).collect()} == {("one", "https://far.com/deep"), ("one", "https://gaps.com/x")}


def test_failure_lines(spark):
    runs_ = [("a", "https://a.com", "2025-01-01", None, 3, "Cancelled by operator"), ("b", "https://b.com", "2025-01-02", "2025-01-03", 12, "no usable pages"), ("c", "https://c.com", "2025-01-03", " ", None, "Cancelled by operator")]
    df = spark.createDataFrame(runs_, "run_id string, seed string, created_at_utc string, purged_at_utc string, pages_saved long, error_summary string")
    lines = [r["line"] for r in reports.failure_lines(df, "x/failures").orderBy("part", "n").collect()]
    assert lines[:2] == ["3 failure post-mortem(s) in x/failures", "  1 purged (12 page(s) gone), 2 not purged"] and lines[3].split("  ")[1] == "cancelled by operator" and lines[3].endswith("  2 run(s)      3 page(s)")
    assert lines[4].startswith("  2025-01-03  not purged      0 page(s)  c  https://c.com") and lines[5] == "      cancelled by operator" and len(lines) == 10
    assert [r["line"] for r in reports.failure_lines(df.limit(0), "x").collect()] == ["No failure post-mortems in x"]
    shown = reports.reject_samples(spark.createDataFrame([(1, "https://me:pw@a.com/x?token=1#y", "got\ntoken: abc", "request_failed")], "seq long, url string, detail string, reason string")).first()
    assert (shown["url"], shown["detail"]) == ("https://a.com/x", "got token: [redacted]")


def test_robots(spark):
    body = "User-agent: Loom\nUser-agent: other\nDisallow: /a\nAllow: /a/b$\n\nUser-agent: *\nDisallow: /\nAllow: /*.html"
    files = spark.createDataFrame([("https://a.com", 200, body), ("https://b.com", 404, None), ("https://c.com", 500, None)], "origin string, status int, body string")
    pages = spark.createDataFrame([(f"https://{h}.com{p}", f"https://{h}.com") for h, p in (("a", "/a"), ("a", "/a/b"), ("a", "/a/b/c"), ("a", "/a/x.html"), ("a", "/z"), ("b", "/a"), ("c", "/z"), ("d", "/z"))], "url string, origin string")
    got = {r["url"]: r["robots_allowed"] for r in readers.robots_gate(pages, files, "Loom").collect()}
    assert list(got.values()) == [got[u] for u in got] and {u.split("//")[1]: v for u, v in got.items()} == {"a.com/a": False, "a.com/a/b": True, "a.com/a/b/c": False, "a.com/a/x.html": True, "a.com/z": True, "b.com/a": True, "c.com/z": False, "d.com/z": False}


def test_records_and_writers(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/a.json").write_text('{"run_id": "a", "created_at_utc": "2025-01-01", "pages_saved": 3}')
    (tmp_path / "runs/b.json").write_text('{"run_id": "b", "created_at_utc": "2025-01-02"}')
    (tmp_path / "runs/c.json").write_text('{"run_id": ')
    records = readers.read_json_records(spark, str(tmp_path / "runs")).cache()
    assert {r["file"].rsplit("/")[-1]: r["state"] for r in records.collect()} == {"a.json": "ok", "b.json": "ok", "c.json": "unreadable"}
    assert [r["run_id"] for r in readers.newest_runs(records).collect()] == ["b", "a"]
    pages = spark.createDataFrame([("u", "<p>", [("x",)]), ("v", None, []), ("w", "", None)], "url string, content_html string, blocks array<struct<text:string>>")
    writers.write_cache(pages, str(tmp_path / "cache"))
    assert [r["url"] for r in readers.cached_pages(spark, str(tmp_path / "cache")).collect()] == ["u"]
    writers.write_csv(spark.createDataFrame([('a "b"', 1), (None, 2)], "t string, n int").coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part*")).read_text()
    assert text.splitlines()[0] == "t,n" and '"a \\"b\\"",1' in text
    sized = writers.size_admission(spark.createDataFrame([(1, "h" * 100, "c"), (2, "h", "c" * 2000), (3, None, None)], "page_id int, html string, content_html string"), 600)
    assert {r["page_id"]: (r["admission"], r["html"] is None) for r in sized.collect()} == {1: ("without_html", True), 2: ("refused", True), 3: ("whole", True)}
    rows = writers.batches(spark.createDataFrame([(1, k, 10) for k in range(7)], "g int, k int, s int"), "g", "k", F.col("s"), most=3, limit=50)
    assert [r["batch"] for r in rows.orderBy("k").collect()] == [1, 1, 1, 2, 2, 3, 4]
    kept = writers.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), "k")
    assert {tuple(r) for r in kept.collect()} == {(1, "a"), (2, "c")}
    links = spark.createDataFrame([("s", 1, "/a#x", "https://a.com"), ("s", 2, "https://a.com/b#y", "https://a.com/"), ("s", 3, "https://a.com/b", "https://a.com/"), ("s", 4, "https://www.a.com/c", "https://a.com/")], "site string, position int, href string, page_url string")
    assert [r["url"] for r in readers.harvested_links(links).collect()] == ["https://a.com/b"]
