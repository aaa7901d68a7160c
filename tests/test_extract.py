from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import classify, extract

PAD = "<p>" + "Padding text that makes the page long enough to read. " * 2 + "</p>"


def blocks(markup: str) -> list[tuple]:
    return [(b["kind"], b["text"] if b["cells"] is None else b["cells"]) for b in extract.clean(markup + " " * 40, "https://a.com/b/c")["blocks"]]


def test_blocks_and_inline_text():
    assert blocks("<main><h2>A<br>b</h2><p>one<p>two <i>x</i> <ul><li>a<ul><li>b</ul>c<li>d</ul></main>") == [("heading", "A b"), ("paragraph", "one"), ("paragraph", "two x"), ("listItem", "ac"), ("listItem", "b"), ("listItem", "d")]
    assert blocks("<main>loose <b>text</b><div>more</div><p>p</p>tail</main>") == [("paragraph", "loose textmore"), ("paragraph", "p"), ("paragraph", "tail")]
    assert blocks("<main><dl><dt>t<dd>d</dl><pre>x  y</pre><blockquote>q<p>in</p></blockquote></main>") == [("term", "t"), ("definition", "d"), ("code", "x y"), ("quote", "q"), ("paragraph", "in")]


def test_tables():
    out = extract.clean("<main><table><tr><th>A<th>B<tr><td>1<td><p>x</p><p>y</p><tr><td></td></tr></table></main>" + " " * 40, "https://a.com")
    assert [(b["header"], b["cells"]) for b in out["blocks"]] == [(True, ["A", "B"]), (False, ["1", "x y"])]
    assert out["content_html"] == "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>x y</td></tr></table>"


def test_anchors():
    out = extract.clean('<main><p>see <a href="../x#f">the <b>x</b></a>, <a href="mailto:a@b">mail</a> &amp; <a href="#t">top</a></p><a href="/card"><h3>Card</h3>text</a></main>', "https://a.com/b/c")
    assert out["blocks"][0]["anchors"] == [{"label": "the x", "href": "https://a.com/x"}]
    assert out["blocks"][0]["html"] == 'see <a href="https://a.com/x">the x</a>, mail &amp; top'
    assert [b["kind"] for b in out["blocks"]] == ["paragraph", "paragraph", "heading"] and out["blocks"][1]["anchors"][0]["href"] == "https://a.com/card"


def test_pruning():
    page = f'<body><header><nav>n</nav>h</header><header><p>kept</p></header><nav>x</nav><div role="banner">y</div><p class="sr-only">z</p><aside>s</aside><script>c()</script>{PAD}<footer>f</footer></body>'
    assert blocks(page) == [("paragraph", "kept"), ("paragraph", PAD[3:-4].strip())]
    twin = '<body><p>alpha beta gamma delta</p> <div class="hidden md:block"><p>alpha beta gamma delta</p></div> <div class="d-none d-md-block"><p>only here now</p></div></body>'
    assert blocks(twin) == [("paragraph", "alpha beta gamma delta"), ("paragraph", "only here now")]
    assert blocks('<body><p>text</p><div class="grid"><a class="card--default">card</a></div></body>') == [("paragraph", "text")]


def test_root_title_excerpt_and_dedup():
    out = extract.clean(f'<head><title>T</title><meta property="og:title" content="OG"><meta name="description" content=" D "><link rel="next canonical" href="/c"></head><main> </main><article>{PAD}{PAD}<p>short</p><p>short</p></article>', "https://a.com")
    assert (out["content_root"], out["title"], out["excerpt"], out["canonical_href"]) == ("article", "OG", "D", "/c")
    assert [b["text"] for b in out["blocks"]] == [PAD[3:-4].strip(), "short", "short"]


def test_limits_and_failures():
    assert extract.clean(None, None)["blocks"] == [] and extract.clean("<p>x", None)["text"] is None
    kept, markup, cut = extract.serialise([extract._block("paragraph", text="x" * 500, html="x" * 500, anchors=[])], cap=200)
    assert cut and len(markup) <= 200 and kept[0]["text"] == "x" * 136
    long = [extract._block("paragraph", text=f"t{k}", html=f"t{k}", anchors=[]) for k in range(50)]
    kept, markup, cut = extract.serialise(long, cap=100)
    assert cut and len(markup) < 100 and 0 < len(kept) < 50
    assert extract.clean("<div>" * 5000 + "deep text that is here" + "</div>" * 5000, "https://a.com")["text"] == "deep text that is here"


def test_links_and_udf(spark):
    assert extract.links('<a href="/a#x">1</a><a href="/a">2</a><a href="#y">3</a><a href="javascript:x">4</a><a>5</a><a href="ftp://b/">6</a>', "https://a.com/q") == ["https://a.com/a"]
    df = spark.createDataFrame([(1, f"<main><h1>H</h1>{PAD}</main>", "https://a.com"), (2, None, None), (3, "", "bad")], "id int, h string, u string")
    rows = {r["id"]: r["c"] for r in df.select("id", extract.extract_clean(F.col("h"), F.col("u")).alias("c")).collect()}
    assert rows[1]["title"] == "H" and len(rows[1]["blocks"]) == 2 and rows[2]["blocks"] == [] and rows[3]["text"] is None
    paths = df.where("id = 1").select(F.explode(extract.heading_paths(extract.extract_clean(F.col("h"), F.col("u"))["blocks"])).alias("p")).collect()
    assert [r["p"] for r in paths] == [["H"], ["H"]]


def test_viability(spark):
    rows = [(None, 0, False, "body_too_small"), ("x" * 600, 90, False, None), ("Just a moment..." + "x" * 600, 90, False, "challenge_page"), ("x" * 600, 10, True, "empty_or_spa_shell"), ("x" * 600, 0, False, "empty_or_spa_shell"), ("x" * 600, 10, False, "insufficient_text")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, h string, n int, m boolean, w string").orderBy("k")
    assert all(a == b for a, b in df.select(classify.viability(F.col("h"), F.col("n"), F.col("m")), "w").collect())
