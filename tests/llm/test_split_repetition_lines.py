from __future__ import annotations

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import repetition, site_lines, split
from sparkloom.llm.common import host_of
from sparkloom.llm.queries import p2_found

BLOCKS = "array<struct<text:string,cells:array<string>>>"


def pages_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"page_id long, origin string, blocks {BLOCKS}{extra}")


@given(st.text(alphabet="ab .!?\n。x", max_size=600), st.integers(2, 80), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text_within_the_limit(text, size, overlap):
    pieces = split.split_text(text, size, overlap)
    assert all(0 < e - s <= size or not text for s, e, _ in pieces)
    body = "".join(text[s + o : e] for s, e, o in pieces)
    assert body == text and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(o <= overlap and s + o == before[1] for (s, _, o), before in zip(pieces[1:], pieces))


def test_cuts_are_natural_and_local():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    text = " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(6000))
    cuts = split.cut_points(text, 800)
    assert all(text[c - 1].isspace() or text[c - 1] in ".!?" for c in cuts[:-1])
    edited = text[:9000] + "an inserted sentence. " + text[9000:]
    moved = {c if c <= 9000 else c - 22 for c in split.cut_points(edited, 800)}
    assert len(set(cuts) - moved) <= 4
    blocks = list(range(500, 6000, 500))
    assert set(split.cut_points("x" * 6000, 900, blocks)[:-1]) <= set(blocks)
    assert split.cut_points("y" * 10_000, 100)[-1] == 10_000 and split.cut_points("", 10) == [0]


def test_oversized_and_pieces(spark):
    limits = spark.createDataFrame([("s", "chars", 50, 10), ("t", "tokens", 1, 0), ("n", "chars", None, 0), (None, "chars", 5, 0)], "limit_name string, unit string, max_size long, overlap_size long")
    long = "word " * 30
    rows = [(1, "o", [(long, None), (None, ["a", None, "b"])], 7), (1, "o", [(long, None), (None, ["a", None, "b"])], 7), (2, "o", [("short", None)], 7), (3, "o", None, 7), (4, "o", [], 7), (None, "o", [(long, None)], 7), (5, "o", [("x" * 25, None), ("y" * 25, None)], 7)]
    df = pages_of(spark, rows, ", max_size int")
    assert {tuple(r) for r in split.oversized(df, limits).collect()} == {("s", 1, -1), ("s", 1, 0), ("s", 5, -1)}
    pieces = split.split_oversized(df, limits).orderBy("page_id", "piece_no").collect()
    one = [r for r in pieces if r["page_id"] == 1]
    assert "".join(r["piece"][r["overlap"] :] for r in one) == long + "\na b" and max(len(r["piece"]) for r in pieces) <= 50 and len({r["page_id"] for r in pieces}) == 2
    assert [r["piece"][r["overlap"] :] for r in pieces if r["page_id"] == 5] == ["x" * 25 + "\n", "y" * 25]
    assert split.oversized(df.limit(0), limits).count() == split.split_oversized(df, limits.limit(0)).count() == 0


def brute_repeats(text):
    words = re.findall(r"[^\W_]+", text.lower())
    marked, seen = set(), set()
    for k in range(len(words) - 4):
        gram = tuple(words[k : k + 5])
        if gram in seen:
            marked |= set(range(k, k + 5))
        seen.add(gram)
    return len(words), len(marked)


def test_repetition_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, "o", [(" ".join(rng.choice("abc") for _ in range(rng.randrange(40))), None) for _ in range(3)]) for k in range(80)]
    rows += [(200, "o", []), (201, "o", None), (202, "o", [("", None), (None, None)]), (203, "o", [("Über_x ² " * 500, None)]), (None, "o", []), (0, "o", rows[0][2])]
    got = {r["page_id"]: (r["n_words"], r["repeated_words"]) for r in repetition.repetition_profile(pages_of(spark, rows)).collect()}
    want = {k: brute_repeats("\n".join(t or "" for t, _ in b)) for k, _, b in rows if b is not None and k is not None}
    assert got == want
    found = {r["page_id"] for r in repetition.repetitive(pages_of(spark, rows)).where("confirmed").collect()}
    assert found == {k for k, (n, m) in want.items() if n and m / n >= 0.3}
    assert repetition.repetitive(pages_of(spark, rows).limit(0)).count() == 0


def test_cutoffs_decide_which_pages_are_rejected(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    fresh = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, "o", [(fresh(100), None)]) for k in range(900)]
    for k in range(900, 960):
        again = fresh(30)
        rows.append((k, "o", [(f"{again} {fresh(60)} {again}" if k < 930 else f"{again} {fresh(20)} {again}", None)]))
    df = pages_of(spark, rows)
    found = {r["page_id"]: r for r in repetition.repetitive(df, alpha=0.05).collect()}
    assert {k for k, r in found.items() if r["confirmed"]} == set(range(930, 960))
    # The cutoff was selected, is above none of them, and keeps the rate of rejected good pages within the bound.
    assert all(0 < r["cutoff"] < 0.3 for r in found.values()) and sum(not r["confirmed"] for r in found.values()) <= 0.05 * 930
    few = {r["page_id"] for r in repetition.repetitive(df, holdout=20).where("confirmed").collect()}
    assert few == set(range(930, 960))
    monkeypatch.setattr(repetition, "select_cutoffs", lambda *a, **k: {"short": 0.9, "medium": 0.9, "long": 0.9})
    assert repetition.repetitive(df).count() == 0


def test_cutoffs_come_from_all_pages(spark, monkeypatch):
    df = spark.range(20_050).selectExpr("id AS page_id", "'o' AS origin", f"CAST(array(struct(concat('page ', id) AS text, null AS cells)) AS {BLOCKS}) AS blocks")
    labelled, select = [], repetition.select_cutoffs
    monkeypatch.setattr(repetition, "select_cutoffs", lambda holdout, **k: labelled.append(holdout.count()) or select(holdout, **k))
    assert repetition.repetitive(df).count() == 0 and labelled == [20_050]


def test_pages_under_a_cutoff_are_found(spark, tmp_path):
    rng = random.Random(10)
    fresh = lambda n: [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(2)) for _ in range(n)]
    rows = []
    for k in range(630):
        lines, again = fresh(10), " ".join(fresh(15))
        # Good pages repeat short lines but no run of words, and lift the cutoff over the score of the others.
        rows.append((k, "o", [(t, None) for t in (*lines, *reversed(lines))] if k < 600 else [(" ".join((again, *fresh(10), again)), None)]))
    df = pages_of(spark, rows)
    want = {k for k, _, b in rows for n, m in [brute_repeats("\n".join(t for t, _ in b))] if m / n >= 0.3}
    assert want == set(range(600, 630)) and repetition.repetitive(df).count() == 0
    df.write.parquet(str(tmp_path / "ingest_pages.parquet"))
    assert {r["page_id"] for r in p2_found(spark, str(tmp_path)).collect()} == want


def test_binomial_bound_of_many_trials():
    # Normal tail of the same error (3.0902 deviations at 0.001), and few enough terms for a whole corpus.
    n, k = 5_000_000, 100_000
    p = repetition.binomial_upper(k, n, 1e-3)
    assert (p * n - k) / math.sqrt(n * p * (1 - p)) == pytest.approx(3.0902, rel=2e-3)


@pytest.mark.parametrize(("k", "n", "error"), [(0, 10, 0.05), (3, 40, 0.01), (10, 10, 0.1), (0, 0, 0.1), (50, 4000, 1e-4)])
def test_binomial_bound(k, n, error):
    p = repetition.binomial_upper(k, n, error)
    if n and k < n:
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert tail == pytest.approx(error, rel=1e-3)
    else:
        assert p == 1.0


def test_cutoffs_control_the_risk(spark):
    rng = random.Random(7)
    rows = [("a", rng.random() ** 6, False) for _ in range(4000)] + [("a", 0.5 + rng.random() / 2, True) for _ in range(400)] + [("few", 0.1, False)] * 5 + [(None, None, True), (None, 0.2, None)]
    cutoffs = repetition.select_cutoffs(spark.createDataFrame(rows, "stratum string, score double, bad boolean"), alpha=0.05, default=0.9)
    over = sum(s >= cutoffs["a"] for g, s, b in rows if g == "a" and not b)
    assert over / 4000 <= 0.05 and 0.3 < cutoffs["a"] < 0.9 and cutoffs["few"] == 0.9


def test_hosts(spark):
    df = spark.createDataFrame([("HTTPS://www.A.com/",), ("http://a.com",), (" a.com ",), (None,), ("https://b.www.com:81/x?y",)], "o string")
    assert [r[0] for r in df.select(host_of(df["o"])).collect()] == ["a.com", "a.com", "a.com", None, "b.www.com:81"]


def test_site_lines_against_brute_force(spark):
    rng = random.Random(8)
    rows, k = [], 0
    for host, n in (("https://a.com", 60), ("HTTP://WWW.a.com/", 20), ("https://b.com", 12), ("https://c.com", 4), (None, 9)):
        for _ in range(n):
            lines = [f"unique line {k} {rng.random()} " + "".join(rng.choice("abcdefgh") for _ in range(12)), rng.choice(["Share this!", "share, THIS", "Copyright 2024 x", "Rare " + rng.choice("abcdefgh"), "123 …"])]
            lines += ["Everywhere: legal"] * (rng.random() < 0.5)
            rng.shuffle(lines)
            rows.append((k, host, [(t, None) for t in lines]))
            k += 1
    rows += [rows[0], (None, "https://a.com", [("Share this!", None)]), (900, "https://a.com", []), (901, "https://a.com", None)]
    pages, on, where = {}, {}, []
    for page, origin, blocks in rows:
        if page is None or origin is None or not blocks:
            continue
        host = re.sub(r"^www\.", "", origin.lower().split("//")[1].strip("/"))
        pages.setdefault(host, set()).add(page)
        for no, (text, _) in enumerate(blocks):
            key = "".join(c for c in text.lower() if c.isalpha())
            if key:
                on.setdefault((host, key), set()).add(page)
                where.append((host, key, page, no))
    repeated = {h for h, v in on.items() if len(v) >= 5 and len(v) >= len(pages[h[0]]) / 5}
    want = {(p, n) for h, key, p, n in where if (h, key) in repeated}
    df = pages_of(spark, rows)
    assert {tuple(r) for r in site_lines.repeated_blocks(df).collect()} == want and len(want) > 50
    clean = {r["page_id"]: r for r in site_lines.without_site_lines(df).collect()}
    assert clean[900]["text"] == "" and 901 not in clean
    for page, _, blocks in rows[:30]:
        assert clean[page]["text"] == "\n".join(t for n, (t, _) in enumerate(blocks) if (page, n) not in want)
    assert site_lines.repeated_blocks(df.limit(0)).count() == 0


def test_line_without_excess_is_not_removed(spark):
    rows, k = [], 0
    for host in range(6):
        for i in range(100):
            # One site has the phrase on a fifth of its pages, the others on nearly as many: no excess. Its own line is one.
            lines = [f"text {chr(97 + k % 26)}{'xyzuvw'[host]} " + "q" * (i % 50 + 1)]
            if i < (20 if host == 0 else 19):
                lines.append("See you next week")
            if host == 0 and i < 20:
                lines.append("Printed in Emberwick")
            rows.append((k, f"https://h{host}.example", [(t, None) for t in lines]))
            k += 1
    stats = site_lines.line_statistics(pages_of(spark, rows)).where("repeated").collect()
    assert len(stats) == 2
    got = {tuple(r) for r in site_lines.repeated_blocks(pages_of(spark, rows)).collect()}
    assert got == {(i, 2) for i in range(20)}


def test_ratio(spark):
    df = spark.createDataFrame([(10.0, 20.0, 5.0, 200.0), (1.0, 10.0, 20.0, 200.0), (5.0, 5.0, 0.0, 0.0)], "a double, b double, c double, d double")
    g = [r[0] for r in df.select(site_lines.llr(*(df[c] for c in "abcd"))).collect()]
    k1, n1, k2, n2 = 10, 20, 5, 200
    h = lambda k, n: k * math.log(k / n) + (n - k) * math.log((n - k) / n)
    assert g[0] == pytest.approx(2 * (h(k1, n1) + h(k2, n2) - h(k1 + k2, n1 + n2))) and g[1] == pytest.approx(0, abs=1e-9) and g[2] == 0
    p = [r[0] for r in df.select(site_lines.minus_log10_p(df["a"])).collect()]
    assert p[0] == pytest.approx(-math.log10(math.erfc(math.sqrt(10.0 / 2))), rel=0.02)


def test_pages_without_blocks_are_cut_by_their_markup(spark):
    markup = "<head><title>no text</title></head><h1>Head</h1><p>" + "one two. " * 12 + "</p><script>x = 1</script><p>A &amp; <b>B</b></p>"
    schema = "page_id long, blocks array<struct<text:string,cells:array<string>>>, content_html string"
    df = spark.createDataFrame([(1, None, markup), (1, None, markup), (2, None, None), (3, [("z" * 60, None)], markup), (3, None, markup), (4, None, "<p>short</p>"), (None, None, markup)], schema)
    limits = spark.createDataFrame([("s", "chars", 50, 0)], "limit_name string, unit string, max_size long, overlap_size long")
    got = split.split_oversized(df, limits).orderBy("page_id", "piece_no").collect()
    assert {r["page_id"] for r in got} == {1, 3} and max(len(r["piece"]) for r in got) <= 50
    assert "".join(r["piece"] for r in got if r["page_id"] == 1) == "Head\n" + ("one two. " * 12).strip() + "\nA & B"
    assert "".join(r["piece"] for r in got if r["page_id"] == 3) == "z" * 60
