from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import main_body, packing, tokens

VOCABULARY = tokens.default_vocabulary()
encode = tokens.encoder(VOCABULARY).encode_ordinary


def test_corpus_equals_each_text_by_itself(spark):
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefghijé日本 ") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(6)]
    texts = [*base, *base, *(b[100:] + "!" + o[:900] for b, o in itertools.pairwise(base)), None, "", " ", "x" * 5000, "日本語" * 800, "a\r\n\t b  " * 300, "word " * 20_000, "<|endoftext|> it's", "​ 👩‍👩‍👧 שלום " * 60]
    rows = [(k, t, "z") for k, t in enumerate(texts)] + [(None, base[0], "z"), (0, base[0], "z")]
    got = [(r["doc_id"], list(r["ids"])) for r in tokens.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, digest string")).collect()]
    want = [(k, encode(t) if t else []) for k, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(spark.createDataFrame(rows[:-2], "doc_id long, text string, digest string")).collect()}
    assert counts == {k: len(i) for k, i in want[:-2]}
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_reused_parts_are_spliced_exactly():
    rng = random.Random(17)
    used = 0
    for _ in range(60):
        text = "".join(rng.choice(["the ", "a", "  ", "\n", "'s ", "émile ", "12", "—", "word.", " x"]) for _ in range(rng.randrange(5, 300)))
        data = text.encode()
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(4))})
        cuts = [c for c in cuts if c == len(data) or data[c] & 0xC0 != 0x80]
        parts = [(a, tokens.encode_chunk(data[a:b], encode)) for a, b in itertools.pairwise(cuts)]
        shared = [(a, p) for a, p in parts if p is not None and rng.random() < 0.8]
        used += len(shared)
        assert tokens.assemble(data, shared, encode) == encode(text)
    assert used > 60
    wrong = tokens.encode_chunk(b"one two three four five six", encode)._replace(head_ids=1, ids=[1, 2, 3, 4], tail_ids=1)
    assert tokens.assemble(b"one two three four five six", [(0, wrong)], encode) == encode("one two three four five six")


def test_chunks_are_content_defined():
    rng = random.Random(18)
    text = bytes(rng.randrange(97, 123) for _ in range(60_000))
    cut = lambda t: {t[a:b] for _, a, b in tokens.chunks([t])}
    assert len(cut(text) - cut(text[:30_000] + b"inserted" + text[30_000:])) <= 3
    assert b"".join(text[a:b] for _, a, b in tokens.chunks([text])) == text
    both = ["é日" * 3000, "", "abc"]
    for k, a, b in tokens.chunks([t.encode() for t in both]):
        both[k].encode()[a:b].decode()


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25), st.integers(60, 64))
@settings(max_examples=120, deadline=None)
def test_plans_use_every_item_once(sizes, capacity):
    plan = packing.plan_containers(sizes, capacity)
    used = Counter()
    for content, copies in plan:
        assert copies > 0 and 0 < sum(content) <= capacity
        for size in content:
            used[size] += copies
    assert used == Counter(sizes)
    total, bins = sum(s * n for s, n in sizes.items()), sum(c for _, c in plan)
    assert bins <= max(1, 2 * total / capacity + 1)


def test_complements_fill_exactly():
    assert sorted(sum(c) for c, n in packing.plan_containers({6: 3, 4: 3, 5: 2, 3: 4, 2: 2}, 10) for _ in range(n)).count(10) >= 5
    assert packing.plan_containers({7: 1, 2: 1, 1: 1}, 10) == [((7, 1, 2), 1)] or sum(sum(c) for c, _ in packing.plan_containers({7: 1, 2: 1, 1: 1}, 10)) == 10
    rng = np.random.Generator(np.random.PCG64(19))
    sizes = Counter(np.clip(rng.lognormal(5.3, 0.8, 20_000).astype(int), 1, 2048).tolist())
    plan = packing.plan_containers(sizes, 2048)
    assert sum(s * n for s, n in sizes.items()) / (2048 * sum(c for _, c in plan)) > 0.995 and len(plan) < 6000
    assert packing.plan_containers({}, 10) == []


def test_packing(spark):
    rng = random.Random(20)
    rows = [(k, rng.choice([3, 3, 3, 3, rng.randrange(1, 25)])) for k in range(400)] + [(500, 0), (501, None), (None, 5), (1, rng.randrange(1, 9))]
    limits = spark.createDataFrame([("small", "tokens", 10), ("large", "tokens", 64), ("c", "chars", 5), ("n", "tokens", None)], "limit_name string, unit string, max_size long")
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), limits).collect()
    for name, capacity in (("small", 10), ("large", 64)):
        mine = [r for r in packed if r["limit_name"] == name]
        fill, whole = Counter(), Counter()
        for r in mine:
            fill[r["container"]] += r["n_tokens"]
            whole[r["doc_id"]] += r["n_tokens"]
            assert r["capacity"] == capacity
        want = Counter()
        for k, n in rows:
            if k is not None and n:
                want[k] += n
        assert whole == want and max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        assert all(r["piece_no"] == 0 or dict(rows)[r["doc_id"]] > capacity for r in mine)
    counted = packing.containers(packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), limits)).collect()
    assert all(r["fill"] == sum(i["n_tokens"] for i in r["items"]) and r["n_items"] == len(r["items"]) for r in counted)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), limits).count() == 0
    assert packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), limits.where("unit = 'chars'")).count() == 0


def stream_of(lines):
    """``lines``: (content, tokens)."""
    columns = [[k for k in range(len(lines))], [c for c, _ in lines], [t for _, t in lines], [[] for _ in lines]]
    return main_body.Stream(pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["key", "content", "tokens", "gaps"]))


def test_repeated_runs_against_brute_force():
    rng, run = np.random.Generator(np.random.PCG64(21)), main_body.RUN
    for _ in range(20):
        lines = [(int(rng.integers(0, 9)), rng.integers(0, 2, rng.integers(0, 30)).tolist()) for _ in range(60)]
        # Short lines count as wholes by their key, which is their own here.
        found: dict[tuple, set] = {}
        for content, t in lines:
            for i in range(len(t) - run + 1):
                found.setdefault(tuple(t[i : i + run]), set()).add(content)
        want = set()
        for k, (_, t) in enumerate(lines):
            mark = np.zeros(len(t), dtype=bool)
            for i in range(len(t) - run + 1):
                if len(found[tuple(t[i : i + run])]) >= 3:
                    mark[i : i + run] = True
            if len(t) and mark.mean() >= main_body.COVERED:
                want.add(k)
        stream = stream_of(lines)
        assert set(stream.covered(main_body.often(stream.names, stream.contents, 3)[0]).tolist()) == want


def test_long_repeats_are_unions_of_runs():
    # A sentence with another word on each page: its repeated parts cover it, the ordinary lines stay.
    rng = random.Random(4)
    part = list(range(100, 130))
    lines = [(c, [*part[:14], 1000 + c, *part[14:]]) for c in range(5)] + [(c, [rng.randrange(10**6) for _ in range(20)]) for c in range(5)]
    stream = stream_of(lines)
    assert stream.covered(main_body.often(stream.names, stream.contents, 3)[0]).tolist() == [0, 1, 2, 3, 4]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n)) + "."


def page(rng, brand, number, upper=False):
    body = [f"<h1>{words(rng, 6)}</h1>", f"<p>By {words(rng, 1)[:-1].title()} {words(rng, 1)[:-1].title()}, 2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)}</p>", f"<p>{words(rng, 30)}</p>", f"<p>{words(rng, 12)}", words(rng, 12), "</p>", f"<p>Share this page with the readers of {brand}: {number} times</p>", f"<ul><li>{words(rng, 9)}</li>", "</ul>", "<div>", "<p>Advertisement</p>", "</div>"]
    side = ["<h3>More to read here</h3>", *(f'<p><a href="/x">{words(rng, 5)}</a></p>' for _ in range(3))]
    lines = ["<html><head>", f"<title>{words(rng, 4)} | {brand}</title>", "<script>var text = 1;", "</script></head>", "<body>", "<nav>", '<a href="/">Home</a> | <a href="/a">About us</a>', "</nav>", '<div class="c1">', *body, "</div>", '<div class="c2">', *side, "</div>", "<footer>", f"<p>{brand} is a company registered in Emberwick under number {number}.</p>", "</footer>", "</body></html>"]
    want = {k + 1 for k, line in enumerate(lines) if line in (body[0], body[2], body[3], body[4], body[7])}
    text = "\n".join(lines)
    return (text.replace("<p>", "<P>").replace("<div", "<DIV").replace("<h1", "<H1") if upper else text), want


def test_main_body(spark):
    rng = random.Random(22)
    rows, want = [], {}
    for host in range(14):
        for _ in range(30 if host == 0 else 6):
            text, lines = page(rng, f"Brand{chr(97 + host)}", rng.randrange(999), host == 3)
            want[len(rows)] = lines
            rows.append((len(rows), f"https://h{host}.example", text, "x"))
    rows += [(0, "https://WWW.h0.example/", rows[0][2], "again"), (900, "https://h1.example", None, "x"), (901, "https://h1.example", "", "x"), (None, "https://h1.example", rows[0][2], "x"), (902, None, "<p>alone", "x"), (903, "https://h2.example", "<div class='c1'>\n<p>No heading here, only words.</p>\n</div>", "x")]
    want |= {902: {1}, 903: {2}}
    df = spark.createDataFrame(rows, "page_id long, origin string, html string, host string")
    got: dict[int, set] = {}
    for r in main_body.main_body_lines(df).collect():
        got.setdefault(r["page_id"], set()).add(r["line_no"])
    assert got == want
    text = {r["page_id"]: r for r in main_body.main_body(df).collect()}
    assert text[903]["text"] == "No heading here, only words." and text[901]["n_lines"] == 0 and None not in text
    assert main_body.main_body_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize(("markup", "want"), [
    ("<p>a</p>\n<p>b\nc</p>", [[1], [2, 3]]), ("<tr><td>a</td><td>b</td></tr>", [[1]]), ("<script>\nx\n</script>\n<p>a<!-- \n --></p>b", [[4], [5]]), ("a <b>b</b>\nc", [[1, 2]]), ("<pre>x\n\ny</pre>", [[1, 3]]), ("", []), ("<p", [[1]]),
])
def test_units(markup, want):
    assert [u.lines for u in main_body.units_of(markup)[0]] == want


def test_blocks_do_not_change_the_result_and_the_suffix_array_decides(spark, monkeypatch):
    rng, rows, want = random.Random(31), [], {}
    notice = "Every price on this page is given without warranty by the {} office and its owner may change any of them at any hour of the day, says {}"
    for k in range(90):
        lines = ["<html><head>", f"<title>{words(rng, 4)}</title></head><body><div>", f"<h1>{words(rng, 5)}</h1>", f"<p>{words(rng, 20)}</p>", f"<p>{notice.format(words(rng, 1)[:-1], words(rng, 1)[:-1])}</p>", f"<p>{words(rng, 9)}</p>", "</div></body></html>"]
        if k % 3:
            del lines[4]
        want[k] = {3, 4, 5 if k % 3 else 6}
        rows.append((k, "https://one.example", "\n".join(lines)))
    df = spark.createDataFrame(rows, "page_id long, origin string, html string")

    def run(**size):
        got: dict[int, set] = {}
        for r in main_body.main_body_lines(df, **size).collect():
            got.setdefault(r["page_id"], set()).add(r["line_no"])
        return got

    assert run() == run(block=40) == run(block=7) == want
    # Without the suffix array the notices stay: no two of them are the same line.
    monkeypatch.setattr(main_body, "covered_lines", lambda units, hosts, block: units.select("host", "key").limit(0))
    assert run() == {k: v if k % 3 else {3, 4, 5, 6} for k, v in want.items()}


def test_copies_count_once_and_headings_and_code_stay(spark):
    rng, rows = random.Random(23), []
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(900)]
    said = lambda: " ".join(rng.choice(words) for _ in range(14))
    story = [said() for _ in range(3)]
    for host in range(7):
        for k in range(9):
            copy = k < 3  # a third of all pages are one story
            lines = story if copy else ["pip install engine", "one footer for everyone", said()]
            title = "Copied story" if copy else f"Page {words[host * 9 + k]}"
            first = "<pre>{}</pre>" if not copy else "<p>{}</p>"
            body = "\n".join([first.format(lines[0]), *(f"<p>{x}</p>" for x in lines[1:])])
            rows.append((len(rows), f"https://h{host}.example", f"<title>{title} | Brand{words[800 + host]}</title>\n<div>\n<h1>{'Story' if copy else 'Overview'}</h1>\n{body}\n</div>"))
    got: dict[int, set] = {k: set() for k in range(len(rows))}
    for r in main_body.main_body_lines(spark.createDataFrame(rows, "page_id long, origin string, html string")).collect():
        got[r["page_id"]].add(r["line_no"])
    assert all(got[k] == ({3, 4, 5, 6} if k % 9 < 3 else {3, 4, 6}) for k in got), got
