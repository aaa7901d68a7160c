from __future__ import annotations

import html
import itertools
import random
import re

import numpy as np
import pytest

from sparkloom.llm import near_pages, residue, truncation

RNG = random.Random(9)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(3, 9))) for _ in range(3000)]


def prose(rng, n):
    out = []
    while len(out) < n:
        out += [rng.choice(VOCABULARY) for _ in range(rng.randrange(6, 14))]
        out[-1] += "."
    return out


def grams(markup):
    words = re.findall(r"[^\W_]+", html.unescape(re.sub(r"<[^>]*>", " ", markup)).lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


def test_near_pages_against_all_pairs(spark):
    rng = random.Random(10)
    rows = []
    for base in (prose(rng, 220) for _ in range(25)):
        for share in (0.0, 0.01, 0.02, 0.04, 0.08, 0.15):
            rows.append("<p>" + " ".join(edited(rng, base, share)) + "</p>")
    crowd = prose(rng, 200)  # a group of copies larger than a region may be
    rows += ["<p>" + " ".join(edited(rng, crowd, 0.005)) + "</p>" for _ in range(60)] + ["<p>" + " ".join(crowd) + "</p>"] * 10
    rows += ["", "<p>too few words</p>", None, "<b>&amp;</b> one two three four five"]
    pages = [(k, m, "x") for k, m in enumerate(rows)] + [(0, rows[0], "again"), (None, rows[0], "null")]
    accepted = [(k, 900 if k % 40 else 100) for k in range(len(rows))] + [(1, 900), (None, 900), (5, None)]
    df = spark.createDataFrame(pages, "page_id long, content_html string, digest string")
    ok = spark.createDataFrame(accepted, "page_id long, content_length long")
    sets = {k: grams(m) for k, m in enumerate(rows) if m is not None and k % 40 and grams(m)}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in near_pages.near_page_pairs(df, ok).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got) & want) >= 0.999 * len(want) and len(want) > 1500
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {r["page_id"]: r["class_id"] for r in near_pages.near_page_groups(df, ok).collect()} == {k: find(k) for k in sets}
    assert near_pages.near_page_pairs(df.limit(0), ok).count() == near_pages.near_page_groups(df, ok.limit(0)).count() == 0


def test_cut_near_copies_are_aligned(spark):
    rng = random.Random(11)
    texts = [" ".join(prose(rng, 120)) for _ in range(20)]
    cut = [t[: int(len(t) * 0.93)] for t in texts]
    cut = [c if c[-1].isalpha() else c[:-3] for c in cut]
    known = re.findall(r"[a-z]+", " ".join(texts))
    items = "Intro sentence here.\n" + "\n".join(f"- {' '.join(rng.sample(known, 3))}" for _ in range(30))
    rows = list(enumerate([*texts, *cut, items, items[: items.rfind(" ")], None, "", " \n"]))
    found = {r["doc_id"]: r for r in truncation.truncated(spark.createDataFrame([*rows, (None, "x"), (0, texts[0])], "doc_id long, text string")).collect()}
    assert [found[k]["is_truncated"] for k in range(20)] == [False] * 20
    assert all(found[20 + k]["aligned"] == 1 and found[20 + k]["is_truncated"] for k in range(20))
    assert not found[40]["is_truncated"] and found[41]["aligned"] == 1 and found[41]["is_truncated"] and set(found) == set(range(42))
    assert truncation.truncated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("share", [0.1, 0.3, 0.5, 0.6, 0.7, 0.75, 0.9])
def test_deep_cuts_are_aligned(spark, share):
    rng = random.Random(19)
    texts = [" ".join(prose(rng, 150)) for _ in range(12)]
    cut = []
    for k, t in enumerate(texts):
        at = int(len(t) * share)
        while not (t[at - 1].isalpha() and t[at].isalpha()):
            at += 1
        # Every other copy has a changed word, too.
        words = t[:at].split(" ")
        cut.append(" ".join([*words[:3], "changed", *words[4:]] if k % 2 and share >= 0.5 else words))
    whole = [t.rstrip(".") for t in texts]
    rows = list(enumerate([*texts, *cut, *whole]))
    found = {r["doc_id"]: r["aligned"] for r in truncation.truncated(spark.createDataFrame(rows, "doc_id long, text string")).where("word != ''").collect()}
    assert [found[12 + k] for k in range(12)] == [1] * 12
    assert all(found[24 + k] == 0 for k in range(12))


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_only_texts_of_pairs_are_shuffled(spark):
    rng = random.Random(20)
    texts = [" ".join(prose(rng, 4_000)) for _ in range(200)]
    cut = [" ".join(t.split(" ")[: 2_000 + k]).rstrip(".") for k, t in enumerate(texts[:3])]
    df = spark.createDataFrame(list(enumerate([*texts, *cut])), "doc_id long, text string").repartition(4).localCheckpoint()
    before = shuffled(spark)
    found = {r["doc_id"] for r in truncation.truncated(df).where("aligned = 1").collect()}
    assert found == {200, 201, 202} and shuffled(spark) - before < 0.25 * sum(map(len, texts))


def test_ids_are_sorted_out_without_loss(spark):
    docs = spark.range(-5_000, 5_000).selectExpr("id AS doc_id", "'x' AS text")
    wanted = docs.where("doc_id % 10 = 0").select("doc_id")
    got = truncation.perhaps_in(docs, wanted)
    kept = [r["doc_id"] for r in got.collect()]
    assert got.columns == docs.columns and len(kept) == len(set(kept)) < 1_050 and set(kept) >= set(range(-5_000, 5_000, 10))
    # With far too few bits all pass, none is lost or repeated.
    assert sorted(r["doc_id"] for r in truncation.perhaps_in(docs, wanted, 64).collect()) == list(range(-5_000, 5_000))
    assert truncation.perhaps_in(docs, wanted.limit(0)).count() == 0


@pytest.mark.parametrize(("short", "long", "want"), [
    ("a b c d e f g h i jk", "a b c d e f g h i jkl m n.", 1), ("a b c d e f g h i j", "a b c d e f g h i j k l.", 1), ("a b c d e f g h i j", "a b c d e f g h i j. K l.", 1), ("a b c d e f g h i j", "a b c d e f g h i j.", 0), ("a b c d e f g h i j", "a b c d e f g h i j.\nK", 0),
    ("a b c d e f g h i j", "a b c d e f g h i j", 0), ("a b c d e f g h i j [...]", "a b c d e f g h i j k", 1), ("a b c d e f g h i j", "q r s t u v w x y z j k", -1), ("a b", "a b c", -1), ("a b c d e f g h i j", "a b c d e f g h i j\nnext", 0),
])
def test_ends_early(short, long, want):
    assert truncation.ends_early(short, long) == want


@pytest.mark.parametrize(("text", "want"), [
    ("All is said.", 0), ("Said “so.”", 0), ("終わりです。", 0), ("Happy filing 🎉", 0), ("the rest [...]", 1), ("and so…", 1), ("goes on… Read more", 1), ("the (more)", 1), ("over a comma,", 1), ("broken �", 1), ("l'", 1),
    ("It ends. The next one sto", 2), ("x.\n- an item", 3), ("x.\n— The Team", 4), ("x.\nTotal | 3.50", 4), ("x.\nTags: a, b", 4), ("   ", 0),
])
def test_closing(text, want):
    assert truncation.closing(text)[0] == want


def test_closing_words_and_sources(spark):
    rng = random.Random(12)
    full = [" ".join(prose(rng, 60)) for _ in range(60)]
    known = re.findall(r"[a-z]+", " ".join(full))
    listed = [f"{t}\n- item {rng.choice(known)}\n- thing {rng.choice(known)}" for t in full[:30]]
    rows = [(k, t, "a") for k, t in enumerate([*full, *listed])] + [(500 + k, t[: 150 + k], "b") for k, t in enumerate(full[30:45])] + [(600, "値は自動で分類されます。多くの場合、請求書", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = truncation.truncated(df)
    flagged = {r["doc_id"] for r in found.where("is_truncated").collect()}
    assert flagged >= {600} | {500 + k for k in range(15) if full[30 + k][: 150 + k].rstrip()[-1].isalpha()} and not flagged & set(range(60))
    rates = {r["source"]: r for r in truncation.source_rates(df, found).collect()}
    assert rates["b"]["n_docs"] == 15 and rates[None]["share"] == 1.0 and rates["a"]["n_truncated"] == 0


@pytest.mark.parametrize(("text", "want"), [
    ("Dear {{ first_name }}, hello", 1), ("Hello %%NAME%%", 1), ("[Insert date here]", 1), ("The {% block x %} y", 1), ("for <AUTHOR>", 1), ("*|CITY|* now", 1), ("for @@CITY@@ only", 1), ("mail me@@home", 0), ("a [sic] b", 0), ("__NAME__", 1), ("{headline}", 1), ("50%% off", 0),
    ("Lorem ipsum dolor sit amet vestibulum lacinia", 2), ("asdf asdf test 12", 2), ("TODO: write copy", 2), ("Designers like lorem ipsum because nobody reads it at all, they say", 0), ("Sample heading", 2), ("A sample heading that is longer", 0),
    ("404 - Page not found.", 3), ("Please enable JavaScript to continue", 3), ("Bitte aktivieren Sie JavaScript, um fortzufahren.", 3), ("Return to the home page", 4), ("The ledger closes on Friday.", 0),
])
def test_residue_labels(text, want):
    assert residue.label(text, False) == want


def test_residue_pages(spark):
    real = "<p>" + " ".join(prose(random.Random(13), 60)) + "</p>"
    rows = [
        (1, f"<h1>T</h1>{real}", None), (2, f"<h1>T</h1>{real}<p>Dear {{{{ name }}}}, hi</p>", None), (3, f"<h1>Merge fields</h1>{real}<pre>Dear {{{{ name }}}}</pre><p>Use <code>${{x}}</code> here</p>", None),
        (4, "<h1>Oops</h1><p>Internal server error.</p><p>Return to the home page</p>", "x"), (5, f"<p>The page said access denied once.</p>{real}", "HTTP 403"), (6, None, "fetch of [your date] gave up"), (7, None, "HTTP 503"), (8, "", None), (9, None, None),
        (10, "<p>We noticed: PAGE not FOUND!</p>", None), (2, f"<h1>T</h1>{real}<p>Dear {{{{ name }}}}, hi</p>", None), (None, "<p>Page not found</p>", None), (11, f"{real}<p>TODO write copy for the section on quarterly ledgers and receipts</p>", None),
        (12, "<p>your usual assistant could not find that so please try the other address again later today</p>", None), (13, "<p>Your usual assistant could not find that; so please try the other address again later, today</p>", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, content_html string, failure_reason string")
    got = {r["page_id"]: r["is_residue"] for r in residue.residue_pages(df).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: False, 9: False, 10: True, 11: True, 12: True, 13: True}
    assert {r["page_id"] for r in residue.without_residue(df).collect()} == {None, 1, 3, 5, 7, 8, 9}
    assert residue.residue_pages(df.limit(0)).count() == 0


def test_labels_spread_to_near_copies(spark):
    base = prose(random.Random(14), 200)
    other = [*base[:-1], "different"]
    rows = [(b"a" * 16, residue.NOTICE, residue.masked(" ".join(base))), (b"b" * 16, residue.NONE, residue.masked(" ".join(other))), (b"c" * 16, residue.NONE, "something else entirely that is not alike")]
    got = {bytes(r["digest"]): r["label"] for r in residue.spread_labels(spark.createDataFrame(rows, "digest binary, label int, plain string")).collect()}
    near = bin(int(residue.simhash([residue.masked(" ".join(base)).split()])[0]) ^ int(residue.simhash([residue.masked(" ".join(other)).split()])[0])).count("1")
    assert near <= 3 and got == {b"a" * 16: residue.NOTICE, b"b" * 16: residue.NOTICE}


def test_templates_are_found_by_their_components(spark, monkeypatch):
    rng = random.Random(18)
    real = lambda: f"<p>{' '.join(prose(rng, 100))}</p>"
    say = "<h1>{}</h1><p>The {} desk has closed this drawer until the morning of another day.</p>"
    foot = "<p>Every reader of the {} circle gets the printed catalogue on Tuesdays for free</p>"
    things = ["copper", "walnut", "linen", "marble", "amber", "cedar"]
    # The same unknown notice with another word each time: twice as a failed request, else as if all was well.
    rows = [(k, say.format(" ".join(prose(rng, 3)), x), 503 if k < 2 else 200) for k, x in enumerate(things)]
    # A line of long pages is no notice, though two failed requests returned nothing else.
    rows += [(20 + k, real() + foot.format(x), 200) for k, x in enumerate(things)] + [(30 + k, foot.format(x), 404) for k, x in enumerate(things[:2])]
    # One failed page alone is no evidence, nor are two short pages that did not fail.
    rows += [(40, "<p>Sorry for the wait, our shelves are being filled by hand this week.</p>", 503), (50, "<p>A short poem about seven quiet lamps and one loud kettle</p>", 200), (51, "<p>A short poem about seven quiet lamps and one loud teapot</p>", 200)]
    df = spark.createDataFrame([(k, c, s, None) for k, c, s in rows], "page_id long, content_html string, status_code int, failure_reason string")
    found = lambda: {r["page_id"] for r in residue.residue_pages(df).where("is_residue").collect()}
    assert found() == set(range(6))
    # Without components none of them is found: no pattern knows them.
    monkeypatch.setattr(residue, "spread_labels", lambda rows, *more: rows.where(f"label != {residue.NONE}").select("digest", "label"))
    assert found() == set()


def test_a_known_notice_names_its_template(spark):
    say = "The {} desk could not find that paper in any of its many drawers today."
    rows = [(0, f"<p>{say.format('copper')}</p>", None)] + [(k, f"<p>{say.format(x).replace('could not find that', 'was unable to see your')}</p>", None) for k, x in ((1, "walnut"), (2, "linen"))]
    # This one differs from the first in one word and from the pattern in it.
    rows += [(3, f"<p>{say.format('copper').replace('find that', 'find their')}</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, content_html string, failure_reason string")
    got = {r["page_id"]: r["is_residue"] for r in residue.residue_pages(df).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True}


def test_tables_find_all_within_three_bits(spark):
    rng = np.random.Generator(np.random.PCG64(15))
    a = rng.integers(0, 1 << 63, 200, dtype=np.int64)
    b = a.copy()
    for k in range(200):
        for bit in rng.choice(64, 3, replace=False):
            b[k] ^= np.int64(-(1 << 63)) if bit == 63 else np.int64(1 << int(bit))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    rows = df.select(residue.table_keys(df["a"]).alias("x"), residue.table_keys(df["b"]).alias("y")).collect()
    assert all(set(r["x"]) & set(r["y"]) for r in rows)


def test_labels_spread_to_short_texts_with_a_changed_word(spark):
    rng, rows, want = random.Random(16), [], 0
    for k in range(60):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randrange(28, 60))]
        other = [*base[:-1], "different"] if k % 2 else ["different", "words", *base]
        rows += [(bytes([k, 0]), residue.NOTICE, " ".join(base)), (bytes([k, 1]), residue.NONE, " ".join(other))]
        want += 1
    rows += [(b"s1", residue.NOTICE, "four words and no"), (b"s2", residue.NONE, "four words and more"), (b"e", residue.NONE, "")]
    got = {bytes(r["digest"]) for r in residue.spread_labels(spark.createDataFrame(rows, "digest binary, label int, plain string")).where(f"label = {residue.NOTICE}").collect()}
    assert sum(bytes([k, 1]) in got for k in range(60)) == want and not got & {b"s2", b"e"}


def test_crowded_family_of_loose_copies(spark):
    rng = np.random.Generator(np.random.PCG64(17))
    # Many pages of one family, any two at a similarity of about 0.6 to 0.7: all regions are crowded.
    core = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    sets = [np.concatenate([core[rng.random(500) < 0.79], rng.integers(0, 1 << 63, 10, dtype=np.uint64)]) for _ in range(400)]
    signature = near_pages.MinHash(near_pages.HASHES)(sets)
    order = np.array([near_pages.positions(t) for t in range(near_pages.TREES)])
    a, b = near_pages.bit_words(signature)
    rows = list(zip(range(len(sets)), near_pages.prefixes(signature, order).to_pylist(), a.tolist(), b.tolist()))
    df = spark.createDataFrame(rows, "page_id long, prefix array<array<int>>, bits_a long, bits_b long")
    got = {tuple(r) for r in near_pages.forest_candidates(df, 0.6).collect()}
    held = [set(x.tolist()) for x in sets]
    want = {(x, y) for x, y in itertools.combinations(range(len(sets)), 2) if len(held[x] & held[y]) >= 0.6 * len(held[x] | held[y])}
    assert len(want) > 20_000 and len(got & want) >= 0.99 * len(want)
