from __future__ import annotations

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import fingerprint as fp
from sparkloom.operators import dedup
from sparkloom.operators.components import connected_components


def test_simhash_by_hand():
    text = "One two three four five six"
    grams = ["one two three four five", "two three four five six"]
    votes = [0] * 64
    for g in grams:
        bits = int.from_bytes(hashlib.sha256(g.encode()).digest()[:8], "big")
        for k in range(64):
            votes[k] += 1 if bits >> (63 - k) & 1 else -1
    want = sum(1 << (63 - k) for k in range(64) if votes[k] >= 0)
    assert fp.simhash_of(text) & (1 << 64) - 1 == want
    assert fp.simhash_of("") == fp.simhash_of(None) == fp.simhash_of(" .,") == 0 and fp.simhash_of("one") != 0


def test_hashes_and_hex(spark):
    df = spark.createDataFrame([(1, "a  b\n"), (2, "a b"), (3, None), (4, "")], "k int, t string").orderBy("k")
    a, b, c, d = (r[0] for r in df.select(fp.content_hash(F.col("t"))).collect())
    assert a == b == hashlib.sha256(b"a b").hexdigest() and c == d == hashlib.sha256(b"").hexdigest()
    hexes = spark.createDataFrame([("0xFF",), ("ff",), (" 00000000000000FF ",), ("ffffffffffffffff",), ("xyz",), (None,)], "h string")
    assert [r[0] for r in hexes.select(fp.from_hex(F.col("h"))).collect()] == [255, 255, 255, -1, None, None]


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = [(k, (base[k % 12] ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5)))) - (1 << 63)) for k in range(120)]
    df = spark.createDataFrame([*prints, (None, 5), (999, None)], "id long, simhash long")
    for hamming in (0, 3, 7):
        want = {(a, b, bin((x ^ y) & (1 << 64) - 1).count("1")) for (a, x), (b, y) in itertools.combinations(prints, 2)}
        want = {t for t in want if t[2] <= hamming}
        assert {tuple(r) for r in fp.near_pairs(df, hamming).collect()} == want


def test_accept_near_against_sequence(spark):
    rng = random.Random(2)
    rows = []
    for k in range(150):
        center = rng.randrange(6)
        bits = hash(("c", center)) & (1 << 63) - 1
        for _ in range(rng.randrange(4)):
            bits ^= 1 << rng.randrange(62)
        rows.append((k, f"h{rng.randrange(120)}", bits, rng.choice([100, 900]), 900))
    state, want = {}, {}
    index = []
    for k, h, s, n, raw in rows:
        near = min(((bin(s ^ t).count("1"), j) for t, j in index), default=(65, 0))
        if h in state:
            want[k] = ("duplicate_content", state[h])
            continue
        state.setdefault(h, k)
        if n >= 500 and near[0] <= 3:
            want[k] = ("near_duplicate", near[1])
        else:
            want[k] = ("saved", None)
            if raw >= 500:
                index.append((s, k))
    got = {r["id"]: (r["outcome"], r["kept_id"]) for r in dedup.accept_near(spark.createDataFrame(rows, "id long, content_hash string, simhash long, length int, raw_length int")).collect()}
    # A content seen first in a rejected row counts as seen in both forms.
    assert got == want


def test_site_sequence(spark):
    big = 3 << 60
    rows = [
        ("s", 1, "u1", ["v1"], "h1", None, "c1", big, 900, 900), ("s", 2, "u1", None, "h2", None, "c2", None, 900, 900), ("s", 3, "v1", None, "h3", None, "c3", None, 900, 900), ("s", 4, "u4", None, "h1", None, "c4", None, 10, 10),
        ("s", 5, "u5", None, "h5", "u9", "c5", None, 10, 10), ("s", 6, "u6", None, "h6", "u9", "c6", None, 10, 10), ("s", 7, "u7", None, "h7", None, "c1", None, 900, 900), ("s", 8, "u8", None, "h8", None, "c8", big + 1, 900, 900),
        ("s", 9, "u4", None, "h9", None, "c9", 5, 900, 900), ("t", 1, "u1", None, "h1", None, "c1", big, 900, 900), (None, 1, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "site string, seq long, url_key string, alias_keys array<string>, html_hash string, canonical_key string, content_hash string, simhash long, length int, raw_length int")
    got = {(r["site"], r["seq"]): (r["outcome"], r["kept_seq"]) for r in dedup.dedup_site_pages(df).collect()}
    assert [got["s", k][0] for k in range(1, 10)] == ["saved", "duplicate_url", "duplicate_url", "duplicate_html", "saved", "canonical_alias", "duplicate_content", "near_duplicate", "saved"]
    assert got["s", 8] == ("near_duplicate", 1) and got["t", 1][0] == "saved" and got[None, 1][0] == "saved"
    counted = {r["site"]: r.asDict() for r in dedup.skip_counters(dedup.dedup_site_pages(df)).collect()}
    assert counted["s"]["n_skipped"] == 6 and counted["s"]["n_saved"] == 3


def test_aliases(spark):
    learned = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "a", "x"), (5, "a", "b"), (6, "p", "q"), (7, "q", "p"), (8, "e", "e"), (9, "", "z"), (10, None, "z")], "seq long, variant string, rep string")
    edges = dedup.last_aliases(learned)
    got = {r["key"]: r["resolved"] for r in dedup.resolve_aliases(spark.createDataFrame([(k,) for k in "abcdpqez"], "key string"), edges).collect()}
    assert got == {"a": "d", "b": "d", "c": "d", "d": "d", "p": "q", "q": "p", "e": "e", "z": "z"}
    chain = spark.createDataFrame([(k, f"n{k}", f"n{k + 1}") for k in range(30)], "seq long, variant string, rep string")
    assert dedup.resolve_aliases(spark.createDataFrame([("n0",)], "key string"), dedup.last_aliases(chain)).first()["resolved"] == "n16"


def test_first_wins_and_islands(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, None), (5, "y")], "id int, k string")
    assert {r["id"]: (r["first_of"], r["is_first"]) for r in dedup.first_wins(df, "k", "id").collect()} == {1: (1, True), 3: (1, False), 2: (2, True), 4: (4, True), 5: (5, True)}
    runs = spark.createDataFrame([(1, k, x) for k, x in enumerate("aabba")] + [(2, 0, None), (2, 1, None)], "g int, o int, x string")
    assert sorted((r["g"], r["first"], r["n"]) for r in dedup.islands(runs, "g", "o", "x").collect()) == [(1, 0, 2), (1, 2, 2), (1, 4, 1), (2, 0, 2)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2300)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame([*edges, (None, 1), (5, 5)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("hamming", "agree"), [(3, 1), (3, 2), (3, 3), (7, 2)])
def test_prints_within_the_distance_share_a_table(spark, hamming, agree):
    rng = random.Random(hamming * 10 + agree)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for _ in range(60):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), hamming):
            b ^= 1 << bit
        rows.append((signed(a), signed(b)))
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select(fp.bands(df["a"], hamming, agree).alias("x"), fp.bands(df["b"], hamming, agree).alias("y")).collect()
    assert all({tuple(x) for x in r["x"]} & {tuple(y) for y in r["y"]} for r in got)
    assert fp.blocks_that_agree(100, 3) == 1 and fp.blocks_that_agree(10**6, 3) == 2 and fp.blocks_that_agree(10**9, 3) == 3


def test_tables_of_prints_are_not_broadcast(spark, tmp_path):
    rng = random.Random(5)
    spark.createDataFrame([(k, rng.getrandbits(63)) for k in range(3000)], "id long, simhash long").write.parquet(str(tmp_path / "prints"))
    df = spark.read.parquet(str(tmp_path / "prints"))
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    lines = fp.near_pairs(df, 7)._jdf.queryExecution().executedPlan().toString().split("\n")
    sent = [itertools.takewhile(lambda x, k=k: depth(x) > depth(lines[k]), lines[k + 1 :]) for k, line in enumerate(lines) if "BroadcastExchange" in line]
    assert not [x for own in sent for x in own if "Generate" in x or "FlatMapGroupsInArrow" in x]


def test_near_pairs_with_longer_keys_cells_and_scopes(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(15)]
    prints = [(k, (base[k % 15] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))) - (1 << 63), "st"[k % 7 < 3]) for k in range(240)]
    df = spark.createDataFrame([*prints, (500, prints[0][1], None)], "id long, simhash long, site string")
    every = {(a, b, bin((x ^ y) & (1 << 64) - 1).count("1"), s == t) for (a, x, s), (b, y, t) in itertools.combinations(prints, 2)}
    monkeypatch.setattr(fp, "CELL", 50)
    for hamming, agree in ((0, 1), (1, 1), (3, 3), (7, 2), (7, 4)):
        monkeypatch.setattr(fp, "blocks_that_agree", lambda n, h, agree=agree: agree)
        got = sorted(map(tuple, fp.near_pairs(df.where("site is not null"), hamming).collect()))
        assert got == sorted(t[:3] for t in every if t[2] <= hamming)
    assert sorted(map(tuple, fp.near_pairs(df, 7, "site").collect())) == sorted(t[:3] for t in every if t[2] <= 7 and t[3])


def test_accept_near_of_a_chain_takes_few_rounds(spark, monkeypatch):
    chain, rows = 0, []
    for k in range(21):
        rows.append((k, f"h{k}", chain, 900, 900))
        chain ^= 7 << 3 * k
    cut, made = dedup.checkpoint, []
    monkeypatch.setattr(dedup, "checkpoint", lambda df: made.append(1) or cut(df))
    got = {r["id"]: (r["outcome"], r["kept_id"]) for r in dedup.accept_near(spark.createDataFrame(rows, "id long, content_hash string, simhash long, length int, raw_length int")).collect()}
    assert got == {k: ("near_duplicate", k - 1) if k % 2 else ("saved", None) for k in range(21)}
    assert len(made) <= 20
