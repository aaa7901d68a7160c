from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from sparkloom import config
from sparkloom.config import EDITORIAL, EVIDENCE, OTHER, PRODUCT
from sparkloom.operators import admission
from sparkloom.operators.sequence import ranked

TIERS = ["product", "evidence", "other", "editorial"]


def test_window_quota_equals_the_sequence(spark):
    rng = random.Random(4)
    caps = {"a": 2, "b": 0, "c": 5}
    rows, want = [], {}
    for site in range(25):
        tiers = sorted((rng.choice(TIERS) for _ in range(rng.randrange(1, 60))), key=TIERS.index)
        admitted: Counter = Counter()
        sections: Counter = Counter()
        for rank, tier in enumerate(tiers, 1):
            section = rng.choice(["a", "b", "c", "", "free"])
            rows.append((site, rank, tier, section))
            others = admitted["product"] + admitted["other"]
            if tier == "editorial" and admitted["editorial"] >= (others // 4 if others else 25):
                want[site, rank] = "share"
            elif section in caps and sections[section] >= caps[section]:
                want[site, rank] = "section"
            else:
                want[site, rank] = "admitted"
                admitted[tier] += 1
                sections[section] += 1
    got = admission.quota_admission(spark.createDataFrame(rows, "site int, rank int, tier string, section string"), caps).collect()
    assert {(r["site"], r["rank"]): r["outcome"] for r in got} == want


OFFER = "site string, seq long, key string, tier string, section string, folder string, trap string, listed boolean, depth_exceeded boolean, locale_excluded boolean"


def offer(seq, key, tier="other", section="", folder="f", trap=None, listed=False, depth=False, locale=False):
    return "s", seq, key, tier, section, folder, trap, listed, depth, locale


def test_links_and_ledger(spark):
    rows = [
        offer(1, "j1", folder="jobs"), offer(2, "j2", folder="jobs"), offer(3, "j3", folder="jobs"), offer(4, "about", folder="about"), offer(5, "p", trap="pagination"), offer(6, "p", trap="search"), offer(7, None),
        offer(8, "fr", locale=True), offer(9, "deep", depth=True), offer(10, "z1", section="zip-codes", folder="locations"), offer(11, "miami", folder="locations"), offer(12, "j1", folder="jobs"), offer(13, "z1", section="zip-codes", listed=True),
        offer(14, "prod", "product"), offer(15, "deep", listed=True),
    ]
    decisions = admission.admit_links(spark.createDataFrame(rows, OFFER), {"zip-codes": 0}, directory=2)
    got = {r["key"]: (r["state"], r["source"], r["rule"]) for r in admission.ledger(decisions).collect()}
    assert got == {
        "j1": ("enqueued", "link", None), "j2": ("enqueued", "link", None), "j3": ("refused", None, "directory"), "about": ("enqueued", "link", None), "p": ("refused", None, "search"), "fr": ("refused", None, "locale"),
        "deep": ("enqueued", "sitemap", None), "z1": ("refused", None, "section"), "miami": ("enqueued", "link", None), "prod": ("enqueued", "link", None),
    }
    assert {r["key"] for r in decisions.where("forefront").collect()} == {"prod"}
    report = admission.discovery_report(admission.ledger(decisions), spark.createDataFrame([("s", "j1"), ("s", "j1"), ("s", "x")], "site string, key string")).first().asDict()
    assert report["discovered"] == report["enqueued"] + sum(v for k, v in report.items() if k.startswith("refused_"))
    assert report["enqueued"] == report["fetched"] + report["not_fetched"] and report["fetched"] == 1


def test_offers_are_idempotent(spark):
    rows = [offer(4 * k + j, f"u{j}", "editorial" if j else "product", "blog" if j else "") for k in range(40) for j in range(4)]
    entries = admission.ledger(admission.admit_links(spark.createDataFrame(rows, OFFER), {"blog": 0})).collect()
    assert len(entries) == 4 and sum(r["state"] == "enqueued" for r in entries) == 1 and all(r["n_offers"] == 40 for r in entries)


def test_abort(spark):
    runs = {"mixed": ["barren", "saved"] + ["barren"] * 24, "many_saved": ["saved"] * 3 + ["barren"] * 29, "enough": ["saved"] * 2 + ["barren"] * 25, "other": ["failed"] * 99, "short": ["barren"] * 24}
    df = spark.createDataFrame([(r, k, o) for r, os in runs.items() for k, o in enumerate(os)], "run string, seq long, outcome string")
    got = {r["run"]: (r["seq"], r["barren"], r["saved"]) for r in admission.early_abort(df).collect()}
    assert got == {"mixed": (25, 25, 1), "enough": (26, 25, 2)}
    assert "25 pages, 1 saved" in spark.range(1).select(admission.abort_message(F.lit(25), F.lit(1))).first()[0]


def test_order_and_config(spark):
    rows = [("other", 1, "https://a.com/b"), ("product", 2, "https://a.com/a/b"), ("product", 1, "https://a.com/Z"), ("product", 1, "https://a.com/a"), ("product", None, "bad"), ("editorial", 0, "x")]
    got = [r["url"] for r in spark.createDataFrame(rows, "tier string, depth int, url string").orderBy(*admission.admission_order()).collect()]
    assert got == ["https://a.com/a", "https://a.com/Z", "https://a.com/a/b", "bad", "https://a.com/b", "x"]
    assert config.section_caps("blog:7.9, x:1,bad,y:z,:3")["blog"] == 7 and config.section_caps("x:1")["x"] == 1 and len(config.SECTION_CAPS) == 34
    assert (config.budget(None), config.budget(0), config.budget(99999)) == (2500, 1, 2500)
    assert config.profile("project-site").quotas is False and config.profile("partner").directory_cap and config.near_setting("0", 3, 0, 7) == 3
    assert len(config.SECTIONS) == 55


def test_admission_order_is_whole(spark, tmp_path):
    from sparkloom.plans import registry

    rows = [(k, f"https://a.example/docs/p{k}") for k in range(130)] + [(500, "https://b.example/"), (501, None)]
    spark.createDataFrame(rows, "doc_id long, url string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.admission_order(spark, str(tmp_path)).collect()
    assert sorted(r["rank"] for r in got if "a.example" in r["url"]) == list(range(1, 131)) and len(got) == 131


def test_ranks_of_a_hot_scope(spark):
    rows = [("hot" if k % 3 else None if k % 2 else "cold", (k * 7919) % 5000) for k in range(5000)]
    df = spark.createDataFrame(rows, "site string, v int").repartition(7)
    got: dict = {}
    for r in ranked(df, "site", [F.col("v").asc()]).collect():
        got.setdefault(r["site"], []).append((r["v"], r["rank"]))
    want: dict = {}
    for site, v in rows:
        want.setdefault(site, []).append(v)
    assert {k: sorted(v) for k, v in got.items()} == {k: [(v, n + 1) for n, v in enumerate(sorted(vs))] for k, vs in want.items()}
    assert ranked(df.limit(0), "site", [F.col("v").asc()]).count() == 0


def test_quotas_against_one_gate(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for site in ("a", "b", None, "c"):
        tiers = sorted((rng.choice([PRODUCT, EVIDENCE, OTHER, EDITORIAL, EDITORIAL]) for _ in range(90 if site != "c" else 30)), key=[PRODUCT, EVIDENCE, OTHER, EDITORIAL].index)
        if site == "c":
            tiers = [EDITORIAL] * 40
        gate = admission.Gate({"x": 4, "y": 0, "z": 9})
        for rank, tier in enumerate(tiers, 1):
            section = rng.choice(["", "x", "y", "z", "free"])
            rule = gate.quota(tier, section)
            if rule is None:
                gate.tiers[tier] += 1
                gate.sections[section] += 1
            rows.append((site, rank, tier, section))
            want[site, rank] = rule or "admitted"
    got = {(r["site"], r["rank"]): r["outcome"] for r in admission.quota_admission(spark.createDataFrame(rows, "site string, rank int, tier string, section string"), {"x": 4, "y": 0, "z": 9}).collect()}
    differ = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert len(got) == len(want) and not differ
