"""Admission of URLs to a run: order, quotas, caps, the discovery ledger, early abort."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom import config
from sparkloom.config import EDITORIAL, EVIDENCE, OTHER, PRODUCT
from sparkloom.functions import classify
from sparkloom.operators.sequence import in_sequence, ranked
from sparkloom.session import checkpoint


def admission_order(collation: str = "UNICODE") -> list[Column]:
    """Sort keys of a frontier ``tier, depth, url``: tier, then depth (unparseable last), then the URL by locale order."""
    return [classify.tier_rank(F.col("tier")).asc_nulls_last(), F.col("depth").asc_nulls_last(), F.collate(F.col("url"), collation).asc(), F.col("url").asc()]


def caps_column(section: Column, caps: dict[str, int]) -> Column:
    """Cap of a section, null where it has none."""
    pairs = [F.lit(x) for item in sorted(caps.items()) for x in item]
    return F.create_map(*pairs)[section] if pairs else F.lit(None).cast("int")


def quota_admission(frontier: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Outcome of a frontier in admission order: ``frontier`` plus ``outcome`` (admitted, section or share).

    ``frontier``: ``site, rank`` (place in the admission order, unique per site), ``tier, section``. Editorial
    pages get a quarter of what product and other pages within their caps number (25 where there are none);
    evidence is neither limited nor counted. Because the order puts editorial pages last, each rule is a rank
    beyond which it refuses: one row for a section or site, found without a site's rows in one task.
    """
    caps = config.SECTION_CAPS if caps is None else caps
    rows = checkpoint(frontier.withColumn("cap", F.when(F.col("section") != "", caps_column(F.col("section"), caps))))
    # Spark keeps the first rows of each section in every partition before the shuffle (a group limit of the window).
    first = rows.where("cap is not null").withColumn("nth", F.row_number().over(Window.partitionBy("site", "section").orderBy("rank"))).where(F.col("nth") <= max(caps.values(), default=0))
    last = first.groupBy("site", "section").agg(F.max(F.when(F.col("nth") <= F.col("cap"), F.col("rank"))).alias("last_rank")).toDF("_site", "_section", "_last")
    capped = rows.where("cap is not null").join(last, F.col("site").eqNullSafe(F.col("_site")) & (F.col("section") == F.col("_section")), "left")
    capped = capped.withColumn("cap_ok", F.coalesce(F.col("rank") <= F.col("_last"), F.lit(False))).drop("_site", "_section", "_last")
    both = checkpoint(capped.unionByName(rows.where("cap is null").withColumn("cap_ok", F.lit(True))).drop("cap"))
    counted = both.groupBy("site").agg(F.count_if(F.col("tier").isin(PRODUCT, OTHER) & F.col("cap_ok")).alias("n"))
    allowed = F.when(F.col("n") == 0, config.EDITORIAL_FLOOR).otherwise(F.floor(F.col("n") / config.EDITORIAL_PER))
    sites = counted.select(F.col("site").alias("of"), allowed.cast("bigint").alias("allowed"))
    editorial = ranked(both.where((F.col("tier") == EDITORIAL) & F.col("cap_ok")).select("site", "rank"), "site", [F.col("rank").asc()], "nth")
    bound = editorial.join(sites, F.col("site").eqNullSafe(F.col("of")) & (F.col("nth") == F.col("allowed"))).select(F.col("of").alias("at"), F.col("rank").alias("last_share"))
    sites = sites.join(bound, F.col("of").eqNullSafe(F.col("at")), "left").select("of", F.when(F.col("allowed") == 0, 0).otherwise(F.col("last_share")).alias("last_share"))
    out = both.join(sites, F.col("site").eqNullSafe(F.col("of")), "left")
    share = F.coalesce((F.col("tier") == EDITORIAL) & (F.col("rank") > F.col("last_share")), F.lit(False))
    return out.withColumn("outcome", F.when(share, "share").when(~F.col("cap_ok"), "section").otherwise("admitted")).select(*frontier.columns, "outcome")


class Gate:
    """Quotas, directory cap and ledger of one site, in arrival order."""

    def __init__(self, caps: dict[str, int] | None = None, quotas: bool = True, directory: int | None = config.DIRECTORY_CAP) -> None:
        self.caps, self.quotas, self.directory = config.SECTION_CAPS if caps is None else caps, quotas, directory
        self.state: dict[str, tuple[str, str | None]] = {}
        self.tiers: Counter[str] = Counter()
        self.sections: Counter[str] = Counter()
        self.folders: Counter[str] = Counter()

    def quota(self, tier: str, section: str) -> str | None:
        """The quota rule that refuses a page, if any."""
        if not self.quotas:
            return None
        if tier == EDITORIAL:
            others = self.tiers[PRODUCT] + self.tiers[OTHER]
            if self.tiers[EDITORIAL] >= (others // config.EDITORIAL_PER if others else config.EDITORIAL_FLOOR):
                return "share"
        cap = self.caps.get(section) if section else None
        return "section" if cap is not None and self.sections[section] >= cap else None

    def offer(self, row: dict) -> tuple[str, str | None]:
        """``(enqueued, source)`` or ``(refused, rule)`` for an offered link; an enqueued key stays enqueued."""
        key = row["key"]
        if key is None:
            return "refused", "invalid"
        if self.state.get(key, ("", None))[0] == "enqueued":
            return self.state[key]
        rule = None
        if row["locale_excluded"]:
            rule = "locale"
        elif not row["listed"]:
            if row["depth_exceeded"]:
                rule = "depth"
            elif row["trap"] is not None:
                rule = row["trap"]
            elif self.directory is not None and row["tier"] == OTHER and self.folders[row["folder"]] >= self.directory:
                rule = "directory"
        rule = rule or self.quota(row["tier"], row["section"])
        if rule is None:
            self.tiers[row["tier"]] += 1
            if row["section"]:
                self.sections[row["section"]] += 1
            if not row["listed"] and row["tier"] == OTHER:
                self.folders[row["folder"]] += 1
        self.state[key] = ("refused", rule) if rule else ("enqueued", "sitemap" if row["listed"] else "link")
        return self.state[key]


OFFERS = "site string, seq long, key string, state string, rule string, forefront boolean"


def admit_links(offers: DataFrame, caps: dict[str, int] | None = None, quotas: bool = True, directory: int | None = config.DIRECTORY_CAP) -> DataFrame:
    """Decisions on discovered links in arrival order: ``site, seq, key, state, rule, forefront``.

    ``offers``: ``site, seq, key, tier, section, folder, trap, listed, depth_exceeded, locale_excluded``. The allowance
    grows with what was admitted before, so a site's offers are one sequence by definition; its rows are
    short keys. ``rule`` of an enqueued row is its source. Offers are decided once per key and batch of state.
    """
    columns = ["site", "seq", "key", "tier", "section", "folder", "trap", "listed", "depth_exceeded", "locale_excluded"]

    def decide(gate: Gate, row: dict) -> tuple:
        state, rule = gate.offer(row)
        return row["site"], row["seq"], row["key"], state, rule, state == "enqueued" and row["tier"] in (PRODUCT, EVIDENCE)

    return in_sequence(offers, "site", "seq", columns, lambda: Gate(caps, quotas, directory), decide, OFFERS, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()])


def ledger(decisions: DataFrame) -> DataFrame:
    """Final state of each key: enqueued if it ever was (its first source counts), else its last refusal."""
    enqueued = F.col("state") == "enqueued"
    return decisions.where("key is not null").groupBy("site", "key").agg(
        F.max(enqueued).alias("is_enqueued"), F.min_by("rule", F.when(enqueued, F.col("seq"))).alias("source"), F.max_by("rule", F.when(~enqueued, F.col("seq"))).alias("last_rule"), F.count("*").alias("n_offers"),
    ).select("site", "key", F.when(F.col("is_enqueued"), "enqueued").otherwise("refused").alias("state"), F.when(F.col("is_enqueued"), F.col("source")).alias("source"), F.when(~F.col("is_enqueued"), F.col("last_rule")).alias("rule"), "n_offers")


def discovery_report(entries: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """Counts of a ledger per site; discovered = enqueued + refused, enqueued = fetched + not fetched. ``fetched``: distinct ``site, key``."""
    rules = ("invalid", "locale", "depth", "pagination", "search", "calendar", "facet", "directory", "section", "share")
    rows = entries.withColumn("is_fetched", F.lit(False)) if fetched is None else entries.join(fetched.select("site", "key").distinct().withColumn("f", F.lit(True)), ["site", "key"], "left").withColumn("is_fetched", F.coalesce("f", F.lit(False)))
    enqueued = F.col("state") == "enqueued"
    return rows.groupBy("site").agg(
        F.count("*").alias("discovered"), F.count_if(enqueued).alias("enqueued"), F.count_if(enqueued & (F.col("source") == "sitemap")).alias("from_sitemap"), F.count_if(enqueued & (F.col("source") == "link")).alias("from_links"),
        F.count_if(enqueued & F.col("is_fetched")).alias("fetched"), F.count_if(enqueued & ~F.col("is_fetched")).alias("not_fetched"), *(F.count_if(F.col("rule") == r).alias(f"refused_{r}") for r in rules),
    )


def early_abort(outcomes: DataFrame, after: int = config.ABORT_AFTER, ratio: int = config.ABORT_RATIO) -> DataFrame:
    """Where runs stop: ``run, seq, barren, saved`` of the first barren page at which enough pages were barren and too few saved.

    ``outcomes``: ``run, seq, outcome`` with outcome ``saved``, ``barren`` or other. Runs that go on have no row.
    """
    by = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = outcomes.where(F.col("outcome").isin("saved", "barren")).withColumns({"barren": F.count_if(F.col("outcome") == "barren").over(by), "saved": F.count_if(F.col("outcome") == "saved").over(by)})
    cut = running.where((F.col("outcome") == "barren") & (F.col("barren") >= after) & (F.col("saved") * ratio < F.col("barren")))
    return cut.groupBy("run").agg(F.min(F.struct("seq", "barren", "saved")).alias("x")).select("run", "x.*")


def abort_message(barren: Column, saved: Column) -> Column:
    return F.concat_ws("", F.lit("early abort: nothing extractable in "), barren.cast("string"), F.lit(" pages, "), saved.cast("string"), F.lit(" saved"))
