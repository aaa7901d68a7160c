"""Problem 3: lines repeated across the pages of one site.

Each line's page frequency within a site is compared with its frequency outside by a log-likelihood ratio;
the Benjamini-Hochberg rule over all lines of all sites controls the false discoveries. Significant lines
with enough pages are anti-joined from the blocks, which are put together again by position.

Outside, a line counts where it stands on sites on which it is rare: a notice that many sites repeat is no
evidence that the line is ordinary prose, nor is one that fills the few pages of a small site. Lines on fewer pages
than a repeated line must have are not tested, so they take no part in the correction for multiple tests. To the
outside pages one more site of the mean size is added, without the line; it decides where the collection has one
site only, and fades where it has many. A line that is about as frequent on the pages of other sites, though rare on
each, is no excess and is not removed, however many of the site's own pages have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import beside, block_lines, host_of
from sparkloom.session import checkpoint

#: Width of the bins of -log10(p) from which the discovery threshold is found; their number bounds what one task sorts.
BIN, BINS = 0.02, 20000


def line_key(line: Column) -> Column:
    """Identity of a line: a 128-bit digest of its letters in order, without case; null where it has none."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
    return F.when(letters != "", F.unhex(F.md5(letters)))


def lines_of(pages: DataFrame) -> DataFrame:
    """``host, page_id, block_no, key`` of each block with letters, null hosts and ids left out."""
    keyed = block_lines(pages.where("page_id is not null and origin is not null"), host_of(F.col("origin")).alias("host"), F.col("page_id"))
    return keyed.select("host", "page_id", "block_no", line_key(F.col("line")).alias("key")).where("key is not null")


def _xlogx(x: Column, of: Column) -> Column:
    return F.when(x > 0, x * F.log(x / of)).otherwise(F.lit(0.0))


def llr(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Log-likelihood ratio (G squared) of k1 in n1 against k2 in n2; 0 without a second sample."""
    both, all_ = k1 + k2, n1 + n2
    inner = _xlogx(k1, n1) + _xlogx(n1 - k1, n1) + _xlogx(k2, n2) + _xlogx(n2 - k2, n2) - _xlogx(both, all_) - _xlogx(all_ - both, all_)
    return F.when(n2 > 0, F.greatest(F.lit(0.0), 2 * inner)).otherwise(F.lit(0.0))


def minus_log10_p(ratio: Column) -> Column:
    """-log10 of the upper tail of chi-square with one degree of freedom (an upper bound of the tail beyond 2 sigma)."""
    x = F.sqrt(ratio / 2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return (x * x - F.log(poly)) / F.log(F.lit(10.0))


def line_statistics(pages: DataFrame, min_pages: int = 5, min_share: float = 0.2) -> DataFrame:
    """Per site and line on at least ``min_pages`` pages: pages with it (``k``) of the site's (``n``), outside counts, the ratio and -log10 p.

    Every line of every site is counted, once per page. The counts are combined before each shuffle, so one
    line on a third of all pages costs no more than another.
    """
    lines = lines_of(pages).select("host", "key", "page_id")
    counts = lines.distinct().groupBy("host", "key").agg(F.count("*").alias("k"))
    sizes = pages.where("page_id is not null and origin is not null and size(blocks) > 0").select(host_of(F.col("origin")).alias("host"), "page_id").distinct().groupBy("host").agg(F.count("*").alias("n"))
    sizes = checkpoint(sizes)
    per = counts.join(sizes, "host").withColumn("repeated", (F.col("k") >= min_pages) & (F.col("k") >= F.col("n") * min_share))
    all_pages, prior = sizes.agg(F.sum("n"), F.avg("n")).first()
    rare = F.col("k") < F.col("n") * min_share
    outside = per.groupBy("key").agg(F.sum(F.when(rare, F.col("k")).otherwise(0)).alias("loose_k"))
    stats = per.where(F.col("k") >= min_pages).join(outside, "key")
    k2 = F.col("loose_k") - F.when(rare, F.col("k")).otherwise(0)
    stats = stats.withColumns({"k2": k2.cast("double"), "n2": (F.lit((all_pages or 0) + (prior or 0.0)) - F.col("n")).cast("double")})
    k1, n1 = F.col("k").cast("double"), F.col("n").cast("double")
    stats = stats.withColumn("ratio", llr(k1, n1, F.col("k2"), F.col("n2")))
    return checkpoint(stats.withColumn("score", F.when(k1 / n1 > F.col("k2") / F.col("n2"), minus_log10_p(F.col("ratio"))).otherwise(F.lit(0.0))))


def significant_lines(stats: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Lines that the Benjamini-Hochberg rule keeps at rate ``fdr``, over all tested lines of all sites.

    The threshold comes from counts by bins of the p-value, rounded to the safe side, so no task ranks all
    lines.
    """
    binned = stats.withColumn("bin", F.least(F.floor(F.col("score") / BIN), F.lit(BINS)).cast("int"))
    by = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = binned.groupBy("bin").agg(F.count("*").alias("c"))
    ranked = hist.withColumns({"rank": F.sum("c").over(by), "m": F.sum("c").over(Window.partitionBy())})
    first = ranked.where(F.pow(F.lit(10.0), -F.col("bin") * BIN) <= fdr * F.col("rank") / F.col("m")).agg(F.coalesce(F.min("bin"), F.lit(BINS + 1)).alias("first_bin")).scalar()
    return binned.where(F.col("bin") >= first).drop("bin")


def repeated_site_lines(pages: DataFrame, min_pages: int = 5, min_share: float = 0.2, fdr: float = 0.05) -> DataFrame:
    """``host, key, k, n`` of the significant excess lines with at least ``min_pages`` pages and ``min_share`` of the site."""
    return significant_lines(line_statistics(pages, min_pages, min_share), fdr).where("repeated").select("host", "key", "k", "n")


def repeated_blocks(pages: DataFrame, **rule: float) -> DataFrame:
    """Blocks whose text is a repeated line: ``page_id, block_no``, distinct."""
    return lines_of(pages).join(beside(repeated_site_lines(pages, **rule).select("host", "key")), ["host", "key"], "left_semi").select("page_id", "block_no").distinct()


def without_site_lines(pages: DataFrame, **rule: float) -> DataFrame:
    """Text of each page with non-null ``blocks`` without its site's repeated lines: ``page_id, n_blocks, kept, text``.

    Blocks keep their order; a page that loses all of them has an empty text, and so has one without blocks.
    """
    rows = block_lines(pages.where("page_id is not null"), host_of(F.col("origin")).alias("host"), F.col("page_id")).dropDuplicates(["page_id", "block_no"])
    rows = rows.withColumn("key", line_key(F.col("line")))
    kept = rows.join(beside(repeated_site_lines(pages, **rule).select("host", "key")), ["host", "key"], "left_anti")
    joined = kept.groupBy("page_id").agg(F.count("*").alias("kept"), F.array_sort(F.collect_list(F.struct("block_no", "line"))).alias("b"))
    sizes = pages.where("page_id is not null and blocks is not null").groupBy("page_id").agg(F.max(F.size("blocks")).cast("bigint").alias("n_blocks"))
    return sizes.join(joined, "page_id", "left").select("page_id", "n_blocks", F.coalesce("kept", F.lit(0).cast("bigint")).alias("kept"), F.coalesce(F.array_join(F.transform("b", lambda x: x["line"]), "\n"), F.lit("")).alias("text"))
