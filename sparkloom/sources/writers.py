"""Size rules of documents and batches, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom import config
from sparkloom.functions import urls

_STRINGS = ("origin", "url", "final_url", "html", "content_html", "title", "excerpt", "failure_reason")


def document_bytes(columns: list[str], html: bool = True) -> Column:
    """Size of a stored document: 512, for each present text 24 and its bytes, and the blocks as JSON."""
    texts = [c for c in _STRINGS if c in columns and (html or c != "html")]
    size = F.lit(512).cast("bigint")
    for c in texts:
        size = size + F.when(F.col(c).isNotNull(), F.octet_length(c) + 24).otherwise(0)
    if "blocks" in columns:
        size = size + F.coalesce(F.octet_length(F.to_json("blocks")), F.lit(0))
    return size


def size_admission(pages: DataFrame, limit: int = config.DOCUMENT_BYTES) -> DataFrame:
    """``pages`` with ``admission``: whole, without_html (then ``html`` is null), or refused; a text is never trimmed."""
    full, bare = document_bytes(pages.columns), document_bytes(pages.columns, html=False)
    out = pages.withColumn("admission", F.when(full <= limit, "whole").when(bare <= limit, "without_html").otherwise("refused"))
    return out.withColumn("html", F.when(F.col("admission") == "whole", F.col("html"))) if "html" in pages.columns else out


def batches(rows: DataFrame, group: str, order: str, size: Column, most: int = config.BATCH_PAGES, limit: int = config.BATCH_BYTES) -> DataFrame:
    """``rows`` with ``batch``: consecutive rows of a group, at most ``most`` of them, cut also where the running size passes another ``limit``."""
    by = Window.partitionBy(group).orderBy(order)
    upto = F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    key = F.struct(F.floor((F.row_number().over(by) - 1) / most).alias("a"), F.floor((upto - 1) / limit).alias("b"))
    return rows.withColumn("key", key).withColumn("batch", F.dense_rank().over(Window.partitionBy(group).orderBy("key"))).drop("key")


def write_cache(pages: DataFrame, path: str) -> None:
    """Cached pages by key; a page without fragment and blocks is not written."""
    keep = pages.where((F.coalesce(F.length("content_html"), F.lit(0)) > 0) | (F.size("blocks") > 0))
    keep.withColumn("key", urls.cache_key(F.col("url"))).select("key", "url", "content_html", "blocks").write.mode("overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header in which texts are quoted like JSON strings."""
    quoted = [F.to_json(F.struct(F.col(n).alias("v"))).alias(n) if t == "string" else F.col(n) for n, t in rows.dtypes]
    plain = [F.regexp_extract(q, r'(?s)^\{"v":(.*)\}$', 1).alias(n) if t == "string" else q for q, (n, t) in zip(quoted, rows.dtypes)]
    rows.select(*plain).write.mode("overwrite").option("header", True).option("quote", "\u0000").csv(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it does not have."""
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def near_copies(rows: DataFrame, order: str, files: int = 200, limit: int = 50 * 2**20, body: int = config.CONTENT_CAP) -> DataFrame:
    """Texts of near-duplicates kept for review: the first ``files`` of each run within ``limit`` bytes, each cut at ``body`` characters."""
    cut = rows.withColumn("text", F.substring("text", 1, body))
    by = Window.partitionBy("run_id").orderBy(order)
    ranked = cut.withColumns({"n": F.row_number().over(by), "upto": F.sum(F.octet_length("text")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return ranked.where((F.col("n") <= files) & (F.col("upto") <= limit)).drop("n", "upto")
