"""Queries of this folder, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import main_body, near_pages, packing, repetition, residue, site_lines, split, tokens, truncation
from sparkloom.llm.sql import ORACLES
from sparkloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(table(spark, sf_dir, "ingest_pages"), table(spark, sf_dir, "size_limits"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(table(spark, sf_dir, "ingest_pages"), table(spark, sf_dir, "size_limits"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All pages of the definition, those under a cutoff too.
    return repetition.judged(table(spark, sf_dir, "ingest_pages")).where("confirmed").select("page_id")


def p2_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = repetition.repetition_profile(table(spark, sf_dir, "ingest_pages"))
    return profile.withColumn("word_share", repetition.word_share(profile))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_blocks(table(spark, sf_dir, "ingest_pages"))


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_site_lines(table(spark, sf_dir, "ingest_pages")).select("host", F.lower(F.hex("key")).alias("line_key"), "k", "n")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.without_site_lines(table(spark, sf_dir, "ingest_pages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pages.near_page_pairs(table(spark, sf_dir, "ingest_pages"), table(spark, sf_dir, "dedup_accepted"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pages.near_page_groups(table(spark, sf_dir, "ingest_pages"), table(spark, sf_dir, "dedup_accepted"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body.main_body_lines(table(spark, sf_dir, "ingest_pages"))


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body.main_body(table(spark, sf_dir, "ingest_pages"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_pages(table(spark, sf_dir, "ingest_pages")).where("is_residue").select("page_id")


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = residue.without_residue(table(spark, sf_dir, "ingest_pages").select("page_id", "content_html", "failure_reason", "status_code"))
    return kept.select("page_id", F.char_length("content_html").alias("content_length"), "failure_reason").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "size_limits"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(_packed(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = packing.containers(_packed(spark, sf_dir)).groupBy("limit_name", "capacity")
    return by.agg(F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("fill").alias("tokens")).withColumn("fill_share", F.col("tokens") / (F.col("n_containers") * F.col("capacity")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).where("is_truncated").select("doc_id")


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return truncation.source_rates(docs, truncation.truncated(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_share, p3_found, p3_lines, p3_clean, p4_found, p4_groups, p5_found, p5_text, p6_found, p6_kept, p7_ids, p8_containers, p8_fill, p9_found, p9_sources)}

__all__ = ["ORACLES", "QUERIES"]
