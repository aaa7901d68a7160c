"""Rules over run records: normal form, reconciliation, transitions, counters, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom import config

#: Spellings of times in run records.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy-MM-dd")


def run_time(text: Column) -> Column:
    """Timestamp from any of the spellings; null from none."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in TIME_FORMATS))


def normal_runs(runs: DataFrame) -> DataFrame:
    """Distinct run records with the status in lower case and times as timestamps."""
    return runs.withColumns({"status": F.lower(F.trim("status")), "created_at": run_time(F.col("created_at_utc")), "purged_at": run_time(F.col("purged_at_utc"))}).drop("created_at_utc", "purged_at_utc").distinct()


def reconcile_orphans(runs: DataFrame, presence: DataFrame) -> DataFrame:
    """Outcome of each pending or running record: ``run_id, outcome, summary``.

    ``runs(run_id, status, written_minutes_ago, live)``; ``presence(run_id, kind, remote_status)``, kind one of
    present, absent, unknown (also without a row). Live runs are left alone, so are those without a time, those
    written under 15 minutes ago, those whose presence is unknown, and those complete in the store.
    """
    rows = runs.where(F.col("status").isin("pending", "running")).join(presence, "run_id", "left")
    kind = F.coalesce("kind", F.lit("unknown"))
    outcome = (
        F.when(F.col("live"), "skipped_live").when(F.col("written_minutes_ago").isNull(), "problem").when(F.col("written_minutes_ago") < config.STALE_MINUTES, "skipped_recent")
        .when((kind == "unknown") | ((kind == "present") & F.col("remote_status").isNull()), "unknown").when((kind == "present") & (F.col("remote_status") == "complete"), "skipped_complete").otherwise("reconciled")
    )
    summary = F.when(outcome == "reconciled", F.format_string("run ended without a record: %s for %d minutes", F.col("status"), F.col("written_minutes_ago")))
    return rows.select("run_id", outcome.alias("outcome"), summary.alias("summary"))


def superseded_runs(runs: DataFrame, presence: DataFrame) -> DataFrame:
    """Outcome of each complete record: kept while live or present in the store, unknown, or removed when absent."""
    rows = runs.where("status = 'complete'").join(presence, "run_id", "left")
    kind = F.coalesce("kind", F.lit("unknown"))
    return rows.select("run_id", F.when(F.col("live") | (kind == "present"), "kept").when(kind == "absent", "removed").otherwise("unknown").alias("outcome"))


def last_status(events: DataFrame) -> DataFrame:
    """State of each run after its events ``run_id, seq, status, error, content_ready``: what the last status leaves set."""
    last = events.groupBy("run_id").agg(F.max_by(F.struct("status", "error", "content_ready"), "seq").alias("x")).select("run_id", "x.*")
    return last.select("run_id", "status", F.when(F.col("status") == "failed", F.col("error")).alias("error"), F.when(F.col("status") == "complete", F.col("content_ready")).alias("content_ready"))


def merged_counters(updates: DataFrame, counters: list[str]) -> DataFrame:
    """Last non-null value of each counter of each run, by ``seq``."""
    return updates.groupBy("run_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in counters))


def slot_conflicts(runs: DataFrame) -> DataFrame:
    """Slots (run type and seed key) that more than one pending or running run holds."""
    rows = runs.where(F.col("status").isin("pending", "running")).groupBy(F.concat_ws(":", "crawl_type", "seed_key").alias("slot")).agg(F.count("*").alias("n_runs"))
    return rows.where("n_runs > 1")


def is_valid_request(seeds: Column, run_type: Column, max_pages: Column) -> Column:
    """One seed, a known type, and a positive limit if any."""
    return (F.size(seeds) == 1) & run_type.isin(*config.RUN_TYPES) & (max_pages.isNull() | (max_pages > 0))


def content_ready(saved: Column, without_content: Column) -> Column:
    return (saved > 0) & (without_content == 0)


def transport_error(causes: Column) -> Column:
    """Messages of a chain of at most six causes ``array<struct<message, code>>``, each with its code."""
    return F.array_join(F.transform(F.slice(causes, 1, 6), lambda c: F.concat_ws(" ", c["message"], F.concat(F.lit("("), c["code"], F.lit(")")))), ": ")


def ingest_failure(method: Column, path: Column, status: Column, code: Column, request: Column, body: Column) -> Column:
    """One line about a refused write: its message, else the first 500 characters of the body."""
    message = F.coalesce(F.try_variant_get(F.try_parse_json(body), "$.message", "string"), F.substring(body, 1, 500))
    return F.concat_ws(", ", F.concat_ws(" ", method, path, F.lit("→"), status.cast("string")), F.concat(F.lit("code "), code), F.concat(F.lit("request "), request), message)


def absence(status: Column, content_type: Column, body: Column) -> Column:
    """found, absent, unreachable or error, from a store's answer; a 404 counts only as the store's own JSON."""
    own = F.coalesce(F.lower(content_type).contains("json"), F.lit(False)) & F.try_parse_json(body).isNotNull()
    return F.when(status.isNull(), "unreachable").when(status.between(200, 299), "found").when((status == 404) & own, "absent").when(status == 404, "unreachable").otherwise("error")
