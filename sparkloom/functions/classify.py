"""Path classes, link traps and reject rules as generated column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom import config
from sparkloom.config import EDITORIAL, EVIDENCE, OTHER, PRODUCT, SECTIONS, Section


def _entry(segment: Column, index: Column, entry: Section) -> Column:
    hit = segment.rlike(f"^{entry.pattern}$")
    return hit & (index == 0) if entry.first_only else hit


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), 0)


def _case(branches: list[tuple[Column, str]]) -> Column:
    return reduce(lambda acc, b: acc.when(b[0], b[1]), branches[1:], F.when(*branches[0]))


def _lower_segments(p: Column) -> Column:
    return F.transform(p["segments"], F.lower)


def path_tier(p: Column) -> Column:
    """product, evidence, other or editorial; null if the URL does not parse.

    Strong editorial signals, then the leftmost segment that the vocabulary classifies (product before
    evidence before editorial), then weak signals, then other. The homepage is other.
    """
    joined = F.array_join(_lower_segments(p), "/")
    ranked = [e for tier in (PRODUCT, EVIDENCE, EDITORIAL) for e in SECTIONS if e.tier == tier]
    by = _first(F.transform(_lower_segments(p), lambda s, i: _case([(_entry(s, i, e), e.tier) for e in ranked])))
    tier = F.when(F.size(p["segments"]) == 0, OTHER).when(joined.rlike(config.STRONG_EDITORIAL), EDITORIAL).when(by.isNotNull(), by).when(joined.rlike(config.WEAK_EDITORIAL), EDITORIAL).otherwise(OTHER)
    return F.when(p["ok"], tier)


def tier_rank(tier: Column) -> Column:
    return F.when(tier == PRODUCT, 0).when(tier == EVIDENCE, 1).when(tier == OTHER, 2).when(tier == EDITORIAL, 3)


def path_section(p: Column) -> Column:
    """Name of the leftmost segment's section, product sections left out; '' if there is none, null if it does not parse."""
    ranked = [e for e in SECTIONS if e.tier != PRODUCT]
    by = _first(F.transform(_lower_segments(p), lambda s, i: _case([(_entry(s, i, e), e.name) for e in ranked])))
    return F.when(p["ok"], F.coalesce(by, F.lit("")))


def trap_rule(p: Column) -> Column:
    """pagination, search, calendar or facet for a URL that leads into endless listings; null for others."""
    segs = _lower_segments(p)
    joined = F.concat(F.lit("/"), F.array_join(segs, "/"), F.lit("/"))
    dated = F.array_join(segs, "/").rlike(r"(?:^|/)(?:19|20)\d{2}(?:-\d{1,2}){0,2}$|(?:^|/)(?:19|20)\d{2}/\d{1,2}(?:/\d{1,2})?$")
    key = lambda x: F.regexp_replace(F.lower(x["k"]), r"(?s)\[.*$", "")
    rule = lambda x: (
        F.when(key(x).isin(*config.PAGINATION_KEYS) & F.trim(x["v"]).rlike(r"^\d+$"), "pagination")
        .when(key(x).isin(*config.SEARCH_KEYS), "search").when(key(x).isin(*config.CALENDAR_KEYS), "calendar").when(key(x).isin(*config.FACET_KEYS), "facet")
    )
    by_key = _first(F.transform(p["params"], rule))
    many = F.size(F.array_distinct(F.transform(p["params"], key))) > 2
    return F.when(p["ok"], F.when(joined.rlike(r"/page/\d+/"), "pagination").when(F.get(segs, 0) == "search", "search").when(dated, "calendar").when(by_key.isNotNull(), by_key).when(many, "facet"))


def is_non_content(p: Column) -> Column:
    return F.coalesce(F.lower(F.get(p["segments"], 0)).isin(*config.NON_CONTENT), F.lit(False))


def is_empty_text(text: Column) -> Column:
    """Null, blank, or shorter than the prose floor once trimmed."""
    return F.coalesce(F.length(F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))), F.lit(0)) < config.PROSE_FLOOR


def viability(html: Column, text_length: Column, mount: Column) -> Column:
    """Why a page is not worth extracting, or null. ``text_length``: of the collapsed text of main, article or body."""
    low = F.lower(html)
    challenge = reduce(lambda a, b: a | b, [low.contains(m) for m in config.CHALLENGE_MARKS])
    return (
        F.when(html.isNull() | (F.length(html) < config.VIABLE_BYTES), "body_too_small").when(challenge, "challenge_page")
        .when(text_length < config.VIABLE_TEXT, F.when(mount | (text_length == 0), "empty_or_spa_shell").otherwise("insufficient_text"))
    )


def viability_reject(reason: Column) -> Column:
    """Reject reason of a viability reason."""
    return F.when(reason == "empty_or_spa_shell", "requires_javascript").when(reason == "challenge_page", "challenge_page").when(reason.isNotNull(), "extract_empty")


def reject_reason(final: Column, scope: Column | None, viability_reason: Column, text: Column, check_text: Column) -> Column:
    """First reject rule that holds, or null. Without a ``scope`` no page is off site; without ``check_text`` none is empty."""
    off = ~_on_site(final, scope) if scope is not None else F.lit(False)
    from sparkloom.functions import urls

    return (
        F.when(off, "off_site_redirect").when(urls.is_locale_excluded(final), "locale_excluded").when(is_non_content(final), "non_content_directory")
        .when(viability_reason == "challenge_page", "challenge_page").when(check_text & is_empty_text(text), "extract_empty")
    )


def _on_site(a: Column, b: Column) -> Column:
    from sparkloom.functions import urls

    return urls.is_on_site(a, b)


def status_outcome(status: Column) -> Column:
    """Outcome of a response by its status: blocked, failed, or null for one that goes on."""
    return F.when(status.isin(401, 403, 429), "challenge_page").when(status >= 400, "request_failed")


def fetch_kind(status: Column) -> Column:
    """ok, absent (404, 410) or failed (anything else, and no response)."""
    return F.when(status.between(200, 299), "ok").when(status.isin(404, 410), "absent").otherwise("failed")


def clean_detail(text: Column) -> Column:
    """Detail of a reject on one line, credentials hidden, at most 300 characters."""
    line = F.regexp_replace(text, r"[\r\n\t]+", " ")
    hidden = F.regexp_replace(line, r"(?i)\b(authorization|bearer|token|api[-_]?key|password|secret|cookie)(\s*[:=]\s*)\S+", "$1$2[redacted]")
    return F.substring(F.trim(hidden), 1, config.DETAIL_CHARS)


def failure_cause(message: Column) -> Column:
    """Cause of a failed run from its error summary; an unknown one is its first 80 characters."""
    batch = F.regexp_extract(message, r"/((?:pages|links)/batch)\b", 1)
    endpoint = F.when(batch != "", batch).when(message.rlike(r"/runs\b"), "runs").otherwise("")
    on = F.when(endpoint != "", F.concat(F.lit(" on "), endpoint)).otherwise("")
    status = F.regexp_extract(message, r"→ (\d{3})\b", 1)
    return (
        F.when(F.coalesce(message, F.lit("")) == "", "no reason recorded")
        .when(message.contains("→ transport:"), F.concat(F.lit("transport failure (no response)"), on))
        .when(message.rlike("(?i)application not found"), F.concat(F.lit("platform proxy 404 (service not running)"), on))
        .when(message.rlike("(?i)no usable pages"), "store: crawl complete with no usable pages")
        .when(message.rlike("(?i)no extracted content"), "store: pages carry no extracted content")
        .when(message.rlike("(?i)exceeds atomic max"), "batch exceeded the atomic maximum")
        .when(message.rlike("(?i)nothing extractable"), "early abort: nothing extractable")
        .when(message.rlike("(?i)robots"), "robots.txt disallowed the crawl")
        .when(message.rlike("(?i)cancelled by operator"), "cancelled by operator")
        .when(status != "", F.concat(F.lit("HTTP "), status, on))
        .otherwise(F.substring(message, 1, 80))
    )
