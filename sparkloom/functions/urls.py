"""URL functions. ``url_parts`` parses once, vectorised; all else is plain columns over its result.

A URL that does not parse has ``ok`` false and null parts; functions of it are null (or as stated).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom import config
from sparkloom.functions import urlparse

PARTS = "ok boolean, scheme string, host string, port string, path string, query string, href string, segments array<string>, params array<struct<k:string,v:string>>"


def url_parts(url: Column) -> Column:
    """Parts of absolute URLs, as a struct. ``href`` has no fragment and no credentials; ``segments`` are the non-empty ones."""
    def apply(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in urls:
            u = urlparse.parse(raw) if isinstance(raw, str) else None
            if u is None:
                rows.append((False, None, None, None, None, None, None, None, None))
            else:
                rows.append((True, u.scheme, u.host, u.port, u.path, u.query, u.href(), [s for s in u.path.split("/") if s], [{"k": k, "v": v} for k, v in urlparse.pairs(u.query)]))
        return pd.DataFrame(rows, columns=["ok", "scheme", "host", "port", "path", "query", "href", "segments", "params"])

    apply.__annotations__ = {"urls": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(apply, PARTS)(url)


def is_web(p: Column) -> Column:
    return p["ok"] & p["scheme"].isin("http", "https")


def origin_of(p: Column) -> Column:
    """Scheme, host and port; '' for a URL that does not parse."""
    return F.when(p["ok"], F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(""))).otherwise("")


def form(params: Column) -> Column:
    """Form-encoded query of parameters; null without any."""
    return F.when(F.size(params) > 0, F.array_join(F.transform(params, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&"))


def without_keys(params: Column, keys: tuple[str, ...]) -> Column:
    return F.filter(params, lambda x: ~F.lower(x["k"]).isin(*keys))


def _with_query(base: Column, query: Column) -> Column:
    return F.concat(base, F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(""))


def normalize(p: Column) -> Column:
    """The URL to fetch: web only, without fragment and tracking keys. A query without such keys is left as written."""
    kept = without_keys(p["params"], config.TRACKING_KEYS)
    query = F.when(F.size(kept) == F.size(p["params"]), p["query"]).otherwise(form(kept))
    return F.when(is_web(p), _with_query(F.concat(origin_of(p), p["path"]), query))


def hostname_key(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), r"^www\.", "")


def dedup_key(p: Column, aggressive: bool = False) -> Column:
    """The key by which pages are compared: noise keys removed, the query always written anew.

    ``aggressive`` also takes https for http, drops ``www.``, one trailing slash and ``/index.htm(l)``, lowers
    the path and sorts the parameters.
    """
    kept = without_keys(p["params"], config.NOISE_KEYS)
    if not aggressive:
        return F.when(is_web(p), _with_query(F.concat(origin_of(p), p["path"]), form(kept)))
    port = F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise("")
    path = F.lower(F.regexp_replace(p["path"], r"(?i)/index\.html?$", "/"))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.when(is_web(p), _with_query(F.concat(F.lit("https://"), hostname_key(p["host"]), port, path), form(F.array_sort(kept))))


def member_key(p: Column) -> Column:
    """Membership in a sitemap: host without ``www.``, path without a trailing slash unless it is the root; scheme left out."""
    path = F.when(F.length(p["path"]) > 1, F.regexp_replace(p["path"], "/$", "")).otherwise(p["path"])
    port = F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise("")
    return F.when(p["ok"], _with_query(F.concat(hostname_key(p["host"]), port, path), p["query"]))


def is_on_site(a: Column, b: Column) -> Column:
    """Same host key; false if either does not parse."""
    return F.coalesce(a["ok"] & b["ok"] & (hostname_key(a["host"]) == hostname_key(b["host"])), F.lit(False))


def is_same_site(a: Column, b: Column) -> Column:
    """Same scheme and host key; false if either does not parse."""
    return F.coalesce(is_on_site(a, b) & (a["scheme"] == b["scheme"]), F.lit(False))


def origin_key(p: Column, raw: Column) -> Column:
    """Scheme and host key, without the port; the trimmed lower-case text if it does not parse."""
    return F.when(p["ok"], F.concat(p["scheme"], F.lit("://"), hostname_key(p["host"]))).otherwise(F.lower(F.trim(raw)))


def clean_seed(raw: Column) -> Column:
    """A seed as typed, ready to parse: trimmed, one list marker removed, https where no scheme is given."""
    text = F.regexp_replace(F.trim(raw), r"^(?:[-*•]|\d+[.)])\s+", "")
    return F.when(text == "", None).when(text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), text).otherwise(F.concat(F.lit("https://"), text))


def seed_url(p: Column) -> Column:
    """A parsed seed without fragment, credentials and a root slash."""
    url = _with_query(F.concat(origin_of(p), p["path"]), p["query"])
    return F.when(is_web(p), F.when((p["path"] == "/") & p["query"].isNull(), origin_of(p)).otherwise(url))


def seed_key(seeds: Column) -> Column:
    """Key of a set of seeds: digest of the sorted list as JSON."""
    return F.sha2(F.to_json(F.array_sort(seeds)), 256)


def first_segment(p: Column, lower: bool = True) -> Column:
    """First segment of the path; '' at the root, null if it does not parse."""
    first = F.coalesce(F.get(p["segments"], 0), F.lit(""))
    return F.when(p["ok"], F.lower(first) if lower else first)


def section_of(p: Column) -> Column:
    """First segment as written, ``(root)`` at the root."""
    return F.when(p["ok"], F.coalesce(F.get(p["segments"], 0), F.lit("(root)")))


def locale_language(segment: Column) -> Column:
    return F.lower(F.regexp_extract(segment, r"^([A-Za-z]{2,3})(?:-(?:[A-Za-z]{2}|\d{3}))?$", 1))


def locale_region(segment: Column) -> Column:
    return F.lower(F.regexp_extract(segment, r"^[A-Za-z]{2,3}-([A-Za-z]{2}|\d{3})$", 1))


def is_locale_excluded(p: Column) -> Column:
    """Another market or language than kept, by the first segment; false at the root and if it does not parse."""
    first = F.coalesce(first_segment(p), F.lit(""))
    language, region = locale_language(first), locale_region(first)
    market = F.when(region != "", region).otherwise(language)
    dropped = market.isin(*config.DROPPED_REGIONS) & (first != config.KEPT_REGION)
    foreign = language.isin(*config.LANGUAGES) & (first != config.KEPT_REGION)
    return F.coalesce((language != "") & (dropped | foreign), F.lit(False))


def strip_english(p: Column) -> Column:
    """Path without a leading ``en`` or ``en-xx``; kept where its market is a dropped one."""
    first = F.coalesce(first_segment(p), F.lit(""))
    english = (locale_language(first) == "en") & ~locale_region(first).isin(*config.DROPPED_REGIONS)
    rest = F.concat(F.lit("/"), F.array_join(F.slice(p["segments"], 2, F.greatest(F.size(p["segments"]) - 1, F.lit(0))), "/"))
    return F.when(english, rest).otherwise(p["path"])


def locale_normalize(p: Column) -> Column:
    """URL with the English prefix stripped; null where its locale is excluded."""
    return F.when(p["ok"] & ~is_locale_excluded(p), _with_query(F.concat(origin_of(p), strip_english(p)), p["query"]))


def sample_url(p: Column, raw: Column) -> Column:
    """URL for a report: without credentials, query and fragment; a bad one is cut before ``?`` or ``#``, at most 500 characters."""
    return F.when(p["ok"], F.concat(origin_of(p), p["path"])).otherwise(F.substring(F.regexp_replace(raw, r"(?s)[?#].*$", ""), 1, 500))


def report_path(p: Column) -> Column:
    """Origin and path without a trailing slash."""
    return F.when(p["ok"], F.regexp_replace(F.concat(origin_of(p), p["path"]), "/$", ""))


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 24)


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of links relative to a base URL, without fragments; null where there is none."""
    def apply(hrefs: pd.Series, bases: pd.Series) -> pd.Series:
        known: dict[str, urlparse.Url | None] = {}
        out = []
        for raw, page in zip(hrefs, bases):
            if isinstance(page, str) and page not in known:
                known[page] = urlparse.parse(page)
            url = urlparse.parse(raw, known.get(page)) if isinstance(raw, str) and raw.strip() else None
            out.append(url.href() if url is not None else None)
        return pd.Series(out, dtype="object")

    apply.__annotations__ = {"hrefs": pd.Series, "bases": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, "string")(href, base)


def canonical_key(href: Column, page_url: Column, scope: Column) -> Column:
    """Dedup key of a declared canonical link, if it is on the scope's site (``scope``: parsed parts)."""
    target = url_parts(resolve(href, page_url))
    return F.when(is_same_site(target, scope), dedup_key(target))
