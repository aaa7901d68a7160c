"""SQL for DuckDB that gives the same results as the queries, written from the rules and their fixed values."""

from __future__ import annotations

from sparkloom import config
from sparkloom.config import EDITORIAL, EVIDENCE, OTHER, PRODUCT, SECTIONS


def _list(values: object) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"  # type: ignore[attr-defined]


def _in(values: object) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"  # type: ignore[attr-defined]


_PAGES = "pages AS (SELECT DISTINCT page_id, url FROM ingest_pages)"
#: Parts of plain web URLs by regular expressions: scheme, host, path, query.
_PARTS = r"""
  lower(regexp_extract({c}, '^(https?)://', 1)) AS scheme, lower(regexp_extract({c}, '^https?://([^/?#]+)', 1)) AS host,
  CASE WHEN regexp_extract({c}, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({c}, '^https?://[^/?#]+([^?#]*)', 1) END AS path,
  nullif(regexp_extract({c}, '^[^?#]*\?([^#]*)', 1), '') AS query
"""
_SPLIT = "list_filter(string_split(coalesce(query, ''), '&'), lambda p: p <> '')"


def _kept(keys: tuple[str, ...]) -> str:
    return f"list_filter({_SPLIT}, lambda p: NOT list_contains({_list(keys)}, lower(split_part(p, '=', 1))))"


_EQ = "list_transform({}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)"


def _suffix(query: str) -> str:
    return f"CASE WHEN coalesce({query}, '') = '' THEN '' ELSE '?' || {query} END"


def _url(select: str) -> str:
    return f"WITH {_PAGES}, parts AS (SELECT page_id, url, {_PARTS.format(c='url')} FROM pages) SELECT page_id, url, {select} FROM parts"


_VARIED = rf"""
{_PAGES}, base AS (
  SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || {_list(('/fr', '/en-gb', '/us', '/en', '/legal', '', ''))}[page_id % 7 + 1]
    || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/$', '')
    || {_list(('/page/2', '/2024/05', '/how-to-start', '/setup-guide', '', '?q=a', '?a=1&b=2&c=3', '?sort=name', ''))}[page_id % 9 + 1] AS url
  FROM pages WHERE page_id IS NOT NULL),
cut AS (SELECT page_id, url, {_PARTS.format(c='url')} FROM base),
varied AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM cut),
loc AS (SELECT *, coalesce(lower(segs[1]), '') AS first,
  regexp_extract(coalesce(lower(segs[1]), ''), '^([a-z]{{2,3}})(?:-(?:[a-z]{{2}}|[0-9]{{3}}))?$', 1) AS lang,
  regexp_extract(coalesce(lower(segs[1]), ''), '^[a-z]{{2,3}}-([a-z]{{2}}|[0-9]{{3}})$', 1) AS region FROM varied),
excl AS (SELECT *, lang <> '' AND first <> '{config.KEPT_REGION}' AND (lang IN {_in(config.LANGUAGES)} OR (CASE WHEN region <> '' THEN region ELSE lang END) IN {_in(config.DROPPED_REGIONS)}) AS excluded FROM loc)
"""


def _vocabulary(pick: str, tiers: tuple[str, ...]) -> str:
    cases = []
    for tier in tiers:
        for e in SECTIONS:
            if e.tier == tier:
                cases.append(f"WHEN regexp_matches(s, '^{e.pattern}$'){' AND i = 1' if e.first_only else ''} THEN '{getattr(e, pick)}'")
    return f"list_filter(list_transform(list_transform(segs, lambda x: lower(x)), lambda s, i: CASE {' '.join(cases)} END), lambda x: x IS NOT NULL)[1]"


_LOW = "list_transform(segs, lambda x: lower(x))"
_TIER = f"""CASE WHEN len(segs) = 0 THEN '{OTHER}' WHEN regexp_matches(array_to_string({_LOW}, '/'), '{config.STRONG_EDITORIAL}') THEN '{EDITORIAL}'
  WHEN {_vocabulary('tier', (PRODUCT, EVIDENCE, EDITORIAL))} IS NOT NULL THEN {_vocabulary('tier', (PRODUCT, EVIDENCE, EDITORIAL))}
  WHEN regexp_matches(array_to_string({_LOW}, '/'), '{config.WEAK_EDITORIAL}') THEN '{EDITORIAL}' ELSE '{OTHER}' END"""
_SECTION = f"coalesce({_vocabulary('name', (EVIDENCE, EDITORIAL, OTHER))}, '')"
_KEY = "regexp_replace(lower(split_part(p, '=', 1)), '\\[.*$', '')"
_TRAP = rf"""CASE WHEN regexp_matches('/' || array_to_string({_LOW}, '/') || '/', '/page/[0-9]+/') THEN 'pagination' WHEN lower(segs[1]) = 'search' THEN 'search'
  WHEN regexp_matches(array_to_string({_LOW}, '/'), '(?:^|/)(?:19|20)[0-9]{{2}}(?:-[0-9]{{1,2}}){{0,2}}$|(?:^|/)(?:19|20)[0-9]{{2}}/[0-9]{{1,2}}(?:/[0-9]{{1,2}})?$') THEN 'calendar'
  ELSE coalesce(list_filter(list_transform({_SPLIT}, lambda p: CASE WHEN {_KEY} IN {_in(config.PAGINATION_KEYS)} AND regexp_matches(split_part(p, '=', 2), '^[0-9]+$') THEN 'pagination'
    WHEN {_KEY} IN {_in(config.SEARCH_KEYS)} THEN 'search' WHEN {_KEY} IN {_in(config.CALENDAR_KEYS)} THEN 'calendar' WHEN {_KEY} IN {_in(config.FACET_KEYS)} THEN 'facet' END), lambda x: x IS NOT NULL)[1],
    CASE WHEN len(list_distinct(list_transform({_SPLIT}, lambda p: {_KEY}))) > 2 THEN 'facet' END) END"""
_SITE = "regexp_replace(host, '^www\\.', '')"
_TRIMMED = "CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END"
_LAST_RUN = r"""runs AS (SELECT DISTINCT run_id, seed, crawl_type, lower(trim(status)) AS status, error_summary,
  coalesce(try_strptime(created_at_utc, '%Y-%m-%dT%H:%M:%S.%fZ'), try_strptime(created_at_utc, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(created_at_utc, '%Y-%m-%d %H:%M:%S')) AS created_at,
  coalesce(try_strptime(purged_at_utc, '%Y-%m-%dT%H:%M:%S.%fZ'), try_strptime(purged_at_utc, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(purged_at_utc, '%Y-%m-%d %H:%M:%S')) AS purged_at, pages_saved, links_saved FROM crawl_runs)"""
_PRESENCE = "presence AS (SELECT run_id, CASE links_saved % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' ELSE 'unknown' END AS kind, CASE WHEN links_saved % 2 = 0 THEN 'complete' END AS remote_status FROM runs)"
_LENGTHS = r"""lens AS (SELECT page_id, min(url) AS url, max(list_sum(list_transform(blocks, lambda b: length(coalesce(b.text, array_to_string(b.cells, ' '), ''))))) AS length FROM ingest_pages WHERE blocks IS NOT NULL GROUP BY page_id),
sized AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') AS site, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1), ''), '(root)') AS section, coalesce(length, 0) AS length FROM lens)"""
_BLOCKS = "rows AS (SELECT page_id, i - 1 AS block_no, min(kind) AS kind, min(text) AS text FROM (SELECT page_id, unnest(range(1, len(blocks) + 1)) AS i, unnest(list_transform(blocks, lambda b: b.kind)) AS kind, unnest(list_transform(blocks, lambda b: coalesce(b.text, array_to_string(b.cells, ' '), ''))) AS text FROM ingest_pages WHERE blocks IS NOT NULL) GROUP BY 1, 2)"
_SPACES = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_HASH = f"sha256(trim(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g'), ' '))"
_CAPS = config.section_caps("templates:2,glossary:1,blog:3,news:3,help:2,tools:2,customers:2,guides:3")
_FRONTIER = f"""
docs AS (SELECT DISTINCT url FROM documents WHERE url IS NOT NULL AND doc_id IS NOT NULL), cut AS (SELECT url, {_PARTS.format(c='url')} FROM docs),
seg AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM cut),
front AS (SELECT {_SITE} AS site, url, {_TIER} AS tier, {_SECTION} AS section, len(segs) AS depth FROM seg),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE tier WHEN '{PRODUCT}' THEN 0 WHEN '{EVIDENCE}' THEN 1 WHEN '{OTHER}' THEN 2 ELSE 3 END, depth, url) AS rank FROM front),
capped AS (SELECT *, section = '' OR NOT map_contains(caps, section) OR row_number() OVER (PARTITION BY site, section ORDER BY rank) <= caps[section] AS cap_ok
  FROM (SELECT *, map({_list(_CAPS)}, {list(_CAPS.values())}) AS caps FROM ranked)),
counted AS (SELECT *, count(*) FILTER (tier IN ('{PRODUCT}', '{OTHER}') AND cap_ok) OVER (PARTITION BY site) AS n,
  count(*) FILTER (tier = '{EDITORIAL}' AND cap_ok) OVER (PARTITION BY site ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM capped),
decided AS (SELECT site, rank, url, section, CASE WHEN tier = '{EDITORIAL}' AND before >= (CASE WHEN n = 0 THEN {config.EDITORIAL_FLOOR} ELSE n // {config.EDITORIAL_PER} END) THEN 'share' WHEN NOT cap_ok THEN 'section' ELSE 'admitted' END AS outcome FROM counted)
"""
_ORIGIN_KEY = r"lower(regexp_extract({c}, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract({c}, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '')"
_STATELESS = f"""
{_LENGTHS}, one AS (SELECT page_id AS seq, min(url) AS url, max(status_code) AS status, min(coalesce(robots_allowed, true)) AS robots, max(strlen(html)) AS size FROM ingest_pages GROUP BY page_id),
judged AS (SELECT one.seq, one.url, coalesce(CAST(status AS VARCHAR), 'none') AS detail, CASE WHEN NOT robots THEN 'robots_disallowed' WHEN status IN (401, 403, 429) THEN 'challenge_page' WHEN status >= 400 THEN 'request_failed'
  WHEN size IS NULL OR size < {config.VIABLE_BYTES} THEN 'requires_javascript' WHEN coalesce(sized.length, 0) < {config.PROSE_FLOOR} THEN 'extract_empty' END AS reason FROM one LEFT JOIN sized ON sized.page_id = one.seq)
"""
_CAUSE = r"""CASE WHEN coalesce(error_summary, '') = '' THEN 'no reason recorded' WHEN contains(error_summary, '→ transport:') THEN 'transport failure (no response)' || onn
  WHEN regexp_matches(error_summary, '(?i)application not found') THEN 'platform proxy 404 (service not running)' || onn WHEN regexp_matches(error_summary, '(?i)no usable pages') THEN 'store: crawl complete with no usable pages'
  WHEN regexp_matches(error_summary, '(?i)no extracted content') THEN 'store: pages carry no extracted content' WHEN regexp_matches(error_summary, '(?i)exceeds atomic max') THEN 'batch exceeded the atomic maximum'
  WHEN regexp_matches(error_summary, '(?i)nothing extractable') THEN 'early abort: nothing extractable' WHEN regexp_matches(error_summary, '(?i)robots') THEN 'robots.txt disallowed the crawl'
  WHEN regexp_matches(error_summary, '(?i)cancelled by operator') THEN 'cancelled by operator' WHEN regexp_extract(error_summary, '→ ([0-9]{3})\b', 1) <> '' THEN 'HTTP ' || regexp_extract(error_summary, '→ ([0-9]{3})\b', 1) || onn ELSE substr(error_summary, 1, 80) END"""
_ON = r"CASE WHEN regexp_extract(coalesce(error_summary, ''), '/((?:pages|links)/batch)\b', 1) <> '' THEN ' on ' || regexp_extract(error_summary, '/((?:pages|links)/batch)\b', 1) WHEN regexp_matches(coalesce(error_summary, ''), '/runs\b') THEN ' on runs' ELSE '' END"

ORACLES: dict[str, str] = {
    "page_scope_outcomes": f"WITH {_VARIED} SELECT {_SITE} AS site, coalesce(segs[1], '(root)') AS section, CASE WHEN excluded THEN 'locale_excluded' WHEN first IN {_in(config.NON_CONTENT)} THEN 'non_content_directory' ELSE 'in_scope' END AS outcome, count(*) AS n_pages FROM excl GROUP BY 1, 2, 3",
    "url_normalize": _url(f"scheme || '://' || host || path || (CASE WHEN len({_kept(config.TRACKING_KEYS)}) = len({_SPLIT}) THEN {_suffix('query')} ELSE {_suffix(f'array_to_string({_EQ.format(_kept(config.TRACKING_KEYS))}, chr(38))')} END) AS normal_url"),
    "url_dedup_key": _url(f"scheme || '://' || host || path || {_suffix(f'array_to_string({_EQ.format(_kept(config.NOISE_KEYS))}, chr(38))')} AS dedup_key"),
    "url_dedup_key_aggressive": _url(f"'https://' || {_SITE} || lower({_TRIMMED.replace('path', 'regexp_replace(path, ' + repr('(?i)/index.html?$') + ', ' + repr('/') + ')')}) || {_suffix(f'array_to_string(list_sort({_EQ.format(_kept(config.NOISE_KEYS))}), chr(38))')} AS dedup_key"),
    "url_member_key": _url(f"{_SITE} || {_TRIMMED} || {_suffix('query')} AS member_key"),
    "url_locale_normalize": f"WITH {_VARIED} SELECT page_id, url, CASE WHEN NOT excluded THEN scheme || '://' || host || (CASE WHEN lang = 'en' AND region NOT IN {_in(config.DROPPED_REGIONS)} THEN '/' || array_to_string(segs[2:], '/') ELSE path END) || {_suffix('query')} END AS locale_url FROM excl",
    "path_classes": f"WITH {_VARIED} SELECT page_id, url, {_TIER} AS tier, {_SECTION} AS section, {_TRAP} AS trap FROM varied",
    "composition_by_tier": f"WITH {_VARIED} SELECT {_TIER} AS tier, count(*) AS n_pages FROM varied GROUP BY 1",
    "link_scope": r"WITH l AS (SELECT DISTINCT page_id, from_url, link_url, is_same_origin FROM crawl_links) SELECT coalesce(lower(regexp_extract(link_url, '^(https?)://', 1)) = lower(regexp_extract(from_url, '^(https?)://', 1)) AND regexp_replace(lower(regexp_extract(link_url, '^https?://([^/?#]+)', 1)), '^www\.', '') = regexp_replace(lower(regexp_extract(from_url, '^https?://([^/?#]+)', 1)), '^www\.', ''), false) AS same_site, is_same_origin, count(*) AS n_links FROM l GROUP BY 1, 2",
    "link_hosts": r"WITH l AS (SELECT DISTINCT page_id, link_url FROM crawl_links) SELECT regexp_replace(lower(regexp_extract(link_url, '^https?://([^/?#]+)', 1)), '^www\.', '') AS host, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM l GROUP BY 1",
    "link_membership": f"WITH {_PAGES}, a AS (SELECT DISTINCT {_SITE} || {_TRIMMED} || {_suffix('query')} AS k FROM (SELECT {_PARTS.format(c='link_url')} FROM crawl_links)), b AS (SELECT DISTINCT {_SITE} || {_TRIMMED} || {_suffix('query')} AS k FROM (SELECT {_PARTS.format(c='url')} FROM pages)) SELECT a.k IN (SELECT k FROM b) AS listed, count(*) AS n_targets FROM a GROUP BY 1",
    "pages_by_origin": f"WITH p AS (SELECT page_id, max(html IS NOT NULL) AS has_html, min(origin) AS origin FROM ingest_pages GROUP BY page_id) SELECT {_ORIGIN_KEY.format(c='origin')} AS origin_key, count(*) AS n_pages, count(*) FILTER (has_html) AS n_with_html FROM p GROUP BY 1",
    "block_kinds": f"WITH {_BLOCKS} SELECT kind, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM rows GROUP BY 1",
    "block_islands": f"WITH {_BLOCKS}, f AS (SELECT *, CASE WHEN block_no = 0 OR lag(kind) OVER w IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS ch FROM rows WINDOW w AS (PARTITION BY page_id ORDER BY block_no)), g AS (SELECT page_id, kind, sum(ch) OVER (PARTITION BY page_id ORDER BY block_no) AS island FROM f), s AS (SELECT page_id, island, kind, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT kind, n, count(*) AS n_islands FROM s GROUP BY 1, 2",
    "corpus_summary": f"WITH {_LENGTHS} SELECT site, section, count(*) AS pages, list_sort(list(length))[count(*) // 2 + 1] AS median_prose, count(*) FILTER (length < {config.THIN_CHARS}) AS thin_pages, round(count(*) / sum(count(*)) OVER (PARTITION BY site), 6) AS share FROM sized GROUP BY site, section",
    "doc_content_hash": f"SELECT doc_id, {_HASH} AS content_hash FROM documents",
    "doc_exact_duplicates": f"WITH h AS (SELECT doc_id, {_HASH} AS k FROM documents WHERE text IS NOT NULL) SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first_of, doc_id = min(doc_id) OVER (PARTITION BY k) AS is_first FROM h",
    "ledger_near_pairs": rf"WITH r AS (SELECT DISTINCT page_id AS id, CAST('0x' || regexp_replace(lower(trim(simhash)), '^0x', '') AS UBIGINT) AS s FROM dedup_accepted WHERE content_length >= {config.NEAR_CHARS} AND regexp_matches(regexp_replace(lower(trim(simhash)), '^0x', ''), '^[0-9a-f]{{1,16}}$') AND page_id IS NOT NULL) SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.s, b.s)) AS INTEGER) AS distance FROM r a JOIN r b ON a.id < b.id WHERE bit_count(xor(a.s, b.s)) <= {config.NEAR_HAMMING}",
    "section_quota": f"WITH {_FRONTIER} SELECT site, rank, url, section, outcome FROM decided",
    "quota_report": f"WITH {_FRONTIER} SELECT site, section, count(*) FILTER (outcome = 'admitted') AS n_admitted, count(*) FILTER (outcome = 'section') AS n_by_section, count(*) FILTER (outcome = 'share') AS n_by_share FROM decided GROUP BY 1, 2",
    "budget_cut": f"WITH {_FRONTIER} SELECT site, place, url FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY rank) AS place FROM decided WHERE outcome = 'admitted') WHERE place <= 20",
    "reject_counters": f"WITH {_STATELESS} SELECT {', '.join(f'count(*) FILTER (reason = {r!r}) AS {r}' for r in config.REJECT_REASONS)} FROM judged",
    "reject_samples": f"WITH {_STATELESS} SELECT reason, row_number() OVER (PARTITION BY reason ORDER BY seq) AS rank, seq, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS url, detail FROM judged WHERE reason IS NOT NULL QUALIFY rank <= {config.SAMPLES}",
    "early_abort": f"WITH o AS (SELECT CAST(user_id % 20 AS VARCHAR) AS run, event_id AS seq, CASE WHEN event_type = 'error' THEN 'barren' WHEN event_type = 'purchase' AND value >= 100 THEN 'saved' END AS outcome FROM events), r AS (SELECT run, seq, outcome, count(*) FILTER (outcome = 'barren') OVER w AS barren, count(*) FILTER (outcome = 'saved') OVER w AS saved FROM o WHERE outcome IS NOT NULL WINDOW w AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT run, seq, barren, saved FROM r WHERE outcome = 'barren' AND barren >= {config.ABORT_AFTER} AND saved * {config.ABORT_RATIO} < barren QUALIFY row_number() OVER (PARTITION BY run ORDER BY seq) = 1",
    "failure_causes": f"WITH {_LAST_RUN}, f AS (SELECT *, {_ON} AS onn FROM runs) SELECT {_CAUSE} AS cause, count(*) AS n_runs, CAST(sum(coalesce(pages_saved, 0)) AS BIGINT) AS n_pages FROM f GROUP BY 1",
    "failure_lines": f"""WITH f AS (SELECT DISTINCT * FROM crawl_runs), g AS (SELECT *, {_ON} AS onn, trim(coalesce(purged_at_utc, '')) <> '' AS gone FROM f), c AS (SELECT *, {_CAUSE} AS cause FROM g),
t AS (SELECT count(*) AS total, count(*) FILTER (gone) AS purged, CAST(coalesce(sum(coalesce(pages_saved, 0)) FILTER (gone), 0) AS BIGINT) AS lost FROM c),
k AS (SELECT cause, count(*) AS n_runs, CAST(sum(coalesce(pages_saved, 0)) AS BIGINT) AS n_pages FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY created_at_utc DESC NULLS LAST, run_id) AS n FROM c)
SELECT 1 AS part, 1 AS n, CASE WHEN total = 0 THEN 'No failure post-mortems in data/failures' ELSE total || ' failure post-mortem(s) in data/failures' END AS line FROM t
UNION ALL SELECT 1, 2, '  ' || purged || ' purged (' || lost || ' page(s) gone)' || CASE WHEN total > purged THEN ', ' || (total - purged) || ' not purged' ELSE '' END FROM t WHERE total > 0
UNION ALL SELECT 2, row_number() OVER (ORDER BY n_pages DESC, n_runs DESC, cause), printf('  %s  %3d run(s)  %5d page(s)', rpad(cause, CAST((SELECT max(length(cause)) FROM k) AS INTEGER), ' '), n_runs, n_pages) FROM k
UNION ALL SELECT 3, 2 * n - 1, printf('  %s  %s  %5d page(s)  %s  %s', created_at_utc, CASE WHEN gone THEN 'purged    ' ELSE 'not purged' END, coalesce(pages_saved, 0), run_id, seed) FROM r
UNION ALL SELECT 3, 2 * n, '      ' || cause FROM r""",
    "failure_totals": "WITH f AS (SELECT DISTINCT * FROM crawl_runs WHERE lower(trim(status)) IN ('failed', 'cancelled')) SELECT count(*) AS total, count(*) FILTER (trim(coalesce(purged_at_utc, '')) <> '') AS purged, CAST(coalesce(sum(coalesce(pages_saved, 0)) FILTER (trim(coalesce(purged_at_utc, '')) <> ''), 0) AS BIGINT) AS pages_lost FROM f",
    "run_reconcile": f"WITH {_LAST_RUN}, {_PRESENCE}, j AS (SELECT r.*, coalesce(p.kind, 'unknown') AS kind, p.remote_status FROM runs r LEFT JOIN presence p USING (run_id) WHERE status IN ('pending', 'running')), o AS (SELECT run_id, status, pages_saved, CASE WHEN pages_saved % 4 = 0 THEN 'skipped_live' WHEN pages_saved IS NULL THEN 'problem' WHEN pages_saved < {config.STALE_MINUTES} THEN 'skipped_recent' WHEN kind = 'unknown' OR (kind = 'present' AND remote_status IS NULL) THEN 'unknown' WHEN kind = 'present' AND remote_status = 'complete' THEN 'skipped_complete' ELSE 'reconciled' END AS outcome FROM j) SELECT run_id, outcome, CASE WHEN outcome = 'reconciled' THEN 'run ended without a record: ' || status || ' for ' || pages_saved || ' minutes' END AS summary FROM o",
    "run_superseded": f"WITH {_LAST_RUN}, {_PRESENCE} SELECT r.run_id, CASE WHEN r.pages_saved % 4 = 0 OR coalesce(p.kind, 'unknown') = 'present' THEN 'kept' WHEN p.kind = 'absent' THEN 'removed' ELSE 'unknown' END AS outcome FROM runs r LEFT JOIN presence p USING (run_id) WHERE status = 'complete'",
    "indexed_report": f"WITH {_LAST_RUN} SELECT CASE WHEN pages_saved % 7 = 0 THEN 'not_indexed' WHEN pages_saved % 5 = 0 THEN 'indexing' WHEN pages_saved % 5 = 1 THEN 'queued' WHEN pages_saved % 5 = 2 THEN 'failed' ELSE 'indexed' END AS state, count(*) AS n_runs FROM runs GROUP BY 1",
    "size_admission": f"WITH b AS (SELECT page_id, html, 512 + {' + '.join(f'coalesce(strlen({c}) + 24, 0)' for c in ('origin', 'url', 'final_url', 'content_html', 'title', 'excerpt', 'failure_reason'))} AS bare FROM ingest_pages) SELECT DISTINCT page_id, CASE WHEN bare + coalesce(strlen(html) + 24, 0) <= 12000 THEN 'whole' WHEN bare <= 12000 THEN 'without_html' ELSE 'refused' END AS admission, html IS NOT NULL AND bare + coalesce(strlen(html) + 24, 0) <= 12000 AS has_html FROM b",
    "link_batches": "WITH l AS (SELECT DISTINCT page_id, link_url FROM crawl_links WHERE page_id IS NOT NULL AND link_url IS NOT NULL), r AS (SELECT page_id, (row_number() OVER w - 1) // 5 AS a, (sum(strlen(link_url)) OVER w - 1) // 400 AS b FROM l WINDOW w AS (PARTITION BY page_id ORDER BY link_url ROWS UNBOUNDED PRECEDING)), d AS (SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY a, b) AS batch FROM r) SELECT page_id, CAST(batch AS INTEGER) AS batch, count(*) AS n_links FROM d GROUP BY 1, 2",
    "stream_first_wins": "SELECT DISTINCT user_id, event_type FROM events",
    "corpus_summary_lines": f"""WITH {_LENGTHS}, s AS (SELECT site, section, count(*) AS pages, list_sort(list(length))[count(*) // 2 + 1] AS median_prose, count(*) FILTER (length < 500) AS thin_pages, count(*) / sum(count(*)) OVER (PARTITION BY site) AS share FROM sized GROUP BY site, section),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pages DESC, section) AS rank FROM s)
SELECT site, CAST(rank AS INTEGER) AS rank, printf('%s: %d pages (%.1f%%), median %d, thin %d', section, pages, round(share * 100, 1), median_prose, CAST(thin_pages AS BIGINT)) AS line FROM r WHERE rank <= 16
UNION ALL SELECT site, 17, printf('and %d more sections with %d pages', count(*), CAST(sum(pages) AS BIGINT)) FROM r WHERE rank > 16 GROUP BY site""",
    "robots_gate": f"""WITH {_PAGES}, p AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '#.*$', '') AS path FROM pages)
SELECT length(lower(origin)) % 3 = 0 OR NOT ((starts_with(path, '/help') AND NOT starts_with(path, '/help/a')) OR (starts_with(path, '/news') AND contains(path, '?utm'))) AS robots_allowed, count(*) AS n_pages FROM p GROUP BY 1""",
    "url_listing": "WITH p AS (SELECT page_id, min(url) AS url FROM ingest_pages WHERE page_id IS NOT NULL GROUP BY page_id ORDER BY page_id LIMIT 50 OFFSET 50) SELECT page_id, url, count(*) OVER () >= 50 AS has_more FROM p",
    "doc_simhash": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents),
g AS (SELECT doc_id, sha256(array_to_string(words[i:i + 4], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
b AS (SELECT doc_id, k, 2 * sum((CAST('0x' || substr(h, 1, 16) AS UBIGINT) >> CAST(k AS UBIGINT)) & 1) >= count(*) AS bit FROM g, range(64) r(k) GROUP BY 1, 2),
d AS (SELECT doc_id, k // 4 AS digit, sum(CASE WHEN bit THEN 1 << (k % 4) ELSE 0 END) AS v FROM b GROUP BY 1, 2),
x AS (SELECT doc_id, string_agg(substr('0123456789abcdef', CAST(v AS INTEGER) + 1, 1), '' ORDER BY digit DESC) AS simhash FROM d GROUP BY 1)
SELECT w.doc_id, coalesce(x.simhash, repeat('0', 16)) AS simhash FROM w LEFT JOIN x ON x.doc_id = w.doc_id""",
    "ledger_aliases": """WITH RECURSIVE learned AS (SELECT DISTINCT page_id AS seq, unnest(list_prepend(requested_url_key, coalesce(alias_keys, []))) AS variant, coalesce(final_url_key, requested_url_key) AS rep FROM dedup_accepted),
edges AS (SELECT variant, arg_max(rep, seq) AS rep FROM learned WHERE variant IS NOT NULL AND rep IS NOT NULL AND variant <> '' AND rep <> '' AND variant <> rep GROUP BY variant),
walk AS (SELECT variant AS key, variant AS node, 0 AS n, [variant] AS seen FROM edges UNION ALL SELECT key, e.rep, n + 1, list_append(seen, e.rep) FROM walk JOIN edges e ON e.variant = walk.node WHERE n < 16 AND NOT list_contains(seen, e.rep))
SELECT key, arg_max(node, n) AS resolved FROM walk GROUP BY key""",
    "run_records": f"""WITH {_LAST_RUN} SELECT run_id, regexp_replace(regexp_replace(trim(seed), '#.*$', ''), '^(https?://[^/]+)/$', '\\1') AS seed, crawl_type, status,
CASE WHEN status = 'complete' THEN 'finished' WHEN status = 'failed' THEN 'stopped by an error' WHEN status = 'cancelled' THEN 'stopped by an operator' WHEN status IN ('pending', 'running') THEN 'in progress' ELSE coalesce(status, 'unknown') END AS status_text, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, pages_saved FROM runs""",
    "seed_report": f"""WITH {_LAST_RUN}, r AS (SELECT run_id, seed, status, pages_saved, {_ORIGIN_KEY.format(c='seed')} AS k FROM runs), tally AS (SELECT run_id, {_ORIGIN_KEY.format(c='origin')} AS k, count(DISTINCT page_id) AS n FROM ingest_pages GROUP BY 1, 2),
paths AS (SELECT seed, max(pages_saved) * 2 AS n_paths FROM r GROUP BY 1), j AS (SELECT r.run_id, r.seed, r.status, coalesce(t.n, CASE WHEN pages_saved % 3 = 0 THEN pages_saved END, CASE WHEN pages_saved % 2 = 0 THEN pages_saved + 1 END, pages_saved, 0) AS n_pages,
CASE WHEN pages_saved % 3 = 0 THEN 'host stopped' WHEN r.status = 'failed' THEN 'run failed' END AS reason, n_paths FROM r LEFT JOIN tally t ON t.run_id = r.run_id AND t.k = r.k LEFT JOIN paths p ON p.seed = r.seed)
SELECT *, CASE WHEN n_paths > 0 THEN CAST(CAST(least(100, floor(n_pages * 100.0 / least(n_paths, {config.MAX_PAGES}) + 0.5)) AS INTEGER) AS VARCHAR) || '%' ELSE status END AS completed FROM j""",
}
ORACLES["stream_abort"] = ORACLES["early_abort"]
