"""SQL for DuckDB that gives the same results as some queries of this folder, over the whole tables."""

from __future__ import annotations

_TEXT = "coalesce(b.text, array_to_string(b.cells, ' '), '')"
_PAGES = f"pages AS (SELECT DISTINCT ON (page_id) page_id, origin, list_transform(blocks, lambda b: {_TEXT}) AS texts FROM ingest_pages WHERE blocks IS NOT NULL AND page_id IS NOT NULL)"
_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(origin)), '^[a-z][a-z0-9+.\-]*://', ''), '[/?#].*$', ''), '^www\.', '')"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_LINES = f"""{_PAGES}, lines AS (SELECT {_HOST} AS host, page_id, i - 1 AS block_no, regexp_replace(lower(t), '[^\\p{{L}}]+', '', 'g') AS k FROM (SELECT page_id, origin, unnest(range(1, len(texts) + 1)) AS i, unnest(texts) AS t FROM pages) WHERE origin IS NOT NULL),
sizes AS (SELECT {_HOST} AS host, count(*) AS n FROM pages WHERE len(texts) > 0 AND origin IS NOT NULL GROUP BY 1),
counted AS (SELECT host, k, count(DISTINCT page_id) AS c FROM lines WHERE k <> '' GROUP BY 1, 2), repeated AS (SELECT host, k, c, n FROM counted JOIN sizes USING (host) WHERE c >= 5 AND c >= n * 0.2)"""

ORACLES: dict[str, str] = {
    "p1_found": f"""WITH {_PAGES}, lim AS (SELECT DISTINCT limit_name, max_size FROM size_limits WHERE unit = 'chars' AND max_size > 0),
sized AS (SELECT page_id, length(array_to_string(texts, chr(10))) AS n, list_transform(texts, lambda t: length(t)) AS sizes FROM pages),
items AS (SELECT page_id, n AS whole, -1 AS block_no, n FROM sized UNION ALL SELECT page_id, n, unnest(range(0, len(sizes))), unnest(sizes) FROM sized)
SELECT limit_name, page_id, CAST(block_no AS BIGINT) AS block_no FROM items JOIN lim ON items.n > lim.max_size AND whole > lim.max_size""",
    "p2_found": f"""WITH {_PAGES}, w AS (SELECT page_id, {_WORDS.format("array_to_string(texts, chr(10))")} AS words FROM pages),
grams AS (SELECT page_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT page_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
again AS (SELECT page_id, i FROM grams QUALIFY row_number() OVER (PARTITION BY page_id, gram ORDER BY i) > 1), marked AS (SELECT DISTINCT page_id, unnest(range(i, i + 5)) AS p FROM again),
shares AS (SELECT page_id, count(*) AS c FROM marked GROUP BY 1) SELECT w.page_id FROM w JOIN shares USING (page_id) WHERE c / len(words) >= 0.3""",
    "p3_found": f"WITH {_LINES} SELECT DISTINCT l.page_id, CAST(l.block_no AS BIGINT) AS block_no FROM lines l JOIN repeated r ON l.host = r.host AND l.k = r.k",
    "p3_lines": f"WITH {_LINES} SELECT host, md5(k) AS line_key, c AS k, n FROM repeated",
    "p4_found": rf"""WITH ok AS (SELECT DISTINCT page_id FROM dedup_accepted WHERE content_length >= 500), t AS (SELECT DISTINCT ON (page_id) page_id,
  {_WORDS.format("regexp_replace(regexp_replace(content_html, '<[^>]*>', ' ', 'g'), '&(amp|lt|gt|quot|nbsp|#39|#x27);', ' ', 'g')")} AS words FROM ingest_pages WHERE content_html IS NOT NULL AND page_id IN (SELECT page_id FROM ok)),
g AS (SELECT DISTINCT page_id, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT page_id, words, unnest(range(1, len(words) - 3)) AS i FROM t WHERE len(words) >= 5)), n AS (SELECT page_id, count(*) AS n FROM g GROUP BY 1),
both_ AS (SELECT a.page_id AS page_a, b.page_id AS page_b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.page_id < b.page_id GROUP BY 1, 2)
SELECT page_a, page_b FROM both_ JOIN n x ON x.page_id = page_a JOIN n y ON y.page_id = page_b WHERE c / (x.n + y.n - c) >= 0.6""",
    "p3_clean": f"""WITH {_LINES}, raw AS (SELECT page_id, i - 1 AS block_no, t, len(texts) AS n FROM (SELECT page_id, texts, unnest(range(1, len(texts) + 1)) AS i, unnest(texts) AS t FROM pages)),
gone AS (SELECT DISTINCT l.page_id, l.block_no FROM lines l JOIN repeated r ON l.host = r.host AND l.k = r.k),
left_ AS (SELECT page_id, count(*) AS kept, string_agg(t, chr(10) ORDER BY block_no) AS text FROM raw ANTI JOIN gone USING (page_id, block_no) GROUP BY 1)
SELECT p.page_id, CAST(len(p.texts) AS BIGINT) AS n_blocks, coalesce(kept, 0) AS kept, coalesce(text, '') AS text FROM pages p LEFT JOIN left_ USING (page_id)""",
}
_SPACE = r"[\t-\r \x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _parts(of: str) -> str:
    return f"list_filter(list_transform({of}, lambda x: regexp_replace(regexp_replace(x, '^{_SPACE}+', ''), '{_SPACE}+$', '')), lambda x: x <> '')"


_SENTENCES = f"string_split(regexp_replace(regexp_replace(low, '([.!?。！？]){_SPACE}+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))"
ORACLES["p2_share"] = f"""WITH {_PAGES}, t AS (SELECT page_id, lower(array_to_string(texts, chr(10))) AS low, {_WORDS.format("array_to_string(texts, chr(10))")} AS words FROM pages),
l AS (SELECT *, {_parts('string_split(low, chr(10))')} AS lines, {_parts(_SENTENCES)} AS sentences FROM t),
grams AS (SELECT page_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT page_id, words, unnest(range(1, len(words) - 3)) AS i FROM t WHERE len(words) >= 5)),
again AS (SELECT page_id, i FROM grams QUALIFY row_number() OVER (PARTITION BY page_id, gram ORDER BY i) > 1), runs AS (SELECT page_id, count(*) AS n FROM again GROUP BY 1),
marked AS (SELECT page_id, count(DISTINCT p) AS n FROM (SELECT page_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY 1)
SELECT l.page_id, len(words) AS n_words, coalesce(marked.n, 0) AS repeated_words, coalesce(runs.n, 0) AS repeated_runs, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS repeated_lines,
len(sentences) AS n_sentences, len(sentences) - len(list_distinct(sentences)) AS repeated_sentences, CASE WHEN len(words) > 0 THEN coalesce(marked.n, 0) / len(words) ELSE 0.0 END AS word_share
FROM l LEFT JOIN runs USING (page_id) LEFT JOIN marked USING (page_id)"""
_PAIRS = ORACLES["p4_found"].replace("\nSELECT page_a, page_b FROM both_", ", pairs AS (SELECT page_a, page_b, c = x.n AND c = y.n AS same FROM both_").replace(">= 0.6", ">= 0.6)")
ORACLES["p4_groups"] = f"""{_PAIRS.replace('WITH ok', 'WITH RECURSIVE ok', 1)},
rep AS (SELECT n.page_id, least(n.page_id, coalesce(min(p.page_a), n.page_id)) AS representative FROM n LEFT JOIN pairs p ON p.page_b = n.page_id AND p.same GROUP BY n.page_id),
links AS (SELECT DISTINCT a.representative AS a, b.representative AS b FROM pairs p JOIN rep a ON a.page_id = p.page_a JOIN rep b ON b.page_id = p.page_b WHERE NOT p.same),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.other),
class AS (SELECT node, min(other) AS class_id FROM reach GROUP BY 1), degree AS (SELECT a AS node, count(*) AS n_links FROM both_ways GROUP BY 1)
SELECT rep.page_id, representative, coalesce(class_id, representative) AS class_id, coalesce(n_links, 0) AS n_links FROM rep LEFT JOIN class ON class.node = representative LEFT JOIN degree ON degree.node = representative"""
