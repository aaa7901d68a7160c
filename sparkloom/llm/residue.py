"""Problem 6: template residue, filler text, error messages and script notices.

Pages are cut into segments (block elements without code). A segment is trusted residue if it matches a
fixed pattern of a placeholder syntax, or is as a whole a known filler, error or script notice. All
distinct segments of five words or more are then compared by min-hash: ten bands of four values, in one of
which two segments at a similarity of 0.8 agree with probability 0.995. SimHash sorts out candidates inside
the join, wide enough for that similarity. Verified pairs (similarity of the texts) form components, and a
component takes its trusted label.

In a short notice one other word changes most runs of five words. So the segments of short pages are also
linked if they are the same but for one or two neighbouring words, and at least four fifths of both are the same.
A component of such segments is trusted as well, without any pattern, if failed requests returned it as their
whole page and hardly any longer page has it; so pages find it that were stored as if all was well.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import MinHash, shingles, small, word_codes
from sparkloom.llm.near_pages import overlap
from sparkloom.operators.components import connected_components
from sparkloom.session import checkpoint

SIMILARITY, RUN = 0.8, 5
#: Min-hash bands, values of each; bits of SimHash that candidates may differ in (usual at 0.8: 5 to 12; unrelated: 32).
BANDS, ROWS, HAMMING = 10, 4, 24
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TABLES = list(itertools.combinations(range(len(BLOCKS)), 2))
#: A page whose words outside notices, headings and lists of links are no more than this consists of its notice.
REST_WORDS = 30
#: Words of a notice, at least and at most, and of a page that can consist of notices: two of them and the rest.
NOTICE_WORDS, SHORT_PAGE = (6, 28), 90
#: A component is trusted if so many failed requests returned it and this share of its pages is short.
FAILED_PAGES, SHORT_SHARE = 2, 0.9

# Syntaxes of unfilled placeholders (outside code).
PLACEHOLDER = (
    r"\{\{[^{}]{1,60}\}\}|\{%[^{}%]{1,60}%\}|<%=?[^<>%]{1,60}%>|\$\{[^{}]{1,60}\}|%%[A-Za-z][A-Za-z0-9_. ]{0,40}%%|\[\[[^\[\]]{1,60}\]\]"
    r"|\*\|[A-Z0-9_: ]{1,40}\|\*|@@[A-Z][A-Z0-9_. ]{0,40}@@|##[A-Z][A-Z0-9_. ]{0,40}##|__[A-Z][A-Z0-9_.]{0,40}__|\{[A-Za-z][A-Za-z0-9_. ]{1,40}\}"
    r"|\[(?:[Ii]nsert|INSERT) [^\[\]]{1,60}\]|\[(?:[Yy]our|YOUR) [^\[\]]{1,60}\]|<[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*>"
)
# Whole segments of filler.
_FILLER = re.compile(
    r"sample (?:heading|text|title|paragraph)|insert (?:caption|text|image|title)(?: here)?|(?:asdf|qwerty|xxxx|test)(?: (?:asdf|qwerty|xxxx|test|\d+)){1,}|placeholder (?:copy|text)\b.{0,40}"
    r"|todo:? .{0,60}|this is a dummy (?:paragraph|text)\b.{0,60}|your (?:text|content|copy|title|heading) (?:goes )?here\b.{0,60}|hello world\b.{0,90}"
    r"|(?:add|enter|write) (?:a|your) (?:short |brief )?(?:description|text|title|summary)\b.{0,50} here",
    re.IGNORECASE,
)
# Beginnings of the words of the usual pseudo-Latin.
_LATIN = re.compile(
    r"(?:lorem|ipsum|dolor|sit|amet|conse|adipi|elit|sed|eius|tempo|incid|labor|magn|aliq|enim|minim|venia|quis|nostr|exerc|ullam|nisi|commo|duis|aute|irure|repre|volup|velit|esse|cillu|fugia|nulla|nulli|paria|excep|sint|occae|cupid|proid|sunt|culpa|offic|deser|molli|anim|laboru|rhonc|vari|faucis|faucib|viver|curab|ultri|vestib|lacin|mauri|tinci|imper|gravi|lectu|preti|saper|sodal|nibh|hendr|ornar|pulvi|porta|felis|odio|justo|digni|pelle|morbi|tristi|senec|netus|malesu|turpis|egest|phase|vivam|accum|eleif|sollic|ut|et|in|ad|ex|id|est|non|do)[a-z]{0,6}"
)
_LATIN_RARE = re.compile(r"lorem|ipsum|rhonc|vestib|pulvi|tinci|faucib|faucis|hendr|curab|ultri|sodal|lacin|viver|conse[cq]t|adipi")
# Error messages and notices that scripts are required.
_NOTICE = re.compile(
    r"page not found|could not find (?:that|the|this)|internal server error|access denied|session has expired|too many requests|service (?:is )?(?:temporarily )?unavailable|gateway timeout"
    r"|bad gateway|something went wrong|fatal error|traceback: ?\w+|error establishing a |down for (?:planned )?maintenance|uncaught exception"
    r"|lo sentimos, la p[aá]gina|seite nicht gefunden|page introuvable|p[aá]gina n[aã]o encontrada|pagina non trovata|ページが見つかりません"
    r"|(?:enable|activate|allow|requires?|need|without|blocking|aktivieren sie|activez|activer|habilite|active|attiva|run|support)\b.{0,40}\b(?:java ?scripts?|scripts?|scripting)\b"
    r"|(?:java ?scripts?|scripting)\b.{0,30}\b(?:is |are )?(?:switched off|turned off|disabled|required|aktivieren|n[eé]cessaire|erforderlich)|check(?:ing)? your browser|scripts? and cookies must|javascript を有効",
    re.IGNORECASE,
)
# Lines that stand beside such messages, and bare error headings.
_BESIDE = re.compile(
    r"(?:contact support if|return to the home ?page|search again|back to the |error reference|we apologi[sz]e|request id|try again|reload the page|go back)\b.{0,70}",
    re.IGNORECASE,
)
_CODE = re.compile(r"<(pre|code|kbd|samp|script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|$)", re.IGNORECASE | re.DOTALL)
_BLOCK = re.compile(r"\n|</?(?:p|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|thead|tbody|div|section|article|blockquote|figcaption|caption|summary|header|footer|nav|main|aside|br|hr)\b[^>]*>", re.IGNORECASE)
_TAGS = re.compile(r"<[^>]*>")
_SPACE = re.compile(r"\s+")
_HEADING = re.compile(r"<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>", re.IGNORECASE | re.DOTALL)
_LINKS = re.compile(r"<(ul|ol|nav)\b[^>]*>(?:\s*<li[^>]*>\s*<a\b[^>]*>[^<]*</a>(?:\s*</li>)?)+\s*</\1>", re.IGNORECASE)
_PLACEHOLDER = re.compile(PLACEHOLDER)
_WORDS = re.compile(r"[^\W_]+")
NONE, HOLDER, FILLER, NOTICE, BESIDE = range(5)


def segments(content: str) -> list[tuple[str, bool]]:
    """``(text, is it a heading)`` of the block elements, without code and lists of links only; white space collapsed."""
    content = _LINKS.sub("\n", _CODE.sub(" ", content))
    out = []
    for part in re.split(r"(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>)", content, flags=re.IGNORECASE | re.DOTALL):
        head = _HEADING.fullmatch(part)
        for piece in [head.group(1)] if head else (x for x in _BLOCK.split(part) if x):
            text = _SPACE.sub(" ", html.unescape(_TAGS.sub("", piece))).strip()
            if text:
                out.append((text, bool(head)))
    return out


def label(text: str, heading: bool) -> int:
    """Trusted label of a segment by the fixed patterns."""
    if _PLACEHOLDER.search(text):
        return HOLDER
    plain = text.strip(" •»«!.*-–—_")
    if _FILLER.fullmatch(plain):
        return FILLER
    words = _WORDS.findall(text.lower())
    if len(words) >= 5 and _LATIN_RARE.search(text.lower()):
        latin = sum(bool(_LATIN.fullmatch(w)) for w in words)
        if latin >= 0.7 * len(words):
            return FILLER
    # A notice is a short text; prose that mentions one goes on about something else.
    if len(words) <= NOTICE_WORDS[1] and _NOTICE.search(text):
        return NOTICE
    if len(words) <= 14 and (_BESIDE.fullmatch(plain) or heading):
        return BESIDE
    return NONE


def masked(text: str) -> str:
    """A segment without case, digits and marks, in which its copies are equal."""
    return " ".join("0" if w.isdigit() else w for w in _WORDS.findall(text.lower()))


def run_codes(words: list[list[str]]) -> list[np.ndarray]:
    """Codes of the runs of five words of each list (a shorter list is one run, an empty one the code 0)."""
    part = [shingles(word_codes(w), max(1, min(RUN, len(w)))) for w in words]
    return [c if len(c) else np.zeros(1, dtype=np.uint64) for c in part]


def _majority(part: list[np.ndarray]) -> np.ndarray:
    places = np.uint64(1) << np.arange(64, dtype=np.uint64)
    bits = np.unpackbits(np.concatenate(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.cumsum([0, *(len(c) for c in part[:-1])]), axis=0, dtype=np.int32)
    sizes = np.array([len(c) for c in part])
    return ((2 * ones >= sizes[:, None]).astype(np.uint64) @ places).astype(np.uint64)


def simhash(words: list[list[str]]) -> np.ndarray:
    """SimHash-64 of each list of words, over its runs of five words (a shorter list is one run)."""
    parts = [_majority(run_codes(words[k : k + 2048])) for k in range(0, len(words), 2048)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def band_keys(part: list[np.ndarray], minhash: MinHash) -> np.ndarray:
    """Keys of each set of runs in the bands, one row for each set."""
    values = minhash(part).astype(np.uint64).reshape(len(part), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(part), BANDS)).copy()
    for k in range(ROWS):
        keys = (keys + values[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def gap_keys(plain: str) -> list[int]:
    """Keys of a masked segment as it is and without one or two neighbouring words, as long as four fifths stay."""
    words = plain.split(" ")
    texts = {plain}
    for width in (1, 2):
        if len(words) - width >= SIMILARITY * len(words):
            texts.update(" ".join([*words[:k], *words[k + width :]]) for k in range(len(words) - width + 1))
    return sorted(code - (1 << 64) if code >> 63 else code for code in map(xxhash.xxh3_64_intdigest, texts))


SEGMENTS = "page_id long, digest binary, label int, n_words int, heading boolean, plain string, short boolean, failed boolean, gaps array<long>"
_SEGMENT_TYPES = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    for batch in small(batches, 1):
        rows: list[tuple] = []
        for page, content, status in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found = [(text, heading, masked(text)) for text, heading in segments(content)]
            sizes = [plain.count(" ") + 1 if plain else 0 for _, _, plain in found]
            short = sum(n for n, (_, heading, _) in zip(sizes, found) if not heading) <= SHORT_PAGE
            for n, (text, heading, plain) in zip(sizes, found):
                gaps = gap_keys(plain) if short and not heading and NOTICE_WORDS[0] <= n <= NOTICE_WORDS[1] else None
                rows.append((page, xxhash.xxh3_128_digest(plain.encode("utf-8", "replace")), label(text, heading), n, heading, plain, short, (status or 0) >= 400, gaps))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SEGMENT_TYPES)], names)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash = MinHash(BANDS * ROWS, 6)
    for whole in batches:
        for batch in (whole.slice(k, 2048) for k in range(0, len(whole), 2048)):
            words = [t.split(" ") if t else [] for t in batch.column(2).to_pylist()]
            part = run_codes(words)
            keys = [row if len(w) >= RUN else [] for row, w in zip(band_keys(part, minhash).tolist(), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_majority(part).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["digest", "label", "plain", "print", "bands"])


def table_keys(print_: Column) -> Column:
    """Keys of a fingerprint in ten tables of two blocks, in one of which any two at a Hamming distance of three or less agree."""
    block = [F.shiftrightunsigned(print_, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]
    return F.array(*(F.shiftleft(F.shiftleft(block[a], 13).bitwiseOR(block[b]), 4).bitwiseOR(F.lit(k)) for k, (a, b) in enumerate(TABLES)))


def runs(text: Column) -> Column:
    """Distinct runs of five words of a masked text; a shorter one is one run."""
    words = F.split(text, " ")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - RUN + 1, F.lit(1))), lambda k: F.array_join(F.slice(words, k, RUN), " ")))


def template_links(gaps: DataFrame) -> DataFrame:
    """``a, b``: each digest of ``gaps(digest, gaps)`` and the least digest that shares a key with it.

    Segments that share a key are one template, so each is linked to one of them, not to all.
    """
    keys = gaps.select("digest", F.explode("gaps").alias("key")).distinct()
    low = keys.groupBy("key").agg(F.min("digest").alias("a"), F.count("*").alias("c")).where("c > 1").select("key", "a")
    return keys.join(low, "key").where("a != digest").select("a", F.col("digest").alias("b")).distinct()


def spread_labels(found: DataFrame, links: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """``digest, label`` of every distinct segment that has a label of its own or gets one from its component.

    ``found``: ``digest, label, plain``, one row per distinct segment. Segments are compared within the
    buckets of each band, an equi-join on a 64-bit key of distinct segments, so copies of one segment,
    however many, are one row. A segment of fewer than five words is a single run and like no other.
    ``links``: further pairs ``a, b`` of digests. ``seen``: ``digest, pages, short_pages, failed_pages``, from which
    components are trusted that no pattern knows.
    """
    prints = checkpoint(found.mapInArrow(_fingerprints, "digest binary, label int, plain string, print long, bands array<long>"))
    rows = prints.select(F.col("digest").alias("d"), F.col("print").alias("p"), F.explode("bands").alias("key"))
    left, right = rows.toDF("a", "pa", "key"), rows.toDF("b", "pb", "key")
    near = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= HAMMING)).select("a", "b").distinct()
    texts = prints.select("digest", "plain")
    both = near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    edges = both.where(overlap(runs(F.col("ta")), runs(F.col("tb"))) >= SIMILARITY).select("a", "b")
    members = connected_components(edges if links is None else edges.unionByName(links))
    labelled = members.join(prints.select(F.col("digest").alias("node"), "label"), "node")
    trusted = labelled.where(F.col("label") != NONE).groupBy("component").agg(F.min("label").alias("given"))
    given = labelled.where(F.col("label") == NONE).join(trusted, "component").select(F.col("node").alias("digest"), F.col("given").alias("label"))
    if seen is not None:
        whole = seen.join(members.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
        sums = whole.groupBy("component").agg(*(F.sum(c).alias(c) for c in ("pages", "short_pages", "failed_pages")))
        learnt = sums.where((F.col("failed_pages") >= FAILED_PAGES) & (F.col("short_pages") >= F.col("pages") * SHORT_SHARE)).select("component")
        given = given.unionByName(whole.join(learnt, "component", "left_semi").select("digest", F.lit(NOTICE).alias("label")))
    return prints.where(F.col("label") != NONE).select("digest", "label").unionByName(given).groupBy("digest").agg(F.min("label").alias("label"))


def residue_pages(pages: DataFrame) -> DataFrame:
    """Pages with residue: ``page_id, holder, filler, notice, rest_words, in_reason, is_residue``, one row per page.

    ``is_residue``: the content holds a placeholder or filler, or consists of a notice (at most
    ``REST_WORDS`` words besides notices, headings and lists of links), or the failure reason holds a
    placeholder. Pages without content can only be found by their reason; null ids have no row; null, empty
    and blank contents have no segments; a repeated row counts once. ``status_code``, where there is such a column,
    tells failed requests; it decides about a template of many pages, never about one page by itself.
    """
    pages = pages.where("page_id is not null")
    status = F.col("status_code").cast("int") if "status_code" in pages.columns else F.lit(None).cast("int")
    cut = checkpoint(pages.where("content_html is not null").select("page_id", "content_html", status.alias("status")).mapInArrow(_segments, SEGMENTS))
    # The label of a segment depends on the marks that the digest leaves out, so own labels count for each occurrence.
    distinct = cut.groupBy("digest").agg(F.max("label").alias("label"), F.first("plain").alias("plain"))
    each = cut.groupBy("page_id", "digest").agg(F.max("label").alias("own"), F.max("n_words").alias("n_words"), F.max("heading").alias("heading"), F.max("short").alias("short"), F.max("failed").alias("failed"))
    known = cut.where("gaps is not null").select("digest", "gaps").dropDuplicates(["digest"])
    stood = each.groupBy("digest").agg(F.count("*").alias("pages"), F.count_if("short").alias("short_pages"), F.count_if(F.col("short") & F.col("failed")).alias("failed_pages"))
    seen = stood.where("short_pages > 0").join(known.select("digest"), "digest", "left_semi")
    given = spread_labels(distinct, template_links(known), seen).withColumnRenamed("label", "given")
    marked = each.join(given, "digest", "left").withColumn("label", F.when(F.col("own") != NONE, F.col("own")).otherwise(F.coalesce("given", F.lit(NONE))))
    by = marked.groupBy("page_id").agg(
        F.max(F.col("label") == HOLDER).alias("holder"), F.max(F.col("label") == FILLER).alias("filler"), F.max(F.col("label") == NOTICE).alias("notice"),
        F.sum(F.when((F.col("label") == NONE) & ~F.col("heading"), F.col("n_words")).otherwise(0)).alias("rest_words"),
    )
    reasons = pages.groupBy("page_id").agg(F.max(F.coalesce(F.col("failure_reason").rlike(PLACEHOLDER), F.lit(False))).alias("in_reason"))
    out = reasons.join(by, "page_id", "left").na.fill(False, ["holder", "filler", "notice"]).na.fill(0, ["rest_words"])
    return out.withColumn("is_residue", F.col("holder") | F.col("filler") | (F.col("notice") & (F.col("rest_words") <= REST_WORDS)) | F.col("in_reason"))


def without_residue(pages: DataFrame) -> DataFrame:
    """Rows of ``pages`` whose page has no residue; rows with a null id stay."""
    return pages.join(residue_pages(pages).where("is_residue").select("page_id"), "page_id", "left_anti").select(*pages.columns)
