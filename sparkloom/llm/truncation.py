"""Problem 9: texts cut off before their end.

A cut copy is the beginning of its original, however much is missing. So min-hash banding is done on beginnings: each
text has bands of three values for its first 8, 16, 32 ... runs of five words. A text without a closing mark is sought
by the longest of its beginnings, which is at least half of it, among all beginnings of longer texts. Pairs of which the
shorter text's runs are contained in the longer one are aligned, and the copy whose alignment ends early, inside
a word or a sentence, is flagged. The other texts without a closing mark are scored by the terminality of their
closing word: how often, in the whole corpus, that word stands at the end of a line or a sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import MinHash, shingles, small, word_codes, words_of
from sparkloom.llm.near_pages import tolerance
from sparkloom.session import checkpoint

#: Bands of each beginning, values of a band; runs in the shortest beginning. At a similarity of 0.8 one beginning is found with probability 0.986.
BANDS, ROWS, FIRST = 6, 3, 8
HASHES = BANDS * ROWS
#: Closing words that end lines or sentences at least this often end a text, by the kind of its last line (of an item,
#: with one more end than seen, so that a rare word is not taken for one that needs a continuation).
PROSE_ENDS, ITEM_ENDS = 0.8, 0.02

# Marks that close a text, marks that stand for a missing rest, and starts of closing lines.
_CLOSED = re.compile(r"[.!?。！？][\"'”’»」』)\]]*$")
_CUT_MARK = re.compile(r"(?:\.\.\.|…|\[(?:\.\.\.|…|truncated|more)\]|\((?:more|continued|truncated|cont\.?)\)|(?:…|\.\.\.)\s*(?:read|show|see)?\s*(?:more|on))$", re.IGNORECASE)
_ITEM = re.compile(r"^\s*(?:[-*•–▪◦]|\d{1,3}[.)])\s+")
_LABELLED = re.compile(r"^\s*(?:[—–]\s*\S.{0,60}|[^\W\d_][\w \-]{0,24}:\s\S.{0,80}|[^|]{1,60}\|.{0,60})$")
_LAST_WORD = re.compile(r"[^\W_]+$")
_ENDING = re.compile(r"\b([^\W_]+)(?:[.!?。！？]|[ \t]*\r?\n)")
#: Scripts without spaces between words: there, prose without a closing mark has no closing word that could be known.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
CLOSED, MARKED, PROSE, ITEM, LABELLED = range(5)
#: Bits by which ids are sorted out before texts are shuffled, 64 in a row.
BITS = 1 << 24


def closing(text: str) -> tuple[int, str]:
    """How a text ends, and its closing word where that has to decide.

    ``CLOSED``: with a full stop or the like, or a symbol such as an emoji; ``MARKED``: with a mark of a
    missing rest, a broken character, or punctuation that needs a continuation; else the kind of the last
    line: ``ITEM`` of a list, ``LABELLED`` (signature, label, table row) or ``PROSE``.
    """
    text = text.rstrip().rstrip("​‌‍‎‏﻿️⁠").rstrip()
    tail = text[-40:]
    if not text:
        return CLOSED, ""
    if _CUT_MARK.search(tail) or text[-1] in "�,;:-–—(/&":
        return MARKED, ""
    if _CLOSED.search(tail):
        return CLOSED, ""
    word = _LAST_WORD.search(text[-80:])
    if not word:
        return (MARKED if text[-1] in "'’`" else CLOSED), ""
    line = text[max(text.rfind("\n"), text.rfind("\r")) + 1 :]
    kind = ITEM if _ITEM.match(line) else LABELLED if _LABELLED.match(line) else PROSE
    return kind, word.group(0).lower()


def beginnings(sets: list[np.ndarray], minhash: MinHash) -> tuple[list[list[int]], list[list[int]]]:
    """Band keys of each list of runs, ``BANDS`` for each beginning, shortest first, and one sketch for each beginning.

    A sketch has the lowest bit of each value, and then the second bit of each.
    """
    parts, levels = [], []
    for runs in sets:
        sizes = [FIRST << k for k in range(max(0, (len(runs) // FIRST).bit_length()))]
        levels.append(len(sizes))
        parts += [runs[:n] for n in sizes]
    if not parts:
        return [[] for _ in sets], [[] for _ in sets]
    values = minhash(parts).astype(np.uint64)
    level = np.concatenate([np.arange(n, dtype=np.uint64) for n in levels])
    keys = level[:, None] * np.uint64(BANDS) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = (keys + values[:, k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    places = np.uint64(1) << np.arange(HASHES, dtype=np.uint64)
    sketch = ((values & np.uint64(1)) @ places) | ((((values >> np.uint64(1)) & np.uint64(1)) @ places) << np.uint64(HASHES))
    ends = np.cumsum([0, *levels])
    return [keys[a:b].reshape(-1).view(np.int64).tolist() for a, b in zip(ends, ends[1:])], [sketch[a:b].view(np.int64).tolist() for a, b in zip(ends, ends[1:])]


READ = "doc_id long, digest binary, state int, word string, n_words int, bands array<long>, sketches array<long>, inner long, ends long, finals long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and rows of word counts (null digest) of each batch."""
    minhash = MinHash(HASHES, 11)
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 3]
    for batch in small(batches, 1):
        inner: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        finals: Counter[str] = Counter()
        ids, digests, states, closers, sizes, sets = [], [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            state, word = closing(text)
            ids.append(doc)
            digests.append(xxhash.xxh3_128_digest(text.encode("utf-8", "replace")))
            states.append(state)
            closers.append(word)
            sizes.append(len(words))
            sets.append(shingles(word_codes(words)))
            # The last word of a text is evidence of a closing only, whatever follows it.
            inner.update(words[:-1])
            ends.update(_ENDING.findall(text.lower()))
            if words and word == words[-1]:
                finals[word] += 1
        if not ids:
            continue
        bands, sketches = beginnings(sets, minhash)
        zeros = pa.array(np.zeros(len(ids), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, types[0]), pa.array(digests, types[1]), pa.array(states, types[2]), pa.array(closers, types[3]), pa.array(sizes, types[4]), pa.array(bands, types[5]), pa.array(sketches, types[6]), zeros, zeros, zeros], names)
        words = sorted(inner.keys() | finals.keys())
        empty = [pa.nulls(len(words), t) for t in types]
        empty[3] = pa.array(words, types[3])
        empty[7:] = [pa.array([c[w] for w in words], pa.int64()) for c in (inner, ends, finals)]
        yield pa.RecordBatch.from_arrays(empty, names)


def ends_early(short: str, long: str) -> int:
    """1 if ``short`` stops inside a word or a sentence of ``long``, 0 if both end alike or at a boundary, -1 if they do not align.

    The last words of ``short`` (without the very last, which may be a part of one) are sought in ``long``
    at the position where the first difference in length would put them, within a twentieth of the text.
    """
    body = _CUT_MARK.sub("", short.rstrip()).rstrip()
    mine, theirs = list(re.finditer(r"[^\W_]+", body.lower())), list(re.finditer(r"[^\W_]+", long.lower()))
    anchor = [m.group(0) for m in mine[-7:-1]]
    if len(anchor) < 4:
        return -1
    words, at = [m.group(0) for m in theirs], len(mine) - 1 - len(anchor)
    slack = max(8, len(mine) // 20)
    for k in sorted(range(max(0, at - slack), min(len(words), at + slack) + 1), key=lambda k: abs(k - at)):
        if words[k : k + len(anchor)] == anchor:
            last = k + len(anchor)
            if last >= len(words) or not words[last].startswith(mine[-1].group(0)):
                return -1
            if words[last] != mine[-1].group(0):
                return 1
            # A missing full stop alone is no cut, nor is an end at the end of a line.
            rest = long[theirs[last].end() :]
            return int(re.search(r"[^\W_]", rest) is not None and not re.match(r"[^\w\n]*\n", rest))
    return -1


def perhaps_in(docs: DataFrame, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is in ``wanted``, and of the others about one in ``bits / n`` for ``n`` wanted ids.

    A bit is set for the hash of each wanted id, ``bits`` being a multiple of 64. However many ids there are, at most
    ``bits / 64`` rows are broadcast, and no row of ``docs`` is shuffled.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    hashed = wanted.select(at.alias("at")).select(F.shiftright("at", 6).alias("part"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    parts = hashed.groupBy("part").agg(F.bit_or("bit").alias("set"))
    marked = docs.withColumn("at", at).withColumn("part", F.shiftright("at", 6)).join(F.broadcast(parts), "part")
    return marked.where("getbit(set, cast(at & 63 as int)) = 1").select(*docs.columns)


def truncated(docs: DataFrame, similarity: float = 0.8, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, state, word, terminality, aligned, is_truncated`` of each document with a non-blank text.

    ``aligned`` is 1, 0 or -1 as in ``ends_early`` for the best near-copy, null without one; a near-copy has at least
    ``similarity`` of the runs of the shorter text. Texts of fewer than twelve words are not compared. Equal texts are
    compared once and share the result. Null ids and null, empty and blank texts have no row; a repeated row
    counts once. Word counts are of all documents and are combined in each batch before the shuffle.
    """
    docs = docs.select(F.col(ids).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null and text rlike '\\\\S'")
    rows = checkpoint(docs.mapInArrow(_read, READ))
    each = rows.where("digest is not null").dropDuplicates(["doc_id"])
    words = rows.where("digest is null").groupBy("word").agg(F.sum("inner").alias("inner"), F.sum("ends").alias("ends"), F.sum("finals").alias("finals"))

    # One document for each text; those without a closing mark are sought among the beginnings of those as long or longer.
    # Repeated rows of a document share its text, so the wide rows are shuffled once, by text.
    single = rows.where("digest is not null and size(bands) > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "state", "n_words", "bands", "sketches")).alias("x")).select("x.*")
    # Sketch and length share one number, so the many rows of beginnings are short; lengths only sort out candidates.
    length = F.shiftleft(F.least(F.col("n_words"), F.lit((1 << 26) - 1)).cast("bigint"), 2 * HASHES)
    level = F.floor(F.col("band") / BANDS).cast("int")
    starts = single.select("doc_id", length.alias("length"), "sketches", F.posexplode("bands").alias("band", "key")).select("key", F.col("doc_id").alias("long"), F.get("sketches", level).bitwiseOR(F.col("length")).alias("of_long"))
    unclosed = single.where(F.col("state") != CLOSED)
    sought = unclosed.select(F.explode(F.slice("bands", -BANDS, BANDS)).alias("key"), F.col("doc_id").alias("short"), F.element_at("sketches", -1).bitwiseOR(length).alias("of_short"))
    other = F.col("of_long").bitwiseXOR(F.col("of_short"))
    differ = F.bit_count(other.bitwiseOR(F.shiftrightunsigned(other, HASHES)).bitwiseAND(F.lit((1 << HASHES) - 1)))
    longer = F.shiftright("of_short", 2 * HASHES) <= F.shiftright("of_long", 2 * HASHES)
    pairs = sought.join(starts, "key").where((F.col("short") != F.col("long")) & longer & (differ <= tolerance(similarity, HASHES)))
    pairs = checkpoint(pairs.select("short", "long").distinct())
    wanted = pairs.select(F.explode(F.array("short", "long")).alias("doc_id")).distinct()
    # Not a semi-join: Spark would do that before the join that sorts out rows, and shuffle all texts.
    texts = perhaps_in(docs, wanted).join(wanted, "doc_id").dropDuplicates(["doc_id"])
    sides = pairs.join(texts.toDF("short", "text_s"), "short").join(texts.toDF("long", "text_l"), "long")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short, one, two = (batch.column(k).to_pylist() for k in range(3))
            found = []
            for a, b in zip(one, two):
                x, y = (set(shingles(word_codes(words_of(t))).tolist()) for t in (a, b))
                # A cut copy has few runs of its own; the longer one may go on for as long as it likes.
                found.append(ends_early(a, b) if x and len(x & y) >= similarity * len(x) - 1e-9 else -1)
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.int64()), pa.array(found, pa.int32())], ["doc_id", "aligned"])

    aligned = sides.select("short", "text_s", "text_l").mapInArrow(align, "doc_id long, aligned int").groupBy("doc_id").agg(F.max("aligned").alias("aligned"))
    shared = each.select("digest", "doc_id").join(aligned, "doc_id").select("digest", "aligned")
    # Texts that end with a closing mark or a cut mark need no statistics, and would all meet on one empty word.
    columns = ["doc_id", "state", "word", "terminality", "aligned", "is_truncated"]
    plain = each.where("word = ''").withColumns({"terminality": F.lit(None).cast("double"), "aligned": F.lit(None).cast("int"), "is_truncated": F.col("state") == MARKED}).select(*columns)
    out = each.where("word != ''").select("doc_id", "digest", "state", "word").join(shared, "digest", "left").join(words, "word", "left")
    seen, finals = F.coalesce("inner", F.lit(0)), F.coalesce("finals", F.lit(0))
    out = out.withColumn("terminality", F.coalesce("ends", F.lit(0)) / F.greatest(seen + finals, F.lit(1)))
    scored = (
        F.when(F.col("state") == LABELLED, ~F.col("word").rlike(r"^\d+$") & (seen + finals < 2))
        .when(F.col("state") == ITEM, (seen == 0) | ((F.coalesce("ends", F.lit(0)) + 1) / (seen + finals + 1) < ITEM_ENDS))
        .otherwise((seen == 0) | (F.col("terminality") < PROSE_ENDS) | F.col("word").rlike(UNSPACED))
    )
    return out.withColumn("is_truncated", F.when(F.col("aligned") == 1, True).otherwise(scored)).select(*columns).unionByName(plain)


def source_rates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """How often each source cuts: ``source, n_docs`` (with a non-blank text), ``n_truncated, share``; a null source is one of its own."""
    docs = docs.where("doc_id is not null and text rlike '\\\\S'").select("doc_id", "source").dropDuplicates(["doc_id"])
    marked = docs.join(found.where("is_truncated").select("doc_id", F.lit(1).alias("t")), "doc_id", "left")
    by = marked.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("t").alias("n_truncated"))
    return by.withColumn("share", F.col("n_truncated") / F.col("n_docs"))
