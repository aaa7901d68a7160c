"""Problem 7: token ids of the whole corpus, by content-defined chunk reuse.

Texts are cut into chunks at rolling-hash landmarks. Chunks that occur more than once in the corpus are
encoded once; every other stretch is encoded where it stands. The joins between reused ids and the rest
are repaired: the text around a join is encoded again together with the outermost segment of each reused
neighbour, and the ids are spliced only if they agree there exactly; otherwise the range that is encoded
again grows, at last to the whole text.

A reused chunk gives only the ids between its first and last *safe edge*: a white-space byte after a
printable ASCII byte. The split patterns of the byte-level vocabularies have no match across such an edge
and look ahead only, so the ids on either side do not depend on the other.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small

#: Bytes that the rolling hash sees, mean distance of landmarks (a power of two), shortest chunk worth sharing.
WINDOW, SPACING, SHORTEST = 32, 512, 64
_GEAR = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def default_vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path of a rank file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.tiktoken"))


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Any:
    """Encoder of a rank file, made once in each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def landmarks(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk ends, by a gear hash of the last ``WINDOW`` bytes computed by doubling."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return np.flatnonzero((h >> np.uint32(16)) % np.uint32(SPACING) == 0) + 1


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """``(text number, start, end)`` in bytes; ends never fall inside a character."""
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(data):
        return
    marks = landmarks(data)
    inside = np.append((data[1:] & 0xC0) == 0x80, False)  # at i: the byte after i continues a character
    for _ in range(3):
        moved = inside[marks - 1]
        if not moved.any():
            break
        marks = marks + moved
    cuts = np.searchsorted(marks, ends)
    first = 0
    for k, end in enumerate(ends.tolist()):
        start = end - len(texts[k])
        at = start
        for mark in [m for m in marks[first : cuts[k]].tolist() if m >= start + WINDOW and m < end] + [end]:
            if mark > at:
                yield k, at - start, mark - start
                at = mark
        first = cuts[k]


def safe_edges(data: bytes) -> np.ndarray:
    """Positions of white space after a printable ASCII byte."""
    b = np.frombuffer(data, dtype=np.uint8)
    if len(b) < 2:
        return np.empty(0, dtype=np.int64)
    space = (b == 32) | (b == 10) | (b == 9) | (b == 13)
    return np.flatnonzero(space[1:] & (b[:-1] > 32) & (b[:-1] < 127)) + 1


class Reused(NamedTuple):
    """Ids of a chunk between safe edges: bytes before and after, and the outermost segments' bytes and ids."""

    lead: int
    end: int
    head: int
    head_ids: int
    tail: int
    tail_ids: int
    ids: list[int]


def encode_chunk(data: bytes, encode: Any) -> Reused | None:
    """What can be reused of a chunk; None where it has fewer than three safe edges."""
    edges = safe_edges(data)
    if len(edges) < 3:
        return None
    a, b, y, z = int(edges[0]), int(edges[1]), int(edges[-2]), int(edges[-1])
    parts = [encode(data[i:j].decode("utf-8", "replace")) if i < j else [] for i, j in ((a, b), (b, y), (y, z))]
    return Reused(a, z, b - a, len(parts[0]), z - y, len(parts[2]), parts[0] + parts[1] + parts[2])


def assemble(data: bytes, shared: list[tuple[int, Reused]], encode: Any) -> list[int]:
    """Ids of a whole text from reused chunks ``(start of the chunk, ids)`` in order, joins repaired."""
    out: list[int] = []
    at, before = 0, []  # the re-encoded range starts at the last reused segment, whose ids are `before`
    for start, part in shared:
        begin = start + part.lead
        again = encode(data[at : begin + part.head].decode("utf-8", "replace"))
        head = part.ids[: part.head_ids]
        if again[: len(before)] != before or again[len(again) - len(head) :] != head:
            return list(encode(data.decode("utf-8", "replace")))
        out += again[len(before) :]
        out += part.ids[part.head_ids :]
        at, before = start + part.end - part.tail, part.ids[len(part.ids) - part.tail_ids :]
    again = encode(data[at:].decode("utf-8", "replace"))
    if again[: len(before)] != before:
        return list(encode(data.decode("utf-8", "replace")))
    return out + again[len(before) :]


_PART = "struct<start:int,n_bytes:int,digest:binary,lead:int,`end`:int,head:int,head_ids:int,tail:int,tail_ids:int,ids:array<int>>"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, start, n_bytes, digest`` of each chunk."""
    for batch in small(batches, 1):
        ids = batch.column(0).to_pylist()
        texts = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
        found = [(ids[k], a, b - a, xxhash.xxh3_128_digest(texts[k][a:b])) for k, a, b in chunks(texts) if b - a >= SHORTEST]
        doc, start, size, digest = zip(*found) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "start", "n_bytes", "digest"])


def encode_corpus(docs: DataFrame, vocabulary: str | None = None, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` of each document, equal to encoding each text by itself, without special tokens.

    Empty and null texts have an empty list. A null id keeps its row and takes no part in the reuse; repeated
    rows come out as often as they come in. Other columns are ignored. The texts are shuffled once, by id
    (for the chunks' first occurrences and for the assembly alike); the search for shared chunks shuffles
    digests only, combined before the shuffle.
    """
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col(ids).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    named = docs.where("doc_id is not null")
    found = named.where("text != ''").mapInArrow(_occurrences, "doc_id long, start int, n_bytes int, digest binary")
    first = found.groupBy("digest").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "start", "n_bytes")).alias("x")).where("c > 1").select("x.doc_id", "digest", "x.start", "x.n_bytes")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in small(batches, 3):
            rows = []
            for digest, start, size, t in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = t.encode("utf-8", "replace")[start : start + size]
                if xxhash.xxh3_128_digest(data) == digest and (part := encode_chunk(data, encode)):
                    rows.append({"digest": digest, **part._asdict()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("digest", pa.binary()), *((k, pa.int32()) for k in Reused._fields[:-1]), ("ids", pa.list_(pa.int32()))]))

    texts = named.join(first, "doc_id").select("digest", "start", "n_bytes", "text")
    known = texts.mapInArrow(once, "digest binary, lead int, `end` int, head int, head_ids int, tail int, tail_ids int, ids array<int>")
    parts = found.join(known, "digest").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_bytes", "digest", "lead", "end", "head", "head_ids", "tail", "tail_ids", "ids")).alias("parts"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in small(batches, 1):
            offsets, flat = [0], []
            parts = batch.column(2).to_pylist() if batch.column(2).null_count < len(batch) else [None] * len(batch)
            for t, shared in zip(batch.column(1).to_pylist(), parts):
                if shared:
                    data, use, at = t.encode("utf-8", "replace"), [], 0
                    for p in sorted(shared, key=lambda p: p["start"]):
                        if p["start"] >= at and xxhash.xxh3_128_digest(data[p["start"] : (at_ := _end(data, p))]) == p["digest"]:
                            use.append((p["start"], Reused(*(p[k] for k in Reused._fields))))
                            at = at_
                    flat.append(assemble(data, use, encode))
                else:
                    flat.append(encode(t) if t else [])
                offsets.append(offsets[-1] + len(flat[-1]))
            values = np.fromiter((x for part in flat for x in part), dtype=np.int32, count=offsets[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], ["doc_id", "ids"])

    out = "doc_id long, ids array<int>"
    empty = F.lit(None).cast(f"array<{_PART}>")
    joined = named.join(parts, "doc_id", "left").select("doc_id", "text", "parts")
    lost = docs.where("doc_id is null").select("doc_id", "text", empty.alias("parts"))
    return joined.mapInArrow(whole, out).unionByName(lost.mapInArrow(whole, out))


def _end(data: bytes, part: dict[str, Any]) -> int:
    """End of a reused chunk in ``data``."""
    return min(len(data), part["start"] + part["n_bytes"])


def token_counts(docs: DataFrame, vocabulary: str | None = None, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of each row, counted where it is read; 0 for empty and null texts."""
    vocabulary = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in small(batches, 1):
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(ids).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "doc_id long, n_tokens long")
