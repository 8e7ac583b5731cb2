"""Context-triggered piecewise hashing of whole texts.

A rolling hash over seven bytes ends a piece wherever its value is -1 modulo the
block size, so an edit changes the pieces around it and no others. Every piece
gives one character, and the characters of all pieces are the signature. Block
sizes are powers of two; a text takes the smallest one with at most ``MOST``
pieces, and its fingerprint has the signatures at that size and at twice it:
``size:signature:signature``. Fingerprints are compared where their sizes are equal
or a factor of two apart, by the edit distance (insertions and deletions) of the
signatures at the common size.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import stored

MOST = 64
WINDOW = 7
#: Two signatures have to share this many characters in a row to be likened at all, or a
#: third of the shorter one where it has fewer than three times as many.
COMMON = 7
_CODE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ROLL = V.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def triggers(data: np.ndarray) -> np.ndarray:
    """The rolling value at every byte: a hash of it and the six before, the nearer the heavier."""
    x = _ROLL[data]
    out = x.copy()
    for k in range(1, WINDOW):
        out[k:] += x[:-k] << np.uint32(k)
    return out ^ (out >> np.uint32(15))


def _signature(text: bytes, ends: list[int]) -> str:
    out, a = [], 0
    for b in ends:
        out.append(_CODE[zlib.crc32(text[a:b]) >> 26])
        a = b
    if a < len(text):
        out.append(_CODE[zlib.crc32(text[a:]) >> 26])
    return "".join(out)


def fingerprint(text: bytes) -> str:
    """The fingerprint of UTF-8 ``text``; of empty text ``1::``."""
    if not text:
        return "1::"
    roll = triggers(np.frombuffer(text, np.uint8))
    size = 1
    if len(text) > MOST:
        # the position k of the lowest zero bit: a byte ends pieces of all sizes up to 2**k
        bits = roll + np.uint32(1)
        low = bits & (~bits + np.uint32(1))
        order = np.bincount(np.frexp(low.astype(np.float64))[1], minlength=34)
        order[33] += order[0]  # all bits set
        order[0] = 0
        reach = order[::-1].cumsum()[::-1][1:]  # reach[k]: ends at size 2**k
        # a last piece without an end of its own counts too
        size = 1 << next(k for k in range(33) if k >= len(reach) or reach[k] < MOST)
    mask = np.uint32(size - 1)
    ends = np.flatnonzero((roll & mask) == mask) + 1
    twice = np.uint32(2 * size - 1)
    wide = ends[(roll[ends - 1] & twice) == twice]
    return f"{size}:{_signature(text, ends.tolist())}:{_signature(text, wide.tolist())}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    n = max(1, min(COMMON, min(len(a), len(b)) // 3))
    grams = {a[i : i + n] for i in range(len(a) - n + 1)}
    if not any(b[i : i + n] in grams for i in range(len(b) - n + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """1 - edit distance / total length at the best compatible block size; 0 if there is none."""
    if x == y:
        return 1.0
    (n, a, b), (m, c, d) = x.split(":"), y.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_alike(a, c), _alike(b, d))
    if n == 2 * m:
        return _alike(a, d)
    if m == 2 * n:
        return _alike(b, c)
    return 0.0


def edited(text: str, following: str) -> str:
    """The last third of ``text`` (whole code points, rounded down) gives way to as much of the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_LAST = -(2**63)  # stands for a null id, which comes last


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """``docs(k, doc_id, text)`` with the ``part`` of each row by ranges of ``k``, plus guests.

    The head of a range (its largest k) is also sent as a guest to the range above,
    the head of all to the lowest range, so every range ends with what follows it.
    The driver sees at most ``parts`` cuts and heads.
    """
    ids = stored(docs.select("k"))
    cuts = sorted({int(c) for c in ids.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)})
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("k"))) if cuts else F.lit(0)
    heads = ids.groupBy(part.alias("part")).agg(F.max("k").alias("k")).orderBy("part").collect()
    to = [(r.k, above.part) for r, above in zip(heads, heads[1:] + heads[:1])]
    send = F.broadcast(docs.sparkSession.createDataFrame(to, "k long, send int"))
    rows = docs.join(send, "k", "left").withColumn("part", part)
    own = F.struct(F.col("part"), F.lit(0).alias("guest"))
    guest = F.when(F.col("send").isNotNull(), F.struct(F.col("send").alias("part"), F.lit(1).alias("guest")))
    return rows.select(F.inline(F.array_compact(F.array(own, guest))), "k", "doc_id", "text")


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _read(batches):
    """Ranges in order, one row held: a row is done when the next one comes."""
    held, out = None, []

    def done(own, other):
        doc, text, print_ = own
        new = edited(text, other[1])
        new_print = fingerprint(new.encode())
        return doc, len(text), hashlib.sha256(new.encode()).hexdigest(), print_, new_print, likeness(print_, new_print), likeness(print_, other[2])

    for b in batches:
        for part, guest, doc, text in zip(*(b.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
            if guest and held is None:  # other rows of the head's id
                continue
            row = (doc, text, fingerprint(text.encode()))
            if held is not None:
                out.append(done(held, row))
            held = None if guest else row
            if len(out) >= 2000:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), _OUT)], schema=_OUT)
                out = []
    if out:
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), _OUT)], schema=_OUT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses, for ``docs(doc_id, text)``.

    The next document is the one that follows in descending doc_id; after the last
    comes the first. Rows of one id follow each other by text, null ids come last.
    Null text is empty, with 0 characters and the fingerprint ``1::``. Equal texts
    have equal fingerprints; repeated rows stay. A single row is its own next one;
    no rows give no rows; other columns are ignored.

    The texts are dealt once, to ranges of ids, and every range is read in order.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("k"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = _dealt(rows, 4 * n).repartition(n, "part").sortWithinPartitions("part", "guest", F.desc("k"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("part", "guest", "doc_id", "text").mapInArrow(_read, schema)
