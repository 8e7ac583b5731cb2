"""Exact n-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word shingles. Two sets of sizes a <= b with
Jaccard >= t satisfy b <= a/t and differ in at most (a+b)(1-t)/(1+t) elements.
Sizes are cut into bands whose ends grow by 1/t; a pair is looked for under the
band of its larger set, so a set takes part in its own band and the next.

Within a band, whose pairs differ in at most K elements, the shingle domain is
hashed into G = K+1 groups of three partitions each. A linked pair that differs in k
elements agrees in all but k partitions. Both sets rank their partitions' projections
by one order of the projections themselves and keep the first k+G+1: of these at
least G+1 are equal in both (the prefix principle), so some group holds two of them.
Every subset of two kept partitions of one group is enumerated, and its projections
are one signature, so linked sets share one. The order puts projections with many
rare shingles first, then large ones, so that passages which many documents share, and
empty partitions, hardly ever make a signature; it affects the cost only. The hint
which shingles are rare comes from a bounded sample and never decides a link.

Links are found in three steps, all exact:

1. within a signature every set is compared with one of them, that which shares the most
   signatures with others (the original of a group of copies rather than a copy); a parity
   sketch of every set bounds the difference from below, and only pairs within the
   bound are compared in full;
2. signatures whose sets are in different components afterwards are reduced to one
   for each list of sets, and those sets are compared with each other, block by
   block, again by sketch first;
3. components are closed over the verified links.

So large groups of near copies cost one comparison a member, and no link between
different components is ever skipped. Equal sets are one node from the start.

Every link lies inside a component, so the number of a set's links comes from
comparing all sets of a component with each other, again in blocks, each pair once.
Only counts leave the tasks. This is quadratic in the sets of a component, as the
links themselves can be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import dropped, small, stored, trimmed
from .components import components

#: Signatures that a task holds before it sends them on, and bytes of them for one target.
WINDOW, TARGET_BYTES = 250_000, 32 << 20
#: The sample behind the rare/common hint: documents, shingles kept, and documents that make one common.
HINT_DOCS, HINT_SHINGLES, HINT_LEAST = 8192, 1 << 19, 3
#: Elements for which signatures are made at once.
ELEMENTS = 1 << 17
#: Sets of one signature that are held together when they are compared with each other;
#: more are cut into blocks, and pairs of blocks go to tasks of their own.
BLOCK = 1024
#: Bytes of elements that one block of a component holds, about, when links are counted.
BLOCK_BYTES = 8 << 20

_U = np.uint64
_HIGH = _U(2**64 - 2**24)
_MIX = "kind int, target int, doc_id long, text_key long, set_id long, n long, blob binary"


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set: equal sets have equal names."""
    with np.errstate(over="ignore"):
        h = V.mix(np.array([V.mix(s ^ _U(0x5BD1E995)).sum(dtype=_U) + _U(len(s))], _U))
    return int(h.view(np.int64)[0])


class PartEnum:
    """Signatures of sets for one threshold ``percent``/100 (over 0, at most 1)."""

    def __init__(self, percent: int, common: np.ndarray | None = None):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.p = percent
        self.common = common if common is not None and len(common) else None
        self.ends = np.ones(1, np.int64)

    def bands(self, most: int) -> np.ndarray:
        """The ends of the bands up to two beyond size ``most``; band i holds ``ends[i-1] < n <= ends[i]``."""
        ends = self.ends.tolist()
        while len(ends) < 3 or ends[-3] < most:
            ends.append((ends[-1] + 1) * 100 // self.p)
        self.ends = np.array(ends, np.int64)
        return self.ends

    def plan(self, n: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
        """For sets of sizes ``n`` in their own band (``step`` 0) or the next: whether they take
        part, the band, its groups, and how many partitions they keep."""
        ends = self.bands(int(n.max(initial=1)))
        band, most = np.searchsorted(ends, n) + step, n * 100 // self.p
        end = ends[band]
        k = (n + np.minimum(end, most)) * (100 - self.p) // (100 + self.p)
        groups = 2 * end * (100 - self.p) // (100 + self.p) + 1
        # with k = 0 only equal sets are that similar, and they are one node
        part = (n > 0) & (k > 0)
        if step:
            part &= most > ends[band - 1]
        return part, band, groups, k + groups + 1

    def signatures(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The signatures of at most 2**16 sets that lie one after another in ``flat``: places of the sets, and 64-bit numbers."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
        n = sizes.astype(np.int64)
        own = np.repeat(np.arange(len(n)), n)
        with np.errstate(over="ignore"):
            value = V.mix(flat ^ _U(0xA0761D6478BD642F))
            low, high = (value & _U(2**32 - 1)).astype(np.float64), (value >> _U(32)).astype(np.float64)
            rare = None
            if self.common is not None:
                at = np.minimum(np.searchsorted(self.common, flat), len(self.common) - 1)
                rare = (self.common[at] != flat).astype(np.float64)
            for step in (0, 1):
                part, band, groups, keep = self.plan(n, step)
                if not part.any():
                    continue
                parts = np.where(part, 3 * groups, 0)
                ends = np.cumsum(parts)
                starts, total = ends - parts, int(ends[-1])
                some = part[own]
                who = own[some]
                salted = V.mix(flat[some] + (band.astype(_U) * _U(0x632BE59BD9B4E019))[who]) >> _U(32)
                place = starts[who] + (salted * parts.astype(_U)[who] >> _U(32)).astype(np.int64)
                size = np.bincount(place, minlength=total)
                info = size if rare is None else np.bincount(place, rare[some], total)
                # sums of halves stay exact in doubles for fewer than 2**21 elements a partition
                sums = np.bincount(place, low[some], total).astype(_U) + (np.bincount(place, high[some], total).astype(_U) << _U(32))
                who = np.repeat(np.arange(len(n)), parts)
                inside = np.arange(total) - starts[who]
                sums = V.mix(sums ^ V.mix((inside + 1).astype(_U) + (band.astype(_U) << _U(40))[who]))
                few = _U(255) - np.minimum(info, 255).astype(_U) << _U(40) | _U(255) - np.minimum(size, 255).astype(_U) << _U(32)
                order = np.argsort(who.astype(_U) << _U(48) | few | sums >> _U(32), kind="stable")
                kept = np.zeros(total, bool)
                kept[order] = inside < keep[who]
                kept, sums, who = kept.reshape(-1, 3), sums.reshape(-1, 3), who[::3]
                for a, b in ((0, 1), (0, 2), (1, 2)):
                    both = kept[:, a] & kept[:, b]
                    places.append(who[both])
                    found.append(V.mix(sums[both, a] * _U(0x9E3779B97F4A7C15) + sums[both, b]))
        return np.concatenate(places), np.concatenate(found)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[object, np.ndarray]]:
    """The first columns of each row, if there are several as a tuple, with the set of the last one, the text."""
    for b in batches:
        ids = b.column(0).to_pylist() if b.num_columns == 2 else list(zip(*(c.to_pylist() for c in b.columns[:-1])))
        for first, _, data, off in V.texts(b.columns[-1]):
            for i, s in enumerate(V.shingle_sets(data, off, words)):
                yield ids[first + i], s


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


_ROWS = pa.schema([("kind", pa.int32()), ("target", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])


def _scan(words: int, percent: int, targets: int, common):
    """Rows of kind 0: documents with their sets' sketches; kind 1: signatures sent to a target; kind 2: sets that share a signature here."""

    def run(batches):
        enum, task = PartEnum(percent, np.frombuffer(common.value, _U) if common is not None else None), TaskContext.get().partitionId()
        docs, sigs, owners, seen = [], [], [], set()
        names, sets, held, waiting = [], [], 0, 0

        def enumerate_():
            nonlocal held, waiting
            if sets:
                at, x = enum.signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
                sigs.append(x)
                owners.append(np.array(names, np.int64)[at])
                held += len(x)
                names.clear()
                sets.clear()
            waiting = 0

        def flush():
            nonlocal held
            enumerate_()
            sig, own = np.concatenate(sigs or [np.zeros(0, _U)]), np.concatenate(owners or [np.zeros(0, np.int64)])
            sig = sig & _HIGH | sig & _U(targets - 1)
            order = np.argsort(sig, kind="stable")
            sig, own = sig[order], own[order]
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            dup = ~new
            dup[:-1] |= ~new[1:]
            rows = [(0, (task * 31 + i) % targets, *d) for i, d in enumerate(docs)]
            shared, name = sig[dup], own[dup]
            for at in range(0, len(shared), 4096):
                rows.append((2, (task * 31 + at // 4096) % targets, None, None, None, None, shared[at : at + 4096].tobytes() + name[at : at + 4096].tobytes()))
            sig, own = sig[new], own[new]
            to = (sig & _U(targets - 1)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            sig, own = sig[order], own[order]
            low = (sig >> _U(24)).view(np.uint8).reshape(-1, 8)[:, :5]
            heads = np.flatnonzero(np.diff(to[order], prepend=-1))
            for t, a, b in zip(to[order][heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(sig)]):
                rows.append((1, t, None, None, None, None, low[a:b].tobytes() + own[a:b].tobytes()))
            for x in (docs, sigs, owners):
                x.clear()
            seen.clear()
            held = 0
            for at in range(0, len(rows), 5000):
                yield _batch(_ROWS, *zip(*rows[at : at + 5000]))

        for doc, s in _sets(batches, words):
            name = set_id(s) if len(s) else None
            docs.append((*doc, name, len(s), sketch(s).tobytes() if len(s) else None))
            if len(s) and name not in seen:
                seen.add(name)
                names.append(name)
                sets.append(s)
                waiting += len(s)
                if waiting >= ELEMENTS or len(sets) == 1 << 16:
                    enumerate_()
            if held >= WINDOW or len(docs) >= 20_000:
                yield from flush()
        yield from flush()

    return run


_FOUND = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("sig", pa.int64())])


def shared_signatures(key: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``(key, name)`` whose key has several names."""
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name = key[first], name[first]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:].copy()
    return key[same], name[same]


def _meet(batches):
    """Kind 0: documents as they came; kind 1: ``(sig, set_id)`` of signatures that two sets share.

    Rows come sorted by target, and one target's signatures are held at a time.
    """
    now, keys, names = None, [], []

    def out(name, sig):
        for at in range(0, len(name), 50_000):
            a, b = name[at : at + 50_000], sig[at : at + 50_000]
            none = pa.nulls(len(a), pa.int64())
            yield pa.record_batch([pa.array(np.ones(len(a), np.int32)), none, none, pa.array(a), none, pa.nulls(len(a), pa.binary()), pa.array(b)], schema=_FOUND)

    def done():
        if keys:
            key, name = shared_signatures(np.concatenate(keys), np.concatenate(names))
            keys.clear()
            names.clear()
            yield from out(name, key.view(np.int64))

    for b in batches:
        kind = b.column("kind").to_numpy()
        own = b.filter(pa.array(kind == 0))
        yield pa.record_batch([own.column(x) for x in ("kind", "doc_id", "text_key", "set_id", "n", "blob")] + [pa.nulls(len(own), pa.int64())], schema=_FOUND)
        target, blob = b.column("target").to_numpy(), b.column("blob")
        for i in np.flatnonzero(kind > 0).tolist():
            raw = blob[i].as_buffer()
            if kind[i] == 2:
                n = raw.size // 16
                yield from out(np.frombuffer(raw, np.int64, n, n * 8), np.frombuffer(raw, np.int64, n))
                continue
            if now != target[i]:
                yield from done()
                now = target[i]
            n = raw.size // 13
            key = np.zeros((n, 8), np.uint8)
            key[:, :5] = np.frombuffer(raw, np.uint8, n * 5).reshape(n, 5)
            keys.append(key.reshape(-1).view(_U) << _U(24) | _U(now))
            names.append(np.frombuffer(raw, np.int64, n, n * 5).copy())
    yield from done()


def _common_shingles(docs: DataFrame, words: int, rows: int) -> np.ndarray:
    """Shingles of several sampled texts, at most ``HINT_SHINGLES`` of them, sorted."""
    every = max(1, rows // HINT_DOCS)
    picked = docs.where(F.pmod("text_key", F.lit(every)) == 0).dropDuplicates(["text_key"])

    def count(batches):
        for _, s in _sets(batches, words):
            yield pa.record_batch([pa.array(s.view(np.int64))], ["h"])

    kept = picked.select("doc_id", "text").mapInArrow(count, "h long").groupBy("h").count().where(F.col("count") >= HINT_LEAST)
    top = kept.orderBy(F.desc("count"), "h").limit(HINT_SHINGLES).select("h").toArrow()["h"].to_numpy()
    return np.sort(top.astype(np.int64).view(_U))


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of a set's elements in two to four cells an element, as 64-bit words.

    Two sketches differ in at most as many bits as the sets in elements.
    """
    words = 1 << max(0, (2 * len(s) - 1).bit_length() - 6)
    cell = ((V.mix(s ^ _U(0x2545F4914F6CDD1D)) >> _U(8)) & _U(64 * words - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=64 * words) & 1).astype(np.uint8), bitorder="little").view(_U)


def fold(x: np.ndarray, words: int) -> np.ndarray:
    """A sketch as one of ``words`` words, a smaller power of two: the halves' parities add up."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _fits(n, m, apart, percent: int):
    """Whether sets of sizes ``n`` and ``m`` that differ in ``apart`` elements or more can be linked."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def near(n: int, m: int, a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets can be linked, by their sizes and sketches."""
    words = min(len(a), len(b))
    return bool(_fits(n, m, int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum()), percent))


def near_pairs(names: np.ndarray, classes: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], blocks: np.ndarray | None, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of one signature that may link: other classes, sizes and sketches near enough (and other blocks, if given)."""
    words = min(map(len, sketches))
    table = np.stack([fold(x, words) for x in sketches])
    step = max(1, (1 << 20) // (len(names) * words))
    for at in range(0, len(names) - 1, step):
        some = slice(at, at + step)
        ok = (classes[some, None] != classes[None, at:]) & (100 * np.minimum(sizes[some, None], sizes[None, at:]) >= percent * np.maximum(sizes[some, None], sizes[None, at:]))
        if blocks is not None:
            ok &= blocks[some, None] != blocks[None, at:]
        i, j = np.nonzero(np.triu(ok, 1))
        i, j = i + at, j + at
        for cut in range(0, len(i), step * len(names)):
            a, b = i[cut : cut + step * len(names)], j[cut : cut + step * len(names)]
            apart = np.bitwise_count(table[a] ^ table[b]).sum(axis=1, dtype=np.int64)
            for x in np.flatnonzero(_fits(sizes[a], sizes[b], apart, percent)).tolist():
                yield max(names[a[x]], names[b[x]]), min(names[a[x]], names[b[x]])


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(percent: int):
    """Runs of rows with one signature and pair of blocks; gives the pairs that may link."""

    def run(batches):
        held = []

        def out(rows):
            lo, hi = rows[0][0][1:]
            if len(rows) < 2:
                return []
            _, name, c, n, sketches, block = zip(*rows)
            blocks = np.array(block) if lo != hi else None
            return list(near_pairs(np.array(name), np.array(c), np.array(n), [np.frombuffer(x, _U) for x in sketches], blocks, percent))

        for b in batches:
            found = []
            cols = [b.column(c).to_pylist() for c in ("sig", "i", "j", "set_id", "c", "n", "sketch", "block")]
            for sig, i, j, *rest in zip(*cols):
                if held and held[0][0] != (sig, i, j):
                    found += out(held)
                    held = []
                held.append(((sig, i, j), *rest))
            yield _batch(_PAIRS, *(zip(*found) if found else ([], [])))
        found = out(held) if held else []
        yield _batch(_PAIRS, *(zip(*found) if found else ([], [])))

    return run


def _elements(docs: DataFrame, wanted: DataFrame, members: DataFrame, words: int, most: int) -> DataFrame:
    """``(set_id, n, elements)`` for the ``wanted(set_id)``, at most ``most``, made again from one document of each."""
    pick = stored(members.join(wanted, "set_id").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), most)
    found = docs.join(small(pick.select(F.col("doc_id").alias("d"), "set_id")), docs.doc_id.eqNullSafe(F.col("d"))).select("doc_id", "set_id", "text")

    def pack(batches):
        for b in batches:
            rows = [(w, len(s), s.tobytes()) for (_, w), s in _sets(iter([b]), words) if len(s) and set_id(s) == w]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], ["set_id", "n", "elements"])

    out = stored(found.mapInArrow(trimmed(pack), "set_id long, n long, elements binary").dropDuplicates(["set_id"]))
    dropped(pick)
    return out


def _both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs(a, b)`` with the ``columns`` of either end, named with a suffix of 1 or 2."""
    for end, i in (("a", 1), ("b", 2)):
        pairs = pairs.join(table.select(F.col("set_id").alias(end), *[F.col(c).alias(f"{c}{i}") for c in columns]), end)
    return pairs.select("a", "b", *[f"{c}{i}" for i in (1, 2) for c in columns])


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose sizes and sketches allow a link."""

    def test(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("n1", "sketch1", "n2", "sketch2")]
            keep = [near(n, m, np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for n, x, m, y in zip(*cols)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _both(pairs, sketches, ["n", "sketch"]).mapInArrow(trimmed(test), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """The ``pairs(a, b)`` of set ids, at most ``most``, that are linked."""

    def test(batches):
        for b in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), percent) for x, y in zip(b.column("elements1"), b.column("elements2"))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(_both(pairs, sets, ["elements"]).mapInArrow(trimmed(test), "a long, b long"), 100 * most)


def counts_of_links(names: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray | None, percent: int) -> np.ndarray:
    """Links of each set to the others (with ``blocks`` only to those of another block)."""
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, sets = sizes[order], [sets[i] for i in order.tolist()]
    blocks = None if blocks is None else blocks[order]
    ends = np.cumsum(sizes)
    domain, flat = np.unique(np.concatenate(sets), return_inverse=True)
    inside, out = np.zeros(len(domain), np.int32), np.zeros(len(names), np.int64)
    for i in range(len(sets) - 1):
        # the larger sets that may link: n_i * 100 >= percent * n_j
        last = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        if last <= i + 1:
            continue
        own = flat[ends[i] - sizes[i] : ends[i]]
        inside[own] = 1
        both = np.add.reduceat(inside[flat[ends[i] : ends[last - 1]]], ends[i : last - 1] - ends[i])
        inside[own] = 0
        ok = 100 * both.astype(np.int64) >= percent * (sizes[i] + sizes[i + 1 : last] - both)
        if blocks is not None:
            ok &= blocks[i + 1 : last] != blocks[i]
        out[i] += ok.sum()
        out[i + 1 : last] += ok
    back = np.zeros(len(names), np.int64)
    back[order] = out
    return back


def _count(percent: int):
    """Runs of rows with one component and pair of blocks; gives each set's links found there."""

    def run(batches):
        key, names, sets, blocks = None, [], [], []

        def out():
            n = counts_of_links(np.array(names), sets, np.array(blocks) if key[1] != key[2] else None, percent) if len(names) > 1 else np.zeros(len(names), np.int64)
            return pa.record_batch([pa.array(names, pa.int64()), pa.array(n, pa.int64())], ["set_id", "n_links"])

        for b in batches:
            c, i, j, name, block = (b.column(x).to_pylist() for x in ("c", "i", "j", "set_id", "block"))
            elements = b.column("elements")
            for at, now in enumerate(zip(c, i, j)):
                if now != key:
                    if names:
                        yield out()
                    key, names, sets, blocks = now, [], [], []
                names.append(name[at])
                sets.append(np.frombuffer(elements[at].as_py(), _U))
                blocks.append(block[at])
        if names:
            yield out()

    return run


def _n_links(classes: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """``set_id, n_links``: the true number of links of every set that has any; ``sets`` has all their elements."""
    some = classes.count()
    groups = stored(classes.groupBy("component").agg(F.count("*").alias("m")), some)
    named = classes.join(groups, "component").select(F.col("node").alias("set_id"), F.col("component").alias("c"), "m")
    pairs = named.where("m = 2").select("set_id", F.lit(1).cast("long").alias("n_links"))
    rows = named.where("m > 2").join(sets.select("set_id", "n", "elements"), "set_id")
    held = named.where("m > 2").join(sets.select("set_id", "n"), "set_id").groupBy("c").agg(F.sum(8 * F.col("n")).alias("bytes"))
    rows = rows.join(small(stored(held, some)), "c")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = rows.select("c", F.inline(places), "set_id", "block", "elements").repartition(n, "c", "i", "j").sortWithinPartitions("c", "i", "j")
    counted = dealt.mapInArrow(trimmed(_count(percent)), "set_id long, n_links long").groupBy("set_id").agg(F.sum("n_links").alias("n_links"))
    return pairs.unionByName(stored(counted, some))


def _apart(shared: DataFrame, classes: DataFrame, sketches: DataFrame, percent: int, n: int) -> DataFrame:
    """Pairs ``(a, b)`` that may link, of sets that share a signature and are in different classes.

    Of signatures with the same list of sets (as many, and alike in two 64-bit hashes
    of the list) the least stands for all.
    """
    named = shared.join(classes, shared.set_id == classes.node, "left").select("sig", "set_id", F.coalesce("component", "set_id").alias("c"))
    named = stored(named, shared.count())
    lists = named.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y"))
    mixed = stored(lists.where("lo <> hi").groupBy("m", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "m"), shared.count())
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = named.join(small(mixed), "sig").join(sketches, "set_id").withColumn("block", F.pmod(F.xxhash64("set_id"), blocks).cast("int"))
    places = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = rows.select("sig", F.inline(places), "set_id", "c", "n", "sketch", "block").repartition(n, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    out = stored(dealt.mapInArrow(trimmed(_compare(percent)), "a long, b long").distinct(), shared.count())
    dropped(named, mixed)
    return out


def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80, counted: bool = True) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_id, class_id, component_id, n_links`` for every row of ``docs(doc_id, text)``.

    ``n_shingles`` is the size of the document's set of ``words``-word shingles over
    words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document of fewer words
    has its whole sequence as one. Documents link when 100*|A&B| >= percent*|A|B|.
    ``component_id`` is the smallest doc_id reachable by links, ``set_id`` the name
    of the set, equal for equal sets and null for empty ones, ``class_id`` that of the
    component, ``text_key`` xxhash64 of the text and ``n_links`` the set's links to all
    other sets; with ``counted`` false that column is left out.

    Null or empty text, or text of spaces only: an empty set, linked with nothing,
    so the component is the row's own doc_id. Repeated rows and ties are equal sets
    and share a component. A null doc_id takes part in links but names no component.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # some two bytes of signatures for a byte of text; a target's share is held in one task
    targets = 1 << min(24, max(6, (max(4 * n, 2 * size // TARGET_BYTES) - 1).bit_length()))
    top = _common_shingles(docs, words, rows)
    common = spark.sparkContext.broadcast(top.tobytes()) if len(top) else None
    sent = docs.mapInArrow(trimmed(_scan(words, percent, targets, common)), _MIX).repartition(n, "target").sortWithinPartitions("target")
    found = stored(sent.mapInArrow(trimmed(_meet), "kind int, doc_id long, text_key long, set_id long, n long, sketch binary, sig long"))
    members = found.where("kind = 0").select("doc_id", "text_key", "set_id", "n")
    shared = stored(found.where("kind = 1").select("sig", "set_id").distinct())
    meeting = stored(shared.groupBy("set_id").agg(F.count("*").alias("times")), shared.count())
    sketches = stored(found.where("kind = 0").join(small(meeting.select("set_id")), "set_id", "left_semi").groupBy("set_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    hubs = shared.join(small(meeting), "set_id").groupBy("sig").agg(F.max(F.struct("times", "set_id"))["set_id"].alias("hub"))
    ends = shared.join(hubs, "sig").where("set_id <> hub").select(F.greatest("set_id", "hub").alias("a"), F.least("set_id", "hub").alias("b"))
    star = ends.distinct()
    tried = stored(_near(star, sketches, percent), shared.count())
    ends = lambda pairs: pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    most = tried.count()
    sets = _elements(docs, ends(tried), members, words, 2 * most)
    links = _verified(tried, sets, percent, most)
    classes = stored(components(links, rows=most), 2 * most)
    apart = _apart(shared, classes, sketches, percent, n)
    more = stored(apart.join(tried, ["a", "b"], "left_anti"), apart.count())
    if found_more := more.count():
        sets = sets.unionByName(_elements(docs, ends(more).join(sets, "set_id", "left_anti"), members, words, 2 * found_more))
        links = links.unionByName(_verified(more, sets, percent, found_more))
        classes = stored(components(links, rows=most + found_more), 2 * (most + found_more))
    dropped(shared, meeting, sketches, tried, apart, more)
    return _result(members, classes, _n_links(classes, sets, percent, n) if counted else None)


def _result(members: DataFrame, classes: DataFrame, ends: DataFrame | None) -> DataFrame:
    sets = classes.select(F.col("node").alias("set_id"), "component")
    sets = sets.join(ends, "set_id", "left") if ends is not None else sets.withColumn("n_links", F.lit(None).cast("long"))
    filled = members.where("set_id is not null").join(sets, "set_id", "left").select("doc_id", "text_key", "set_id", "n", F.coalesce("component", "set_id").alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    filled = stored(filled)
    least = filled.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    filled = filled.join(least, "c").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "set_id", F.col("c").alias("class_id"), "component_id", "n_links")
    blank = members.where("set_id is null").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "set_id", F.lit(None).cast("long").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = filled.unionByName(blank)
    return out if ends is not None else out.drop("n_links")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class: its smallest doc_id (null last). Rows without words all stay.

    Only the rows that go, and rows that repeat one id and text, are joined with the
    texts; both are broadcast if they are few and shuffled otherwise.
    """
    rows = stored(jaccard_classes(docs, words, percent, counted=False).where("class_id is not null").groupBy("class_id", "doc_id", "text_key").agg(F.count("*").alias("rows")))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    best = rows.groupBy("class_id").agg(F.min(first).alias("best"))
    rows = stored(rows.join(best, "class_id").withColumn("stays", first == F.col("best")).select("doc_id", "text_key", "rows", "stays"))
    key = F.xxhash64("text")

    def side(df: DataFrame):
        s = small(df.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")))
        return s, docs.doc_id.eqNullSafe(s.d) & (key == s.t)

    kept = docs.join(*side(rows.where("not stays")), "left_anti")
    again = rows.where("stays and rows > 1")
    if again.take(1):
        s, _ = side(again)
        same = kept.doc_id.eqNullSafe(s.d) & (key == s.t)
        once = kept.join(s, same, "left_semi").withColumn("t__", key).dropDuplicates(["doc_id", "t__"]).drop("t__")
        kept = kept.join(s, same, "left_anti").unionByName(once)
    return kept


#: The same as ``jaccard_classes`` with its defaults, as SQL over ``documents``.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
k AS (SELECT doc_id, g, CAST(len(g) AS BIGINT) AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), chr(10))) END AS name FROM s),
u AS (SELECT name, any_value(n) AS n, any_value(g) AS g, min(doc_id) AS least FROM k WHERE name IS NOT NULL GROUP BY name),
e AS (SELECT name, n, unnest(g) AS t FROM u),
p AS (SELECT a.name AS x, b.name AS y, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS both_ FROM e a JOIN e b ON a.t = b.t AND a.name <> b.name GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * both_ >= 80 * (m + n - both_)),
r(x, y) AS (SELECT name, name FROM u UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT r.x AS name, min(u.least) AS component_id FROM r JOIN u ON r.y = u.name GROUP BY 1),
h AS (SELECT x AS name, count(*) AS n_links FROM l GROUP BY 1)
SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.name IS NULL THEN k.doc_id ELSE c.component_id END AS component_id, CAST(coalesce(h.n_links, 0) AS BIGINT) AS n_links
FROM k LEFT JOIN c ON k.name = c.name LEFT JOIN h ON k.name = h.name
"""
