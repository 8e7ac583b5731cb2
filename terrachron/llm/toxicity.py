"""Toxicity by two class-conditional Kneser-Ney models, toxic and ordinary.

Counts: n_c(u,w) is the number of documents of class c's sample in which word w follows
word u, and N1+_c(.w) the number of distinct words that w follows there. Either class has

    p_c(w)   = e_c(w) / N1+_c(..)  + b_c    * p(w)     p(w) = N1+(.w) / N1+(..) over the whole corpus
    p_c(w|u) = e_c(u,w) / n_c(u.)  + b_c(u) * p_c(w)

where e is the excess of a count over its discount, max(n (1 - K r) - D, 0), and b what the
discounts leave of the mass, so each of the distributions sums to 1. The backoff
counts N1+(.w), and the documents of the corpus that have a word or pair, are shared by
both classes. D is Kneser-Ney's constant discount. K r is added: r is the part of the
class's documents with the expression that the rate of such documents in the corpus,
or in the other class, explains. Without it the log-likelihoods of long documents are
ruled by how languages and subjects happen to be spread over two samples: with D alone
the AUC on held-out rows was 0.83 at best (README). So rare expressions, and
those no commoner in a class than elsewhere, fall back on the shared counts and say nothing.

A document's score is the calibrated mean of log p_toxic - log p_ordinary a word.

Words that have no excess in either class, and end no pair that might have one, have the
same ratio whatever their counts, so they are one word of the vocabulary. The shared
counts cover all documents. They are exact, by 64-bit hashes of words and pairs and,
inside a word, 44-bit hashes of its contexts. The class counts come from bounded samples
of labelled rows outside the held-out fold; texts stay in the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import dropped, fold, stored, trimmed
from .quality import logistic, sample_rows, sigmoid

#: Discounts of words and of pairs, and the weights of what is expected.
D, K, D2, K2 = 2.0, 3.0, 4.0, 4.0
#: Labelled rows per class for the counts, and twice as many, as they come, for the calibration.
SAMPLE_ROWS = 4000
FOLDS, HELD_OUT = 5, 0
#: Distinct keys that a task holds before it sends them on.
HELD = 1 << 20
_U = np.uint64
_START = _U(0x1234567)
_CONTEXT = 44


def pair_hashes(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return V.mix(before * _U(0x9E3779B97F4A7C15) + h)


def words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents: the word hashes, those of the words before (the first of a document follows
    a start mark) and the place of each document's first word. Null and empty texts have none."""
    for _, _, data, off in V.texts(column):
        starts, ends, at = V.tokens(data, off, V.WORD)
        h = V.word_hashes(data, starts, ends)
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[at[:-1][at[:-1] < at[1:]]] = _START
        yield h, before, at


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of ``asked`` in the sorted ``keys``; ``len(keys)`` if absent."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, len(keys))


def _once_a_document(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the first of equal ``keys`` in each document."""
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((keys, own))
    k, o = keys[order], own[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return order[first]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sample_counts(rows: DataFrame) -> DataFrame:
    """``kind, y, u, w, n``: documents of each class that have the pair (kind 0) or the word (1), for ``rows(y, text)``."""

    def run(batches):
        for b in batches:
            for y in (0, 1):
                for h, before, at in words(b.column(1).filter(pc.equal(b.column(0), y))):
                    for kind, key in enumerate((pair_hashes(before, h), h)):
                        one = _once_a_document(key, at)
                        _, first, n = np.unique(key[one], return_index=True, return_counts=True)
                        for i in range(0, len(first), 50_000):
                            k = one[first[i : i + 50_000]]
                            u = before[k] if kind == 0 else np.zeros(len(k), _U)
                            yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(np.full(len(k), y, np.int32)), _signed(u), _signed(h[k]), pa.array(n[i : i + 50_000])], ["kind", "y", "u", "w", "n"])

    return stored(rows.mapInArrow(trimmed(run), "kind int, y int, u long, w long, n long").groupBy("kind", "y", "u", "w").agg(F.sum("n").alias("n")))


def _arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a small table on the driver; 64-bit hashes (``u``, ``w``) as unsigned."""
    t = df.select(*names).toArrow()
    return [t[c].to_numpy().astype(np.int64).view(_U) if c in ("u", "w") else t[c].to_numpy().astype(float) for c in names]


def _uncommon(df: DataFrame, docs: dict[int, int], d: float, k: float) -> DataFrame:
    """The rows of ``df(n0, n1)`` that one class has in more than ``d`` documents and ``k`` times the other's rate."""
    rate = docs[1] / docs[0]
    return df.where(f"n1 > {d!r} and n1 > {k * rate!r} * n0 or n0 > {d!r} and n0 > {k / rate!r} * n1")


def _classes(y: str, n) -> list:
    return [F.coalesce(F.sum(F.when(F.col(y) == c, n)), F.lit(0)).alias(f"n{c}") for c in (0, 1)]


def _corpus_counts(docs: DataFrame, vocabulary: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Over all ``docs``: distinct words before each word of the sorted ``vocabulary`` and, last, before
    any other word; documents with each of the words, and of the ``pairs`` (sorted hashes); documents."""
    given = docs.sparkSession.sparkContext.broadcast((vocabulary, pairs))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    targets, schema = 4 * n, pa.schema([("target", pa.int32()), ("keys", pa.binary())])

    def gather(batches):
        own, two = given.value
        keys, held, count = [], 0, 0
        seen = [np.zeros(len(x) + 1, np.int64) for x in (own, two)]

        def flush():
            nonlocal held
            if keys:
                key = np.unique(np.concatenate(keys))
                to = (V.mix(key) % _U(targets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                heads = np.flatnonzero(np.diff(to[order], prepend=-1)).tolist()
                yield pa.record_batch([pa.array(to[order][heads], pa.int32()), pa.array([key[order[a:b]].tobytes() for a, b in zip(heads, [*heads[1:], len(key)])], pa.binary())], schema=schema)
                keys.clear()
            held = 0

        for b in batches:
            count += b.num_rows
            for h, before, at in words(b.column(0)):
                places = (_find(own, h), _find(two, pair_hashes(before, h)))
                keys.append(np.unique(places[0].astype(_U) << _U(_CONTEXT) | V.mix(before) >> _U(64 - _CONTEXT)))
                held += len(keys[-1])
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                for x, p in zip(seen, places):
                    some = np.flatnonzero(p < len(x) - 1)
                    x += np.bincount(np.unique(doc[some] * len(x) + p[some]) % len(x), minlength=len(x))
                if held >= HELD:
                    keys[:] = [np.unique(np.concatenate(keys))]
                    held = len(keys[0])
                    if held >= HELD // 2:
                        yield from flush()
        yield from flush()
        # sums of documents: targets -1 for words, -2 for pairs, -3 for all
        for target, x in ((-1, seen[0][:-1]), (-2, seen[1][:-1]), (-3, np.array([count]))):
            some = np.flatnonzero(x)
            yield pa.record_batch([pa.array([target], pa.int32()), pa.array([np.r_[some, x[some]].astype(np.int64).tobytes()], pa.binary())], schema=schema)

    def count(batches):
        now, keys = None, []

        def done():
            if keys:
                key = np.unique(np.concatenate(keys)) >> _U(_CONTEXT)
                at, sums = np.unique(key, return_counts=True)
                keys.clear()
                yield pa.record_batch([pa.array(np.zeros(len(at), np.int32)), _signed(at), pa.array(sums)], ["kind", "at", "n"])

        for b in batches:
            for target, blob in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(blob.as_py(), np.int64)
                if target < 0:
                    m = len(x) // 2
                    yield pa.record_batch([pa.array(np.full(m, -target, np.int32)), pa.array(x[:m]), pa.array(x[m:])], ["kind", "at", "n"])
                    continue
                if target != now:
                    yield from done()
                    now = target
                keys.append(x.view(_U))
        yield from done()

    sent = docs.select("text").mapInArrow(trimmed(gather), "target int, keys binary").repartition(n, "target").sortWithinPartitions("target")
    got = sent.mapInArrow(trimmed(count), "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, at, sums = (got[c].to_numpy() for c in ("kind", "at", "n"))
    out = [np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary)), np.zeros(len(pairs))]
    for k, x in enumerate(out):
        x[at[kind == k]] = sums[kind == k]
    return *out, int(sums[kind == 3].sum())


@dataclass(frozen=True)
class Model:
    """Sorted hashes with their log ratios: words (others have ``other``), contexts' backed-off mass, corrections of seen pairs."""

    word: tuple[np.ndarray, np.ndarray]
    context: tuple[np.ndarray, np.ndarray]
    pair: tuple[np.ndarray, np.ndarray]
    other: float
    weights: tuple[float, float]

    def means(self, column: pa.Array) -> np.ndarray:
        """The mean log ratio a word of each text; without words 0."""
        out = [np.zeros(0)]
        for h, before, at in words(column):
            each = np.zeros(len(h))
            for (keys, values), asked, missing in ((self.word, h, self.other), (self.context, before, 0.0), (self.pair, pair_hashes(before, h), 0.0)):
                each += np.append(values, missing)[_find(keys, asked)]
            n, mean = np.diff(at), np.zeros(len(at) - 1)
            if len(h):
                mean[n > 0] = np.add.reduceat(each, at[:-1][n > 0]) / n[n > 0]
            out.append(mean)
        return np.concatenate(out)

    def probability(self, mean: float) -> float:
        return sigmoid(self.weights[0] * mean + self.weights[1])


def excess(count: np.ndarray, docs: np.ndarray, size: int, shared: np.ndarray, other: np.ndarray, d: float, k: float, rarer: float) -> np.ndarray:
    """What is left of ``count`` after the discount ``d`` and ``k`` times the part of it that is explained.

    ``docs`` of a class's ``size`` sampled documents have the expression; the rates ``shared``, of the corpus,
    and ``other``, of the other class, explain so many of them. What only the rarer class has, with the share
    ``rarer`` of all rows, comes up there 1/rarer times as often as in the corpus; of the shared rate
    no more is taken than half way from once to that.
    """
    explained = size * np.maximum(min(k, (1 + 1 / rarer) / 2) * shared, k * other) / np.maximum(docs, 1.0)
    return np.maximum(count * (1 - np.minimum(explained, 1)) - d, 0)


def word_probabilities(seen: dict[int, np.ndarray], docs: dict[int, np.ndarray], size: dict[int, int], shared: np.ndarray, rate: np.ndarray, rarer: float) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """p_c(w) and b_c for continuation counts ``seen`` of a class and ``shared`` ones, the last entry being all other
    words, the classes' documents with each word and their numbers, and the ``rate`` of such documents in the corpus."""
    p = (shared + 0.5) / (shared.sum() + 0.5 * len(shared))
    out, left = {}, {}
    for y in (0, 1):
        total = max(seen[y].sum(), 1.0)
        e = np.append(excess(seen[y][:-1], docs[y], size[y], rate, docs[1 - y] / size[1 - y], D, K, rarer), 0.0)
        left[y] = 1 - e.sum() / total
        out[y] = e / total + left[y] * p
    return out, left


def pair_probabilities(count: dict[int, np.ndarray], follow: dict[int, np.ndarray], at: np.ndarray, docs: dict[int, int], shared: np.ndarray, word: dict[int, np.ndarray], rarer: float):
    """p_c(w|u) of pairs whose context is number ``at``, and b_c(u), for pair counts, context counts ``follow``, numbers
    of documents, the share of the corpus's documents that has each pair, and the last words' p_c(w)."""
    p, left = {}, {}
    for y in (0, 1):
        e = excess(count[y], count[y], docs[y], shared, count[1 - y] / docs[1 - y], D2, K2, rarer)
        n = np.maximum(follow[y], 1.0)
        left[y] = 1 - np.bincount(at, e, len(n)) / n
        p[y] = e / n[at] + left[y][at] * word[y]
    return p, left


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """The models and their calibration; without both classes every score is the share of toxic labels."""
    spark = docs.sparkSession
    got = stored(sample_rows(labels, docs, "toxic", folds, held_out, SAMPLE_ROWS, 3).select("fit", "y", "text"))
    size = {(r.fit, r.y): r.n for r in got.groupBy("fit", "y").agg(F.count("*").alias("n")).collect()}
    of = lambda fit, y: size.get((fit, y), 0)
    share = (of(True, 1) + 1) / (of(True, 0) + of(True, 1) + 2)
    none = (np.zeros(0, _U), np.zeros(0))
    constant = Model(none, none, none, 0.0, (0.0, math.log(share / (1 - share))))
    if not all(of(f, y) for f in (True, False) for y in (0, 1)):
        return constant
    rarer = min(share, 1 - share)
    table = _sample_counts(got.where("not fit").select("y", "text"))
    n_docs = {y: of(False, y) for y in (0, 1)}
    pairs, single = table.where("kind = 0"), table.where("kind = 1").groupBy("w").agg(*_classes("y", F.col("n")))
    pu, pw, p0, p1 = _arrays(_uncommon(pairs.groupBy("u", "w").agg(*_classes("y", F.col("n"))), n_docs, D2, K2), "u", "w", "n0", "n1")
    ends = spark.createDataFrame(pa.table({"w": _signed(np.unique(pw))}))
    chosen = stored(_uncommon(single, n_docs, D, K).select("w").union(ends).distinct())
    here = F.broadcast(chosen)  # of the bounded sample
    # distinct words before each of them
    sums = pairs.join(here, "w").groupBy("w").agg(*_classes("y", F.lit(1))).select("w", F.col("n0").alias("c0"), F.col("n1").alias("c1"))
    w, n0, n1, c0, c1 = _arrays(single.join(here, "w").join(sums, "w"), "w", "n0", "n1", "c0", "c1")
    # all other words together: distinct words before any of them
    rest = {r.y: r.n for r in pairs.join(here, "w", "left_anti").select("y", "u").distinct().groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = np.argsort(w)
    w, have = w[order], {0: n0[order], 1: n1[order]}
    seen = {y: np.append(x[order], rest.get(y, 0)) for y, x in ((0, c0), (1, c1))}
    key = pair_hashes(pu, pw)
    order = np.argsort(key)
    key, pu, pw, count = key[order], pu[order], pw[order], {0: p0[order], 1: p1[order]}
    one, with_word, two, n = _corpus_counts(docs, w, key)
    word, left = word_probabilities(seen, have, n_docs, one, with_word / max(n, 1), rarer)
    ratio, other = np.log(word[1]) - np.log(word[0]), math.log(left[1]) - math.log(left[0])
    before = np.unique(pu)
    context, pair = np.zeros(len(before)), np.zeros(0)
    if len(key):
        asked = F.broadcast(spark.createDataFrame(pa.table({"u": _signed(before)})))
        u, f0, f1 = _arrays(pairs.join(asked, "u").groupBy("u").agg(*_classes("y", F.col("n"))), "u", "n0", "n1")
        order = np.argsort(u)
        at, last = np.searchsorted(before, pu), np.searchsorted(w, pw)
        p, b = pair_probabilities(count, {0: f0[order], 1: f1[order]}, at, n_docs, two / max(n, 1), {y: word[y][last] for y in (0, 1)}, rarer)
        context = np.log(b[1]) - np.log(b[0])
        pair = np.log(p[1]) - np.log(p[0]) - context[at] - ratio[last]
        some = np.abs(pair) > 1e-9
        key, pair = key[some], pair[some]
    model = Model((w, ratio[:-1]), (before, context), (key, pair), other, (0.0, 0.0))
    given = spark.sparkContext.broadcast(model)

    def means(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(given.value.means(b.column(1)))], ["y", "mean"])

    x = got.where("fit").select("y", "text").mapInArrow(means, "y int, mean double").orderBy("mean", "y").toArrow()
    dropped(table, chosen)
    weights = logistic(x["mean"].to_numpy().reshape(-1, 1), x["y"].to_numpy().astype(float), 1e-3)
    return Model(model.word, model.context, model.pair, other, tuple(weights.tolist()))


def scored(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT, accept: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted, log_ratio`` for every row of ``docs(doc_id, text)``.

    Null texts, and texts without words, have a log ratio of 0. Equal texts have
    equal scores; repeated rows stay; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words, contexts and pairs of the bounded sample

    def run(batches):
        for b in batches:
            x = shared.value.means(b.column(1))
            score = 1 / (1 + np.exp(-np.clip(shared.value.weights[0] * x + shared.value.weights[1], -30, 30)))
            yield pa.record_batch([b.column(0), pa.array(score), pa.array(x)], ["doc_id", "score", "log_ratio"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, score double, log_ratio double")
    return out.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"), "log_ratio")
