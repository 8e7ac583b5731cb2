"""Quality by compression: two zstandard dictionaries, one built from good and one from bad text.

A text is cut into pieces; every piece is compressed with either dictionary and
without one. The features are the difference of the two compressed sizes (bad
minus good) per byte and the size without a dictionary per byte; a logistic
calibration turns them into the probability of label 1.

Only the fit uses labels, and of them bounded samples: ``DICT_ROWS`` labelled rows
of each class for the dictionaries and twice as many others, as they come, for the
calibration, texts that repeat counted once. A dictionary is trained on ``SHARE``
pieces of each of its rows at most, spread evenly over the whole text, so the driver
holds DICT_ROWS * SHARE * SAMPLE_PIECE bytes a class at most; the calibration's texts are
compressed whole, in the tasks. Every text is scored whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, fold, stored

#: Bounds of the samples: labelled rows of each class for the dictionaries (and twice as many for
#: the calibration), pieces that a row gives to a dictionary, and their bytes.
DICT_ROWS, SHARE, SAMPLE_PIECE = 2000, 4, 2048
DICT_BYTES, PIECE, LEVEL = 65_536, 1024, 3
FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(pieces)[:DICT_BYTES]


def spread(text: bytes, most: int = SHARE, size: int = SAMPLE_PIECE) -> list[bytes]:
    """The pieces of ``size`` bytes of ``text``, or ``most`` of them at even distances."""
    n = -(-len(text) // size)
    return [text[i * size : (i + 1) * size] for i in (range(n) if n <= most else [k * (n - 1) // (most - 1) for k in range(most)])]


class Sizes:
    """Compressed-size features of texts for a pair of dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(d) if d else None)
        self.with_good, self.with_bad, self.plain = make(good), make(bad), make(b"")

    def __call__(self, text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 1.0
        g = b = p = 0
        for i in range(0, len(text), PIECE):
            piece = text[i : i + PIECE]
            g += len(self.with_good.compress(piece))
            b += len(self.with_bad.compress(piece))
            p += len(self.plain.compress(piece))
        return (b - g) / len(text), p / len(text)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression on ``x`` with a constant last."""
    a = np.c_[x, np.ones(len(x))]
    scale = np.r_[x.std(0) + 1e-9, 1.0]
    a = a / scale
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        sizes, (d, p, c) = Sizes(self.good, self.bad), self.weights
        return lambda text: sigmoid(d * (x := sizes(text))[0] + p * x[1] + c)


def sample_rows(labels: DataFrame, docs: DataFrame, label: str, folds: int, held_out: int, rows: int, salt: int) -> DataFrame:
    """``text, y, fit, text_key``: bounded samples of labelled rows outside the held-out fold, each text once
    for a class: ``rows`` of either class, and with ``fit`` twice as many as they come.

    Rows are taken in the order of a hash of the id, from two halves of the ids, so
    that no row serves both. Null labels, ids and texts are passed over.
    """
    h = F.xxhash64("doc_id", F.lit(salt))
    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    one = one.select("doc_id", F.col(label).cast("int").alias("y"), h.alias("h"), (F.pmod(h, F.lit(2)) == 0).alias("fit"))
    top = lambda df, n: df.orderBy("h", "doc_id", "y").limit(n)
    ids = top(one.where("fit"), rows * 2).unionByName(top(one.where("not fit and y = 1"), rows)).unionByName(top(one.where("not fit and y = 0"), rows))
    picked = F.broadcast(stored(ids))  # at most 4 * rows ids
    found = docs.where("text is not null").select("doc_id", "text").join(picked, "doc_id").withColumn("text_key", F.xxhash64("text"))
    return found.dropDuplicates(["fit", "y", "text_key"]).select("text", "y", "fit", "text_key")


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """The model of labelled rows outside the held-out fold; without both classes it scores their share."""
    got = stored(sample_rows(labels, docs, "quality", folds, held_out, DICT_ROWS, 8))

    def cut(batches):
        for b in batches:
            for y, key, text in zip(*(c.to_pylist() for c in b.columns)):
                pieces = spread(text.encode())
                yield pa.record_batch([pa.array([y] * len(pieces), pa.int32()), pa.array([key] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["y", "text_key", "i", "piece"])

    t = got.where("not fit").select("y", "text_key", "text").mapInArrow(cut, "y int, text_key long, i int, piece binary").toArrow().sort_by([("text_key", "ascending"), ("i", "ascending")])
    good, bad = (t.filter(pc.equal(t["y"], y))["piece"].to_pylist() for y in (1, 0))
    counts = {r.y: r.n for r in got.where("fit").groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if not good or not bad or len(counts) < 2:
        return Model(b"", b"", (0.0, 0.0, math.log(share / (1 - share))))
    good, bad = _dictionary(good), _dictionary(bad)
    given = docs.sparkSession.sparkContext.broadcast((good, bad))

    def measure(batches):
        sizes = Sizes(*given.value)
        for b in batches:
            x = [sizes(t.as_py().encode()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([a for _, a in x], pa.float64())], ["y", "d", "p"])

    x = got.where("fit").select("y", "text").mapInArrow(measure, "y int, d double, p double").toArrow().sort_by([("d", "ascending"), ("p", "ascending"), ("y", "ascending")])
    dropped(got)
    return Model(good, bad, tuple(logistic(np.c_[x["d"].to_numpy(), x["p"].to_numpy()], x["y"].to_numpy().astype(float)).tolist()))


def scored(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` for every row, other columns kept.

    Null and empty texts get the score of a text that neither dictionary helps.
    Equal texts have equal scores; repeated rows stay; no rows give no rows. Columns
    of ``docs`` named like the three are replaced.
    """
    keep = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    docs = docs.select(*keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES
    at = keep.index("text")

    def run(batches):
        score = shared.value.scorer()
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            out = pa.array([score(t.as_py() or b"") for t in texts], pa.float64())
            yield pa.record_batch([*b.columns, out], names=[*keep, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    out = docs.mapInArrow(run, schema)
    return out.withColumn("held_out", fold("doc_id", folds) == held_out).withColumn("predicted", (F.col("score") >= accept).cast("int"))
