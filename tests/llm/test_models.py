"""The toxicity and quality models against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from terrachron.llm import quality, toxicity

DOC = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def pairs_of(text):
    w = words_of(text)
    return list(zip(["<s>", *w], w))


class Plain:
    """The two models with dictionaries, for samples of texts by class and a corpus."""

    def __init__(self, sample, corpus, rarer=0.3):
        half = lambda k: min(k, (1 + 1 / rarer) / 2)
        D, K, D2, K2 = toxicity.D, toxicity.K, toxicity.D2, toxicity.K2
        n = {y: Counter(p for t in sample[y] for p in set(pairs_of(t))) for y in (0, 1)}
        have = {y: Counter(w for t in sample[y] for w in set(words_of(t))) for y in (0, 1)}
        docs = {y: len(sample[y]) for y in (0, 1)}
        odd = lambda a, b, d, k: a > d and a * docs[0] > k * b * docs[1] or b > d and b * docs[1] > k * a * docs[0]
        pairs = {p for p in {*n[0], *n[1]} if odd(n[1][p], n[0][p], D2, K2)}
        self.vocabulary = {w for w in {*have[0], *have[1]} if odd(have[1][w], have[0][w], D, K)} | {w for _, w in pairs}
        name = lambda w: w if w in self.vocabulary else None
        contexts = lambda ps: (lambda seen: Counter(w for _, w in seen))({(u, name(w)) for u, w in ps})
        shared = contexts(p for t in corpus for p in pairs_of(t))
        all_ = sum(shared.values()) + 0.5 * (len(self.vocabulary) + 1)
        p = {w: (shared[w] + 0.5) / all_ for w in [*self.vocabulary, None]}
        corpus_have = Counter(w for t in corpus for w in set(words_of(t)))
        seen = {y: contexts(n[y]) for y in (0, 1)}
        size = {y: sum(seen[y].values()) for y in (0, 1)}

        def over(count, mine, other, shared, y, d, k):
            part = docs[y] * max(half(k) * shared / len(corpus), k * other / docs[1 - y]) / max(mine, 1)
            return max(count * (1 - min(part, 1)) - d, 0)

        self.word = {}
        for y in (0, 1):
            e = {w: 0.0 if w is None else over(seen[y][w], have[y][w], have[1 - y][w], corpus_have[w], y, D, K) for w in p}
            left = 1 - sum(e.values()) / size[y]
            self.word[y] = {w: e[w] / size[y] + left * p[w] for w in p}
        two = Counter(q for t in corpus for q in set(pairs_of(t)) & pairs)
        self.pair, self.left, self.follow = {}, {}, {}
        for y in (0, 1):
            follow = Counter()
            for (u, _), c in n[y].items():
                follow[u] += c
            e = {q: over(n[y][q], n[y][q], n[1 - y][q], two[q], y, D2, K2) for q in pairs}
            self.left[y] = {u: 1 - sum(x for (v, _), x in e.items() if v == u) / max(follow[u], 1) for u, _ in pairs}
            self.pair[y] = {q: x / max(follow[q[0]], 1) for q, x in e.items()}

    def probability(self, y, u, w):
        one = self.word[y][w if w in self.vocabulary else None]
        return self.pair[y].get((u, w), 0.0) + self.left[y].get(u, 1.0) * one

    def mean(self, text):
        ratios = [math.log(self.probability(1, u, w)) - math.log(self.probability(0, u, w)) for u, w in pairs_of(text)]
        return sum(ratios) / len(ratios) if ratios else 0.0


def corpus(seed, n=500):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 4))) for _ in range(120)]
    out = []
    for i in range(n):
        w = rng.choices(plain, k=rng.randint(1, 30))
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = rng.choice([["Vile"], ["vile"], ["you", "rotten"], ["you", "rotten", "beast"]])
        if i % 5 == 0:
            w[0:0] = ["you"]
        out.append((i, " ".join(w), int(i % 3 == 0)))
    return out + [(n, "", 0), (n + 1, None, 1), (n + 2, out[0][1], 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_toxicity_scores_are_those_of_the_plain_model(spark, monkeypatch, seed):
    monkeypatch.setattr(toxicity, "D2", 1.0)
    monkeypatch.setattr(toxicity, "K2", 1.5)
    rows = corpus(seed)
    d = spark.createDataFrame([r[:2] for r in rows], DOC)
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sample, as_they_come = defaultdict(list), Counter()
    for r in quality.sample_rows(lab, d, "toxic", toxicity.FOLDS, toxicity.HELD_OUT, toxicity.SAMPLE_ROWS, 3).collect():
        if r.fit:
            as_they_come[r.y] += 1
        else:
            sample[r.y].append(r.text)
    plain, model = Plain(sample, [t for _, t, _ in rows], (min(as_they_come.values()) + 1) / (sum(as_they_come.values()) + 2)), toxicity.fit(d, lab)
    assert any(x > 0 for x in plain.pair[1].values()) and len(model.pair[0])
    got = {r.doc_id: r.log_ratio for r in toxicity.scored(d, model).collect()}
    assert got == pytest.approx({i: plain.mean(t) for i, t, _ in rows}, abs=1e-9)


def test_kneser_ney_mass_is_whole(monkeypatch):
    monkeypatch.setattr(toxicity, "D2", 1.0)
    rows = corpus(3)
    sample = {y: [t for _, t, x in rows if x == y] for y in (0, 1)}
    plain = Plain(sample, [t for _, t, _ in rows])
    contexts = {u for u, _ in plain.pair[1]} | {"abc"}
    for y in (0, 1):
        assert sum(plain.word[y].values()) == pytest.approx(1) and min(plain.word[y].values()) > 0
        for u in contexts:
            assert sum(plain.probability(y, u, w) for w in [*plain.vocabulary, "<other>"]) == pytest.approx(1)
    seen = {0: np.array([9.0, 4.0, 9.0, 200.0]), 1: np.array([40.0, 4.0, 9.0, 220.0])}
    docs = {0: np.array([3.0, 5.0, 9.0]), 1: np.array([90.0, 5.0, 9.0])}
    word, left = toxicity.word_probabilities(seen, docs, {0: 100, 1: 100}, np.array([40.0, 10.0, 30.0, 900.0]), np.array([0.1, 0.05, 0.09]), 0.3)
    assert all(word[y].sum() == pytest.approx(1) and 0 < left[y] <= 1 for y in (0, 1)) and word[1][0] > word[0][0]


def test_corpus_counts_are_exact(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(200))) for _ in range(300)] + ["", None, "w1 w2 w1 w2"] * 3
    at = lambda ws: np.concatenate([h for h, _, _ in toxicity.words(pa.array(ws))])
    own = sorted((f"w{i}" for i in range(0, 3000, 7)), key=lambda w: at([w])[0])
    two = [p for t in texts[:40] for p in pairs_of(t)[1:]] + [("no", "pair"), ("w1", "w2")]
    key = lambda p: toxicity.pair_hashes(at([p[0]]), at([p[1]]))[0]
    two = sorted(set(two), key=key)
    got = toxicity._corpus_counts(spark.createDataFrame(list(enumerate(texts)), DOC).repartition(3), at(own), np.array([key(p) for p in two], np.uint64))
    before, docs, have = defaultdict(set), Counter(), Counter()
    for t in texts:
        have.update(set(words_of(t)))
        docs.update(set(pairs_of(t)))
        for u, w in pairs_of(t):
            before[w if w in set(own) else None].add(u)
    assert got[0].tolist() == [len(before[w]) for w in [*own, None]]
    assert got[1].tolist() == [have[w] for w in own]
    assert got[2].tolist() == [docs[p] for p in two] and got[3] == len(texts)


def test_models_on_long_and_repeated_texts(spark):
    """Texts of a million characters are scored whole, and a text that repeats counts once in the samples."""
    rng = random.Random(5)
    rows = [(i, t, y) for i, t, y in corpus(5, 300)]
    long_ = [(1000 + i, " ".join(rng.choices(["ab", "cd", "ef", "gh"], k=300_000)) + (" vile" * 30_000) * (i % 2), i % 2) for i in range(2)]
    same = [(2000 + i, "ab cd vile", 0) for i in range(400)]
    rows += long_ + same
    d = spark.createDataFrame([r[:2] for r in rows], DOC)
    lab = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, toxic int, quality int")
    got = quality.sample_rows(lab, d, "toxic", 5, 0, 4000, 3)
    assert got.where("text = 'ab cd vile'").count() == 2 and got.agg(F.max(F.length("text"))).first()[0] > 100_000
    by = {r.doc_id: r for r in toxicity.scored(d, toxicity.fit(d, lab)).collect()}
    assert 0 <= by[1001].score <= 1 and len({by[2000 + i].score for i in range(400)}) == 1
    assert len(quality.scored(d, quality.fit(d, lab)).where("score between 0 and 1").collect()) == len(rows)


def test_quality_scores_are_those_of_the_plain_model(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["good", "fine", "words", "here"] if i % 2 else ["b#d", "ju%k", "l@ne"], k=rng.randint(5, 900))), i % 2) for i in range(200)]
    d = spark.createDataFrame([r[:2] for r in rows] + [(900, None)], DOC)
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(d, lab)
    tools = {k: zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(x) if x else None) for k, x in (("good", model.good), ("bad", model.bad), ("none", b""))}

    def plain(text):
        raw = (text or "").encode()
        if not raw:
            return 0.0, 1.0
        size = {k: sum(len(z.compress(raw[i : i + quality.PIECE])) for i in range(0, len(raw), quality.PIECE)) for k, z in tools.items()}
        return (size["bad"] - size["good"]) / len(raw), size["none"] / len(raw)

    a, b, c = model.weights
    want = {i: 1 / (1 + math.exp(-max(-30, min(30, a * x + b * y + c)))) for i, t in [*[r[:2] for r in rows], (900, None)] for x, y in [plain(t)]}
    assert {r.doc_id: r.score for r in quality.scored(d, model).collect()} == pytest.approx(want)
    fit = quality.sample_rows(lab, d, "quality", quality.FOLDS, quality.HELD_OUT, quality.DICT_ROWS, 8).where("fit").collect()
    x = sorted((*plain(r.text), r.y) for r in fit)
    assert model.weights == pytest.approx(quality.logistic(np.array([v[:2] for v in x]), np.array([v[2] for v in x], float)).tolist(), rel=1e-6)


def test_pieces_are_spread_over_the_whole_text():
    text = bytes(range(256)) * 100
    assert b"".join(quality.spread(text[:5000])) == text[:5000] and quality.spread(b"") == []
    pieces = quality.spread(text)
    assert len(pieces) == quality.SHARE and pieces[0] == text[: quality.SAMPLE_PIECE] and text.endswith(pieces[-1])
