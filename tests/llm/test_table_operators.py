"""Joins, mixing, sharding, decontamination, URLs and the pipeline against plain Python and SQL."""

import heapq
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from terrachron.llm import components, decontaminate, jaccard, mixing, queries, sharding, url_filter
from terrachron.llm.common import stored

DOC = "doc_id long, text string"
SMALL = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# -- components ------------------------------------------------------------------------
def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 200), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 7 Jaccard join --------------------------------------------------------------------
def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(d, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(300)]
    passage = rng.choices(words, k=50)
    texts = []
    for _ in range(8):  # groups at every distance around the threshold, some chained
        base = rng.choices(words, k=rng.choice([5, 6, 8, 9, 12, 20, 60, 150]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 7)):
            if rng.random() < 0.5:
                base = list(base)
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[: max(1, len(copy) - rng.randint(0, 3))]
            base = copy if rng.random() < 0.5 else base
            texts.append((" ".join(copy)).replace(" ", rng.choice([" ", "\n", "  "])).upper() if rng.random() < 0.2 else " ".join(copy))
    for _ in range(10):  # unlike texts that share a passage
        texts.append(" ".join(rng.choices(words, k=rng.randint(0, 30)) + passage + rng.choices(words, k=rng.randint(0, 30))))
    return texts + ["", None, " \n", "one", "One", "é ñ ß", "É ñ ß"]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_classes(spark, seed):
    texts = near_copies(seed)
    rng = random.Random(seed)
    ids = rng.sample(range(-1000, 1000), len(texts))
    rows = list(zip(ids, texts))
    rows += rng.sample(rows, 5) + [(None, texts[0]), (ids[0], "some other text of this very id")]
    df = spark.createDataFrame(rows, DOC).withColumn("set_id", F.lit("x")).withColumn("n", F.lit(1))
    got = jaccard.jaccard_classes(df).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, brute(rows)))
    kept = jaccard.without_near_duplicates(df).collect()
    texts_kept = [shingles(r.text) for r in kept if shingles(r.text)]
    classes = {x[2] if x[2] is not None else x for x, (_, t) in zip(brute(rows), rows) if shingles(t)}
    assert len(texts_kept) == len({r.class_id for r in got if r.class_id is not None}) and len(texts_kept) >= len(classes) - 1
    assert Counter(r.doc_id for r in kept if not shingles(r.text)) == Counter(d for d, t in rows if not shingles(t))


def test_jaccard_in_blocks_and_windows(spark, monkeypatch):
    """The same classes when signatures leave early, sets are compared in small blocks and nothing is broadcast."""
    rows = list(enumerate(near_copies(3)))
    monkeypatch.setattr(jaccard, "WINDOW", 50)
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "small", lambda df: df)
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


@pytest.mark.parametrize("block", [None, 2])
def test_links_are_counted_inside_a_group(spark, monkeypatch, block):
    """Every set's links to other sets, not only those to the least set of a signature."""
    if block:
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "BLOCK_BYTES", 2000)
        monkeypatch.setattr(jaccard, "small", lambda df: df)
    base = [f"w{i}" for i in range(120)]
    group = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(10, 110, 10)]
    rows = list(enumerate([*near_copies(4), *group, group[0]]))
    sets = {i: shingles(t) for i, t in rows}
    links = lambda s: sum(s != o and 100 * len(s & o) >= 80 * len(s | o) for o in set(sets.values()) if o)
    want = {i: links(s) if s else 0 for i, s in sets.items()}
    assert min(want[i] for i in range(len(rows) - 11, len(rows))) == 9
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_classes(spark.createDataFrame(rows, DOC)).collect()}
    assert got == want


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], DOC)).count() == 0
    assert [r.component_id for r in jaccard.jaccard_classes(spark.createDataFrame([(3, None)], DOC)).collect()] == [3]


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 400), st.integers(0, 10**6), st.floats(0, 1), st.booleans())
def test_linked_sets_share_a_signature(n, seed, how, hint):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    away, new = int(how * len(a) * 0.2), int((1 - how) * len(a) * 0.25)
    b = np.union1d(a[away:], rng.integers(0, 2**63, new).astype(np.uint64))
    common = np.sort(rng.choice(a, len(a) // 2, replace=False)) if hint else None
    if jaccard.linked(a, b, 80) and len(a) != len(b) or not np.array_equal(a, b) and jaccard.linked(a, b, 80):
        enum = jaccard.PartEnum(80, common)
        x, y = (enum.signatures(s, np.array([len(s)]))[1] for s in (a, b))
        assert set(x.tolist()) & set(y.tolist())
        other = np.unique(rng.integers(0, 2**63, 30).astype(np.uint64))  # sets beside them change nothing
        at, both = enum.signatures(np.concatenate([a, other, b]), np.array([len(a), len(other), len(b)]))
        assert sorted(both[at == 0].tolist()) == sorted(x.tolist()) and sorted(both[at == 2].tolist()) == sorted(y.tolist())


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 600), st.integers(1, 600), st.integers(0, 10**6))
def test_sketches_bound_the_difference(n, m, seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**63, 700).astype(np.uint64)
    a, b = (np.unique(rng.choice(pool, k)) for k in (n, m))
    x, y = jaccard.sketch(a), jaccard.sketch(b)
    w = min(len(x), len(y))
    apart = int(np.bitwise_count(jaccard.fold(x, w) ^ jaccard.fold(y, w)).sum())
    assert apart <= len(np.setxor1d(a, b))


# -- 5 mixing --------------------------------------------------------------------------
def fixed_point(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s] - 1e-9] if free else []
        if not over:
            return {s: most * sizes[s] if s in full else left * w[s] / total for s in names}
        full |= set(over)
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)


def test_targets_are_the_fixed_point(spark):
    rng = random.Random(5)
    for _ in range(3):
        sizes = {f"s{i}é": rng.choice([0, 1, 7, 500, 90000]) for i in range(rng.randint(1, 9))} | {None: 40, "": 3}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2)).collect()}
        want = fixed_point(sizes)
        assert all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6) for s in sizes)


def test_quotas_are_the_highest_quotients(spark):
    plan = [("a", 5300.0), ("b", 2400.0), ("c", 130.0), ("d", 0.0)]
    df = spark.createDataFrame([(s, t, 100) for s, t in plan], "source string, target double, block long")
    got = {(r.source, r.shard): r.quota for r in mixing.quotas(df, 6).collect()}
    for k in range(6):
        seats = sum(got[s, j] for s, _ in plan for j in range(k + 1))
        heap = [(-t, 1, s) for s, t in plan if t]
        heapq.heapify(heap)
        won = Counter()
        for _ in range(seats):
            q, odd, s = heapq.heappop(heap)
            won[s] += 1
            t = dict(plan)[s]
            heapq.heappush(heap, (-t / (odd + 2), odd + 2, s))
        assert won == {s: n for s, _ in plan if (n := sum(got[s, j] for j in range(k + 1)))}


def mix_rows(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(n)]
    return rows + rows[:5] + [(None, "x y", "a"), (7777, None, "b")]


def test_mix_comes_near_and_agrees(spark):
    df = spark.createDataFrame(mix_rows(1), "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    got = mixing.placed(df).toPandas()
    assert len(got) == len(mix_rows(1)) and (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    by = got.groupby(got.source.fillna("none")).agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 2 + by.target * 0.02).all()
    again = mixing.placed(df.repartition(3)).toPandas()
    cols = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[cols].itertuples(index=False))) == sorted(map(str, again[cols].itertuples(index=False)))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    copies = got.groupby(got.doc_id.fillna(-1)).copies.sum()
    out = mixed.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("d")).count().toPandas().set_index("d")["count"]
    assert (out.reindex(copies.index).fillna(0) == copies).all()
    assert mixing.placed(df.where("false")).count() == 0 and mixing.mixed(df.where("false")).count() == 0


def test_shards_take_the_blocks_of_their_quotas(spark):
    """Every shard gets as many takes of a source as the highest quotients award it, over blocks of one word."""
    rng = random.Random(4)
    rows = [(i, "w", rng.choice(["a", "a", "a", "b", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(1)).withColumn("rows", F.lit(2)).withColumn("mix__d", F.lit(3))
    got = mixing.placed(df, shards=6).collect()
    assert all(len(r.shards) == r.copies == r.taken for r in got)
    sources = {r.source: r.target for r in got}
    heap, seats, won = [(-t, 1, str(s)) for s, t in sources.items()], Counter(), Counter()
    for r in got:
        seats.update(r.shards)
        won.update((str(r.source), k) for k in r.shards)
    heapq.heapify(heap)
    for k in range(6):
        awarded = Counter()
        for _ in range(seats[k]):
            q, odd, s = heapq.heappop(heap)
            awarded[s] += 1
            heapq.heappush(heap, (q * odd / (odd + 2), odd + 2, s))
        assert awarded == {s: won[s, k] for s in map(str, sources) if won[s, k]}
    mixed = mixing.mixed(df)
    assert mixed.columns == ["doc_id", "text", "source", "copies", "rows"] and mixed.count() == sum(r.copies for r in mixing.placed(df).collect())
    odd = spark.createDataFrame([(i, "a b", s) for i, s in enumerate(["\x00", None] * 20)], "doc_id long, text string, source string")
    assert {(r.source, r.source_size) for r in mixing.placed(odd).collect()} == {("\x00", 40), (None, 40)}


def test_sql_of_mixing_urls_and_contamination(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        a, b = queries.QUERIES[name](spark, SMALL).toPandas(), con.execute(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        show = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).map(lambda v: round(float(v), 6) if isinstance(v, (int, float)) else v).itertuples(index=False, name=None)))
        assert show(a) == show(b), name


# -- 6 sharding ------------------------------------------------------------------------
def test_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(30):
        supply = [rng.randint(0, 30) for _ in range(rng.randint(1, 5))]
        n = rng.randint(1, 6)
        cap = sharding.equal_capacities(sum(supply), n)
        flow = sharding.min_cost_flow(supply, cap, lambda i, j: int(i != j))
        assert [sum(v for (a, _), v in flow.items() if a == i) for i in range(len(supply))] == supply
        assert all(sum(v for (_, b), v in flow.items() if b == j) <= cap[j] for j in range(n))
        stays = sum(min(s, cap[i]) for i, s in enumerate(supply) if i < n)
        assert sum(v for (i, j), v in flow.items() if i != j) == sum(supply) - stays
    costly = sharding.min_cost_flow([2, 2], [2, 2], lambda i, j: [[5, 1], [1, 9]][i][j])
    assert costly == {(0, 1): 2, (1, 0): 2}
    with pytest.raises(ValueError):
        sharding.min_cost_flow([3], [2], lambda i, j: 0)


def shard_rows(n=3000):
    rng = random.Random(9)
    rows = [(i, "x" * rng.choice([0, 10, 100, 400])) for i in range(n)]
    return rows + rows[:50] + [(5, "same")] * 200 + [(None, None)] * 3 + [(10**6, "y" * 5_000)]


def test_assignment(spark):
    df = sharding.with_bytes(spark.createDataFrame(shard_rows(), DOC)).withColumn("shard", F.lit("clash")).withColumn("h", F.lit(0))
    got = sharding.assign(df).toPandas()
    assert len(got) == len(shard_rows())
    by = got.groupby("shard").agg(size=("size", "sum"), slots=("slot", lambda s: sorted(s) == list(range(len(s)))))
    assert by.slots.all() and set(by.index) <= set(range(24))
    fair = got["size"].sum() / 24
    assert (abs(by["size"] - fair) <= 600).all()
    again = sharding.assign(df.repartition(5)).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(str, got[key].itertuples(index=False))) == sorted(map(str, again[key].itertuples(index=False)))
    assert sharding.assign(df.where("false")).count() == 0


def test_rewrite_keeps_what_does_not_change(spark, tmp_path):
    df = sharding.assign(sharding.with_bytes(spark.createDataFrame(shard_rows(), DOC)))
    state = sharding.rewrite(spark, df, str(tmp_path)).collect()
    assert all(r.path for r in state) and sum(r.rows for r in state) == len(shard_rows())
    read = spark.read.parquet(*{r.path.rsplit("/", 1)[0] for r in state})
    assert read.count() == len(shard_rows()) and {r[0] for r in read.select("shard").distinct().collect()} == {r.shard for r in state}
    still = df.withColumn("shard", F.col("old_shard"))
    assert all(r.path is None for r in sharding.rewrite(spark, still, str(tmp_path)).collect())


def test_layout_is_read_whole(spark, tmp_path):
    """The files, and shards that keep theirs, give every row back with its text."""
    df = sharding.assign(sharding.with_bytes(spark.createDataFrame(shard_rows(), DOC))).withColumn("extra", F.lit("e"))
    mixed = df.withColumn("shard", F.when(F.col("old_shard") < 4, F.col("old_shard")).when(F.col("shard") < 4, 4).otherwise(F.col("shard")))
    for rows in (df, mixed):
        layout = sharding.rewrite(spark, rows, str(tmp_path))
        back = sharding.read_layout(spark, rows, layout)
        assert sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert any(r.path is None for r in layout.collect()) and any(r.path for r in layout.collect())
    none = df.where("false")
    assert sharding.read_layout(spark, none, sharding.rewrite(spark, none, str(tmp_path))).count() == 0


# -- 9 decontamination -----------------------------------------------------------------
def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


def contaminated(docs, items, k=10):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for item, u in items:
            v = words(u)
            n = min(k, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def leak_rows(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "and"] * 20 + ["".join(rng.choices("abcdé", k=4)) for _ in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 9, 10, 11, 25, 60])))) for i in range(25)]
    items += [(3, "another text of item three, with its own words"), (None, "item without an id at all"), (99, None), (98, "the " * 30)]
    docs = []
    for i in range(80):
        w = rng.choices(vocab, k=rng.randint(0, 80))
        if i % 2 and (src := words(rng.choice(items)[1])):
            a = rng.randrange(len(src))
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.randint(1, 30)]
        docs.append((i, ", ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    return docs + docs[:4] + [(500, None), (501, ""), (None, docs[1][1]), (502, "THE-of...and")], items


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, seed, monkeypatch):
    docs, items = leak_rows(seed)
    if seed == 2:
        monkeypatch.setattr(decontaminate, "small", lambda df, most=0: df)
    d = spark.createDataFrame(docs, DOC).withColumn("found", F.lit("clash")).withColumn("text_key", F.lit(1)).withColumn("near_items", F.lit(1)).withColumn("lang", F.lit("en"))
    got = decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["doc_id", "text", "found", "text_key", "lang", "n_words", "n_hit", "items", "contaminated", "near_items"]
    want = contaminated(docs, [("" if i is None else i, t) for i, t in items])
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()))) == sorted(map(str, want))
    assert all(r.contaminated == (r.n_hit > 0) for r in got.collect())


def test_contamination_of_nothing(spark):
    d, b = spark.createDataFrame([(1, "a b c")], DOC), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[2:] for r in decontaminate.contamination(d, b).collect()] == [(3, 0, [], False, [])]
    assert decontaminate.contamination(d.where("false"), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def near_by_hand(docs, items):
    """Items of which a text has enough anchors on alignments of one stretch."""
    split = {i: [w for w in re.findall(decontaminate.WORD, (t or "").lower()) if w] for i, t in items}
    n, out = Counter(w for _, t in docs for w in re.findall(decontaminate.WORD, (t or "").lower())), {}
    for d, t in docs:
        own, found = re.findall(decontaminate.WORD, (t or "").lower()), set()
        for i, ws in split.items():
            k = min(10, len(ws))
            marks = {q for s in range(len(ws) - k + 1) for q in sorted(range(s, s + k), key=lambda q: (n[ws[q]], -len(ws[q]), q))[: decontaminate.ANCHORS]} if ws else set()
            stretches = {}
            for pos, w in enumerate(own):
                for q in marks:
                    if ws[q] == w:
                        s = (pos - q) // decontaminate.STEP
                        stretches.setdefault(s, set()).add(q)
                        stretches.setdefault(s - 1, set()).add(q)
            if any(len(x) >= decontaminate.NEAR for x in stretches.values()):
                found.add(str(i))
        out[d] = sorted(found)
    return out


def test_proximity(spark):
    passage = [f"term{i}" for i in range(40)]
    loose = " ".join(w for i, w in enumerate(passage) for w in ([w, "filler"] if i % 9 == 8 else [w]))
    rng = random.Random(2)
    docs = [(1, loose), (2, "term0 and then nothing of it"), (3, None), (4, "x " * 30_000 + loose)] + [(10 + i, " ".join(rng.choices(passage, k=60))) for i in range(20)]
    items = [(7, " ".join(passage)), (8, " ".join(passage[5:25])), (9, "short one"), (10, None)]
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert "7" in got[1].near_items and not got[1].contaminated and got[4].near_items == got[1].near_items and got[2].near_items == []
    assert {d: r.near_items for d, r in got.items()} == near_by_hand(docs, items)


# -- 10 urls ---------------------------------------------------------------------------
@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.NET/x?y#z", "a.example.net", "/x", "net/", "block"),
        ("https://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
        ("https://b.example.com/de/", "b.example.com", "/de/", "example.com/de/", "block"),
        ("https://spam.org/fr/x", "spam.org", "/fr/x", "org/fr/", "allow"),
        ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.com#://y/z", "x.com", "", None, "allow"),
        ("http://casino-win.com/", "casino-win.com", "/", None, "block"),
        ("http://casinos.com/", "casinos.com", "/", None, "allow"),
        ("http://free.com/bets", "free.com", "/bets", None, "block"),
        ("http://free.com/free", "free.com", "/free", None, "allow"),
        ("http://FREE.com/\nBETS", "free.com", "/\nBETS", None, "block"),
        ("no scheme", "", "", None, "allow"),
        ("porn", "", "", None, "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url)], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit("clash"))
    r = url_filter.judge(df).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    assert url_filter.judge(df.where("false")).count() == 0


def test_vocabulary_of_a_table(spark):
    """Terms come from a table; a weight of 2 is strict, repeats and blanks count once or not at all."""
    terms = spark.createDataFrame([("Bad", 2.0), ("bad", 1.0), ("iffy", 1.0), ("odd", 1.5), ("none", 0.5), ("", 2.0), (None, 2.0), ("odd", 1.0)], "term string, weight double")
    strict, soft = url_filter.vocabulary(terms)
    assert (strict, soft) == (["bad"], ["iffy", "odd"])
    pages = spark.createDataFrame([(1, "http://a.bad.com/"), (2, "http://iffy.com/iffy"), (3, "http://iffy.com/odd"), (4, "http://badly.com/")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.n_strict, r.n_soft) for r in url_filter.judge(pages, strict=strict, soft=soft).collect()}
    assert got == {1: ("block", 1, 0), 2: ("allow", 0, 1), 3: ("block", 0, 2), 4: ("allow", 0, 0)}


def test_jaccard_with_boilerplate(spark):
    """A passage that 20,000 unlike texts share makes no pairs of them, and the near copies among them are found."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(f"license{i}" for i in range(12))
    rows = [(i, " ".join(rng.choices(words, k=20)) + " " + passage) for i in range(20_000)]
    for i in range(0, 300, 3):
        near = rows[i][1].split()
        near[0] = "edited"
        rows.append((100_000 + i, " ".join(near)))
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[100_000 + i] == (i, 1) and got[i] == (i, 1) for i in range(0, 300, 3))
    assert sum(n for _, n in got.values()) == 200 and len({c for c, _ in got.values()}) == 20_000


# -- pipeline --------------------------------------------------------------------------
def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "decontamination", "source mixing", "sharding"]
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stored(stage(spark, before, SMALL))
        a, b = before.toPandas(), after.toPandas()
        if i < 4:
            assert after.columns == columns, name
        if i == 0:
            labels = pd.read_parquet(f"{SMALL}/labels.parquet")
            good = set(labels.doc_id[labels.quality == 1])
            assert len(good & set(b.doc_id)) >= 0.95 * len(good) and len(b) < rows
        elif i == 1:
            want = {x[2] for x in brute(list(zip(a.doc_id, a.text)))}
            assert set(b.doc_id) == want and len(b) == len(want)
        elif i == 2:
            items = pd.read_parquet(f"{SMALL}/benchmark.parquet")
            want = {d for d, _, hit, _ in contaminated(list(zip(a.doc_id, a.text)), list(zip(items.item_id, items.text))) if not hit}
            assert set(b.doc_id) == want and len(b) == len(want)
        elif i == 3:
            copies = mixing.placed(before).toPandas().set_index("doc_id").copies
            assert Counter(b.doc_id) == Counter({d: n for d, n in copies.items() if n})
            assert b.merge(a, on=columns).shape[0] == len(b)
        else:
            assert len(b) == len(a) and Counter(b.doc_id) == Counter(a.doc_id) and {"shard", "slot", "text"} <= set(b.columns)
        before = after


def test_pipeline_of_no_rows(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, SMALL))
    assert empty.count() == 0
