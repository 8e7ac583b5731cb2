"""Benchmark decontamination with a distributed positional inverted index.

Every benchmark item is cut into windows of ten words. A window's rarest terms, over all
documents, are its anchors; the index holds the positions of the anchor terms in the
documents. Shifting a posting back by the anchor's place in the item gives the alignment
of the item in the document. Lists are intersected from the rarest anchor: an alignment
that has all anchors of some window is a candidate for an exact phrase, and the words
along it are compared. Two anchors a window leave few candidates, whatever common words a
passage has. Anchors on nearby alignments, as insertions and deletions make them, are
proximity matches.

All of it is DataFrame expressions. Texts are not shuffled unless the candidates
are too many to broadcast; the index is keyed by the hash of a text, so copies of a
document are looked up once. Only texts with candidates are cut into words again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same before or after A-Z are lower-cased, its members spelled out: the engine looks single
#: characters up in a table but tries ranges one by one, which takes some fifteen times as long.
ANY_CASE = rf"[0123456789{UPPER}{LOWER}\x80-\x{{10FFFF}}]+"
WINDOW, ANCHORS = 10, 2
#: Proximity: distinct anchors of an item, on alignments in one stretch of ``2 * STEP``, a stretch every ``STEP``.
NEAR, STEP = 4, 4


def words(text: Column) -> Column:
    """The words of a text with A-Z (and nothing else) lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(ANY_CASE), F.lit(0))


def _terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``(text_key, pos, term)`` of ``terms(term)`` in ``docs``.

    A text of ASCII alone is lower-cased whole, any other word by word, where most words are ASCII again.
    """
    text = F.coalesce("text", F.lit(""))
    plain = lambda c: F.length(c) == F.octet_length(c)
    cut = F.regexp_extract_all(F.when(plain(text), F.lower(text)).otherwise(text), F.lit(ANY_CASE), F.lit(0))
    rows = docs.select(F.xxhash64("text").alias("text_key"), F.posexplode(cut).alias("pos", "as_is"))
    low = F.when(plain(F.col("as_is")), F.lower("as_is")).otherwise(F.translate("as_is", UPPER, LOWER))
    return rows.select("text_key", "pos", low.alias("term")).join(terms, "term")


def anchors(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, start, q, term``: the anchors of each window of ``items(item_id, w)``: its terms that
    have the fewest places in ``docs``, the longer and then the earlier first."""
    place = stored(items.select("item_id", "w", F.posexplode("w").alias("q", "term")))
    rarity = _terms(docs, small(stored(place.select("term").distinct()))).groupBy("term").agg(F.count("*").alias("n"))
    m, k = F.size("w"), F.least(F.lit(window), F.size("w"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - k + 1), F.least(F.col("q"), m - k))
    rows = place.join(rarity, "term", "left").select("item_id", "q", "term", F.coalesce("n", F.lit(0)).alias("n"), F.explode(starts).alias("start"))
    order = Window.partitionBy("item_id", "start").orderBy("n", F.desc(F.length("term")), "q")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ANCHORS).select("item_id", "start", "q", "term")


def alignments(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Candidates ``(text_key, item_id, shift)``: item word i would be document word shift + i; and the
    proximity matches ``(text_key, item_id)``: texts with ``NEAR`` or more distinct anchors of an item on
    alignments within one stretch."""
    marks = stored(anchors(docs, items, window))
    index = stored(_terms(docs, small(stored(marks.select("term").distinct()))))
    places = small(stored(marks.select("item_id", "term", "q").distinct()))
    lists = stored(index.join(places, "term").groupBy("text_key", "item_id", (F.col("pos") - F.col("q")).alias("shift")).agg(F.collect_set("q").alias("qs")))
    sets = marks.groupBy("item_id", "start").agg(F.array_sort(F.collect_set("q")).alias("all")).groupBy("item_id").agg(F.collect_set("all").alias("windows"))
    met = lists.join(small(stored(sets)), "item_id").where(F.exists("windows", lambda a: F.size(F.array_except(a, F.col("qs"))) == 0))
    stretch = F.floor(F.col("shift") / STEP)
    near = lists.select("text_key", "item_id", F.explode(F.array(stretch - 1, stretch)).alias("stretch"), "qs")
    near = near.groupBy("text_key", "item_id", "stretch").agg(F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("n"))
    return met.select("text_key", "item_id", "shift"), near.where(F.col("n") >= NEAR).select("text_key", "item_id").distinct()


def _covered(own: Column, theirs: Column, shift: Column, window: int) -> Column:
    """``array<struct<a, b>>``: runs of at least a window of equal words along one alignment, as first and last document word."""
    k = F.least(F.lit(window), F.size(theirs))
    skip = F.greatest(-shift, F.lit(0))
    at = F.greatest(shift, F.lit(0))
    pairs = F.zip_with(F.slice(own, at + 1, F.size(theirs)), F.slice(theirs, skip + 1, F.size(theirs)), lambda a, b: F.coalesce(a == b, F.lit(False)))
    start = F.struct(at.cast("int").alias("at"), F.lit(0).alias("run"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def ended(acc):
        run = F.array(F.struct((acc["at"] - acc["run"]).alias("a"), (acc["at"] - 1).alias("b")))
        return F.when(acc["run"] >= k, F.concat(acc["out"], run)).otherwise(acc["out"])

    def step(acc, same):
        return F.struct((acc["at"] + 1).alias("at"), F.when(same, acc["run"] + 1).otherwise(F.lit(0)).alias("run"), F.when(same, acc["out"]).otherwise(ended(acc)).alias("out"))

    return F.aggregate(pairs, start, step, ended)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items, contaminated, near_items`` for every row; other columns are kept.

    ``items`` has the item ids, as sorted strings, of which a window of ``window``
    consecutive words (all words of a shorter item) occurs; ``n_hit`` counts document
    words inside any occurrence; ``near_items`` has the items with a proximity match.
    Words are ``WORD`` after lower-casing A-Z; null and wordless texts, and items, have
    none and match nothing. Repeated rows stay, items that repeat an id count as that
    item; no rows, or an empty benchmark, are fine. Columns of ``docs`` named like the
    five are replaced, as are names that start with ``leak__``.
    """
    fresh = ("n_words", "n_hit", "items", "contaminated", "near_items")
    keep = [c for c in docs.columns if c not in fresh and not c.startswith("leak__")]
    docs = docs.select(*keep)
    items = stored(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct())
    # items that share an id get a number each, so that their windows stay apart
    items = items.withColumn("item", F.xxhash64("item_id", "w"))
    found, near = alignments(docs.select("text"), items.select(F.col("item").alias("item_id"), "w"), window)
    named = small(stored(items))
    found = found.withColumnRenamed("item_id", "item").join(named, "item").select("text_key", F.struct("item_id", "w", "shift").alias("hit"), F.lit(None).cast("string").alias("near"))
    near = near.withColumnRenamed("item_id", "item").join(named.select("item", "item_id"), "item").select("text_key", F.lit(None).cast(found.schema["hit"].dataType).alias("hit"), F.col("item_id").alias("near"))
    found = found.unionByName(near).groupBy("text_key").agg(F.collect_list("hit").alias("leak__found"), F.collect_set("near").alias("leak__near")).withColumnRenamed("text_key", "leak__key")
    both = docs.withColumn("leak__text", F.xxhash64("text")).join(small(stored(found), 50_000), F.col("leak__text") == F.col("leak__key"), "left")
    both = both.withColumn("leak__words", F.when(F.size("leak__found") > 0, words(F.col("text"))))
    hits = F.transform("leak__found", lambda c: F.struct(c["item_id"].alias("item_id"), _covered(F.col("leak__words"), c["w"], c["shift"], window).alias("runs")))
    n_words = F.when(F.col("leak__words").isNotNull(), F.size("leak__words")).otherwise(F.coalesce(F.regexp_count("text", F.lit(ANY_CASE)), F.lit(0))).cast("long")
    none = F.array().cast("array<string>")
    near_items = F.array_sort(F.coalesce("leak__near", none))
    both = both.select(*keep, n_words.alias("n_words"), near_items.alias("near_items"), F.when(F.col("leak__words").isNotNull(), F.filter(hits, lambda h: F.size(h["runs"]) > 0)).alias("leak__found"))
    at = F.flatten(F.transform(F.flatten(F.col("leak__found.runs")), lambda r: F.sequence(r["a"], r["b"])))
    n_hit = F.coalesce(F.size(F.array_distinct(at)), F.lit(0)).cast("long")
    ids = F.array_sort(F.array_distinct(F.coalesce(F.col("leak__found.item_id"), none)))
    both = both.select(*keep, "n_words", F.when(F.col("leak__found").isNull(), F.lit(0).cast("long")).otherwise(n_hit).alias("n_hit"), ids.alias("items"), "near_items")
    return both.withColumn("contaminated", F.col("n_hit") > 0).select(*keep, *fresh)


CONTAMINATION_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
bi AS (SELECT item_id, w, CAST(least(10, len(w)) AS BIGINT) AS k FROM b WHERE len(w) > 0),
bx AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bi),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bx),
dx AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) ks),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM dx),
h AS (SELECT dw.rid, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
p AS (SELECT DISTINCT rid, unnest(range(i, i + k)) AS at FROM h),
n AS (SELECT rid, count(*) AS n_hit FROM p GROUP BY rid),
-- proximity: two anchors a window, the terms with the fewest places in the documents
it AS (SELECT DISTINCT item_id, w, k FROM bi),
nm AS (SELECT item_id, w, k, row_number() OVER () AS item FROM it),
pl AS (SELECT item, k, len(w) AS m, unnest(w) AS term, unnest(range(len(w))) AS q FROM nm),
dp AS (SELECT rid, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
ra AS (SELECT t.term, count(dp.rid) AS n FROM (SELECT DISTINCT term FROM pl) t LEFT JOIN dp ON t.term = dp.term GROUP BY 1),
ps AS (SELECT item, q, term, unnest(range(greatest(0, q - k + 1), least(q, m - k) + 1)) AS start FROM pl),
rk AS (SELECT ps.item, ps.q, ps.term, row_number() OVER (PARTITION BY ps.item, ps.start ORDER BY ra.n, length(ps.term) DESC, ps.q) AS r FROM ps JOIN ra ON ps.term = ra.term),
mk AS (SELECT DISTINCT item, term, q FROM rk WHERE r <= {ANCHORS}),
sh AS (SELECT DISTINCT dp.rid, mk.item, mk.q, CAST(floor((dp.pos - mk.q) / {STEP}.0) AS BIGINT) AS s FROM dp JOIN mk ON dp.term = mk.term),
st AS (SELECT rid, item, q, unnest([s - 1, s]) AS s FROM sh),
nr AS (SELECT rid, item FROM st GROUP BY rid, item, s HAVING count(DISTINCT q) >= {NEAR}),
ne AS (SELECT rid, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT nr.rid, nm.item_id FROM nr JOIN nm ON nr.item = nm.item) z GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) q GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated,
       coalesce(ne.ids, '') AS near_items
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN t ON d.rid = t.rid LEFT JOIN ne ON d.rid = ne.rid
"""
