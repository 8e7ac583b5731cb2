"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source's documents lie end to end, in a seeded order, on a line of words
that is cut into blocks of the same number of words. A source with target t is
awarded a block for every odd quotient t/(2j+1) that reaches half the block size;
taken in falling order of those quotients, that is Sainte-Lague's method with the
block size as divisor, so after k of K shards the awards are the apportionment of
that many seats and their differences are whole quotas for every shard. Each
source then takes its blocks: all of them as often as they go into the quotas, and
the rest spread evenly from a seeded phase. The takes of a source are numbered, first
whole rounds over its line, then the rest, and every shard gets the next ones, as
many as its quota.

Everything is a DataFrame expression. Prefix sums go in two steps (totals of
buckets, then inside a bucket), so no task sees a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored

#: Blocks are this long, or shorter so that the smallest target has ``LEAST_BLOCKS``.
BLOCK_TOKENS, LEAST_BLOCKS = 2048, 128
SHARDS = 24
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` for ``sources(source, source_size)``, one row a source.

    Sources in code-point order (null last) take ``weights`` in turn and share
    ``share`` times all sizes by weight; a target stops at ``most`` times its
    source's size and the excess is shared again. The fixed point fills sources in
    rising order of limit per weight, so it is read off prefix sums.
    """
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    one = sources.withColumn("w", cycle[((F.row_number().over(order) - 1) % len(weights)).cast("int")])
    one = one.withColumn("limit", F.lit(float(most)) * F.col("source_size")).withColumn("per", F.col("limit") / F.col("w"))
    rising = Window.orderBy("per", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    one = one.withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    one = one.withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    one = one.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.lit(float(most)) * F.col("size_before")) / (F.sum("w").over(every) - F.col("w_before")))
    # a source is full while the level of those not yet full reaches its limit; the level rises
    # over the full ones and falls after the first other one, which has the rate of all others
    full = F.col("level") >= F.col("per")
    one = one.withColumn("rate", F.max("level").over(every))
    target = F.when(full, F.col("limit")).otherwise(F.col("w") * F.col("rate"))
    return one.select("source", "source_size", target.alias("target"))


def quotas(plan: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``source, shard, quota``: the whole blocks of each source in each shard."""
    seats = lambda k: F.floor(F.col("target") * k / (F.col("block") * F.lit(float(shards))) + 0.5)
    rows = plan.select("source", "target", "block", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("k"))
    return rows.select("source", (F.col("k") - 1).alias("shard"), (seats(F.col("k")) - seats(F.col("k") - 1)).alias("quota"))


def shard_of(take: Column, shards: int) -> Column:
    """The shard, from 0, that gets a source's take number ``take``, from 0: the first after which so many seats are awarded."""
    seats = lambda k: F.col("target") * k / (F.col("block") * F.lit(float(shards)))
    near = F.floor((take + 0.5) * F.col("block") * F.lit(float(shards)) / F.col("target")).cast("int")
    # the quotient t/(2j+1) reaches half a block; rounding may put the closed form one off
    tries = F.array(*[near + i for i in (-1, 0, 1, 2)])
    return F.element_at(F.filter(tries, lambda k: (k >= 1) & (F.floor(seats(k) + 0.5) > take)), 1) - 1


def _plan(sizes: DataFrame, weights, share, most, seed, shards) -> DataFrame:
    """One row a source: target, block size, blocks, quota, whole rounds, extra blocks and phase."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(by_source, weights, share, most)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    plan = plan.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK_TOKENS), F.floor(F.coalesce(least, F.lit(0.0)) / LEAST_BLOCKS))).cast("long"))
    plan = stored(plan.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long")))
    total = quotas(plan, shards).groupBy("source").agg(F.sum("quota").alias("quota"))
    plan = plan.join(total, plan.source.eqNullSafe(total.source)).drop(total.source)
    rounds = F.when(F.col("blocks") > 0, F.expr(f"least(quota div blocks, cast({int(most)} as bigint))")).otherwise(F.lit(0).cast("long"))
    extra = F.when((F.col("blocks") > 0) & (F.col("rounds") < F.lit(int(most))), F.col("quota") - F.col("rounds") * F.col("blocks")).otherwise(F.lit(0).cast("long"))
    phase = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return plan.withColumn("rounds", rounds).withColumn("extra", extra).withColumn("phase", phase)


def _chosen(i: Column) -> Column:
    """How many extra blocks are chosen among a source's first ``i``."""
    return F.when(F.col("blocks") > 0, F.floor(i.cast("double") * F.col("extra") / F.col("blocks") + F.col("phase"))).otherwise(F.lit(0)).cast("long")


def _up_to(x: Column) -> Column:
    """Words of chosen extra blocks among a source's first ``x`` words."""
    i = F.floor(x / F.col("block"))
    last = F.least((i + 1) * F.col("block"), F.col("source_size")) - i * F.col("block")
    inside = (_chosen(i + 1) - _chosen(i)) * F.least(x - i * F.col("block"), last)
    return _chosen(i) * F.col("block") + inside


def placed(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, shards: int = SHARDS) -> DataFrame:
    """Documents with their place on the source's line and what the mix takes of them.

    ``docs(doc_id, text, source)`` gives ``doc_id, source, key, size, source_size,
    target, text_key, taken, copies, shards``. ``size`` is the number of words (null text: 0),
    ``taken`` the words in awarded blocks, repeats counted, at most ``most`` times the size;
    ``copies`` how often the block with the document's first word is taken, and ``shards``
    which shard gets each of those takes.

    A null source is a source of its own, the last; empty texts have size and taken
    0; repeated rows are counted and placed one by one; a source without words has
    target 0; an empty table gives no rows. Other columns are ignored. Reruns agree:
    the order is that of md5(seed, doc_id), then doc_id and size.
    """
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = stored(docs.select("doc_id", "source", key.alias("key"), F.xxhash64("text").alias("text_key"), word_count(F.col("text")).alias("size")))
    bucket = F.substring("key", 1, 3)
    sums = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    plan = stored(_plan(sizes, weights, share, most, seed, shards))
    starts = sums.join(small(plan, 100_000), sums.s.eqNullSafe(plan.source)).drop("source")
    null = F.col("source").isNull()
    own = sizes.withColumn("bucket", bucket).withColumn("salted", F.struct(null.alias("null"), F.coalesce("source", F.lit("")).alias("source"), F.col("bucket").alias("bucket")))
    inside = Window.partitionBy("salted").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    starts = starts.withColumn("salted", F.struct(F.col("s").isNull().alias("null"), F.coalesce("s", F.lit("")).alias("source"), F.col("bucket").alias("bucket"))).drop("s", "bucket")
    at = own.join(starts, "salted").withColumn("start", F.col("base") + F.col("before"))
    taken = F.col("rounds") * F.col("size") + _up_to(F.col("start") + F.col("size")) - _up_to(F.col("start"))
    at = at.withColumn("first", F.floor(F.least(F.col("start"), F.greatest(F.col("source_size") - 1, F.lit(0))) / F.col("block")))
    more = _chosen(F.col("first") + 1) - _chosen(F.col("first"))
    none = F.array().cast("array<bigint>")
    takes = F.concat(
        F.when(F.col("rounds") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1), lambda r: r * F.col("blocks") + F.col("first"))).otherwise(none),
        F.when(more > 0, F.array(F.col("rounds") * F.col("blocks") + _chosen(F.col("first")))).otherwise(none),
    )
    return at.select("doc_id", "source", "key", "text_key", "size", "source_size", "target", taken.alias("taken"), (F.col("rounds") + more).alias("copies"), F.transform(takes, lambda t: shard_of(t, shards)).alias("shards"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: every row of ``docs`` as often as its first word's block is taken, columns kept.

    Rows alike in doc_id, source and text share their copies evenly.
    """
    place = placed(docs, **options).groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    names = {"doc_id": "mix__d", "source": "mix__s", "text_key": "mix__t", "copies": "mix__copies", "rows": "mix__rows"}
    place = stored(place.select(*[F.col(c).alias(n) for c, n in names.items()]))
    docs = docs.drop(*names.values(), "mix__r", "mix__copy")
    key, columns = F.xxhash64("text"), docs.columns

    def joined(part: DataFrame) -> DataFrame:
        side = small(part)
        return docs.join(side, docs.doc_id.eqNullSafe(side.mix__d) & docs.source.eqNullSafe(side.mix__s) & (key == side.mix__t))

    out = joined(place.where("mix__rows = 1 and mix__copies > 0"))
    again = place.where("mix__rows > 1 and mix__copies > 0")
    if again.take(1):
        order = Window.partitionBy("mix__d", "mix__s", "mix__t").orderBy(*[docs[c] for c in columns if c != "text"])
        more = joined(again).withColumn("mix__r", F.row_number().over(order))
        out = out.unionByName(more.withColumn("mix__copies", F.expr("mix__copies div mix__rows + int(mix__r <= mix__copies % mix__rows)")).drop("mix__r"))
    return out.where("mix__copies > 0").withColumn("mix__copy", F.explode(F.array_repeat(F.lit(0), F.col("mix__copies").cast("int")))).select(*columns)


#: The same as ``placed`` with its defaults, as SQL over ``documents``.
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) + 1] AS w FROM s),
l AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / w AS per FROM w),
b AS (SELECT *, coalesce(sum(source_size) OVER r, 0) AS size_before, coalesce(sum(w) OVER r, 0) AS w_before,
             sum(source_size) OVER () AS size_all, sum(w) OVER () AS w_all
      FROM l WINDOW r AS (ORDER BY per, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (1.5::DOUBLE * CAST(size_all AS DOUBLE) - 2.0::DOUBLE * CAST(size_before AS DOUBLE)) / CAST(w_all - w_before AS DOUBLE) AS level FROM b),
t AS (SELECT source, source_size, CASE WHEN level >= per THEN lim
             ELSE w * max(level) OVER () END AS target FROM v),
p AS (SELECT *, CAST(greatest(1, least(2048, floor(coalesce(min(CASE WHEN target > 0 THEN target END) OVER (), 0.0) / 128))) AS BIGINT) AS block FROM t),
n AS (SELECT source, j, target / (2 * j + 1) AS quotient, block
      FROM (SELECT source, target, block, unnest(range(0, CAST(target / block AS BIGINT) + 2)) AS j FROM p)),
o AS (SELECT source, count(*) AS quota FROM n WHERE quotient >= block / 2.0::DOUBLE GROUP BY source),
q AS (SELECT p.*, CAST(ceil(source_size / CAST(block AS DOUBLE)) AS BIGINT) AS blocks, CAST(coalesce(o.quota, 0) AS BIGINT) AS quota,
             CAST(('0x' || substr(md5('17|' || coalesce(p.source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS phase
      FROM p LEFT JOIN o ON p.source IS NOT DISTINCT FROM o.source),
-- the shard of a take: the first whose quotients, with the target's share of the shards so far, reach half a block
g AS (SELECT source, j, CAST(min(k) - 1 AS INT) AS shard
      FROM (SELECT source, j, block, quotient, unnest(range(1, 25)) AS k FROM n) WHERE quotient * k / 24.0::DOUBLE >= block / 2.0::DOUBLE GROUP BY source, j),
r AS (SELECT *, CASE WHEN blocks > 0 THEN least(quota // blocks, 2) ELSE 0 END AS rounds FROM q),
e AS (SELECT *, CASE WHEN blocks > 0 AND rounds < 2 THEN quota - rounds * blocks ELSE 0 END AS extra FROM r),
d AS (SELECT z.doc_id, z.size, e.*, CAST(coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.k, z.doc_id, z.size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
      FROM sizes z JOIN e ON z.source IS NOT DISTINCT FROM e.source),
x AS (SELECT *, a // block AS i, (a + size) // block AS j FROM d),
c AS (SELECT *, CASE WHEN blocks > 0 THEN CAST(floor(i * CAST(extra AS DOUBLE) / blocks + phase) AS BIGINT) ELSE 0 END AS ci,
             CASE WHEN blocks > 0 THEN CAST(floor((i + 1) * CAST(extra AS DOUBLE) / blocks + phase) AS BIGINT) ELSE 0 END AS ci1,
             CASE WHEN blocks > 0 THEN CAST(floor(j * CAST(extra AS DOUBLE) / blocks + phase) AS BIGINT) ELSE 0 END AS cj,
             CASE WHEN blocks > 0 THEN CAST(floor((j + 1) * CAST(extra AS DOUBLE) / blocks + phase) AS BIGINT) ELSE 0 END AS cj1 FROM x),
-- takes of the block with a document's first word
f AS (SELECT *, least(a, greatest(source_size - 1, 0)) // block AS h FROM c),
z AS (SELECT *, CAST(floor(h * CAST(extra AS DOUBLE) / blocks + phase) AS BIGINT) AS ch,
             CAST(floor((h + 1) * CAST(extra AS DOUBLE) / blocks + phase) AS BIGINT) AS ch1 FROM f),
y AS (SELECT *, row_number() OVER () AS rid, CASE WHEN blocks > 0 THEN
        list_concat([r * blocks + h FOR r IN range(0, rounds)], CASE WHEN ch1 > ch THEN [rounds * blocks + ch] ELSE [] END) ELSE [] END AS takes FROM z),
u AS (SELECT x.rid, string_agg(CAST(g.shard AS VARCHAR), ',' ORDER BY x.take) AS shards
      FROM (SELECT rid, source, unnest(takes) AS take FROM y) x JOIN g ON x.source IS NOT DISTINCT FROM g.source AND x.take = g.j GROUP BY x.rid)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size
         + cj * block + (cj1 - cj) * least(a + size - j * block, least((j + 1) * block, source_size) - j * block)
         - ci * block - (ci1 - ci) * least(a - i * block, least((i + 1) * block, source_size) - i * block) AS BIGINT) AS taken,
       coalesce(u.shards, '') AS shards
FROM y LEFT JOIN u ON y.rid = u.rid
"""
