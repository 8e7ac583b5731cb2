"""Resharding by minimum-cost flow.

The old layout puts a row into one of ``old`` shards by its id. New shards have
equal capacities in bytes. A flow network, source -> old shards -> new shards ->
sink, with cost 0 a byte for staying and 1 for moving, says how many bytes go
from where to where so that the fewest move. Blocks of rows are then transferred
to match the flow; the few blocks over which a boundary runs are split by row.

The driver holds the flow (old x new numbers) and one total per block: at most
``BLOCKS`` for every old shard, however large the table is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WRITING, settings, shared_dir, stored

OLD, NEW, BLOCKS, ROW_BYTES = 16, 24, 1024, 8
#: Rows over this part of a shard's capacity come first in their old shard, largest first,
#: and so stay where they can; there are at most NEW * LARGE of them in all.
LARGE = 256


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """The cheapest transport of every ``supply`` into ``capacity``: successive shortest paths.

    ``cost(i, j)`` is for a byte from old shard i to new shard j. Capacities have to
    suffice. Gives the flows over 0 by ``(i, j)``.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new capacities do not hold the data")
    m, n = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(capacity)
    while any(left):
        # Bellman-Ford over the residual graph; nodes 0..m-1 are old shards, m..m+n-1 new ones
        dist, back = [0 if i < m and left[i] else float("inf") for i in range(m + n)], [-1] * (m + n)
        changed = True
        while changed:
            changed = False
            for i in range(m):
                for j in range(n):
                    c = cost(i, j)
                    if dist[i] + c < dist[m + j]:
                        dist[m + j], back[m + j], changed = dist[i] + c, i, True
                    if flow.get((i, j)) and dist[m + j] - c < dist[i]:
                        dist[i], back[i], changed = dist[m + j] - c, m + j, True
        end = min((x for x in range(m, m + n) if room[x - m]), key=lambda x: dist[x])
        path, at = [], end
        while back[at] >= 0:
            path.append((back[at], at))
            at = back[at]
        push = min([left[at], room[end - m], *(flow[v, u - m] for u, v in path if u >= m)])
        for u, v in path:
            if u < m:
                flow[u, v - m] = flow.get((u, v - m), 0) + push
            else:
                flow[v, u - m] -= push
        left[at] -= push
        room[end - m] -= push
    return {k: v for k, v in flow.items() if v}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def with_bytes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the text's UTF-8 bytes (null: none) plus ``ROW_BYTES``, and ``text_crc32`` (null: of no bytes, 0)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    return docs.withColumn("size", size).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))


_ORDER = ("rank", "h", "doc_id", "size", "text_crc32")


def _keyed(rows: DataFrame, old: int, large: int) -> DataFrame:
    """The old shard, block and place in the block's order of every row, from the row alone."""
    h = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(7))
    block = F.when(F.col("size") > large, F.lit(0)).otherwise(1 + F.pmod(F.shiftright(h, 20), F.lit(BLOCKS - 1)))
    rows = rows.withColumn("h", h).withColumn("old_shard", F.pmod("h", F.lit(old)).cast("int")).withColumn("block", block.cast("int"))
    return rows.withColumn("rank", F.when(F.col("block") == 0, -F.col("size")).otherwise(0))


def _transferred(keyed: DataFrame, bounds: DataFrame, new: int) -> DataFrame:
    """Rows with ``row``, their number in the block from 1, and the new ``shard``.

    Blocks come together by the shard that gets their first rows, and lots of it, so what
    is written by shard afterwards needs no other shuffle.
    """
    n = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = keyed.join(F.broadcast(bounds), ["old_shard", "block"])
    rows = rows.withColumn("home", F.element_at("parts", 1)["shard"]).withColumn("lot", F.pmod("block", F.lit(max(1, n // new))))
    rows = rows.repartition(n, "home", "lot")
    inside = Window.partitionBy("home", "lot", "old_shard", "block").orderBy(*_ORDER)
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("row", F.row_number().over(inside))
    middle = F.col("at") + F.col("before") + F.expr("size div 2")
    fits = F.filter("parts", lambda p: (p["lo"] <= middle) & (middle < p["hi"]))
    return rows.withColumn("shard", F.coalesce(F.try_element_at(fits, F.lit(1))["shard"], F.element_at("parts", -1)["shard"])).drop("parts", "at", "before", "home", "lot")


def assign(docs: DataFrame, old: int = OLD, new: int = NEW) -> DataFrame:
    """``docs(doc_id, size, text_crc32, ...)`` with ``old_shard``, ``shard`` and ``slot``.

    Shard sizes are within a row or two of each other: every boundary of the flow
    falls between two rows. Slots count from 0 in each shard without gaps. Rows of
    one id, and null ids, are placed one by one; ties go by size and checksum, and
    what is then equal is interchangeable. Other columns are carried once, in the
    last pass; the flow and the counts are made from the three. No rows give no rows;
    columns named like those added, or ``h, block, rank, row, before, at, parts, first,
    home, lot``, are dropped.
    """
    docs = docs.drop("old_shard", "shard", "slot", "h", "block", "rank", "row", "before", "at", "parts", "first", "home", "lot")
    spark, light = docs.sparkSession, stored(docs.select("doc_id", "size", "text_crc32"))
    total = int(light.agg(F.sum("size")).first()[0] or 0)
    large = max(1, total // new // LARGE)
    keyed = _keyed(light, old, large)
    # large rows form block 0: at most new * LARGE in all shards
    totals = keyed.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).toPandas().sort_values(["old_shard", "block"], ignore_index=True)
    supply = [int(totals.bytes[totals.old_shard == i].sum()) for i in range(old)]
    flow = min_cost_flow(supply, equal_capacities(total, new), lambda i, j: int(i != j))
    # each old shard's bytes, in block order: what stays first, then what goes to each new shard
    cuts: dict[int, list[tuple[int, int, int]]] = {}
    for i in range(old):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            cuts.setdefault(i, []).append((at, at + flow[i, j], j))
            at += flow[i, j]
    starts = totals.groupby("old_shard").bytes.cumsum() - totals.bytes
    plan = []
    for i, b, size, at in zip(totals.old_shard, totals.block, totals.bytes, starts):
        plan.append((int(i), int(b), int(at), [(lo, hi, j) for lo, hi, j in cuts.get(i, []) if lo < at + size and hi > at]))
    # bounded: at most old * BLOCKS rows, and a few more for split blocks
    bounds = spark.createDataFrame(plan, "old_shard int, block int, at long, parts array<struct<lo: long, hi: long, shard: int>>")
    counts = _transferred(keyed, bounds, new).groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"), F.min("row").alias("row")).toPandas()
    counts = counts.sort_values(["shard", "old_shard", "block"], ignore_index=True)
    counts["first"] = counts.groupby("shard")["n"].cumsum() - counts["n"] - counts["row"]
    firsts = spark.createDataFrame([tuple(map(int, r)) for r in counts[["shard", "old_shard", "block", "first"]].to_numpy()], "shard int, old_shard int, block int, first long")
    out = _transferred(_keyed(docs, old, large), bounds, new).join(F.broadcast(firsts), ["shard", "old_shard", "block"])
    return out.select(*docs.columns, "old_shard", "shard", (F.col("first") + F.col("row")).alias("slot"))


def rewrite(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """Writes the shards that change and says where every shard's files are.

    ``rows`` are assigned rows with all columns to keep. A new shard whose rows are
    exactly an old shard's keeps its files (``path`` null); every other is written
    under ``root`` in a folder of this call, so readers of the old layout are not
    disturbed. Rows as ``assign`` gives them lie by shard, and every task writes a file
    for each shard it has. Gives ``shard, rows, moved_bytes, path``, one row a shard.
    """
    moved = F.sum(F.when(F.col("old_shard") != F.col("shard"), F.col("size")).otherwise(0))
    inward = rows.groupBy("shard").agg(F.count("*").alias("rows"), moved.alias("moved_bytes"))
    outward = rows.where("old_shard <> shard").select(F.col("old_shard").alias("shard")).distinct().withColumn("gave", F.lit(True))
    state = stored(inward.join(outward, "shard", "left"))
    changed = state.where("moved_bytes > 0 or gave").select("shard")
    path = f"{root.rstrip('/')}/layout-{uuid.uuid4().hex}"
    own = rows.join(F.broadcast(changed), "shard")  # at most ``new`` rows
    with settings(spark, WRITING):
        own.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    where = F.when((F.col("moved_bytes") > 0) | F.col("gave"), F.concat(F.lit(f"{path}/shard="), F.col("shard").cast("string")))
    return stored(state.select("shard", "rows", "moved_bytes", where.alias("path")))


def read_layout(spark: SparkSession, rows: DataFrame, layout: DataFrame) -> DataFrame:
    """The rows of all shards as the layout has them: from the files written, and of kept shards from ``rows``."""
    places = {r.shard: r.path for r in layout.collect()}  # one row a shard
    written = sorted({p.rpartition("/shard=")[0] for p in places.values() if p})
    kept = rows.where(F.col("shard").isin([s for s, p in places.items() if p is None]))
    schema = rows.select(*[c for c in rows.columns if c != "shard"], "shard").schema
    for path in written:
        kept = kept.unionByName(spark.read.schema(schema).parquet(path))
    return kept


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/layouts-{spark.sparkContext.applicationId}"
