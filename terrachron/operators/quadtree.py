"""Dated versions from materialised quadtree nodes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grids as G
from ..functions.codecs import inflate, unmask
from ..functions.dates import MIN_JPEG_DATE, packed_date
from ..sources.dbroot import read_packet


def reachable(tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tiles(path, ...)`` whose packets all exist: every packet on the way down has an epoch.

    ``nodes(path, cache_node_epoch)`` has the node above each packet. Depth by depth the
    tiles are joined with the nodes of that depth, of which the upper ones are few: the
    rows are never multiplied and never brought together by a short prefix.
    """
    deepest = tiles.agg(F.max(F.length("path"))).first()[0] or 0
    known = nodes.where("cache_node_epoch <> 0").select("path").distinct()
    for depth in range(4, deepest, 4):
        here = known.where(F.length("path") == depth).select(F.col("path").alias("hop__"))
        hop = F.when(F.length("path") > depth, F.left("path", F.lit(depth)))
        out = tiles.withColumn("key__", hop).join(here, F.col("key__") == F.col("hop__"), "left")
        tiles = out.where("key__ is null or hop__ is not null").drop("key__", "hop__")
    return tiles


def dated_versions(tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path, capture_date, provider, epoch, packed`` of every version of each tile.

    ``nodes(path, imagery_epoch, dates array<struct<date, epoch, provider>>)``. A dated
    entry counts if its packed date is above ``MIN_JPEG_DATE`` and exists; provider 0
    stands for the default imagery of that date and needs an imagery layer. A node
    without dated entries has its default imagery once, undated.
    """
    here = tiles.select("path").distinct().join(nodes, "path")
    none = here.where(F.coalesce(F.size("dates"), F.lit(0)) <= 0).where("imagery_epoch is not null")
    undated = none.select("path", F.lit(None).cast("date").alias("capture_date"), F.lit(0).alias("provider"), F.col("imagery_epoch").alias("epoch"), F.lit(None).cast("int").alias("packed"))
    each = here.select("path", "imagery_epoch", F.inline("dates"))
    each = each.where(F.col("date") > MIN_JPEG_DATE).withColumn("capture_date", packed_date(F.col("date"))).where("capture_date is not null")
    each = each.where("provider <> 0 or imagery_epoch is not null")
    own = F.col("provider") != 0
    dated = each.select("path", "capture_date", F.col("provider").cast("int").alias("provider"), F.when(own, F.col("epoch")).otherwise(F.col("imagery_epoch")).alias("epoch"), F.when(own, F.col("date")).alias("packed"))
    return dated.unionByName(undated)


def with_copyright(versions: DataFrame, providers: DataFrame) -> DataFrame:
    """Versions with their provider's name; blank names count as none. ``providers`` is a small dimension table."""
    names = providers.select(F.col("provider_id").alias("provider"), F.nullif("copyright", F.lit("")).alias("provider_name"))
    return versions.join(names, "provider", "left")


def decoded_nodes(payloads: DataFrame, key: bytes | None = None) -> DataFrame:
    """``packet, number, cache_node_epoch, imagery_epoch, dates`` from recorded packets ``(packet, body)``.

    ``packet`` is the path of the packet's top. A body that can't be read gives no rows.
    """
    schema = "packet string, number int, cache_node_epoch int, imagery_epoch int, dates array<struct<date:int,epoch:int,provider:int>>"
    dated = pa.list_(pa.struct([("date", pa.int32()), ("epoch", pa.int32()), ("provider", pa.int32())]))

    def run(batches):
        for b in batches:
            rows = []
            for path, body in zip(b.column("packet").to_pylist(), b.column("body").to_pylist()):
                try:
                    _, nodes = read_packet(inflate(unmask(body, key) if key else body))
                except Exception:  # noqa: BLE001  damage of any kind means no nodes
                    continue
                rows += [(path, n, c, i, [dict(zip(("date", "epoch", "provider"), d)) for d in ds]) for n, c, i, ds in nodes]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([pa.array(cols[0], pa.string()), *[pa.array(cols[i], pa.int32()) for i in (1, 2, 3)], pa.array(cols[4], dated)], ["packet", "number", "cache_node_epoch", "imagery_epoch", "dates"])

    return payloads.select("packet", "body").mapInArrow(run, schema)


def nodes_of_tiles(tiles: DataFrame, decoded: DataFrame) -> DataFrame:
    """Each tile's node: the packet above its path and the number in it, by one equi-join."""
    last = F.length("path") - 1
    above = F.when(last < 4, F.lit("0")).otherwise(F.substr(F.col("path"), F.lit(1), last - F.pmod(last - 1, F.lit(4))))
    keyed = tiles.withColumn("packet", above).withColumn("number", G.subindex(F.col("path")))
    return keyed.join(decoded, ["packet", "number"]).select("path", "cache_node_epoch", "imagery_epoch", "dates")


def binary_imagery(nodes: DataFrame, imagery: int = 0) -> DataFrame:
    """``path, number, capture_date, epoch, provider``: the undated image of every node of ``packets`` that has one.

    A node with children bits of an image takes its first layer of the type
    ``imagery``; other nodes give no row.
    """
    own = F.try_element_at(F.filter("layers", lambda x: x["type"] == imagery), F.lit(1))
    return nodes.select("path", "number", F.lit(None).cast("date").alias("capture_date"), own.alias("x")).where("x is not null").select("path", "number", "capture_date", "x.epoch", "x.provider")
