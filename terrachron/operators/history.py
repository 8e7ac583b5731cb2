"""Change history of tiles over a list of releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TILE = ("tile_col", "tile_row")


def change_history(carried: DataFrame) -> DataFrame:
    """Rows of ``carried(tile, pos, capture_date, ...)`` at which a tile's imagery changed.

    ``pos`` counts releases from the newest, 1. Of every run of equal dates the
    earliest release stays; a date may come again later. Rows without a date are
    left out first, so they do not break a run.
    """
    order = Window.partitionBy(*TILE).orderBy("pos")
    after = F.lead("capture_date").over(order)
    rows = carried.where(F.col("capture_date").isNotNull()).withColumn("after__", after)
    return rows.where(F.col("after__").isNull() | (F.col("after__") != F.col("capture_date"))).drop("after__")


def skip_chain(tilemaps: DataFrame, positions: Column | None = None) -> DataFrame:
    """``tile, pos, effective``: the releases that are looked at and carry imagery.

    ``tilemaps(tile, pos, has, sel)`` is walked from the newest release. Where ``sel``
    names a release, the ones before it are passed over until it comes, and it is
    looked at itself; the row's imagery is that release's if it is known, else its
    own. A ``sel`` that never comes, or has gone by, ends the walk. One fold over the
    tile's ordered array; a tile has as many rows as there are releases.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "has", "sel")))
    state = "struct<want:int,out:array<struct<pos:int,effective:int>>>"
    start = F.struct(F.lit(None).cast("int").alias("want"), F.array().cast("array<struct<pos:int,effective:int>>").alias("out")).cast(state)

    def step(acc, x):
        skip = acc["want"].isNotNull() & (acc["want"] != x["pos"])
        known = F.array_contains("known", x["sel"])
        own = F.when(x["sel"].isNotNull() & known, x["sel"]).otherwise(x["pos"])
        hit = F.struct(x["pos"].alias("pos"), own.alias("effective"))
        out = F.when(~skip & (x["has"] == 1), F.concat(acc["out"], F.array(hit))).otherwise(acc["out"])
        want = F.when(skip, acc["want"]).otherwise(x["sel"])
        return F.struct(want.alias("want"), out.alias("out")).cast(state)

    per_tile = tilemaps.groupBy(*TILE).agg(rows.alias("rows"))
    per_tile = per_tile.withColumn("known", positions if positions is not None else F.transform("rows", lambda r: r["pos"]))
    return per_tile.select(*TILE, F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("x")).select(*TILE, "x.pos", "x.effective")


def candidate_releases(tilemaps: DataFrame, releases: DataFrame) -> DataFrame:
    """The releases that changed any of the tiles, oldest first."""
    used = skip_chain(tilemaps).select(F.col("effective").alias("pos")).distinct()
    return releases.join(used, "pos", "left_semi").orderBy(F.desc("pos"))
