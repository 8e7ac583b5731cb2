"""Tiles of areas and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids as G

MAX_TILES = 10_000


def select_tiles(spark: SparkSession, aoi: G.Box, scheme: str, level: int, max_tiles: int = MAX_TILES) -> DataFrame:
    """``tile_col, tile_row, zoom`` of the tiles that touch a box, edges included.

    The index ranges are computed from the box, so no grid is scanned; above
    ``max_tiles`` cells an error is raised before anything runs.
    """
    c0, c1, r0, r1 = aoi.tile_range(scheme, level)
    count = (c1 - c0 + 1) * (r1 - r0 + 1)
    if count > max_tiles:
        raise ValueError(f"the area spans {count} tiles at zoom {level}, above max_tiles={max_tiles}")
    rows = spark.range(r0, r1 + 1).select(F.col("id").alias("tile_row"), F.explode(F.sequence(F.lit(c0).cast("long"), F.lit(c1).cast("long"))).alias("tile_col"))
    return rows.select("tile_col", "tile_row", F.lit(level).alias("zoom"))


def in_range(aoi: G.Box, scheme: str, level: int, col: Column, row: Column) -> Column:
    """The same tiles as a predicate of literals, which Parquet statistics can prune with."""
    c0, c1, r0, r1 = aoi.tile_range(scheme, level)
    return col.between(c0, c1) & row.between(r0, r1)


def tiles_of_points(points: DataFrame, scheme: str, level: int, max_tiles: int | None = MAX_TILES) -> DataFrame:
    """The distinct tiles of ``points(lon, lat)``; more than ``max_tiles`` raise an error."""
    col, row = G.tile_of_point(scheme, F.col("lon"), F.col("lat"), level)
    tiles = points.select(col.alias("tile_col"), row.alias("tile_row"), F.lit(level).alias("zoom")).distinct()
    if max_tiles is not None and tiles.limit(max_tiles + 1).count() > max_tiles:
        raise ValueError(f"the points fall into more than max_tiles={max_tiles} tiles")
    return tiles


def clip_share(aoi: G.Box, scheme: str, level: int, col: Column, row: Column) -> Column:
    """The tile's part inside a box as a share of the box, by planar area in web mercator.

    Mercator rows are linear in the projected ordinate; keyhole rows are linear in
    degrees, so there every clipped edge is projected. Zero where only edges touch.
    """
    x0, y0, x1, y1 = aoi.units(scheme, level)
    width = F.greatest(F.lit(0.0), F.least(col + 1.0, F.lit(x1)) - F.greatest(col.cast("double"), F.lit(x0)))
    low, high = F.greatest(row.cast("double"), F.lit(y0)), F.least(row + 1.0, F.lit(y1))
    if scheme == G.MERCATOR:
        return width * F.greatest(F.lit(0.0), high - low) / ((x1 - x0) * (y1 - y0))
    n = float(1 << level)
    up = lambda y: -G.lat_to_y(y / n * 360.0 - 180.0)
    tall = G._lat_y(aoi.south) - G._lat_y(aoi.north)
    return width * F.when(high > low, up(high) - up(low)).otherwise(0.0) / ((x1 - x0) * tall)
