"""Operators for areas and footprints that are not boxes; geometry is multipolygon WKB."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as Y
from ..functions import grids as G
from .tiles import MAX_TILES, select_tiles


def select_tiles_in(spark: SparkSession, area: bytes, scheme: str, level: int, max_tiles: int = MAX_TILES) -> DataFrame:
    """Tiles that touch a polygonal area; the limit is on the cells of its bounding box."""
    polygons = Y.check_area(Y.from_wkb(area))
    points = [p for rings in polygons for r in rings for p in r]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    cells = select_tiles(spark, G.Box(min(xs), min(ys), max(xs), max(ys)), scheme, level, max_tiles)
    b = G.bounds(scheme, F.col("tile_col"), F.col("tile_row"), level)

    @F.pandas_udf("boolean")
    def touches(west: pd.Series, south: pd.Series, east: pd.Series, north: pd.Series) -> pd.Series:
        return pd.Series([Y.intersects([Y.box(*x)], polygons) for x in zip(west, south, east, north)], dtype=bool)

    return cells.where(touches(b["west"], b["south"], b["east"], b["north"]))


def box_wkb(west, south, east, north):
    """Column: a box as WKB."""

    @F.pandas_udf("binary")
    def make(w: pd.Series, s: pd.Series, e: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([Y.to_wkb([Y.box(*x)]) for x in zip(w, s, e, n)])

    return make(west, south, east, north)


#: Cells along either side of an area's bounds, in which unions are taken.
CELLS = 8


def clipped_union(footprints: DataFrame, area: bytes, keys: list[str]) -> DataFrame:
    """``keys, area_fraction, geometry``: the union of each group's ``geom`` inside an area.

    First every row is clipped, rows that miss the area drop out, and what is left is
    cut at the lines of a grid over the area, one by one; then the pieces of a group in
    one cell are merged, in any number of tasks. The last step only strings the cells'
    disjoint pieces together and adds up their areas.
    """
    polygons = Y.check_area(Y.from_wkb(area))
    whole = Y.mercator_area(Y.overlay(polygons))
    xs, ys = zip(*[p for rings in polygons for ring in rings for p in ring])
    lines = [[a + (b - a) * k / CELLS for k in range(CELLS + 1)] for a, b in ((min(xs), max(xs)), (min(ys), max(ys)))]

    @F.pandas_udf("array<struct<cell:int,geom:binary>>")
    def clip(geom: pd.Series) -> pd.Series:
        out = []
        for g in geom:
            parts = Y.from_wkb(bytes(g)) if g is not None else []
            cut = Y.overlay(parts, polygons) if parts else []
            pieces: dict[int, list] = {}
            for part in cut:
                x, y = zip(*part[0])
                (i0, i1), (j0, j1) = (tuple(min(CELLS - 1, max(0, bisect.bisect_right(at, v) - 1)) for v in (min(w), max(w))) for w, at in ((x, lines[0]), (y, lines[1])))
                for i in range(i0, i1 + 1):
                    for j in range(j0, j1 + 1):
                        one = [part] if i0 == i1 and j0 == j1 else Y.overlay([part], [Y.box(lines[0][i], lines[1][j], lines[0][i + 1], lines[1][j + 1])])
                        if one:
                            pieces.setdefault(i * CELLS + j, []).extend(one)
            if not pieces and parts and Y.intersects(parts, polygons):  # it only touches the area
                pieces[0] = []
            out.append([{"cell": c, "geom": Y.to_wkb(p)} for c, p in pieces.items()])
        return pd.Series(out, dtype=object)

    @F.pandas_udf("binary")
    def union(geom: pd.Series) -> bytes:
        return Y.to_wkb(Y.overlay([p for g in geom for p in Y.from_wkb(bytes(g))]))

    @F.pandas_udf("binary")
    def together(geom: pd.Series) -> bytes:
        return Y.to_wkb([p for g in geom for p in Y.from_wkb(bytes(g))])

    @F.pandas_udf("double")
    def share(geom: pd.Series) -> pd.Series:
        return pd.Series([Y.mercator_area(Y.from_wkb(bytes(g))) / whole for g in geom], dtype=float)

    cut = footprints.select(*keys, F.inline(clip("geom")))
    merged = cut.groupBy(*keys, "cell").agg(union("geom").alias("geom"))
    return merged.groupBy(*keys).agg(together("geom").alias("geometry")).withColumn("area_fraction", share("geometry"))


def geometries_in_degrees(rows: DataFrame) -> DataFrame:
    """``rows(rings, ...)`` in mercator metres with ``geom``, valid WKB in degrees, in place of the rings.

    Outlines that cross themselves are cut where they do; rows without rings, or of
    which nothing is left, go.
    """

    @F.pandas_udf("binary")
    def shape(rings: pd.Series) -> pd.Series:
        out = []
        for r in rings:
            own = Y.rings_to_polygons(r) if r is not None else []
            valid = Y.overlay(Y.from_metres(own)) if own else []
            out.append(Y.to_wkb(valid) if valid else None)
        return pd.Series(out, dtype=object)

    return rows.withColumn("geom", shape(F.col("rings"))).drop("rings").where("geom is not null")
