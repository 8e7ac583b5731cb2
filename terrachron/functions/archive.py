"""Addresses, extents and overview levels of a tile archive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grids import EQUATOR_METRES, KEYHOLE, TILE_PX


def address(scheme: str, col: Column, row: Column, level: Column) -> dict[str, Column]:
    """``zoom, column, row`` in the archive, rows from the north.

    Keyhole tiles move to a grid of two tiles by one over the latitudes that exist,
    one zoom lower; levels below 2 and rows outside it raise an error.
    """
    if scheme != KEYHOLE:
        return {"zoom": level.cast("int"), "column": col.cast("long"), "row": row.cast("long")}
    n = F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))
    north = n - 1 - row - F.call_function("shiftright", n, F.lit(2))
    ok = (level >= 2) & (north >= 0) & (north < F.call_function("shiftright", n, F.lit(1)))
    return {
        "zoom": (level - 1).cast("int"),
        "column": col.cast("long"),
        "row": F.when(ok, north).otherwise(F.raise_error(F.lit("a tile lies outside the archive's grid")).cast("long")),
    }


def matrix(scheme: str, level: int) -> dict[str, object]:
    """The grid of one level: name, reference system, size in pixels, origin and pixel size."""
    n = 1 << level
    if scheme == KEYHOLE:
        if level < 2:
            raise ValueError("keyhole levels 0 and 1 have no place in the archive's grid")
        return {"scheme": "InspireCRS84Quad", "crs": "EPSG:4326", "width": n * TILE_PX, "height": n // 2 * TILE_PX, "x": -180.0, "y": 90.0, "pixel": 360.0 / (n * TILE_PX)}
    return {"scheme": "GoogleMapsCompatible", "crs": "EPSG:3857", "width": n * TILE_PX, "height": n * TILE_PX, "x": -EQUATOR_METRES / 2, "y": EQUATOR_METRES / 2, "pixel": EQUATOR_METRES / (n * TILE_PX)}


def overview_factors(width: int, height: int, zoom: int) -> list[int]:
    """Powers of two that still shrink the raster, down to one pixel or to zoom 0."""
    half = lambda f: (max(1, -(-width // f)), max(1, -(-height // f)))
    factors = [1 << k for k in range(1, zoom + 1)]
    return [f for i, f in enumerate(factors) if (i == 0 or half(f) != half(f // 2)) and (i == 0 or half(f // 2) != (1, 1))]
