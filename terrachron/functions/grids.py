"""Tile-grid arithmetic as column expressions, for both tile schemes.

``keyhole``: a square plate-carree grid, 360 degrees across and down, rows counted
north from the south edge. ``mercator``: the usual XYZ grid, rows counted south.
All functions are pure expressions, so they stay inside whole-stage codegen and
can be used in filters that reach the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYHOLE, MERCATOR = "keyhole", "mercator"
SCHEMES = (KEYHOLE, MERCATOR)
TILE_PX = 256
#: Highest addressable level of each scheme, and highest imagery zoom of each provider.
MAX_LEVEL = {KEYHOLE: 30, MERCATOR: 23}
MAX_ZOOM = {"google": 21, "esri": 20}
PROVIDER_SCHEME = {"google": KEYHOLE, "esri": MERCATOR}
EARTH_RADIUS = 6378137.0
EQUATOR_METRES = 2 * math.pi * EARTH_RADIUS
MERCATOR_MAX_LAT = math.degrees(math.atan(math.sinh(math.pi)))


def check_level(scheme: str, level: int) -> int:
    if scheme not in SCHEMES:
        raise ValueError(f"unknown tile scheme {scheme!r}")
    if isinstance(level, bool) or not isinstance(level, int) or not 0 <= level <= MAX_LEVEL[scheme]:
        raise ValueError(f"level must be in [0, {MAX_LEVEL[scheme]}] for {scheme}, not {level!r}")
    return level


def check_zoom(provider: str, zoom: int) -> int:
    """The provider's imagery limit; an unknown provider is left to whoever looks it up."""
    if provider in MAX_ZOOM and zoom > MAX_ZOOM[provider]:
        raise ValueError(f"zoom {zoom} is above the highest {provider} imagery zoom, {MAX_ZOOM[provider]}")
    return zoom


def check_zooms(zooms, provider: str = "esri") -> list[int]:
    """One zoom or several, as a sorted list without repeats; booleans and strings are refused."""
    if isinstance(zooms, (str, bool)):
        raise TypeError(f"zoom must be an int or a sequence of ints, not {type(zooms).__name__}")
    values = [zooms] if isinstance(zooms, int) else list(zooms)
    if not values:
        raise ValueError("no zoom given")
    for z in values:
        if isinstance(z, bool) or not isinstance(z, int):
            raise TypeError(f"zoom values must be ints, not {type(z).__name__}")
        if z < 0:
            raise ValueError(f"zoom must be at least 0, not {z}")
        check_zoom(provider, z)
    return sorted(set(values))


def _n(level: Column | int) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.pow(F.lit(2.0), level)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high) if not isinstance(high, Column) else high)


def _index(value: Column, level) -> Column:
    # positions below the grid truncate towards zero and are clamped, so floor agrees
    return clamp(F.floor(value).cast("long"), 0, _n(level).cast("long") - 1)


def degrees_index(degrees: Column, level) -> Column:
    """The column (or keyhole row) of a coordinate in degrees."""
    return _index((degrees + 180.0) / 360.0 * _n(level), level)


def lat_to_y(lat: Column) -> Column:
    """Latitude to the mercator fraction from the north edge, clamped to the square."""
    lat = F.radians(clamp(lat, -MERCATOR_MAX_LAT, MERCATOR_MAX_LAT))
    return (F.lit(1.0) - F.asinh(F.tan(lat)) / math.pi) / 2.0


def y_to_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - y * 2.0))))


def tile_of_point(scheme: str, lon: Column, lat: Column, level) -> tuple[Column, Column]:
    """The one tile ``(column, row)`` that holds a point."""
    if scheme == KEYHOLE:
        return degrees_index(lon, level), degrees_index(lat, level)
    return degrees_index(lon, level), _index(lat_to_y(lat) * _n(level), level)


def bounds(scheme: str, col: Column, row: Column, level) -> dict[str, Column]:
    """``west, south, east, north`` in degrees."""
    n = _n(level)
    west, east = col / n * 360.0 - 180.0, (col + 1) / n * 360.0 - 180.0
    if scheme == KEYHOLE:
        return {"west": west, "south": row / n * 360.0 - 180.0, "east": east, "north": (row + 1) / n * 360.0 - 180.0}
    return {"west": west, "south": y_to_lat((row + 1) / n), "east": east, "north": y_to_lat(row / n)}


def center(scheme: str, col: Column, row: Column, level) -> tuple[Column, Column]:
    b = bounds(scheme, col, row, level)
    return (b["west"] + b["east"]) / 2.0, (b["south"] + b["north"]) / 2.0


def pixel_origin(scheme: str, col: Column, row: Column, level) -> tuple[Column, Column]:
    """The tile's left and top pixel in the level's mosaic, counted from the north-west."""
    top = row if scheme == MERCATOR else _n(level).cast("long") - 1 - row
    return col * TILE_PX, top * TILE_PX


def pixel_window(scheme: str, west: Column, south: Column, east: Column, north: Column, level) -> dict[str, Column]:
    """``left, top, right, bottom`` pixels of a box, rounded half to even, at least one pixel each way."""
    size = _n(level) * TILE_PX
    across = lambda x: F.rint((x + 180.0) / 360.0 * size).cast("long")
    if scheme == KEYHOLE:
        down = lambda y: F.rint((F.lit(180.0) - y) / 360.0 * size).cast("long")
    else:
        down = lambda y: F.rint(lat_to_y(y) * size).cast("long")
    left, top = across(west), down(north)
    return {"left": left, "top": top, "right": F.greatest(across(east), left + 1), "bottom": F.greatest(down(south), top + 1)}


def affine(scheme: str, left: Column, top: Column, level) -> list[Column]:
    """The six numbers a..f of the pixel-to-map transform of a window's corner."""
    span, x0, y0 = (360.0, -180.0, 180.0) if scheme == KEYHOLE else (EQUATOR_METRES, -EQUATOR_METRES / 2, EQUATOR_METRES / 2)
    px = F.lit(span) / (_n(level) * TILE_PX)
    return [px, F.lit(0.0), left * px + x0, F.lit(0.0), -px, F.lit(y0) - top * px]


def envelope(west: Column, south: Column, east: Column, north: Column) -> dict[str, Column]:
    """A box in degrees as a box in mercator metres."""
    x = lambda lon: (lon / 360.0) * EQUATOR_METRES
    y = lambda lat: (F.lit(0.5) - lat_to_y(lat)) * EQUATOR_METRES
    return {"xmin": x(west), "ymin": y(south), "xmax": x(east), "ymax": y(north)}


def pixel_size(scheme: str, level) -> Column:
    return F.lit(360.0 if scheme == KEYHOLE else EQUATOR_METRES) / (_n(level) * TILE_PX)


# -- keyhole paths ---------------------------------------------------------------
def path(col: Column, row: Column, level) -> Column:
    """The quadtree path ``0...``; a level's digit is 0 to 3 anticlockwise from the south-west."""
    level = F.lit(level) if isinstance(level, int) else level

    def digit(k):
        r, c = (F.call_function("shiftright", x, k.cast("int")).bitwiseAND(F.lit(1).cast("long")) for x in (row, col))
        return (r * 2 + r.bitwiseXOR(c)).cast("string")

    return F.concat(F.lit("0"), F.when(level > 0, F.array_join(F.transform(F.sequence(level - 1, F.lit(0), F.lit(-1)), digit), "")).otherwise(F.lit("")))


def path_position(path: Column) -> tuple[Column, Column, Column]:
    """``(column, row, level)`` of a path."""
    digits = F.transform(F.filter(F.split(F.substring(path, 2, 40), ""), lambda d: d != ""), lambda d: d.cast("int"))
    r = lambda d: F.call_function("shiftright", d, F.lit(1)).cast("long")
    c = lambda d: r(d).bitwiseXOR(d.cast("long").bitwiseAND(F.lit(1).cast("long")))
    zero = F.lit(0).cast("long")
    row = F.aggregate(digits, zero, lambda a, d: a * 2 + r(d))
    col = F.aggregate(digits, zero, lambda a, d: a * 2 + c(d))
    return col, row, F.length(path) - 1


def valid_path(path: Column) -> Column:
    return F.rlike(path, F.lit(r"\A0[0-3]*\z")) & (F.length(path) <= MAX_LEVEL[KEYHOLE] + 1)


def _fold(digits: Column) -> Column:
    """Numbering of a packet's nodes: four children to a node, breadth by digits, from 1."""
    return F.aggregate(F.filter(F.split(digits, ""), lambda d: d != ""), F.lit(0), lambda a, d: a * 4 + d.cast("int") + 1)


def root_subindex(path: Column) -> Column:
    """A node's number in the root packet; the path has one to four digits."""
    return _fold(F.substring(path, 2, 3))


def tree_subindex(suffix: Column) -> Column:
    """A node's number in a packet below the root; ``suffix`` has the one to four digits after its own path."""
    first = F.substring(suffix, 1, 1).cast("int")
    return first * 85 + 1 + _fold(F.substring(suffix, 2, 3))


def subindex(path: Column) -> Column:
    """A path's number in the packet it belongs to; packets break every four levels."""
    tail = F.pmod(F.length(path) - 1, F.lit(4))
    own = F.when(tail == 0, F.lit(4)).otherwise(tail)
    return F.when(F.length(path) <= 4, root_subindex(path)).otherwise(tree_subindex(F.substr(path, F.length(path) - own + 1)))


def index_paths(path: Column) -> Column:
    """The paths of the packets between the root and a tile's own, from the top."""
    last = F.length(path) - 1
    return F.when(last >= 4, F.transform(F.sequence(F.lit(4), F.greatest(last, F.lit(4)), F.lit(4)), lambda k: F.substr(path, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def parent(path: Column) -> Column:
    return F.when(F.length(path) > 1, F.substr(path, F.lit(1), F.length(path) - 1))


# -- areas of interest -----------------------------------------------------------
@dataclass(frozen=True)
class Box:
    """An area of interest as a box in degrees; larger or smaller than nothing, within the world."""

    west: float
    south: float
    east: float
    north: float

    def __post_init__(self):
        if not (self.west < self.east and self.south < self.north):
            raise ValueError("the area of interest is empty or has no area")
        if self.west < -180 or self.east > 180:
            raise ValueError("longitudes must be within -180 and 180")
        if self.south < -90 or self.north > 90:
            raise ValueError("latitudes must be within -90 and 90")

    def units(self, scheme: str, level: int) -> tuple[float, float, float, float]:
        """``x0, y0, x1, y1`` in tiles of a level, y counted as the scheme counts rows."""
        n = 1 << check_level(scheme, level)
        x0, x1 = ((x + 180.0) / 360.0 * n for x in (self.west, self.east))
        if scheme == KEYHOLE:
            y0, y1 = ((y + 180.0) / 360.0 * n for y in (self.south, self.north))
        else:
            y0, y1 = (_lat_y(y) * n for y in (self.north, self.south))
        return x0, y0, x1, y1

    def tile_range(self, scheme: str, level: int) -> tuple[int, int, int, int]:
        """First and last column, first and last row of the tiles that touch the box."""
        last = (1 << level) - 1
        x0, y0, x1, y1 = (min(max(int(v), 0), last) for v in self.units(scheme, level))
        return x0, x1, y0, y1


def _lat_y(lat: float) -> float:
    lat = math.radians(max(min(lat, MERCATOR_MAX_LAT), -MERCATOR_MAX_LAT))
    return (1.0 - math.asinh(math.tan(lat)) / math.pi) / 2.0
