"""What a published release displayed: a dated seam map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grids as G

SOURCE = ("source_provider", "source_description", "source_resolution_m", "source_accuracy_m", "min_map_level", "max_map_level")


def _projected(aoi: G.Box):
    """Columns of a footprint box clipped to the area, in fractions of the mercator square."""
    x = lambda lon: (lon + 180.0) / 360.0
    left = F.greatest(x(F.col("west")), F.lit(x(aoi.west)))
    right = F.least(x(F.col("east")), F.lit(x(aoi.east)))
    top = F.greatest(G.lat_to_y(F.col("north")), F.lit(G._lat_y(aoi.north)))
    bottom = F.least(G.lat_to_y(F.col("south")), F.lit(G._lat_y(aoi.south)))
    return left, top, right, bottom


def union_length(spans: Column) -> Column:
    """Total length of the union of ``array<struct<lo, hi>>`` by one sorted fold."""
    start = F.struct(F.lit(float("-inf")).alias("end"), F.lit(0.0).alias("sum"))

    def step(acc, s):
        add = F.greatest(F.lit(0.0), s["hi"] - F.greatest(s["lo"], acc["end"]))
        return F.struct(F.greatest(acc["end"], s["hi"]).alias("end"), (acc["sum"] + add).alias("sum"))

    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["sum"])


def _with(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, though lambdas in it use it many times."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def union_area(boxes: Column) -> Column:
    """Area of the union of ``array<struct<x0, y0, x1, y1>>``: slabs between the sorted y ends.

    Exact for any overlap; work is the number of ends times the number of boxes, so ``covered`` takes it cell by cell and divides cells of many.
    """

    def of(ys):
        def slab(y, i):
            upper = F.try_element_at(ys, i + 2)
            inside = F.filter(boxes, lambda b: (b["y0"] <= y) & (b["y1"] > y))
            spans = F.transform(inside, lambda b: F.struct(b["x0"].alias("lo"), b["x1"].alias("hi")))
            return F.coalesce((upper - y) * union_length(spans), F.lit(0.0))

        return F.aggregate(F.transform(ys, slab), F.lit(0.0), lambda a, v: a + v)

    return _with(F.array_sort(F.array_distinct(F.concat(F.transform(boxes, lambda b: b["y0"]), F.transform(boxes, lambda b: b["y1"])))), of)


#: Cells along either side of an area, in which unions are taken; the bits of a mask.
CELLS = 32
#: Distinct pieces in a cell, above which the cell is divided again.
FEW = 64


def _place(v: Column, lo, size, n) -> Column:
    """The cell of ``n`` that a coordinate is in."""
    return F.least(F.lit(n) - 1, F.greatest(F.lit(0), F.floor((v - lo) / size))).cast("int")


def _line(k: Column, lo, size, n, hi) -> Column:
    """The start of cell ``k`` of ``n``; the end of the last is ``hi`` itself."""
    return F.when(k >= n, hi).otherwise(F.lit(lo) + k * size)


def _bits(first: Column, last: Column) -> Column:
    """A mask of the cells from ``first`` to ``last``, none if they are the wrong way round."""
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    return F.when(first <= last, power(last + 1) - power(first)).otherwise(F.lit(0).cast("long"))


def _box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _clipped(b, c) -> Column:
    """A box inside a cell."""
    return _box(F.greatest(b["x0"], c["x0"]), F.greatest(b["y0"], c["y0"]), F.least(b["x1"], c["x1"]), F.least(b["y1"], c["y1"]))


def _divided_area(pieces: Column, c: Column) -> Column:
    """``union_area`` of many pieces of a cell, which is divided by the root of their number across the sides inside which they end."""
    k = F.ceil(F.sqrt(F.size(pieces) / F.lit(FEW / 2.0))).cast("int")
    times = lambda test: F.when(F.exists(pieces, test), k).otherwise(F.lit(1))
    sides = F.struct(times(lambda b: (b["x0"] > c["x0"]) | (b["x1"] < c["x1"])).alias("x"), times(lambda b: (b["y0"] > c["y0"]) | (b["y1"] < c["y1"])).alias("y"))

    def of(n):
        def part(s):
            at = lambda d, k: _line(k, c[f"{d}0"], (c[f"{d}1"] - c[f"{d}0"]) / n[d], n[d], c[f"{d}1"])
            p, q = s % n["x"], F.floor(s / n["x"])
            return _with(_box(at("x", p), at("y", q), at("x", p + 1), at("y", q + 1)), held)

        def held(c):
            whole = F.exists(pieces, lambda b: (b["x0"] <= c["x0"]) & (b["y0"] <= c["y0"]) & (b["x1"] >= c["x1"]) & (b["y1"] >= c["y1"]))
            there = F.filter(pieces, lambda b: (b["x0"] < c["x1"]) & (b["y0"] < c["y1"]) & (b["x1"] > c["x0"]) & (b["y1"] > c["y0"]))
            return F.when(whole, F.array(c)).otherwise(F.transform(there, lambda b: _clipped(b, c)))

        parts = F.transform(F.sequence(F.lit(0), n["x"] * n["y"] - 1), part)
        return F.aggregate(parts, F.lit(0.0), lambda a, b: a + union_area(b))

    return _with(sides, of)


def covered(footprints: DataFrame, aoi: G.Box, keys: list[str], each: tuple[str, ...] | None = None) -> DataFrame:
    """``keys, area_fraction, n_footprints``: the share of the area that each group's boxes cover together.

    A group's boxes count once for equal ``each``, or row by row without it; give the empty
    tuple where the number does not matter. They are laid on a grid over the area.
    The cells that one box covers whole are masks, which need no boxes brought together;
    only in the others are boxes cut at the cell's lines and united cell by cell, in any
    number of tasks, and a cell with many pieces is divided again. Groups are equal with
    equal nulls; boxes off the area are dropped, ones that only touch it count.
    """
    left, top, right, bottom = _projected(aoi)
    boxes = footprints.select(*keys, *(each or ()), left.alias("x0"), top.alias("y0"), right.alias("x1"), bottom.alias("y1")).where("x0 <= x1 and y0 <= y1")
    boxes = boxes if each is None else boxes.distinct()
    x = ((aoi.west + 180.0) / 360.0, (aoi.east - aoi.west) / 360.0 / CELLS, CELLS, F.lit((aoi.east + 180.0) / 360.0))
    y = (G._lat_y(aoi.north), (G._lat_y(aoi.south) - G._lat_y(aoi.north)) / CELLS, CELLS, F.lit(G._lat_y(aoi.south)))
    i0, i1, j0, j1 = (_place(F.col(v), *w[:3]) for v, w in (("x0", x), ("x1", x), ("y0", y), ("y1", y)))
    inner = lambda first, last, lo, hi, w: (first + F.when(F.col(lo) > _line(first, *w), 1).otherwise(0), last - F.when(F.col(hi) < _line(last + 1, *w), 1).otherwise(0))
    (f0, f1), (g0, g1) = inner(i0, i1, "x0", "x1", x), inner(j0, j1, "y0", "y1", y)
    laid = boxes.select(*keys, _bits(f0, f1).alias("bits"), g0.alias("g0"), g1.alias("g1"))
    of_row = F.expr("array(" + ", ".join(f"coalesce(bit_or(if(g0 <= {k} and g1 >= {k}, bits, null)), 0L)" for k in range(CELLS)) + ")")
    whole = F.aggregate("full", F.lit(0), lambda a, m: a + F.bit_count(m)) * (x[1] * y[1])
    masks = laid.groupBy(*[F.col(k).alias(f"{k}__") for k in keys]).agg(of_row.alias("full"), F.count("*").alias("n")).withColumn("whole", whole)

    same = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    cut = boxes.select(*keys, "x0", "y0", "x1", "y1").join(masks, same)
    free = F.transform(F.sequence(j0, j1), lambda j: F.struct(j.alias("j"), _bits(i0, i1).bitwiseAND(F.bitwise_not(F.get("full", j))).alias("bits")))
    cut = cut.withColumn("free", F.explode_outer(F.filter(free, lambda r: r["bits"] != 0)))
    cut = cut.withColumn("j", F.col("free.j")).withColumn("i", F.explode_outer(F.filter(F.sequence(i0, i1), lambda i: F.getbit("free.bits", i) == 1)))
    own = {"x0": F.col("x0"), "y0": F.col("y0"), "x1": F.col("x1"), "y1": F.col("y1")}
    cell = _box(*[_line(F.col(v) + d, *w) for d in (0, 1) for v, w in (("i", x), ("j", y))])
    cut = cut.select(*keys, "n", "whole", "i", "j", cell.alias("c"), *own.values())
    piece = F.when(F.col("i").isNotNull(), _clipped(own, F.col("c")))  # a box without a free cell has none
    held = cut.groupBy(*keys, "i", "j").agg(F.collect_set(piece).alias("pieces"), *[F.any_value(v).alias(v) for v in ("c", "n", "whole")])
    area = F.when(F.size("pieces") <= FEW, union_area(F.col("pieces"))).otherwise(_divided_area(F.col("pieces"), F.col("c")))
    by_group = held.select(*keys, "n", "whole", area.alias("area")).groupBy(*keys).agg(F.sum("area").alias("area"), F.any_value("whole").alias("whole"), F.any_value("n").alias("n_footprints"))
    return by_group.select(*keys, ((F.col("area") + F.col("whole")) / (x[1] * CELLS * y[1] * CELLS)).alias("area_fraction"), "n_footprints")


def seam_map(footprints: DataFrame, aoi: G.Box) -> DataFrame:
    """``zoom, date, area_fraction, release_id`` and the source, from box footprints of one release.

    ``footprints(zoom, capture_date, release_id, object_id, west, south, east, north, <source>)``.
    An object that several rows of a group show by the same box is one footprint.
    Groups are (zoom, date, source) with nulls equal; the fraction is that of the
    union, so overlaps count once. Footprints off the area are dropped, ones that
    only touch it stay with fraction 0. Order: zoom, newest first, then source.
    """
    out = covered(footprints, aoi, ["zoom", "capture_date", "release_id", *SOURCE], ("object_id",))
    out = out.select("zoom", F.col("capture_date").alias("date"), "area_fraction", "release_id", "n_footprints", *SOURCE)
    return out.orderBy("zoom", F.desc("date"), *[F.col(c).asc_nulls_first() for c in SOURCE])
