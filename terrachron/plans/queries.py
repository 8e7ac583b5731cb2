"""The queries over the catalogue, each with the SQL that says the same where SQL can."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import archive as A
from ..functions import codecs as C
from ..functions import dates as D
from ..functions import geometry as Y
from ..functions import grids as G
from ..functions import values as X
from ..operators import coverage, history, matching, mosaic, polygons, quadtree, raster, releases, tiles
from ..sources import catalogue
from ..sources.payloads import fresh, latest
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The area of the demonstrations: columns 20973.25 to 20983.6 and rows 50652.3 to 50656.5 of level 17.
_N = 1 << V.LEVEL
_X = (20973.25, 20983.6)
_Y = (50652.3, 50656.5)


def _lat(y: float) -> float:
    return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / _N))))


AOI = G.Box(_X[0] / _N * 360 - 180, _lat(_Y[1]), _X[1] / _N * 360 - 180, _lat(_Y[0]))


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _r(c, digits: int = 9):
    return F.round(c, digits)


_LAT_Y = "((1.0::DOUBLE - asinh(tan(radians({0}))) / pi()) / 2.0::DOUBLE)"


# -- grids -------------------------------------------------------------------------
@query(V.with_sql(V.POINTS) + f"""SELECT l_orderkey, l_linenumber, CAST(least(greatest(floor((lon + 180.0) / 360.0 * {1 << 17}), 0), {(1 << 17) - 1}) AS BIGINT) AS tile_col,
  CAST(least(greatest(floor({_LAT_Y.format('lat')} * {1 << 17}), 0), {(1 << 17) - 1}) AS BIGINT) AS tile_row FROM points""")
def tile_of_point_mercator(spark, sf_dir):
    col, row = G.tile_of_point(G.MERCATOR, F.col("lon"), F.col("lat"), 17)
    return V.points(spark, sf_dir).select("l_orderkey", "l_linenumber", col.alias("tile_col"), row.alias("tile_row"))


@query(V.with_sql(V.POINTS) + f"""SELECT l_orderkey, l_linenumber, CAST(floor((lon + 180.0) / 360.0 * {1 << 12}) AS BIGINT) AS tile_col,
  CAST(floor((lat + 180.0) / 360.0 * {1 << 12}) AS BIGINT) AS tile_row FROM points""")
def tile_of_point_keyhole(spark, sf_dir):
    col, row = G.tile_of_point(G.KEYHOLE, F.col("lon"), F.col("lat"), 12)
    return V.points(spark, sf_dir).select("l_orderkey", "l_linenumber", col.alias("tile_col"), row.alias("tile_row"))


_KEYED = f"""keyed AS (SELECT DISTINCT CAST(floor((lon + 180.0) / 360.0 * 4096) AS BIGINT) AS c, CAST(floor((lat + 180.0) / 360.0 * 4096) AS BIGINT) AS r FROM points),
paths AS (SELECT c, r, '0' || array_to_string(list_transform([11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0], lambda k: CAST(((r >> k) & 1) * 2 + xor((r >> k) & 1, (c >> k) & 1) AS VARCHAR)), '') AS path FROM keyed)"""


def _keyhole_tiles(spark, sf_dir):
    col, row = G.tile_of_point(G.KEYHOLE, F.col("lon"), F.col("lat"), 12)
    return V.points(spark, sf_dir).select(col.alias("c"), row.alias("r")).distinct().withColumn("path", G.path(F.col("c"), F.col("r"), 12))


@query(V.with_sql(V.POINTS, _KEYED) + "SELECT c, r, path FROM paths")
def quadkey_path(spark, sf_dir):
    return _keyhole_tiles(spark, sf_dir)


@query(V.with_sql(V.POINTS, _KEYED) + "SELECT path, c AS tile_col, r AS tile_row, 12 AS level FROM paths")
def quadkey_decode(spark, sf_dir):
    col, row, level = G.path_position(F.col("path"))
    return _keyhole_tiles(spark, sf_dir).select("path", col.alias("tile_col"), row.alias("tile_row"), level.alias("level"))


@query(V.with_sql(V.POINTS, _KEYED) + """SELECT path, CAST(1 + 4 * (1 + 4 * (1 + CAST(path[2] AS INT)) + CAST(path[3] AS INT)) + CAST(path[4] AS INT) AS INT) AS root_index,
  CAST(CAST(path[10] AS INT) * 85 + 1 + 1 + 4 * (1 + 4 * (1 + CAST(path[11] AS INT)) + CAST(path[12] AS INT)) + CAST(path[13] AS INT) AS INT) AS tree_index,
  substr(path, 1, 12) AS parent, path[1:4] || ',' || path[1:8] || ',' || path[1:12] AS packets FROM paths""")
def quadkey_subindex(spark, sf_dir):
    p = F.col("path")
    return _keyhole_tiles(spark, sf_dir).select(
        "path", G.subindex(F.left(p, F.lit(4))).alias("root_index"), G.tree_subindex(F.right(p, F.lit(4))).alias("tree_index"), G.parent(p).alias("parent"), F.array_join(G.index_paths(p), ",").alias("packets")
    )


def _tiles17(spark, sf_dir):
    return V.captures(spark, sf_dir).select("tile_col", "tile_row").distinct()


@query(V.with_sql(V.CAPTURES) + f"""SELECT DISTINCT tile_col, tile_row, round(tile_col / {float(_N)}::DOUBLE * 360.0 - 180.0, 9) AS west,
  round(degrees(atan(sinh(pi() * (1.0 - 2.0 * (tile_row + 1) / {float(_N)}::DOUBLE)))), 9) AS south,
  round((tile_col + 1) / {float(_N)}::DOUBLE * 360.0 - 180.0, 9) AS east,
  round(degrees(atan(sinh(pi() * (1.0 - 2.0 * tile_row / {float(_N)}::DOUBLE)))), 9) AS north FROM captures""")
def tile_bounds_mercator(spark, sf_dir):
    b = G.bounds(G.MERCATOR, F.col("tile_col"), F.col("tile_row"), 17)
    return _tiles17(spark, sf_dir).select("tile_col", "tile_row", *[_r(v).alias(k) for k, v in b.items()])


@query(V.with_sql(V.POINTS, _KEYED) + """SELECT c, r, round(c / 4096.0::DOUBLE * 360.0 - 180.0, 9) AS west, round(r / 4096.0::DOUBLE * 360.0 - 180.0, 9) AS south,
  round((c + 1) / 4096.0::DOUBLE * 360.0 - 180.0, 9) AS east, round((r + 1) / 4096.0::DOUBLE * 360.0 - 180.0, 9) AS north,
  c * 256 AS origin_x, (4095 - r) * 256 AS origin_y FROM keyed""")
def tile_bounds_keyhole(spark, sf_dir):
    b = G.bounds(G.KEYHOLE, F.col("c"), F.col("r"), 12)
    x, y = G.pixel_origin(G.KEYHOLE, F.col("c"), F.col("r"), 12)
    return _keyhole_tiles(spark, sf_dir).select("c", "r", *[_r(v).alias(k) for k, v in b.items()], x.alias("origin_x"), y.alias("origin_y"))


_SPANS = "spans AS (SELECT l_orderkey, l_linenumber, lon AS west, lat AS south, least(lon + 0.01, 180.0) AS east, least(lat + 0.02, 85.0) AS north FROM points)"


def _spans(spark, sf_dir):
    p = V.points(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", F.col("lon").alias("west"), F.col("lat").alias("south"), F.least(F.col("lon") + 0.01, F.lit(180.0)).alias("east"), F.least(F.col("lat") + 0.02, F.lit(85.0)).alias("north"))


def _window(spark, sf_dir, scheme):
    w = G.pixel_window(scheme, *[F.col(c) for c in ("west", "south", "east", "north")], 14)
    return _spans(spark, sf_dir).select("l_orderkey", "l_linenumber", *[v.alias(f"px_{k}") for k, v in w.items()])


def _window_sql(left, top, right, bottom):
    cast = lambda e: f"CAST(round_even({e}, 0) AS BIGINT)"
    return f"""SELECT l_orderkey, l_linenumber, {cast(left)} AS px_left, {cast(top)} AS px_top,
  greatest({cast(right)}, {cast(left)} + 1) AS px_right, greatest({cast(bottom)}, {cast(top)} + 1) AS px_bottom FROM spans"""


_P = float(256 << 14)


@query(V.with_sql(V.POINTS, _SPANS) + _window_sql(f"(west + 180.0) / 360.0 * {_P}", f"(180.0 - north) / 360.0 * {_P}", f"(east + 180.0) / 360.0 * {_P}", f"(180.0 - south) / 360.0 * {_P}"))
def pixel_window_keyhole(spark, sf_dir):
    return _window(spark, sf_dir, G.KEYHOLE)


@query(V.with_sql(V.POINTS, _SPANS) + _window_sql(f"(west + 180.0) / 360.0 * {_P}", f"{_LAT_Y.format('north')} * {_P}", f"(east + 180.0) / 360.0 * {_P}", f"{_LAT_Y.format('south')} * {_P}"))
def pixel_window_mercator(spark, sf_dir):
    return _window(spark, sf_dir, G.MERCATOR)


@query(V.with_sql(V.CAPTURES) + f"""SELECT DISTINCT tile_col, tile_row, round({G.EQUATOR_METRES} / {256.0 * _N}, 9) AS a, round(tile_col * 256 * ({G.EQUATOR_METRES} / {256.0 * _N}) - {G.EQUATOR_METRES / 2}, 5) AS c,
  round(-({G.EQUATOR_METRES} / {256.0 * _N}), 9) AS e, round({G.EQUATOR_METRES / 2} - tile_row * 256 * ({G.EQUATOR_METRES} / {256.0 * _N}), 5) AS f FROM captures""")
def affine_mercator(spark, sf_dir):
    x, y = G.pixel_origin(G.MERCATOR, F.col("tile_col"), F.col("tile_row"), 17)
    a = G.affine(G.MERCATOR, x, y, 17)
    return _tiles17(spark, sf_dir).select("tile_col", "tile_row", _r(a[0]).alias("a"), _r(a[2], 5).alias("c"), _r(a[4]).alias("e"), _r(a[5], 5).alias("f"))


@query(f"SELECT CAST(c AS BIGINT) AS tile_col, CAST(r AS BIGINT) AS tile_row, 17 AS zoom FROM range({int(_X[0])}, {int(_X[1]) + 1}) a(c), range({int(_Y[0])}, {int(_Y[1]) + 1}) b(r)")
def select_tiles_bbox(spark, sf_dir):
    return tiles.select_tiles(spark, AOI, G.MERCATOR, 17).orderBy("tile_row", "tile_col")


@query(f"SELECT CAST(c AS BIGINT) AS tile_col, CAST(r AS BIGINT) AS tile_row, 16 AS zoom FROM range({int((AOI.west + 180) / 360 * 65536)}, {int((AOI.east + 180) / 360 * 65536) + 1}) a(c), range({int((AOI.south + 180) / 360 * 65536)}, {int((AOI.north + 180) / 360 * 65536) + 1}) b(r)")
def select_tiles_keyhole(spark, sf_dir):
    return tiles.select_tiles(spark, AOI, G.KEYHOLE, 16).orderBy("tile_row", "tile_col")


@query(V.with_sql(V.POINTS) + """SELECT DISTINCT CAST(floor((lon + 180.0) / 360.0 * 64) AS BIGINT) AS tile_col, CAST(floor((lat + 180.0) / 360.0 * 64) AS BIGINT) AS tile_row, 6 AS zoom FROM points""")
def tiles_of_points(spark, sf_dir):
    return tiles.tiles_of_points(V.points(spark, sf_dir), G.KEYHOLE, 6)


# -- coverage ----------------------------------------------------------------------
def _versions(spark, sf_dir):
    c, s = V.captures(spark, sf_dir), V.sources(spark, sf_dir)
    return c.join(s, "source_id")


_SHARE = f"""least(tile_col + 1.0, {_X[1]}::DOUBLE) - greatest(tile_col * 1.0::DOUBLE, {_X[0]}::DOUBLE)"""
_COVER = f"""inside AS (SELECT DISTINCT tile_col, tile_row, capture_date FROM captures WHERE tile_col BETWEEN {int(_X[0])} AND {int(_X[1])} AND tile_row BETWEEN {int(_Y[0])} AND {int(_Y[1])}),
shares AS (SELECT capture_date, count(*) AS n_tiles, sum(({_SHARE}) * (least(tile_row + 1.0, {_Y[1]}::DOUBLE) - greatest(tile_row * 1.0::DOUBLE, {_Y[0]}::DOUBLE))) / {(_X[1] - _X[0]) * (_Y[1] - _Y[0])}::DOUBLE AS coverage FROM inside GROUP BY 1)"""


@query(V.with_sql(V.CAPTURES, _COVER) + "SELECT capture_date AS date, round(coverage, 7) AS coverage, coverage >= 1 - 1e-7 AS complete, n_tiles FROM shares")
def availability_coverage(spark, sf_dir):
    out = coverage.coverage_by_date(_versions(spark, sf_dir), AOI, G.MERCATOR, V.LEVEL)
    return out.select("date", _r("coverage", 7).alias("coverage"), "complete", "n_tiles")


@query(V.with_sql(V.CAPTURES, _COVER) + "SELECT capture_date AS date, round(coverage, 7) AS coverage, n_tiles FROM shares WHERE capture_date BETWEEN DATE '1997-03-01' AND DATE '1999-06-30'")
def availability_bounds(spark, sf_dir):
    own = coverage.in_bounds(_versions(spark, sf_dir), "1997-03-01", "1999-06-30")
    return coverage.coverage_by_date(own, AOI, G.MERCATOR, V.LEVEL).select("date", _r("coverage", 7).alias("coverage"), "n_tiles")


_LISTS = ", ".join(f"coalesce(string_agg(DISTINCT CAST({p} AS VARCHAR), '|' ORDER BY CAST({p} AS VARCHAR)), '') AS {q}" for p, q in coverage.PROVENANCE)


@query(V.with_sql(V.CAPTURES, V.SOURCES) + f"""SELECT capture_date AS date, string_agg(DISTINCT provider, ', ' ORDER BY provider) AS providers, {_LISTS}
  FROM captures JOIN sources USING (source_id) WHERE tile_col BETWEEN {int(_X[0])} AND {int(_X[1])} AND tile_row BETWEEN {int(_Y[0])} AND {int(_Y[1])} GROUP BY 1""")
def availability_provenance_arrays(spark, sf_dir):
    out = coverage.coverage_by_date(_versions(spark, sf_dir), AOI, G.MERCATOR, V.LEVEL)
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), "|").alias(c)
    return out.select("date", "providers", *[text(q) for _, q in coverage.PROVENANCE])


_K = 1 << 16
_KB = [(v + 180) / 360 * _K for v in (AOI.west, AOI.south, AOI.east, AOI.north)]
_KY = lambda e: f"(asinh(tan(radians(({e}) / {float(_K)}::DOUBLE * 360.0 - 180.0))) / pi() / 2.0)"


@query(V.with_sql(V.CAPTURES) + f""", k AS (SELECT DISTINCT CAST({int(_KB[0])} + tile_col % 6 AS BIGINT) AS c, CAST({int(_KB[1])} + tile_row % 3 AS BIGINT) AS r, capture_date FROM captures),
o AS (SELECT capture_date, greatest(0.0, least(c + 1.0, {_KB[2]!r}::DOUBLE) - greatest(c * 1.0::DOUBLE, {_KB[0]!r}::DOUBLE)) AS w,
  least(r + 1.0, {_KB[3]!r}::DOUBLE) AS hi, greatest(r * 1.0::DOUBLE, {_KB[1]!r}::DOUBLE) AS lo FROM k
  WHERE c BETWEEN {int(_KB[0])} AND {int(_KB[2])} AND r BETWEEN {int(_KB[1])} AND {int(_KB[3])})
SELECT capture_date AS date, round(sum(w * (CASE WHEN hi > lo THEN {_KY('hi')} - {_KY('lo')} ELSE 0.0 END)) / {(_KB[2] - _KB[0]) * (G._lat_y(AOI.south) - G._lat_y(AOI.north))!r}::DOUBLE, 6) AS coverage, count(*) AS n_tiles FROM o GROUP BY 1""")
def availability_keyhole(spark, sf_dir):
    c = V.captures(spark, sf_dir)
    own = c.select((int(_KB[0]) + F.col("tile_col") % 6).cast("long").alias("tile_col"), (int(_KB[1]) + F.col("tile_row") % 3).cast("long").alias("tile_row"), "capture_date", F.lit("A").alias("provider"))
    return coverage.coverage_by_date(own, AOI, G.KEYHOLE, 16).select("date", _r("coverage", 6).alias("coverage"), "n_tiles")


# -- matching ----------------------------------------------------------------------
_TARGET = "1998-02-15"


def _nearest_sql(match: str) -> str:
    rule = {"closest": "TRUE", "before": f"capture_date IS NULL OR capture_date <= DATE '{_TARGET}'", "after": f"capture_date IS NULL OR capture_date >= DATE '{_TARGET}'", "exact": "capture_date = DATE '1998-02-01'"}[match]
    target = "1998-02-01" if match == "exact" else _TARGET
    return V.with_sql(V.CAPTURES, V.TILE_VERSIONS) + f"""SELECT tile_col, tile_row, zoom, capture_date, source_id FROM (SELECT *, row_number() OVER (PARTITION BY tile_col, tile_row, zoom
  ORDER BY capture_date IS NULL, abs(date_diff('day', DATE '{target}', capture_date)), capture_date, source_id) AS rk FROM tile_versions WHERE {rule}) q WHERE rk = 1"""


def _nearest(match: str):
    target = "1998-02-01" if match == "exact" else _TARGET

    def run(spark, sf_dir):
        return matching.nearest(V.tile_versions(spark, sf_dir), target, match, ties=("source_id",))

    run.__name__ = f"nearest_{match}"
    query(_nearest_sql(match))(run)


for _m in D.MATCHES:
    _nearest(_m)


@query(V.with_sql(V.CAPTURES, V.TILE_VERSIONS) + f"""SELECT tile_col, tile_row, capture_date, source_id, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tile_col, tile_row, zoom
  ORDER BY capture_date IS NULL, abs(date_diff('day', DATE '{_TARGET}', capture_date)), capture_date, source_id) AS rk FROM tile_versions) q""")
def ranked_candidates(spark, sf_dir):
    out = matching.ranked(V.tile_versions(spark, sf_dir), _TARGET, "closest", ties=("source_id",))
    return out.select("tile_col", "tile_row", "capture_date", "source_id", F.col("rank").cast("long").alias("rank"))


@query(V.with_sql(V.CAPTURES) + """, f AS (SELECT tile_col, tile_row, zoom, capture_date, source_id, min(object_id) AS object_id FROM captures GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tile_col, tile_row, zoom ORDER BY abs(date_diff('day', DATE '1998-02-15', capture_date)), capture_date, source_id) AS rk FROM f)
SELECT tile_col, tile_row, zoom, rk AS rank, object_id AS content, capture_date FROM (SELECT *, row_number() OVER (PARTITION BY tile_col, tile_row ORDER BY rk) AS n FROM r WHERE object_id % 3 = 0) q WHERE n = 1""")
def first_usable(spark, sf_dir):
    one = V.captures(spark, sf_dir).groupBy("tile_col", "tile_row", "zoom", "capture_date", "source_id").agg(F.min("object_id").alias("object_id"))
    rows = matching.ranked(one, _TARGET, "closest", ties=("source_id",)).withColumnRenamed("object_id", "content")
    out = matching.first_usable(rows, F.col("content") % 3 == 0)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(V.with_sql(V.CAPTURES) + f"""SELECT CAST(c AS BIGINT) AS tile_col, CAST(r AS BIGINT) AS tile_row, 17 AS zoom FROM range({int(_X[0])}, {int(_X[1]) + 1}) a(c), range({int(_Y[0])}, {int(_Y[1]) + 1}) b(r)
  WHERE NOT EXISTS (SELECT 1 FROM captures WHERE tile_col = c AND tile_row = r AND capture_date = DATE '2001-11-01')""")
def missing_tiles(spark, sf_dir):
    found = V.captures(spark, sf_dir).where("capture_date = date '2001-11-01'")
    return matching.missing_tiles(tiles.select_tiles(spark, AOI, G.MERCATOR, 17), found)


# -- releases ----------------------------------------------------------------------
@query(V.with_sql(V.RELEASES) + "SELECT * FROM releases")
def release_catalogue(spark, sf_dir):
    return releases.catalogue(V.releases(spark, sf_dir))


@query(V.with_sql(V.RELEASES) + "SELECT * FROM releases WHERE release_date <= DATE '1997-08-17' ORDER BY release_date DESC LIMIT 1")
def release_as_of(spark, sf_dir):
    return releases.as_of(V.releases(spark, sf_dir), "1997-08-17")


@query(V.with_sql(V.RELEASES) + "SELECT * FROM releases WHERE release_id = 'WB_1996_R05'")
def release_exact(spark, sf_dir):
    return releases.exact(V.releases(spark, sf_dir), "WB_1996_R05")


@query(V.with_sql(V.RELEASES) + """SELECT o.o_orderkey, r.release_id, r.release_date FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) - 20 AS day FROM orders) o
  LEFT JOIN releases r ON r.release_date = (SELECT max(release_date) FROM releases x WHERE x.release_date <= o.day)""")
def release_as_of_each(spark, sf_dir):
    o = V.read(spark, sf_dir, "orders").select("o_orderkey", F.date_sub(F.col("o_orderdate").cast("date"), 20).alias("day"))
    return releases.as_of_each(o, V.releases(spark, sf_dir), F.col("day")).select("o_orderkey", "release_id", "release_date")


_LISTING = "listing AS (SELECT DISTINCT c.capture_date, r.release_id, r.release_date FROM captures c JOIN releases r ON r.release_date >= c.capture_date AND r.release_date < c.capture_date + INTERVAL 4 MONTH)"


def _listing(spark, sf_dir):
    """Which releases list which dates: a date is listed in the four months from it on."""
    dates = V.captures(spark, sf_dir).select("capture_date").distinct()
    later = dates.select("capture_date", F.explode(F.expr("transform(sequence(0, 3), k -> add_months(capture_date, k))")).alias("release_date"))
    return later.join(V.releases(spark, sf_dir), "release_date")


@query(V.with_sql(V.CAPTURES, V.RELEASES, _LISTING) + "SELECT capture_date, min(release_id) AS release_id, min(release_date) AS release_date FROM listing GROUP BY 1")
def earliest_release_per_date(spark, sf_dir):
    return releases.earliest_per_date(_listing(spark, sf_dir))


@query(V.with_sql(V.CAPTURES, V.RELEASES) + """, i AS (SELECT DISTINCT r.release_id, c.object_id FROM captures c JOIN releases r ON r.release_date = c.capture_date)
SELECT release_id, object_id, CAST(floor((row_number() OVER (PARTITION BY release_id ORDER BY object_id) - 1) / 100) AS BIGINT) AS batch FROM i""")
def batch_ids(spark, sf_dir):
    c, r = V.captures(spark, sf_dir), V.releases(spark, sf_dir)
    return releases.batches(c.join(F.broadcast(r), c.capture_date == r.release_date))


# -- history -----------------------------------------------------------------------
_CARRIED = """carried AS (SELECT t.tile_col, t.tile_row, t.pos, r.release_id,
  CASE WHEN (t.tile_col + t.pos) % 13 <> 0 THEN CAST(date_trunc('year', r.release_date) AS DATE) END AS capture_date FROM tilemaps t JOIN releases r ON r.pos = t.pos WHERE t.has = 1)"""


def _carried(spark, sf_dir):
    t, r = V.tilemaps(spark, sf_dir).where("has = 1"), V.releases(spark, sf_dir).withColumn("pos", F.col("pos").cast("int"))
    day = F.when((F.col("tile_col") + F.col("pos")) % 13 != 0, F.trunc("release_date", "year"))
    return t.join(F.broadcast(r), "pos").select("tile_col", "tile_row", "pos", "release_id", day.alias("capture_date"))


@query(V.with_sql(V.CAPTURES, V.RELEASES, V.TILEMAPS, _CARRIED) + """SELECT tile_col, tile_row, pos, release_id, capture_date FROM (SELECT *, lead(capture_date) OVER (PARTITION BY tile_col, tile_row ORDER BY pos) AS nxt
  FROM carried WHERE capture_date IS NOT NULL) q WHERE nxt IS NULL OR nxt <> capture_date""")
def change_history(spark, sf_dir):
    return history.change_history(_carried(spark, sf_dir))


_CHAIN = """chain(tile_col, tile_row, pos, has, sel) AS (SELECT tile_col, tile_row, pos, has, sel FROM tilemaps WHERE pos = 1
  UNION ALL SELECT t.tile_col, t.tile_row, t.pos, t.has, t.sel FROM chain c JOIN tilemaps t ON t.tile_col = c.tile_col AND t.tile_row = c.tile_row AND t.pos = coalesce(c.sel, c.pos + 1))"""


@query(V.with_sql(V.CAPTURES, V.RELEASES, V.TILEMAPS, _CHAIN) + "SELECT tile_col, tile_row, pos, coalesce(sel, pos) AS effective FROM chain WHERE has = 1")
def skip_chain(spark, sf_dir):
    return history.skip_chain(V.tilemaps(spark, sf_dir))


@query(V.with_sql(V.CAPTURES, V.RELEASES, V.TILEMAPS, _CHAIN) + "SELECT * FROM releases WHERE pos IN (SELECT coalesce(sel, pos) FROM chain WHERE has = 1)")
def candidate_releases(spark, sf_dir):
    return history.candidate_releases(V.tilemaps(spark, sf_dir), V.releases(spark, sf_dir))


# -- mosaics -----------------------------------------------------------------------
MOSAIC_AOI = G.Box(-122.41, 37.783, -122.385, 37.796)
_F = lambda lon: (lon + 180.0) / 360.0
_M = (_F(MOSAIC_AOI.west), G._lat_y(MOSAIC_AOI.north), _F(MOSAIC_AOI.east), G._lat_y(MOSAIC_AOI.south))
_SRC = ", ".join(mosaic.SOURCE)


@query(V.with_sql(V.CAPTURES, V.RELEASES, V.SOURCES, V.FOOTPRINTS) + f""", one AS (SELECT release_id FROM releases WHERE release_date <= DATE '1997-08-17' ORDER BY release_date DESC LIMIT 1),
p AS (SELECT DISTINCT f.zoom, f.capture_date, f.release_id, {_SRC}, greatest((west + 180.0) / 360.0, {_M[0]!r}::DOUBLE) AS x0, greatest({_LAT_Y.format('north')}, {_M[1]!r}::DOUBLE) AS y0,
  least((east + 180.0) / 360.0, {_M[2]!r}::DOUBLE) AS x1, least({_LAT_Y.format('south')}, {_M[3]!r}::DOUBLE) AS y1, object_id FROM footprints f JOIN one USING (release_id) JOIN sources s USING (source_id)),
q AS (SELECT *, dense_rank() OVER (ORDER BY zoom, capture_date, release_id, {_SRC}) AS g FROM p WHERE x0 <= x1 AND y0 <= y1),
ys AS (SELECT g, y, lead(y) OVER (PARTITION BY g ORDER BY y) AS y2 FROM (SELECT g, y0 AS y FROM q UNION SELECT g, y1 FROM q) u),
xs AS (SELECT g, x, lead(x) OVER (PARTITION BY g ORDER BY x) AS x2 FROM (SELECT g, x0 AS x FROM q UNION SELECT g, x1 FROM q) u),
cell AS (SELECT ys.g, (y2 - y) * (x2 - x) AS a FROM ys JOIN xs ON ys.g = xs.g WHERE y2 IS NOT NULL AND x2 IS NOT NULL
  AND EXISTS (SELECT 1 FROM q WHERE q.g = ys.g AND q.x0 <= x AND q.x1 >= x2 AND q.y0 <= y AND q.y1 >= y2)),
area AS (SELECT g, sum(a) AS a FROM cell GROUP BY 1)
SELECT zoom, capture_date AS date, round(coalesce(any_value(area.a), 0) / {(_M[2] - _M[0]) * (_M[3] - _M[1])!r}::DOUBLE, 6) AS area_fraction, release_id, count(*) AS n_footprints, {_SRC}
FROM q LEFT JOIN area ON q.g = area.g GROUP BY q.g, zoom, capture_date, release_id, {_SRC}""")
def mosaic_as_of(spark, sf_dir):
    one = releases.as_of(V.releases(spark, sf_dir), "1997-08-17").select("release_id")
    f = V.footprints(spark, sf_dir).join(F.broadcast(one), "release_id").join(V.sources(spark, sf_dir), "source_id")
    return mosaic.seam_map(f, MOSAIC_AOI).withColumn("area_fraction", _r("area_fraction", 6))


# -- archive -----------------------------------------------------------------------
@query(V.with_sql(V.POINTS, _KEYED) + "SELECT c, r, 11 AS zoom, c AS archive_col, 4095 - r - 1024 AS archive_row FROM keyed")
def archive_address(spark, sf_dir):
    a = A.address(G.KEYHOLE, F.col("c"), F.col("r"), F.lit(12))
    return _keyhole_tiles(spark, sf_dir).select("c", "r", a["zoom"].alias("zoom"), a["column"].alias("archive_col"), a["row"].alias("archive_row"))


_PX17 = G.EQUATOR_METRES / _N


@query(V.with_sql(V.CAPTURES) + f"""SELECT capture_date, round(min(tile_col) * {_PX17}::DOUBLE - {G.EQUATOR_METRES / 2}::DOUBLE, 3) AS min_x, round({G.EQUATOR_METRES / 2}::DOUBLE - (max(tile_row) + 1) * {_PX17}::DOUBLE, 3) AS min_y,
  round((max(tile_col) + 1) * {_PX17}::DOUBLE - {G.EQUATOR_METRES / 2}::DOUBLE, 3) AS max_x, round({G.EQUATOR_METRES / 2}::DOUBLE - min(tile_row) * {_PX17}::DOUBLE, 3) AS max_y,
  CAST((max(tile_col) - min(tile_col) + 1) * 256 AS BIGINT) AS width, CAST((max(tile_row) - min(tile_row) + 1) * 256 AS BIGINT) AS height FROM captures GROUP BY 1""")
def archive_extent(spark, sf_dir):
    half = G.EQUATOR_METRES / 2
    a = V.captures(spark, sf_dir).groupBy("capture_date").agg(F.min("tile_col").alias("c0"), F.max("tile_col").alias("c1"), F.min("tile_row").alias("r0"), F.max("tile_row").alias("r1"))
    return a.select(
        "capture_date",
        _r(F.col("c0") * _PX17 - half, 3).alias("min_x"),
        _r(F.lit(half) - (F.col("r1") + 1) * _PX17, 3).alias("min_y"),
        _r((F.col("c1") + 1) * _PX17 - half, 3).alias("max_x"),
        _r(F.lit(half) - F.col("r0") * _PX17, 3).alias("max_y"),
        ((F.col("c1") - F.col("c0") + 1) * 256).cast("long").alias("width"),
        ((F.col("r1") - F.col("r0") + 1) * 256).cast("long").alias("height"),
    )


@query(V.with_sql(V.CAPTURES) + """, t AS (SELECT DISTINCT tile_col, tile_row FROM captures), k AS (SELECT CAST(unnest(range(0, 6)) AS INT) AS shift)
SELECT 17 - shift AS zoom, count(DISTINCT (tile_col >> shift, tile_row >> shift)) AS n_tiles FROM t, k GROUP BY 1""")
def overview_counts(spark, sf_dir):
    t = _tiles17(spark, sf_dir).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(5))))
    up = t.select((17 - F.col("shift")).alias("zoom"), F.expr("shiftright(tile_col, shift)").alias("c"), F.expr("shiftright(tile_row, shift)").alias("r")).distinct()
    return up.groupBy("zoom").agg(F.count("*").alias("n_tiles"))


# -- mosaics: counters and tags ------------------------------------------------------
@query(V.with_sql(V.CAPTURES, V.TILE_VERSIONS) + f""", w AS (SELECT CAST(c AS INT) AS tile_col, CAST(r AS INT) AS tile_row FROM range({int(_X[0])}, {int(_X[1]) + 1}) a(c), range({int(_Y[0])}, {int(_Y[1]) + 1}) b(r)),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_col, tile_row ORDER BY capture_date IS NULL, abs(date_diff('day', DATE '1995-01-01', capture_date)), capture_date, source_id) AS rk
  FROM tile_versions WHERE capture_date IS NULL OR capture_date <= DATE '1995-02-01') q WHERE rk = 1)
SELECT count(*) AS n_tiles, count(*) FILTER (n.tile_col IS NULL) AS n_missing, count(*) FILTER (n.tile_col IS NOT NULL AND capture_date IS NULL) AS n_undated,
  coalesce(string_agg(DISTINCT CAST(capture_date AS VARCHAR), ',' ORDER BY CAST(capture_date AS VARCHAR)), '') AS dates FROM w LEFT JOIN n USING (tile_col, tile_row)""")
def mosaic_tags(spark, sf_dir):
    want = tiles.select_tiles(spark, AOI, G.MERCATOR, 17)
    own = V.tile_versions(spark, sf_dir).where("capture_date is null or capture_date <= date '1995-02-01'")
    best = matching.nearest(own, "1995-01-01", "closest", ties=("source_id",)).withColumn("found", F.lit(True))
    rows = want.join(best, list(matching.TILE), "left")
    return rows.agg(
        F.count("*").alias("n_tiles"),
        F.count_if(F.col("found").isNull()).alias("n_missing"),
        F.count_if(F.col("found") & F.col("capture_date").isNull()).alias("n_undated"),
        F.array_join(F.array_sort(F.collect_set(F.col("capture_date").cast("string"))), ",").alias("dates"),
    )


# -- values ------------------------------------------------------------------------
@query("""SELECT o_orderkey, packed, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 28 + (CASE WHEN m <> 2 THEN 2 + CAST(m IN (1, 3, 5, 7, 8, 10, 12) AS INT) ELSE CAST(y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) AS INT) END)
  THEN make_date(y, m, d) END AS day FROM (SELECT *, packed >> 9 AS y, (packed >> 5) & 15 AS m, packed & 31 AS d FROM (SELECT o_orderkey, CAST(((1990 + o_orderkey % 40) << 9) + o_orderkey % 512 AS INT) AS packed FROM orders) a) b""")
def packed_date_decode(spark, sf_dir):
    k = F.col("o_orderkey")
    packed = (F.expr("shiftleft(cast(1990 + o_orderkey % 40 as int), 9)") + (k % 512)).cast("int")
    return V.read(spark, sf_dir, "orders").select("o_orderkey", packed.alias("packed")).withColumn("day", D.packed_date(F.col("packed")))


@query("""SELECT event_id, nullif(trim(CASE WHEN event_id % 3 = 0 THEN '  ' ELSE event_type END), '') AS label,
  CASE WHEN event_id % 5 <> 0 THEN round(value, 6) END AS metres, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN '3.7' ELSE CAST(user_id AS VARCHAR) END AS INT) AS level FROM events WHERE NOT (event_id % 4 = 0)
UNION ALL SELECT event_id, nullif(trim(CASE WHEN event_id % 3 = 0 THEN '  ' ELSE event_type END), ''), CASE WHEN event_id % 5 <> 0 THEN round(value, 6) END, NULL FROM events WHERE event_id % 4 = 0""")
def lenient_values(spark, sf_dir):
    e = V.read(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.lit("  ")).otherwise(F.col("event_type"))
    number = F.when(F.col("event_id") % 5 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    level = F.when(F.col("event_id") % 4 == 0, F.lit("3.7")).otherwise(F.col("user_id").cast("string"))
    return e.select("event_id", X.optional_text(text).alias("label"), _r(X.optional_float(number), 6).alias("metres"), X.optional_int(level).alias("level"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def lenient_dates(spark, sf_dir):
    o, k = V.read(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, iso).when(k == 1, F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string")).otherwise(F.lit("soon"))
    return o.select("o_orderkey", D.lenient_date(text).alias("day"))


@query("""SELECT s_suppkey, sha256('https://tiles.example/' || CAST(s_suppkey AS VARCHAR)) AS url_key,
  sha256('https://tiles.example/q' || chr(0) || 'f=json&id=' || CAST(s_suppkey AS VARCHAR)) AS form_key, 'f1-0' || CAST(s_suppkey % 4 AS VARCHAR) || '-i.' || CAST(s_suppkey AS VARCHAR) || '-' || lower(hex(1000000 + s_suppkey)) AS asset,
  CAST(least(13, 23 - s_suppkey % 24) AS INT) AS scale FROM supplier""")
def request_keys(spark, sf_dir):
    k = F.col("s_suppkey")
    t = k.cast("string")
    form = F.create_map(F.lit("id"), t, F.lit("f"), F.lit("json"))
    return V.read(spark, sf_dir, "supplier").select(
        "s_suppkey",
        X.cache_key(F.concat(F.lit("https://tiles.example/"), t)).alias("url_key"),
        X.cache_key(F.lit("https://tiles.example/q"), form).alias("form_key"),
        X.asset_key(F.concat(F.lit("0"), (k % 4).cast("string")), k, (1000000 + k)).alias("asset"),
        X.metadata_scale((k % 24).cast("int")).alias("scale"),
    )


@query(V.with_sql(V.SOURCES) + """SELECT source_id, '{"provider":' || coalesce('"' || source_provider || '"', 'null') || ',"description":' || coalesce('"' || source_description || '"', 'null') || ',"min_map_level":' || CAST(min_map_level AS VARCHAR) || '}' AS record FROM sources""")
def provenance_json(spark, sf_dir):
    rec = F.struct(F.col("source_provider").alias("provider"), F.col("source_description").alias("description"), "min_map_level")
    return V.sources(spark, sf_dir).select("source_id", X.provenance_json(rec).alias("record"))


_PAYLOADS = """payloads AS (SELECT user_id AS key, ts AS fetched_at, event_id, CAST(length(event_type) AS INT) AS size FROM events)"""


@query(V.with_sql(_PAYLOADS) + """SELECT key, fetched_at, event_id, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fetched_at DESC, event_id DESC) AS n FROM payloads) q WHERE n = 1 AND fetched_at >= TIMESTAMP '2024-01-29 00:00:00'""")
def cache_freshness(spark, sf_dir):
    e = V.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("fetched_at"), "event_id", F.length("event_type").alias("size"))
    return fresh(latest(e, ("event_id",)), "1 day", "2024-01-30 00:00:00")


# -- quadtree ----------------------------------------------------------------------

def _nodes(spark, sf_dir):
    """A node above every packet; about one in 29 has no epoch, and some are missing."""
    p = _keyhole_tiles(spark, sf_dir).select(F.explode(G.index_paths(F.col("path"))).alias("path")).distinct()
    digits = F.regexp_count("path", F.lit("[13]"))
    return p.where(digits % 7 != 6).select("path", F.when((digits * 3 + F.length("path")) % 11 == 0, 0).otherwise(1).alias("cache_node_epoch"))


@query(V.with_sql(V.POINTS, _KEYED) + """, hop AS (SELECT DISTINCT path, substr(path, 1, k) AS h FROM paths, (SELECT CAST(unnest([4, 8, 12]) AS BIGINT) AS k) q),
s AS (SELECT path, h, length(regexp_replace(h, '[02]', '', 'g')) AS d FROM hop)
SELECT path FROM s GROUP BY path HAVING bool_and(d % 7 <> 6 AND (d * 3 + length(h)) % 11 <> 0)""")
def quadtree_walk(spark, sf_dir):
    return quadtree.reachable(_keyhole_tiles(spark, sf_dir), _nodes(spark, sf_dir)).select("path")


@query(V.with_sql(V.POINTS, _KEYED) + """, n AS (SELECT path, CAST(c % 5 AS INT) AS k, CAST(r % 4 AS INT) AS im, CAST(c % 900 AS INT) AS z FROM paths),
e AS (SELECT path, im, z, CAST(unnest(range(0, k)) AS INT) AS i FROM n WHERE k > 0),
x AS (SELECT path, im, ((1990 + i) << 9) + (1 + (z + i) % 14 << 5) + 5 AS packed, i + 10 AS epoch, i % 3 AS provider FROM e)
SELECT path, CAST(make_date(packed >> 9, (packed >> 5) & 15, packed & 31) AS DATE) AS capture_date, provider, CASE WHEN provider <> 0 THEN epoch ELSE im + 100 END AS epoch FROM x WHERE (packed >> 5) & 15 <= 12 AND (provider <> 0 OR im <> 0)
UNION ALL SELECT path, NULL, 0, im + 100 FROM n WHERE k = 0 AND im <> 0""")
def quadtree_versions(spark, sf_dir):
    t = _keyhole_tiles(spark, sf_dir)
    k, im, z = (F.col("c") % 5).cast("int"), (F.col("r") % 4).cast("int"), (F.col("c") % 900).cast("int")
    entry = lambda i: F.struct(
        (F.shiftleft(1990 + i, 9) + F.shiftleft(1 + (z + i) % 14, 5) + 5).alias("date"), (i + 10).alias("epoch"), (i % 3).alias("provider")
    )
    dates = F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), entry))
    nodes = t.select("path", F.when(im != 0, im + 100).alias("imagery_epoch"), dates.alias("dates"))
    return quadtree.dated_versions(t.select("path"), nodes).select("path", "capture_date", "provider", "epoch")


@query(V.with_sql(V.CAPTURES, V.SOURCES) + """SELECT c.object_id, c.part_no, count(*) AS n, max(CASE WHEN s.source_id % 6 <> 0 THEN s.provider END) AS provider_name FROM captures c LEFT JOIN sources s ON c.source_id = s.source_id GROUP BY 1, 2""")
def provider_names(spark, sf_dir):
    p = V.sources(spark, sf_dir).select(F.col("source_id").alias("provider_id"), F.when(F.col("source_id") % 6 == 0, F.lit("")).otherwise(F.col("provider")).alias("copyright"))
    v = V.captures(spark, sf_dir).withColumnRenamed("source_id", "provider")
    return quadtree.with_copyright(v, p).groupBy("object_id", "part_no").agg(F.count("*").alias("n"), F.max("provider_name").alias("provider_name"))


# -- decoding ------------------------------------------------------------------------
_KEY = bytes((i * 37 + 11) % 256 for i in range(1016))


def _mask_sql(n: int) -> str:
    """The key byte at every place of a text of up to ``n`` bytes, as the format's rule gives it: the
    place starts at 16; after every 8 bytes it goes on by 16, and past the key's end it starts again 8 further in, modulo 24."""
    places, at, off = [], 16, 16
    for i in range(n):
        places.append(at)
        at += 1
        if at % 8 == 0:
            at += 16
        if at >= len(_KEY):
            off = (off + 8) % 24
            at = off
    return "[" + ", ".join(str(_KEY[p]) for p in places) + "]"


@query(f"""WITH k AS (SELECT {_mask_sql(64)} AS mask), e AS (SELECT event_id, substr(props, 1, 64) AS t FROM events WHERE props IS NOT NULL)
SELECT event_id, array_to_string([lpad(lower(to_hex(xor(ascii(t[i]), mask[i]))), 2, '0') FOR i IN range(1, length(t) + 1)], '') AS masked, CAST(length(t) AS INT) AS n FROM e, k""")
def xor_decode(spark, sf_dir):
    """The first 64 bytes of every text, masked once; the SQL has the key's bytes by the format's rule."""

    @F.pandas_udf("binary")
    def masked(body: pd.Series) -> pd.Series:
        return pd.Series([C.unmask(bytes(b), _KEY) for b in body])

    e = V.read(spark, sf_dir, "events").where("props is not null")
    return e.select("event_id", F.lower(F.hex(masked(F.encode(F.substring("props", 1, 64), "utf-8")))).alias("masked"), F.length(F.substring("props", 1, 64)).alias("n"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN NULL ELSE 'png' END AS image_format, CASE WHEN s_suppkey % 4 < 3 THEN CASE s_suppkey % 4 WHEN 0 THEN 256 ELSE 64 END END AS width, s_suppkey % 4 = 0 AS is_tile FROM supplier""")
def payload_inspect(spark, sf_dir):
    @F.pandas_udf("binary")
    def payload(k: pd.Series) -> pd.Series:
        image = {0: C.write_png(np.zeros((256, 256, 3), np.uint8)), 1: C.write_png(np.zeros((64, 64), np.uint8)), 2: C.write_png(np.zeros((64, 64, 3), np.uint8)), 3: b"no image"}
        return k.map(lambda x: image[x % 4])

    s = V.read(spark, sf_dir, "supplier").select("s_suppkey", payload("s_suppkey").alias("content")).withColumn("info", raster.inspect(F.col("content")))
    return s.select("s_suppkey", "info.image_format", "info.width", raster.is_tile(F.col("info")).alias("is_tile"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS path, n AS number, CASE n WHEN 0 THEN 3 ELSE 64 END AS children, CAST(s_suppkey % 100 + n AS INT) AS cache_node_epoch, CASE n WHEN 0 THEN 0 ELSE 1 END AS n_layers
FROM supplier, (SELECT CAST(unnest([0, 1, 86]) AS INT) AS n) q WHERE s_suppkey % 5 <> 0""")
def packet_decode(spark, sf_dir):
    @F.pandas_udf("binary")
    def packet(k: pd.Series) -> pd.Series:
        make = lambda x: C.deflate(C.build_packet([(3, x % 100, 0), (64, x % 100 + 1, 7), (64, x % 100 + 86, 8)], epoch=2))
        return k.map(lambda x: C.unmask(make(x), _KEY) if x % 5 else b"damaged")

    s = V.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), packet("s_suppkey").alias("body"))
    return raster.packets(s, _KEY).select("path", "number", "children", "cache_node_epoch", F.size("layers").alias("n_layers"))


@query(V.with_sql(V.RELEASES) + """SELECT row_number() OVER (ORDER BY pos) AS pos, CAST(1000 + pos AS INT) AS layer_id, release_id, release_date, 'World Imagery (Wayback ' || CAST(release_date AS VARCHAR) || ')' AS title,
  CASE WHEN pos % 2 = 0 THEN 'set ' || CAST(pos AS VARCHAR) ELSE 'default028mm' END AS matrix_set FROM releases WHERE pos % 11 <> 0 AND pos % 9 <> 0 AND pos % 8 <> 0 AND pos % 7 <> 0 AND pos % 10 <> 3""")
def capabilities_parse(spark, sf_dir):
    """A document with layers of every kind that is left out: without a date, the mark, a whole number, an address or an identifier."""
    r, pos = V.releases(spark, sf_dir), F.col("pos")
    title = F.concat(F.lit(" World Imagery (Wayback "), F.when(pos % 11 == 0, F.lit("undated")).otherwise(F.col("release_date").cast("string")), F.lit(")\n"))
    mark = F.when(pos % 9 == 0, F.lit("Other_Imagery")).otherwise(F.lit("World_Imagery"))
    number = F.when(pos % 8 == 0, F.lit("x7")).otherwise((1000 + pos).cast("string"))
    kind = F.when(pos % 7 == 0, F.lit("FeatureServer")).otherwise(F.lit("MapServer"))
    url = F.concat(F.lit("https://t/"), mark, F.lit("/"), kind, F.lit("/tile/"), number, F.lit("/{TileMatrix}"))
    name = F.when(pos % 10 == 3, F.lit("")).otherwise(F.concat(F.lit("<ows:Identifier>"), F.col("release_id"), F.lit("</ows:Identifier>")))
    sets = F.when(pos % 2 == 0, F.concat(F.lit("<TileMatrixSetLink><TileMatrixSet>set "), pos.cast("string"), F.lit("</TileMatrixSet></TileMatrixSetLink>"))).otherwise(F.lit(""))
    layer = F.concat(F.lit("<Layer><ows:Title>"), title, F.lit("</ows:Title>"), name, F.lit('<ResourceURL template="'), url, F.lit('"/>'), sets, F.lit("</Layer>"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", layer.alias("x")))), lambda s: s["x"]), "")
    body = F.concat(F.lit('<Capabilities xmlns:ows="http://o"><Contents>'), every, F.lit("</Contents></Capabilities>"))
    return catalogue.releases(r.agg(body.alias("body"))).select("pos", "layer_id", "release_id", "release_date", "title", "matrix_set")


@query(V.with_sql(V.CAPTURES, V.RELEASES, V.TILEMAPS) + "SELECT pos, tile_col, tile_row, has, sel FROM tilemaps")
def tilemap_parse(spark, sf_dir):
    t = V.tilemaps(spark, sf_dir)
    body = F.to_json(F.struct(F.array("has").alias("data"), F.when(F.col("sel").isNotNull(), F.array("sel")).alias("select")))
    return catalogue.tilemaps(t.select("pos", "tile_col", "tile_row", body.alias("body"))).select("pos", "tile_col", "tile_row", "has", "sel")


@query(V.with_sql(V.CAPTURES, _COVER) + "SELECT capture_date AS date, round(coverage, 5) AS coverage FROM shares")
def polygon_coverage(spark, sf_dir):
    area = Y.to_wkb([Y.box(AOI.west, AOI.south, AOI.east, AOI.north)])
    own = V.captures(spark, sf_dir).where(tiles.in_range(AOI, G.MERCATOR, 17, F.col("tile_col"), F.col("tile_row")))
    own = own.select("capture_date", "tile_col", "tile_row").distinct()
    b = G.bounds(G.MERCATOR, F.col("tile_col"), F.col("tile_row"), 17)
    geo = own.select("capture_date", polygons.box_wkb(b["west"], b["south"], b["east"], b["north"]).alias("geom"))
    return polygons.clipped_union(geo, area, ["capture_date"]).select(F.col("capture_date").alias("date"), _r("area_fraction", 5).alias("coverage"))


@query("""WITH a AS (SELECT table_name || '.' || column_name AS field, data_type AS kind FROM (VALUES ('releases', 'pos', 'long'), ('releases', 'title', 'string'), ('tiles', 'zoom', 'int')) t(table_name, column_name, data_type)),
b AS (SELECT table_name || '.' || column_name AS field, data_type AS kind FROM (VALUES ('releases', 'pos', 'int'), ('tiles', 'zoom', 'int'), ('tiles', 'col', 'long')) t(table_name, column_name, data_type))
SELECT coalesce(a.field, b.field) AS field, a.kind AS old_kind, b.kind AS new_kind, CASE WHEN a.kind IS NULL THEN 'added' WHEN b.kind IS NULL THEN 'removed' ELSE 'changed' END AS change,
  a.kind IS NULL AS compatible FROM a FULL JOIN b ON a.field = b.field WHERE a.kind IS DISTINCT FROM b.kind""")
def schema_changes(spark, sf_dir):
    make = lambda rows: spark.createDataFrame([(f"{t}.{c}", k) for t, c, k in rows], "field string, kind string")
    old = make([("releases", "pos", "long"), ("releases", "title", "string"), ("tiles", "zoom", "int")])
    return catalogue.schema_changes(old, make([("releases", "pos", "int"), ("tiles", "zoom", "int"), ("tiles", "col", "long")]))

from . import more_queries  # noqa: E402, F401  registers its queries
