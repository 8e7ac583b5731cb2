"""Further queries: payloads and decoding from literal bytes, point metadata, addresses, limits and states.

Where bytes are read, they are literals (fixed values) that other tools have written,
so that no query reads what its own module wrote.
"""

from __future__ import annotations

import base64
import math
import re

import pandas as pd
from pyspark.sql import functions as F

from ..functions import archive as A
from ..functions import geometry as Y
from ..functions import grids as G
from ..functions import values as X
from ..functions.jpeg import read_jpeg
from ..operators import coverage, matching, metadata, polygons, quadtree, raster, releases, tiles
from ..operators.history import skip_chain
from ..sources import catalogue, listing
from ..sources.payloads import attach, keys_to_fetch, kind_of_store
from ..streaming import controller
from . import views as V
from .queries import _M, AOI, MOSAIC_AOI, _LAT_Y, query
from .requests import Catalog

_R9 = "round({0}, 9)"


def _r(c, digits: int = 9):
    return F.round(c, digits)


# -- point metadata ------------------------------------------------------------------
#: What each release says at the centre of each tile: some answers are empty, some undated.
_ANSWERS = """said AS (SELECT t.tile_col, t.tile_row, r.pos, CASE WHEN (t.tile_col + r.pos) % 13 <> 0 THEN CAST(date_trunc('year', r.release_date) AS DATE) END AS capture_date,
  CASE WHEN r.pos % 4 <> 0 THEN 'Provider ' || CAST(r.pos % 5 AS VARCHAR) END AS provider, CASE WHEN r.pos % 3 <> 0 THEN (r.pos % 8) * 0.25::DOUBLE END AS resolution_m,
  CAST(r.pos % 6 AS INT) AS min_map_level, (t.tile_row + r.pos) % 17 <> 0 AS answered FROM tiles t CROSS JOIN releases r)"""


def _answers(spark, sf_dir):
    grid = V.captures(spark, sf_dir).select("tile_col", "tile_row").distinct()
    r = V.releases(spark, sf_dir).withColumn("pos", F.col("pos").cast("int"))
    every = grid.join(F.broadcast(r))  # 128 tiles and one release a month
    day = F.when((F.col("tile_col") + F.col("pos")) % 13 != 0, (F.unix_date(F.trunc("release_date", "year")).cast("long") * 86_400_000).cast("string"))
    name = F.when(F.col("pos") % 4 != 0, F.concat(F.lit(" Provider "), (F.col("pos") % 5).cast("string"), F.lit(" "))).otherwise(F.lit("  "))
    size = F.when(F.col("pos") % 3 != 0, ((F.col("pos") % 8) * F.lit(0.25)).cast("string")).otherwise(F.lit("NaN"))
    one = F.struct(F.struct(day.alias("SRC_DATE2"), name.alias("NICE_NAME"), size.alias("SRC_RES"), (F.col("pos") % 6).cast("string").alias("MinMapLevel")).alias("attributes"))
    body = F.when((F.col("tile_row") + F.col("pos")) % 17 != 0, F.to_json(F.struct(F.array(one).alias("features")))).when(F.col("pos") % 2 == 0, F.lit('{"features":[]}')).otherwise(F.lit("<html>busy</html>"))
    return every.select("tile_col", "tile_row", "pos", body.alias("body"))


@query(V.with_sql(V.CAPTURES, V.RELEASES, V.TILEMAPS, _ANSWERS) + "SELECT tile_col, tile_row, CAST(pos AS INT) AS pos, capture_date, provider, resolution_m, min_map_level FROM said WHERE answered AND capture_date IS NOT NULL")
def point_metadata(spark, sf_dir):
    return metadata.point_metadata(_answers(spark, sf_dir)).select("tile_col", "tile_row", "pos", "capture_date", "source.provider", "source.resolution_m", "source.min_map_level")


_CHAIN = """chain(tile_col, tile_row, pos, has, sel) AS (SELECT tile_col, tile_row, pos, has, sel FROM tilemaps WHERE pos = 1
  UNION ALL SELECT t.tile_col, t.tile_row, t.pos, t.has, t.sel FROM chain c JOIN tilemaps t ON t.tile_col = c.tile_col AND t.tile_row = c.tile_row AND t.pos = coalesce(c.sel, c.pos + 1))"""


@query(V.with_sql(V.CAPTURES, V.RELEASES, V.TILEMAPS, _ANSWERS, _CHAIN) + """, looked AS (SELECT tile_col, tile_row, pos, coalesce(sel, pos) AS effective FROM chain WHERE has = 1),
dated AS (SELECT l.*, s.capture_date, s.provider, lead(s.capture_date) OVER (PARTITION BY l.tile_col, l.tile_row ORDER BY l.pos) AS nxt
  FROM looked l JOIN said s ON l.tile_col = s.tile_col AND l.tile_row = s.tile_row AND l.effective = s.pos WHERE s.answered AND s.capture_date IS NOT NULL)
SELECT tile_col, tile_row, pos, effective, capture_date, provider FROM dated WHERE nxt IS NULL OR nxt <> capture_date""")
def dated_tiles(spark, sf_dir):
    out = metadata.dated_tiles(V.tilemaps(spark, sf_dir), metadata.point_metadata(_answers(spark, sf_dir)))
    return out.select("tile_col", "tile_row", "pos", "effective", "capture_date", "source.provider")


@query(V.with_sql(V.CAPTURES, V.RELEASES, V.TILEMAPS, _ANSWERS) + """SELECT CAST(t.pos AS INT) AS pos, t.tile_col, t.tile_row, s.capture_date, s.provider FROM tilemaps t
  LEFT JOIN said s ON s.tile_col = t.tile_col AND s.tile_row = t.tile_row AND s.pos = t.pos AND s.answered AND s.capture_date IS NOT NULL WHERE t.pos = 3""")
def tiles_at_release(spark, sf_dir):
    """One exact release: tiles without an answer stay, undated."""
    own = V.tilemaps(spark, sf_dir).where("pos = 3").select("pos", "tile_col", "tile_row")
    said = metadata.point_metadata(_answers(spark, sf_dir).where("pos = 3"))
    return metadata.with_metadata(own, said, ["tile_col", "tile_row", "pos"], required=False).select("pos", "tile_col", "tile_row", "capture_date", "source.provider")


@query(V.with_sql(V.CAPTURES) + "SELECT tile_col, tile_row, CAST(NULL AS DATE) AS capture_date, count(*) AS n FROM captures GROUP BY 1, 2")
def tiles_without_metadata(spark, sf_dir):
    return metadata.undated_if_not_asked(V.captures(spark, sf_dir), False).groupBy("tile_col", "tile_row", "capture_date").agg(F.count("*").alias("n"))


_LISTED = """listed AS (SELECT f.*, r.release_date FROM footprints f JOIN releases r USING (release_id)),
first AS (SELECT capture_date, min_by(release_id, (release_date, release_id)) AS release_id FROM listed GROUP BY 1)"""
_TITLED = "'Wayback ' || substr(release_id, 4, 4)"


def _chosen(spark, sf_dir):
    own, r = V.footprints(spark, sf_dir), V.releases(spark, sf_dir)
    first = releases.earliest_per_date(own.join(r.select("release_id", "release_date"), "release_id").select("capture_date", "release_id", "release_date"))
    return own.join(first.select("capture_date", "release_id"), ["capture_date", "release_id"], "left_semi")


@query(V.with_sql(V.CAPTURES, V.RELEASES, V.FOOTPRINTS, _LISTED) + "SELECT f.release_id, f.object_id, f.zoom, f.capture_date FROM listed f JOIN first USING (capture_date, release_id)")
def footprints_of_earliest_release(spark, sf_dir):
    return _chosen(spark, sf_dir).select("release_id", "object_id", "zoom", "capture_date")


@query(V.with_sql(V.CAPTURES, V.RELEASES, V.FOOTPRINTS, _LISTED) + f"SELECT capture_date, string_agg(DISTINCT {_TITLED}, ', ' ORDER BY {_TITLED}) AS titles FROM listed f JOIN first USING (capture_date, release_id) GROUP BY 1")
def titles_per_date(spark, sf_dir):
    r = V.releases(spark, sf_dir).withColumn("title", F.concat(F.lit("Wayback "), F.substring("release_id", 4, 4)))
    return metadata.titles_by_date(_chosen(spark, sf_dir), r)


@query(V.with_sql(V.CAPTURES, V.RELEASES) + "SELECT c.capture_date, count(*) AS n FROM captures c JOIN releases r ON r.release_date = c.capture_date WHERE c.capture_date >= DATE '1997-03-01' AND r.release_date >= DATE '1997-03-01' GROUP BY 1")
def releases_from_a_date_on(spark, sf_dir):
    """Releases before the earliest date asked for can't show it, so they are pruned."""
    r = V.releases(spark, sf_dir).where("release_date >= date '1997-03-01'")
    own = coverage.in_bounds(V.captures(spark, sf_dir), "1997-03-01", None)
    return own.join(F.broadcast(r), own.capture_date == r.release_date).groupBy("capture_date").agg(F.count("*").alias("n"))


_RECORD = """'{"provider":' || coalesce('"' || source_provider || '"', 'null') || ',"description":' || coalesce('"' || source_description || '"', 'null') || ',"max_map_level":' || CAST(max_map_level AS VARCHAR) || '}'"""


@query(V.with_sql(V.CAPTURES, V.SOURCES) + f"SELECT tile_row, '[' || string_agg(DISTINCT {_RECORD}, ',' ORDER BY {_RECORD}) || ']' AS sources FROM captures JOIN sources USING (source_id) GROUP BY 1")
def source_records(spark, sf_dir):
    s = V.sources(spark, sf_dir).select("source_id", F.struct(F.col("source_provider").alias("provider"), F.col("source_description").alias("description"), "max_map_level").alias("source"))
    own = V.captures(spark, sf_dir).select("tile_row", "source_id").distinct().join(s, "source_id")
    return own.groupBy("tile_row").agg(X.sources_json(F.col("source")).alias("sources"))


# -- addresses and sizes -------------------------------------------------------------
@query("""SELECT s_suppkey, 'https://m.example/' || CAST(s_suppkey AS VARCHAR) || '/MapServer/' || CAST(least(13, 23 - s_suppkey % 24) AS VARCHAR) || '/query' AS metadata_url,
  'https://kh.google.com/flatfile?q2-0' || CAST(s_suppkey % 4 AS VARCHAR) || '-q.' || CAST(s_suppkey AS VARCHAR) AS packet_url,
  'https://khmdb.google.com/flatfile?db=tm&qp-0' || CAST(s_suppkey % 4 AS VARCHAR) || '-q.' || CAST(s_suppkey AS VARCHAR) AS dated_packet_url,
  'https://khmdb.google.com/dbRoot.v5?&hl=en&gl=us&output=proto' AS root_url, 'https://khmdb.google.com/dbRoot.v5?db=tm&hl=en&gl=us&output=proto' AS dated_root_url,
  'f=json&where=id+%3D+' || CAST(s_suppkey AS VARCHAR) AS fields, 'https://m.example/tilemap/' || CAST(s_suppkey AS VARCHAR) || '/17/2/3' AS tilemap_url, 'https://t.example/default/17/2/' || CAST(s_suppkey AS VARCHAR) AS tile_url FROM supplier""")
def request_urls(spark, sf_dir):
    k = F.col("s_suppkey")
    path = F.concat(F.lit("0"), (k % 4).cast("string"))
    level, row = F.lit(17), F.lit(2)
    return V.read(spark, sf_dir, "supplier").select(
        "s_suppkey",
        X.metadata_query_url(F.lit("https://m.example"), k, (k % 24).cast("int")).alias("metadata_url"),
        X.packet_url(path, k).alias("packet_url"),
        X.packet_url(path, k, "tm").alias("dated_packet_url"),
        F.lit(X.root_url()).alias("root_url"),
        F.lit(X.root_url("tm")).alias("dated_root_url"),
        X.query_string({"f": F.lit("json"), "where": F.concat(F.lit("id = "), k.cast("string"))}).alias("fields"),
        X.tilemap_url(F.lit("https://m.example"), k, level, row, F.lit(3)).alias("tilemap_url"),
        X.tile_url(F.lit("https://t.example/{TileMatrixSet}/{TileMatrix}/{TileRow}/{TileCol}"), F.lit("default"), level, row, k).alias("tile_url"),
    )


_EQ = f"{G.EQUATOR_METRES!r}::DOUBLE"


@query(V.with_sql(V.POINTS) + f"""SELECT l_orderkey, l_linenumber, round(lon / 360.0 * {_EQ}, 3) AS xmin, round(asinh(tan(radians(lat))) / (2 * pi()) * {_EQ}, 3) AS ymin,
  round((lon + 0.01) / 360.0 * {_EQ}, 3) AS xmax, round(asinh(tan(radians(lat + 0.01))) / (2 * pi()) * {_EQ}, 3) AS ymax FROM points WHERE lat < 84""")
def envelope_in_metres(spark, sf_dir):
    p = V.points(spark, sf_dir).where("lat < 84")
    e = G.envelope(F.col("lon"), F.col("lat"), F.col("lon") + 0.01, F.col("lat") + 0.01)
    return p.select("l_orderkey", "l_linenumber", *[_r(v, 3).alias(k) for k, v in e.items()])


@query(f"""SELECT z AS zoom, round({_EQ} / (256.0 * (1::BIGINT << z)), 9) AS pixel, round({_EQ} / (256.0 * (1::BIGINT << z)) / 2, 9) AS offset_m,
  CAST(greatest(0, ceil(-log10({_EQ} / (256.0 * (1::BIGINT << z)) / 10))) AS INT) AS decimals, round(360.0 / (256.0 * (1::BIGINT << z)), 12) AS degrees
FROM (SELECT DISTINCT CAST(p_size % 23 AS INT) AS z FROM part) q""")
def pixel_sizes(spark, sf_dir):
    z = V.read(spark, sf_dir, "part").select((F.col("p_size") % 23).cast("int").alias("zoom")).distinct()
    offset, decimals = X.generalisation(F.col("zoom"))
    return z.select("zoom", _r(G.pixel_size(G.MERCATOR, F.col("zoom")), 9).alias("pixel"), _r(offset, 9).alias("offset_m"), decimals.alias("decimals"), _r(G.pixel_size(G.KEYHOLE, F.col("zoom")), 12).alias("degrees"))


@query(f"""SELECT z AS level, 256 * (1::BIGINT << z) AS width, 256 * (1::BIGINT << z) AS height, round({_EQ} / 2 * -1, 3) AS x, round({_EQ} / (256.0 * (1::BIGINT << z)), 12) AS pixel, 'EPSG:3857' AS crs FROM (SELECT unnest(range(0, 20)) AS z) q
UNION ALL SELECT z, 256 * (1::BIGINT << z), 128 * (1::BIGINT << z), -180.0, round(360.0 / (256.0 * (1::BIGINT << z)), 12), 'EPSG:4326' FROM (SELECT unnest(range(2, 20)) AS z) q""")
def archive_matrices(spark, sf_dir):
    rows = [(z, m["width"], m["height"], round(m["x"], 3), round(m["pixel"], 12), m["crs"]) for s, low in ((G.MERCATOR, 0), (G.KEYHOLE, 2)) for z in range(low, 20) for m in [A.matrix(s, z)]]
    return spark.createDataFrame(rows, "level long, width long, height long, x double, pixel double, crs string")


@query("""WITH s AS (SELECT DISTINCT p_size * 37 AS width, p_size * 20 AS height, p_size % 12 AS zoom FROM part),
f AS (SELECT *, unnest(range(1, zoom + 1)) AS k FROM s),
h AS (SELECT *, greatest(1, ceil(width / (1 << k))) AS w, greatest(1, ceil(height / (1 << k))) AS h, greatest(1, ceil(width / (1 << (k - 1)))) AS w1, greatest(1, ceil(height / (1 << (k - 1)))) AS h1 FROM f)
SELECT width, height, zoom, string_agg(CAST(1 << k AS VARCHAR), ',' ORDER BY k) AS factors FROM h WHERE k = 1 OR ((w <> w1 OR h <> h1) AND (w1 > 1 OR h1 > 1)) GROUP BY 1, 2, 3""")
def overview_factors(spark, sf_dir):
    s = V.read(spark, sf_dir, "part").select((F.col("p_size") * 37).alias("width"), (F.col("p_size") * 20).alias("height"), (F.col("p_size") % 12).alias("zoom")).distinct()

    @F.pandas_udf("string")
    def factors(width: pd.Series, height: pd.Series, zoom: pd.Series) -> pd.Series:
        return pd.Series([",".join(map(str, A.overview_factors(int(w), int(h), int(z)))) for w, h, z in zip(width, height, zoom)])

    return s.where("zoom > 0").select("width", "height", "zoom", factors("width", "height", "zoom").alias("factors"))


# -- payloads and pages --------------------------------------------------------------
@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'body ' || CAST(o_orderkey % 7 AS VARCHAR) END AS body FROM orders""")
def payloads_attached(spark, sf_dir):
    rows = V.read(spark, sf_dir, "orders").select("o_orderkey", X.cache_key(F.concat(F.lit("https://t/"), F.col("o_orderkey").cast("string"))).alias("key"))
    kept = rows.where("o_orderkey % 3 <> 0").select("key", F.concat(F.lit("body "), (F.col("o_orderkey") % 7).cast("string")).alias("body"))
    return attach(rows, kept).select("o_orderkey", "body")


@query("""WITH p AS (SELECT CAST(s_suppkey AS INT) AS k FROM supplier), f AS (SELECT k, unnest(range(0, 3)) AS i FROM p WHERE k % 5 <> 0)
SELECT 'R' || CAST(k AS VARCHAR) AS release_id, CAST(k * 10 + i AS BIGINT) AS object_id, DATE '2001-01-01' + CAST(k AS INT) AS capture_date, CASE WHEN i <> 1 THEN 'N' || CAST(i AS VARCHAR) END AS provider, k % 3 <> 0 AS complete FROM f WHERE NOT (i = 2 AND k % 2 = 0)
UNION ALL SELECT 'R' || CAST(k AS VARCHAR), NULL, NULL, NULL, false FROM p WHERE k % 5 = 0""")
def footprint_pages(spark, sf_dir):
    """Recorded pages: some cut short, some features without a date, some pages in error."""
    k = F.col("s_suppkey").cast("int")
    day = lambda i: F.when((F.lit(i) != 2) | (k % 2 != 0), F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), k), "yyyy-MM-dd"))
    feature = lambda i: F.struct(F.struct((k * 10 + i).cast("string").alias("OBJECTID"), day(i).alias("SRC_DATE2"), F.lit(f"N{i}" if i != 1 else " ").alias("NICE_NAME")).alias("attributes"))
    page = F.to_json(F.struct((k % 3 == 0).alias("exceededTransferLimit"), F.array(*[feature(i) for i in range(3)]).alias("features")))
    body = F.when(k % 5 != 0, page).when(k % 2 == 0, F.lit('{"error":{"code":400}}')).otherwise(F.lit("no json"))
    pages = V.read(spark, sf_dir, "supplier").select(F.concat(F.lit("R"), k.cast("string")).alias("release_id"), body.alias("body"))
    return catalogue.footprint_pages(pages).select("release_id", "object_id", "capture_date", "source.provider", "complete")


# -- images --------------------------------------------------------------------------
# Fixed values, written by another encoder: 32 by 16 pixels, half of one colour and half of another.
_JPEG = (
    "/9j/4AAQSkZJRgABAgAAAQABAAD/2wBDAAgGBgcGBQgHBwcJCQgKDBQNDAsLDBkSEw8UHRofHh0aHBwgJC4nICIsIxwcKDcpLDAxNDQ0Hyc5PTgyPC4zNDL/2wBDAQkJCQwLDBgNDRgyIRwhMjIyMjIyMjIyMjIy"
    "MjIyMjIyMjIyMjIyMjIyMjIyMjIyMjIyMjIyMjIyMjIyMjIyMjL/wAARCAAQACADASIAAhEBAxEB/8QAHwAAAQUBAQEBAQEAAAAAAAAAAAECAwQFBgcICQoL/8QAtRAAAgEDAwIEAwUFBAQAAAF9AQIDAAQRBRIh"
    "MUEGE1FhByJxFDKBkaEII0KxwRVS0fAkM2JyggkKFhcYGRolJicoKSo0NTY3ODk6Q0RFRkdISUpTVFVWV1hZWmNkZWZnaGlqc3R1dnd4eXqDhIWGh4iJipKTlJWWl5iZmqKjpKWmp6ipqrKztLW2t7i5usLDxMXG"
    "x8jJytLT1NXW19jZ2uHi4+Tl5ufo6erx8vP09fb3+Pn6/8QAHwEAAwEBAQEBAQEBAQAAAAAAAAECAwQFBgcICQoL/8QAtREAAgECBAQDBAcFBAQAAQJ3AAECAxEEBSExBhJBUQdhcRMiMoEIFEKRobHBCSMzUvAV"
    "YnLRChYkNOEl8RcYGRomJygpKjU2Nzg5OkNERUZHSElKU1RVVldYWVpjZGVmZ2hpanN0dXZ3eHl6goOEhYaHiImKkpOUlZaXmJmaoqOkpaanqKmqsrO0tba3uLm6wsPExcbHyMnK0tPU1dbX2Nna4uPk5ebn6Onq"
    "8vP09fb3+Pn6/9oADAMBAAIRAxEAPwDHoooryTmNiiiiv0Q+KP/Z"
)
_TILE = (
    "/9j/4AAQSkZJRgABAgAAAQABAAD/2wBDAAgGBgcGBQgHBwcJCQgKDBQNDAsLDBkSEw8UHRofHh0aHBwgJC4nICIsIxwcKDcpLDAxNDQ0Hyc5PTgyPC4zNDL/2wBDAQkJCQwLDBgNDRgyIRwhMjIyMjIyMjIyMjIy"
    "MjIyMjIyMjIyMjIyMjIyMjIyMjIyMjIyMjIyMjIyMjIyMjIyMjL/wAARCAEAAQADASIAAhEBAxEB/8QAHwAAAQUBAQEBAQEAAAAAAAAAAAECAwQFBgcICQoL/8QAtRAAAgEDAwIEAwUFBAQAAAF9AQIDAAQRBRIh"
    "MUEGE1FhByJxFDKBkaEII0KxwRVS0fAkM2JyggkKFhcYGRolJicoKSo0NTY3ODk6Q0RFRkdISUpTVFVWV1hZWmNkZWZnaGlqc3R1dnd4eXqDhIWGh4iJipKTlJWWl5iZmqKjpKWmp6ipqrKztLW2t7i5usLDxMXG"
    "x8jJytLT1NXW19jZ2uHi4+Tl5ufo6erx8vP09fb3+Pn6/8QAHwEAAwEBAQEBAQEBAQAAAAAAAAECAwQFBgcICQoL/8QAtREAAgECBAQDBAcFBAQAAQJ3AAECAxEEBSExBhJBUQdhcRMiMoEIFEKRobHBCSMzUvAV"
    "YnLRChYkNOEl8RcYGRomJygpKjU2Nzg5OkNERUZHSElKU1RVVldYWVpjZGVmZ2hpanN0dXZ3eHl6goOEhYaHiImKkpOUlZaXmJmaoqOkpaanqKmqsrO0tba3uLm6wsPExcbHyMnK0tPU1dbX2Nna4uPk5ebn6Onq"
    "8vP09fb3+Pn6/9oADAMBAAIRAxEAPwDHoooryTmCiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooo"
    "oAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooo"
    "oAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooo"
    "oAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooo"
    "oAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooo"
    "oAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooo"
    "oAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooo"
    "oAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooo"
    "oAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKACiiigAooooAKKKKAP/9k="
)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 3 AND s_suppkey % 3 <> 2 THEN 32 END AS width, CASE WHEN s_suppkey % 4 <> 3 AND s_suppkey % 3 <> 2 THEN 16 END AS height,
  CASE WHEN s_suppkey % 4 <> 3 AND s_suppkey % 3 <> 2 THEN '90,120,60' END AS "left", CASE WHEN s_suppkey % 4 <> 3 AND s_suppkey % 3 <> 2 THEN '30,160,220' END AS "right" FROM supplier""")
def jpeg_decode(spark, sf_dir):
    """Every third payload is cut short and every fourth is no image."""
    body = F.lit(base64.b64decode(_JPEG))
    k = F.col("s_suppkey")
    cut = F.when(k % 4 == 3, F.encode(F.lit("<html>"), "utf-8")).when(k % 3 == 2, F.substring(body, 1, 300)).otherwise(body)

    @F.pandas_udf("width int, height int, left string, right string")
    def read(data: pd.Series) -> pd.DataFrame:
        out = []
        for d in data:
            px = read_jpeg(bytes(d))
            out.append((None,) * 4 if px is None else (px.shape[1], px.shape[0], ",".join(map(str, px[4, 2].tolist())), ",".join(map(str, px[4, 26].tolist()))))
        return pd.DataFrame(out, columns=["width", "height", "left", "right"]).astype({"width": "Int32", "height": "Int32"})

    return V.read(spark, sf_dir, "supplier").select("s_suppkey", read(cut).alias("x")).select("s_suppkey", "x.*")


@query("""SELECT CAST(s_suppkey AS INT) AS tile_col, 0 AS tile_row, CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS rank FROM supplier WHERE s_suppkey % 4 <> 3""")
def raster_fallback(spark, sf_dir):
    """The first candidate of a tile that can be read: those before it have a good header and are cut short."""
    k = F.col("s_suppkey")
    tile = F.lit(base64.b64decode(_TILE))
    rows = V.read(spark, sf_dir, "supplier").select(k.cast("int").alias("tile_col"), F.lit(0).alias("tile_row"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank"))
    body = F.when(F.col("tile_col") % 4 < F.col("rank"), tile).otherwise(F.expr("null"))
    whole = F.when(F.col("tile_col") % 4 == 3, F.substring(tile, 1, 400)).otherwise(F.coalesce(body, F.substring(tile, 1, 400)))
    return raster.first_decodable(rows.withColumn("content", whole)).select("tile_col", "tile_row", "rank")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' END AS image_format,
  CASE s_suppkey % 4 WHEN 0 THEN 256 WHEN 1 THEN 32 WHEN 2 THEN 256 END AS width, CASE s_suppkey % 4 WHEN 0 THEN 256 WHEN 1 THEN 16 WHEN 2 THEN 256 END AS height, s_suppkey % 4 IN (0, 2) AS is_tile FROM supplier""")
def foreign_payloads(spark, sf_dir):
    """Payloads of other encoders, by their headers; a WebP header with a size of 256 by 256."""
    k = F.col("s_suppkey") % 4
    webp = F.lit(b"RIFF\x1a\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a\0\x01\0\x01")
    body = F.when(k == 0, F.lit(base64.b64decode(_TILE))).when(k == 1, F.lit(base64.b64decode(_JPEG))).when(k == 2, webp).otherwise(F.encode(F.lit("no image"), "utf-8"))
    s = V.read(spark, sf_dir, "supplier").select("s_suppkey", body.alias("content")).withColumn("info", raster.inspect(F.col("content")))
    return s.select("s_suppkey", "info.image_format", "info.width", "info.height", raster.is_tile(F.col("info")).alias("is_tile"))


@query("""SELECT '0' || CAST(s_suppkey % 4 AS VARCHAR) || CAST(s_suppkey AS VARCHAR) AS path, CAST(s_suppkey % 9 AS INT) AS number, CAST(NULL AS DATE) AS capture_date, CAST(s_suppkey AS INT) AS epoch, CAST(s_suppkey % 3 AS INT) AS provider FROM supplier WHERE s_suppkey % 5 <> 0""")
def binary_imagery(spark, sf_dir):
    k = F.col("s_suppkey").cast("int")
    layer = lambda t, e: F.struct(F.lit(t).alias("type"), e.alias("epoch"), (k % 3).alias("provider"))
    layers = F.when(k % 5 != 0, F.array(layer(1, k + 1), layer(0, k), layer(0, k + 2))).otherwise(F.array(layer(1, k + 1)))
    nodes = V.read(spark, sf_dir, "supplier").select(F.concat(F.lit("0"), (k % 4).cast("string"), k.cast("string")).alias("path"), (k % 9).alias("number"), layers.alias("layers"))
    return quadtree.binary_imagery(nodes)


# -- limits, lists and states --------------------------------------------------------
def _raises(f) -> bool:
    try:
        f()
    except Exception:  # noqa: BLE001  whether, not how
        return True
    return False


@query("""SELECT * FROM (VALUES ('keyhole level 30', false), ('keyhole level 31', true), ('mercator level 23', false), ('mercator level 24', true), ('level -1', true), ('zoom 20 esri', false), ('zoom 21 esri', true), ('zoom 21 google', false), ('zoom 22 google', true), ('no zooms', true), ('zooms twice', false), ('zoom true', true), ('path 0123', false), ('path 12', true), ('path 04', true),
  ('box', false), ('box without width', true), ('box beyond the pole', true), ('tiles 44', false), ('tiles 43', true), ('footprints 5', false), ('footprints 4', true), ('match nearest', true), ('match before', false)) t(what, refused)""")
def refused_arguments(spark, sf_dir):
    path = lambda p: not spark.range(1).select(G.valid_path(F.lit(p)).alias("ok")).first().ok
    from ..functions.dates import check_match

    c0, c1, r0, r1 = AOI.tile_range(G.MERCATOR, 17)
    n = (c1 - c0 + 1) * (r1 - r0 + 1)
    cases = {
        "keyhole level 30": lambda: G.check_level(G.KEYHOLE, 30), "keyhole level 31": lambda: G.check_level(G.KEYHOLE, 31),
        "mercator level 23": lambda: G.check_level(G.MERCATOR, 23), "mercator level 24": lambda: G.check_level(G.MERCATOR, 24), "level -1": lambda: G.check_level(G.MERCATOR, -1),
        "zoom 20 esri": lambda: G.check_zoom("esri", 20), "zoom 21 esri": lambda: G.check_zoom("esri", 21), "zoom 21 google": lambda: G.check_zoom("google", 21), "zoom 22 google": lambda: G.check_zoom("google", 22),
        "no zooms": lambda: G.check_zooms([]), "zooms twice": lambda: G.check_zooms([3, 3]), "zoom true": lambda: G.check_zooms(True),
        "box": lambda: G.Box(0, 0, 1, 1), "box without width": lambda: G.Box(0, 0, 0, 1), "box beyond the pole": lambda: G.Box(0, 0, 1, 91),
        "tiles 44": lambda: tiles.select_tiles(spark, AOI, G.MERCATOR, 17, n), "tiles 43": lambda: tiles.select_tiles(spark, AOI, G.MERCATOR, 17, n - 1),
        "footprints 5": lambda: releases.at_most(spark.range(5), 5), "footprints 4": lambda: releases.at_most(spark.range(5), 4),
        "match nearest": lambda: check_match("nearest"), "match before": lambda: check_match("before"),
    }
    rows = [(k, _raises(f)) for k, f in cases.items()] + [(f"path {p}", path(p)) for p in ("0123", "12", "04")]
    return spark.createDataFrame(rows, "what string, refused boolean")


@query(V.with_sql(V.RELEASES) + """SELECT 'early day' AS what, 'no release on or before 1980-01-01; the earliest release is ' || CAST(min(release_date) AS VARCHAR) AS says FROM releases
UNION ALL SELECT * FROM (VALUES ('incomplete listing', 'a listing is incomplete'), ('unknown release', 'unknown release WB_0'), ('missing tile', 'no version of a selected tile')) t(what, says)""")
def errors_when_run(spark, sf_dir):
    """What is only known from the data is an error of the plan, not an empty answer."""
    r = V.releases(spark, sf_dir)
    want = spark.createDataFrame([(1, 1, 17)], "tile_col int, tile_row int, zoom int").withColumn("key", F.lit("k"))
    plans = {
        "incomplete listing": releases.require_complete(spark.range(3).withColumn("complete", F.col("id") < 2)),
        "early day": releases.as_of(r, "1980-01-01"),
        "unknown release": releases.exact(r, "WB_0"),
        "missing tile": matching.require_all(want, want.where("false")),
    }
    rows = []
    for what, df in plans.items():
        try:
            df.collect()
            rows.append((what, None))
        except Exception as e:  # noqa: BLE001  the engine's own class differs by version
            rows.append((what, re.sub(r"(?s)^.*?USER_RAISED_EXCEPTION\] (.*?) SQLSTATE.*$", r"\1", str(e))))
    return spark.createDataFrame(rows, "what string, says string")


@query("SELECT * FROM (VALUES (1, 1, 1), (1, 3, 9), (2, 1, 4)) t(tile_row, pos, effective)")
def skip_chain_edges(spark, sf_dir):
    """A skip to a release that is not known keeps the row's own and ends the walk after it comes by; one to a release gone by ends it."""
    rows = [(1, 1, 1, None), (1, 2, 0, 3), (1, 3, 1, 9), (1, 9, 0, None), (2, 1, 1, 4), (2, 2, 1, None), (2, 4, 0, 2)]
    t = spark.createDataFrame([(0, *r) for r in rows], "tile_col int, tile_row int, pos int, has int, sel int")
    return skip_chain(t).select("tile_row", "pos", "effective")


@query("""SELECT * FROM (VALUES (1, 1, false), (2, 2, false), (3, 2, false), (4, 4, false), (5, 4, false), (6, 2, true), (7, 2, true), (8, 1, true), (9, 1, true), (10, 1, true)) t(step, workers, settled)""")
def request_widths(spark, sf_dir):
    """Two observations a width: 10 and 20 items a second, then 20.5 at the third width, which is no gain; then an unusable batch."""
    s, rows = controller.start((1, 2, 4)), []
    seen = [controller.Observation(x, (0.1,)) for x in (10.0, 10.0, 20.0, 20.0, 20.5, 20.5, 20.0)] + [controller.Observation(20.0, (0.1,), False), controller.Observation(9.0), controller.Observation(9.0)]
    for i, o in enumerate(seen, 1):
        s = controller.observe(s, o, float(i))
        rows.append((i, s.workers, s.settled))
    return spark.createDataFrame(rows, "step int, workers int, settled boolean")


# -- composed requests ---------------------------------------------------------------
@query(V.with_sql(V.CAPTURES, V.RELEASES, V.FOOTPRINTS, _LISTED.replace("FROM footprints f", "FROM (SELECT * FROM footprints WHERE zoom = 17 AND capture_date BETWEEN DATE '1995-02-01' AND DATE '1997-06-01') f")) + f""", q AS (
  SELECT f.capture_date AS g, f.release_id, greatest((west + 180.0) / 360.0, {_M[0]!r}::DOUBLE) AS x0, greatest({_LAT_Y.format('north')}, {_M[1]!r}::DOUBLE) AS y0,
  least((east + 180.0) / 360.0, {_M[2]!r}::DOUBLE) AS x1, least({_LAT_Y.format('south')}, {_M[3]!r}::DOUBLE) AS y1 FROM listed f JOIN first USING (capture_date, release_id)),
b AS (SELECT * FROM q WHERE x0 <= x1 AND y0 <= y1),
ys AS (SELECT g, y, lead(y) OVER (PARTITION BY g ORDER BY y) AS y2 FROM (SELECT g, y0 AS y FROM b UNION SELECT g, y1 FROM b) u),
xs AS (SELECT g, x, lead(x) OVER (PARTITION BY g ORDER BY x) AS x2 FROM (SELECT g, x0 AS x FROM b UNION SELECT g, x1 FROM b) u),
cell AS (SELECT ys.g, (y2 - y) * (x2 - x) AS a FROM ys JOIN xs ON ys.g = xs.g WHERE y2 IS NOT NULL AND x2 IS NOT NULL
  AND EXISTS (SELECT 1 FROM b WHERE b.g = ys.g AND b.x0 <= x AND b.x1 >= x2 AND b.y0 <= y AND b.y1 >= y2)),
area AS (SELECT g, sum(a) AS a FROM cell GROUP BY 1)
SELECT area.g AS date, round(area.a / {(_M[2] - _M[0]) * (_M[3] - _M[1])!r}::DOUBLE, 6) AS coverage, t.titles FROM area
JOIN (SELECT g, string_agg(DISTINCT {_TITLED}, ', ' ORDER BY {_TITLED}) AS titles FROM q GROUP BY 1) t ON t.g = area.g""")
def availability_by_footprint(spark, sf_dir):
    """Each date from the earliest release that lists it, with that release's title."""
    r = V.releases(spark, sf_dir).withColumn("title", F.concat(F.lit("Wayback "), F.substring("release_id", 4, 4)))
    catalog = Catalog(spark, "esri", releases=r, footprints=V.footprints(spark, sf_dir))
    answer = catalog.availability(MOSAIC_AOI, 17, "1995-02-01", "1997-06-01", max_footprints=10**9)
    return answer.df.select("date", _r("coverage", 6).alias("coverage"), "titles")


#: Three by two tiles of the demonstrations' area.
_BLOCK = (20975, 20977, 50652, 50653)


def _block():
    inner = 0.25
    west, east = ((c + d) / (1 << 17) * 360 - 180 for c, d in ((_BLOCK[0], inner), (_BLOCK[1], 1 - inner)))
    lat = lambda y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / (1 << 17)))))
    return G.Box(west, lat(_BLOCK[3] + 1 - inner), east, lat(_BLOCK[2] + inner))


_BEST = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_col, tile_row ORDER BY capture_date IS NULL, abs(date_diff('day', DATE '1998-02-15', capture_date)), capture_date, CAST(source_id AS VARCHAR)) AS rk
  FROM tile_versions WHERE tile_col BETWEEN {_BLOCK[0]} AND {_BLOCK[1]} AND tile_row BETWEEN {_BLOCK[2]} AND {_BLOCK[3]} AND {{0}}) q WHERE rk = 1)"""


def _catalog(spark, sf_dir):
    """Versions with a payload for each source: a tile, or for every fourth source one that is cut short."""
    tile = F.lit(base64.b64decode(_TILE))
    versions = V.tile_versions(spark, sf_dir).withColumn("key", F.col("source_id").cast("string")).withColumn("provider", F.lit("p"))
    whole = V.sources(spark, sf_dir).select(F.col("source_id").cast("string").alias("key"), F.when(F.col("source_id") % 4 == 0, F.substring(tile, 1, 400)).otherwise(tile).alias("body"))
    return Catalog(spark, "esri", versions=versions, payloads=whole)


@query(V.with_sql(V.CAPTURES, V.TILE_VERSIONS, _BEST.format("source_id % 4 <> 0")) + "SELECT tile_col, tile_row, CAST(source_id AS VARCHAR) AS key, 'jpeg' AS image_format, 'image/jpeg' AS media_type, CAST(NULL AS DATE) AS capture_date FROM best")
def download_tiles(spark, sf_dir):
    """Payload rows of an area without their metadata."""
    c = _catalog(spark, sf_dir)
    good = Catalog(spark, "esri", versions=c.versions.where("source_id % 4 <> 0"), payloads=c.payloads)
    return good.tiles(_block(), 17, "1998-02-15", include_metadata=False).select("tile_col", "tile_row", "key", "image_format", "media_type", "capture_date")


@query(V.with_sql(V.CAPTURES, V.TILE_VERSIONS, _BEST.format("source_id % 4 <> 0")) + f"""SELECT count(*) AS n_tiles, count(*) FILTER (capture_date IS NULL) AS n_undated,
  coalesce(string_agg(DISTINCT CAST(capture_date AS VARCHAR), ',' ORDER BY CAST(capture_date AS VARCHAR)), '') AS dates, {(_BLOCK[1] - _BLOCK[0] + 1) * (_BLOCK[3] - _BLOCK[2] + 1)} - count(*) AS n_missing FROM best""")
def raster_tags(spark, sf_dir):
    """The same area as a raster: payloads that are cut short give way to the next candidate."""
    return _catalog(spark, sf_dir).raster(_block(), 17, "1998-02-15").meta


@query(f"""SELECT x AS block_x, y AS block_y, CAST(least(128, 640 - x * 128) AS INT) AS width, CAST(least(128, 384 - y * 128) AS INT) AS height, 90 AS red, 120 AS green, 60 AS blue, 255 AS seen
FROM (SELECT CAST(unnest(range(0, 5)) AS INT) AS x) a, (SELECT CAST(unnest(range(0, 3)) AS INT) AS y) b""")
def raster_blocks(spark, sf_dir):
    """Blocks of the mosaic; every pixel is of the one colour that all tiles have."""
    df = _catalog(spark, sf_dir).raster(_block(), 17, "1998-02-15", block=128).df

    @F.pandas_udf("red int, green int, blue int, seen int")
    def one(pixels: pd.Series, mask: pd.Series) -> pd.DataFrame:
        out = []
        for p, m in zip(pixels, mask):
            px = {bytes(p)[i : i + 3] for i in range(0, len(p), 3)}
            out.append((*(next(iter(px)) if len(px) == 1 else (-1, -1, -1)), min(m)))
        return pd.DataFrame(out, columns=["red", "green", "blue", "seen"])

    return df.select("block_x", "block_y", "width", "height", one("pixels", "mask").alias("x")).select("block_x", "block_y", "width", "height", "x.*")


@query("SELECT DISTINCT 'k' || CAST(l_partkey AS VARCHAR) AS key FROM lineitem WHERE l_partkey % 3 <> 0")
def keys_not_stored(spark, sf_dir):
    key = F.concat(F.lit("k"), F.col("l_partkey").cast("string"))
    rows = V.read(spark, sf_dir, "lineitem").select(key.alias("key"))
    kept = V.read(spark, sf_dir, "lineitem").where("l_partkey % 3 = 0").select(key.alias("key")).distinct()
    return keys_to_fetch(rows, kept)


@query(V.with_sql(V.CAPTURES, V.TILEMAPS.replace("tiles AS", "tiles AS", 1).split("ch AS")[0].rstrip().rstrip(",")) + """SELECT t.tile_col, t.tile_row, d.capture_date FROM tiles t CROSS JOIN (SELECT DISTINCT capture_date FROM captures WHERE capture_date >= DATE '1998-01-01') d
  WHERE NOT EXISTS (SELECT 1 FROM captures c WHERE c.tile_col = t.tile_col AND c.tile_row = t.tile_row AND c.capture_date = d.capture_date AND c.part_no > 1)""")
def dates_not_covered(spark, sf_dir):
    """(tile, date) that the later parts lack, of all there could be: the superset check and what it finds."""
    c = V.captures(spark, sf_dir)
    every = c.select("tile_col", "tile_row").distinct().crossJoin(F.broadcast(c.where("capture_date >= date '1998-01-01'").select("capture_date").distinct()))  # 128 tiles, one row a month
    return matching.uncovered(c.where("part_no > 1"), every, ("tile_col", "tile_row", "capture_date"))


@query(V.with_sql(V.SOURCES) + """SELECT source_id, CASE WHEN source_id % 3 = 0 THEN source_provider WHEN source_id % 5 <> 0 THEN provider END AS provider,
  CASE WHEN source_id % 3 = 0 THEN source_resolution_m END AS resolution_m, source_id % 3 <> 0 AND source_id % 5 = 0 AS nothing FROM sources""")
def source_or_name(spark, sf_dir):
    s = V.sources(spark, sf_dir)
    record = F.struct(F.col("source_provider").alias("provider"), F.col("source_description").alias("description"), F.col("source_resolution_m").alias("resolution_m"), F.col("source_accuracy_m").alias("accuracy_m"), "min_map_level", "max_map_level")
    own = F.when(F.col("source_id") % 3 == 0, record)
    name = F.when(F.col("source_id") % 5 != 0, F.col("provider")).otherwise(F.lit(""))
    return s.select("source_id", metadata.source_or_name(own, name).alias("s")).select("source_id", "s.provider", "s.resolution_m", F.col("s").isNull().alias("nothing"))


@query("""SELECT s_suppkey, round(degrees(s_suppkey * 1000.0 / 6378137.0), 9) AS west, round(degrees(atan(sinh(s_suppkey * 500.0 / 6378137.0))), 9) AS south, round(degrees((s_suppkey * 1000.0 + 100) / 6378137.0), 9) AS east,
  round(degrees(atan(sinh((s_suppkey * 500.0 + 100) / 6378137.0))), 9) AS north, CASE s_suppkey % 4 WHEN 1 THEN 5000.0::DOUBLE WHEN 2 THEN 7500.0::DOUBLE ELSE 10000.0::DOUBLE END AS area FROM supplier WHERE s_suppkey % 4 <> 3""")
def geometries_in_degrees(spark, sf_dir):
    """Recorded rings in metres: squares, squares that cross themselves, squares with a hole, and rows without any."""
    k = F.col("s_suppkey")
    at = lambda dx, dy: F.array(k * 1000.0 + dx, k * 500.0 + dy)
    square = F.array(at(0, 0), at(0, 100), at(100, 100), at(100, 0), at(0, 0))
    crossed = F.array(at(0, 0), at(100, 100), at(100, 0), at(0, 100), at(0, 0))
    hole = F.array(at(25, 25), at(75, 25), at(75, 75), at(25, 75), at(25, 25))
    rings = F.when(k % 4 == 0, F.array(square)).when(k % 4 == 1, F.array(crossed)).when(k % 4 == 2, F.array(square, hole))
    rows = polygons.geometries_in_degrees(V.read(spark, sf_dir, "supplier").select("s_suppkey", rings.alias("rings")))

    @F.pandas_udf("west double, south double, east double, north double, area double")
    def measure(geom: pd.Series) -> pd.DataFrame:
        out = []
        for g in geom:
            parts = Y.from_wkb(bytes(g))
            x, y = zip(*[p for rings in parts for ring in rings for p in ring])
            out.append((min(x), min(y), max(x), max(y), Y.mercator_area(parts)))
        return pd.DataFrame(out, columns=["west", "south", "east", "north", "area"])

    out = rows.select("s_suppkey", measure("geom").alias("m")).select("s_suppkey", "m.*")
    return out.select("s_suppkey", *[_r(c).alias(c) for c in ("west", "south", "east", "north")], _r("area", 2).alias("area"))


@query("""SELECT * FROM (VALUES ('429 then an answer', 2, 'answer'), ('three of 503 then an answer', 4, 'answer'), ('always 500', 4, 'failed'), ('403', 1, 'failed'), ('404', 1, 'not found'), ('broken line then an answer', 2, 'answer')) t(what, attempts, ends)""")
def request_retries(spark, sf_dir):
    cases = {"429 then an answer": [429, 0], "three of 503 then an answer": [503, 503, 503, 0], "always 500": [500] * 9, "403": [403, 0], "404": [404, 0], "broken line then an answer": [-1, 0]}
    rows = []
    for what, seen in cases.items():
        asked: list[int] = []

        def call(seen=seen, asked=asked):
            status = seen[len(asked)]
            asked.append(status)
            if status == -1:
                raise OSError("broken")
            if status:
                raise listing.StatusError(status)
            return "answer"

        try:
            ends = listing.with_retries(call, pause=0)
        except listing.NotFound:
            ends = "not found"
        except listing.RequestFailed:
            ends = "failed"
        rows.append((what, len(asked), ends))
    return spark.createDataFrame(rows, "what string, attempts int, ends string")


@query("SELECT * FROM (VALUES ('none', 'table'), ('file', 'file'), ('FILE by environment', 'file'), ('sqlite', 'refused')) t(what, kind)")
def kinds_of_store(spark, sf_dir):
    cases = {"none": (None, {}), "file": ("file", {}), "FILE by environment": (None, {"TERRACHRON_CACHE_KIND": "FILE"}), "sqlite": ("sqlite", {})}
    rows = []
    for what, (name, env) in cases.items():
        try:
            rows.append((what, kind_of_store(name, env)))
        except ValueError:
            rows.append((what, "refused"))
    return spark.createDataFrame(rows, "what string, kind string")
