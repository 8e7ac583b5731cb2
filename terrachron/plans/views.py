"""The catalogue's tables as views of the driver's Parquet tables, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVEL, COL0, ROW0 = 17, 20972, 50651


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 by 8 mercator tiles, a row for every (tile, month, source) seen, with repeats."""
    return read(spark, sf_dir, "lineitem").select(
        (COL0 + F.col("l_partkey") % 16).cast("int").alias("tile_col"),
        (ROW0 + F.col("l_suppkey") % 8).cast("int").alias("tile_row"),
        F.lit(LEVEL).alias("zoom"),
        F.trunc("l_shipdate", "month").alias("capture_date"),
        F.col("l_suppkey").alias("source_id"),
        F.col("l_orderkey").alias("object_id"),
        F.col("l_linenumber").alias("part_no"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance by source; some fields are blank."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("source_id"),
        F.col("s_name").alias("provider"),
        F.when(k % 5 != 0, F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))).alias("source_provider"),
        F.when(k % 7 != 0, F.concat(F.lit("Series "), (k % 9).cast("string"))).alias("source_description"),
        F.when(k % 4 != 0, (k % 5) * F.lit(0.25) + 0.5).alias("source_resolution_m"),
        F.when(k % 3 != 0, (k % 6) * F.lit(0.5) + 1.0).alias("source_accuracy_m"),
        (10 + k % 3).cast("int").alias("min_map_level"),
        (17 + k % 4).cast("int").alias("max_map_level"),
    )


def tile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (tile, date, source) with some undated ones."""
    c = captures(spark, sf_dir)
    day = F.when(F.col("object_id") % 97 != 0, F.col("capture_date"))
    return c.select("tile_col", "tile_row", "zoom", day.alias("capture_date"), "source_id").distinct()


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One release a month of orders, newest first."""
    m = read(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("release_date")).distinct()
    name = F.concat(F.lit("WB_"), F.year("release_date").cast("string"), F.lit("_R"), F.lpad(F.month("release_date").cast("string"), 2, "0"))
    pos = F.row_number().over(Window.orderBy(F.desc("release_date"))).cast("long")  # one row a release
    return m.select(name.alias("release_id"), "release_date", pos.alias("pos"))


def tilemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per release and tile: is imagery carried, and which older release to skip to."""
    c, r = captures(spark, sf_dir), releases(spark, sf_dir)
    tiles = c.select("tile_col", "tile_row").distinct()
    changed = c.where(F.col("object_id") % 11 == 0).join(F.broadcast(r), c.capture_date == r.release_date).select("tile_col", "tile_row", F.col("pos").alias("hit")).distinct()
    hits = changed.groupBy("tile_col", "tile_row").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    every = r.agg(F.collect_list("pos").alias("all"))  # one row; a list of releases
    grid = tiles.join(hits, ["tile_col", "tile_row"], "left").join(F.broadcast(every)).select("tile_col", "tile_row", "hits", F.explode("all").alias("pos"))
    nxt = F.try_element_at(F.filter(F.coalesce("hits", F.array().cast("array<bigint>")), lambda h: h >= F.col("pos")), F.lit(1))
    return grid.select(F.col("pos").cast("int").alias("pos"), "tile_col", "tile_row", F.when(nxt.isNull(), 0).otherwise(1).alias("has"), F.when(nxt > F.col("pos"), nxt).cast("int").alias("sel"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    lon = ((F.col("l_orderkey") * 7919) % 360000) / F.lit(1000.0) - 180.0
    lat = ((F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31) % 170000) / F.lit(1000.0) - 85.0
    return li.select("l_orderkey", "l_linenumber", lon.alias("lon"), lat.alias("lat")).distinct()


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in degrees of each (release, zoom, object), from integer micro-degrees."""
    c = captures(spark, sf_dir)
    r = releases(spark, sf_dir)
    x = F.col("object_id") * 7919 % 40000
    y = F.col("object_id") * 104729 % 20000
    box = {
        "west": (F.lit(-122420000) + x) / F.lit(1e6),
        "east": (F.lit(-122420000) + x + 2000 + F.col("source_id") % 7 * 500) / F.lit(1e6),
        "south": (F.lit(37780000) + y) / F.lit(1e6),
        "north": (F.lit(37780000) + y + 1500 + F.col("source_id") % 5 * 400) / F.lit(1e6),
    }
    c = c.select("object_id", "source_id", "capture_date", (17 + F.col("part_no") % 2).cast("int").alias("zoom"), *[v.alias(k) for k, v in box.items()]).distinct()
    return c.join(F.broadcast(r), c.capture_date == F.add_months(r.release_date, -1)).select("release_id", "object_id", "source_id", "zoom", "capture_date", "west", "south", "east", "north")


CAPTURES = f"""captures AS (SELECT CAST({COL0} + l_partkey % 16 AS INT) AS tile_col, CAST({ROW0} + l_suppkey % 8 AS INT) AS tile_row,
  {LEVEL} AS zoom, CAST(date_trunc('month', l_shipdate) AS DATE) AS capture_date, l_suppkey AS source_id,
  l_orderkey AS object_id, l_linenumber AS part_no FROM lineitem)"""

SOURCES = """sources AS (SELECT s_suppkey AS source_id, s_name AS provider,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'Nation ' || CAST(s_nationkey AS VARCHAR) END AS source_provider,
  CASE WHEN s_suppkey % 7 <> 0 THEN 'Series ' || CAST(s_suppkey % 9 AS VARCHAR) END AS source_description,
  CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 5) * 0.25::DOUBLE + 0.5::DOUBLE END AS source_resolution_m,
  CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 6) * 0.5::DOUBLE + 1.0::DOUBLE END AS source_accuracy_m,
  CAST(10 + s_suppkey % 3 AS INT) AS min_map_level, CAST(17 + s_suppkey % 4 AS INT) AS max_map_level FROM supplier)"""

TILE_VERSIONS = """tile_versions AS (SELECT DISTINCT tile_col, tile_row, zoom,
  CASE WHEN object_id % 97 <> 0 THEN capture_date END AS capture_date, source_id FROM captures)"""

RELEASES = """releases AS (SELECT 'WB_' || CAST(year(m) AS VARCHAR) || '_R' || lpad(CAST(month(m) AS VARCHAR), 2, '0') AS release_id,
  m AS release_date, row_number() OVER (ORDER BY m DESC) AS pos
  FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders) q)"""

TILEMAPS = """tiles AS (SELECT DISTINCT tile_col, tile_row FROM captures),
ch AS (SELECT DISTINCT r.pos, c.tile_col, c.tile_row FROM captures c JOIN releases r ON r.release_date = c.capture_date WHERE c.object_id % 11 = 0),
gaps AS (SELECT r.pos, t.tile_col, t.tile_row, min(ch.pos) AS nxt FROM releases r CROSS JOIN tiles t
  LEFT JOIN ch ON ch.tile_col = t.tile_col AND ch.tile_row = t.tile_row AND ch.pos >= r.pos GROUP BY 1, 2, 3),
tilemaps AS (SELECT CAST(pos AS INT) AS pos, tile_col, tile_row, CASE WHEN nxt IS NULL THEN 0 ELSE 1 END AS has,
  CAST(CASE WHEN nxt > pos THEN nxt END AS INT) AS sel FROM gaps)"""

POINTS = """points AS (SELECT DISTINCT l_orderkey, l_linenumber, ((l_orderkey * 7919) % 360000) / 1000.0::DOUBLE - 180.0::DOUBLE AS lon,
  ((l_partkey * 104729 + l_linenumber * 31) % 170000) / 1000.0::DOUBLE - 85.0::DOUBLE AS lat FROM lineitem)"""

FOOTPRINTS = """boxes AS (SELECT DISTINCT object_id, source_id, capture_date, CAST(17 + part_no % 2 AS INT) AS zoom,
  (-122420000 + object_id * 7919 % 40000) / 1e6::DOUBLE AS west,
  (-122420000 + object_id * 7919 % 40000 + 2000 + source_id % 7 * 500) / 1e6::DOUBLE AS east,
  (37780000 + object_id * 104729 % 20000) / 1e6::DOUBLE AS south,
  (37780000 + object_id * 104729 % 20000 + 1500 + source_id % 5 * 400) / 1e6::DOUBLE AS north FROM captures),
footprints AS (SELECT r.release_id, b.object_id, b.source_id, b.zoom, b.capture_date, b.west, b.south, b.east, b.north
  FROM boxes b JOIN releases r ON b.capture_date = CAST(r.release_date - INTERVAL 1 MONTH AS DATE))"""


def with_sql(*views: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(views) + "\n"
