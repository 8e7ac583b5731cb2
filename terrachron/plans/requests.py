"""The catalogue's questions as composed plans: availability, releases, mosaics, tiles, archives, rasters.

A ``Catalog`` holds the tables of one provider. Answers are a DataFrame with a
one-row ``meta`` DataFrame beside it. Arguments are checked before any plan is built.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import archive as A
from ..functions import geometry as Y
from ..functions import grids as G
from ..functions import values as X
from ..functions.dates import as_date, check_match
from ..operators import coverage, matching, metadata, mosaic, polygons
from ..operators import raster as R
from ..operators import releases as Q
from ..operators import tiles as grid_tiles
from ..sources.archive import write_archive
from ..sources.geotiff import write_geotiff
from ..sources.payloads import attach


@dataclass(frozen=True)
class Answer:
    df: DataFrame
    meta: DataFrame


@dataclass(frozen=True)
class Catalog:
    """Tables of a provider; the ones a question does not need may be None.

    ``versions(tile_col, tile_row, zoom, capture_date, provider, key, <provenance>)``,
    ``releases(release_id, release_date, pos)``, ``footprints(zoom, release_id,
    object_id, capture_date, west, south, east, north, <provenance>[, geom])``,
    ``payloads(key, body)``.
    """

    spark: SparkSession
    provider: str
    versions: DataFrame | None = None
    releases: DataFrame | None = None
    footprints: DataFrame | None = None
    payloads: DataFrame | None = None

    @property
    def scheme(self) -> str:
        if self.provider not in G.PROVIDER_SCHEME:
            raise ValueError(f"unknown provider {self.provider!r}; one of {', '.join(G.PROVIDER_SCHEME)}")
        return G.PROVIDER_SCHEME[self.provider]

    def _meta(self, **values) -> DataFrame:
        return self.spark.createDataFrame([tuple(None if v is None else str(v) for v in values.values())], ", ".join(f"{k} string" for k in values))

    def availability(self, aoi: G.Box | bytes, zoom: int, min_date=None, max_date=None, max_tiles: int = grid_tiles.MAX_TILES, max_footprints: int = 10_000) -> Answer:
        """Which capture dates exist over an area and what share of it each covers, newest first.

        A box takes the closed form; WKB takes polygon overlay. With footprints, every
        date is taken from the earliest release that lists it.
        """
        G.check_zoom(self.provider, zoom)
        G.check_level(self.scheme, zoom)
        if self.footprints is not None:
            return self._availability_by_footprint(aoi, zoom, min_date, max_date, max_footprints)
        n = None
        if isinstance(aoi, G.Box):
            c0, c1, r0, r1 = aoi.tile_range(self.scheme, zoom)
            n = (c1 - c0 + 1) * (r1 - r0 + 1)
            if n > max_tiles:
                raise ValueError(f"the area spans {n} tiles at zoom {zoom}, above max_tiles={max_tiles}")
            own = coverage.in_bounds(self.versions.where(F.col("zoom") == zoom), min_date, max_date)
            df = coverage.coverage_by_date(own, aoi, self.scheme, zoom)
        else:
            cells = polygons.select_tiles_in(self.spark, aoi, self.scheme, zoom, max_tiles)
            own = coverage.in_bounds(self.versions.where(F.col("zoom") == zoom), min_date, max_date).join(F.broadcast(cells), list(matching.TILE))  # at most max_tiles
            b = G.bounds(self.scheme, F.col("tile_col"), F.col("tile_row"), zoom)
            one = own.select("capture_date", "tile_col", "tile_row").distinct().select("capture_date", polygons.box_wkb(b["west"], b["south"], b["east"], b["north"]).alias("geom"))
            shares = polygons.clipped_union(one, aoi, ["capture_date"])
            names = own.groupBy("capture_date").agg(coverage.joined_distinct(F.col("provider")).alias("providers"))
            df = shares.join(names, "capture_date").select(F.col("capture_date").alias("date"), F.col("area_fraction").alias("coverage"), (F.col("area_fraction") >= 1 - coverage.COMPLETE_TOLERANCE).alias("complete"), "providers", "geometry").orderBy(F.desc("date"))
        return Answer(df, self._meta(zoom=zoom, provider=self.provider, n_aoi_tiles=n, method="tiles"))

    def _availability_by_footprint(self, aoi, zoom, min_date, max_date, max_footprints) -> Answer:
        own = coverage.in_bounds(self.footprints.where(F.col("zoom") == zoom), min_date, max_date)
        rel = self.releases.select("release_id", "release_date")
        if min_date is not None:  # a release can't show what was captured after it
            rel = rel.where(F.col("release_date") >= F.lit(as_date(min_date)))
        listing = own.join(rel, "release_id")
        first = Q.earliest_per_date(listing.select("capture_date", "release_id", "release_date"))
        chosen = own.join(first.select("capture_date", "release_id"), ["capture_date", "release_id"], "left_semi")
        Q.at_most(chosen.select("object_id"), max_footprints)
        keys = ["capture_date"]
        if isinstance(aoi, G.Box):
            shares = mosaic.covered(chosen, aoi, keys, ()).drop("n_footprints")
        else:
            shares = polygons.clipped_union(_shaped(chosen), aoi, keys)
        there = [p for p, _ in coverage.PROVENANCE if p in chosen.columns]
        arrays = chosen.groupBy(*keys).agg(*[coverage.sorted_distinct(F.col(p)).alias(q) for p, q in coverage.PROVENANCE if p in there], F.min("release_id").alias("release_id"))
        df = shares.join(arrays, keys)
        if "title" in self.releases.columns:
            df = df.join(metadata.titles_by_date(chosen, self.releases), keys)
        df = df.withColumn("complete", F.col("area_fraction") >= 1 - coverage.COMPLETE_TOLERANCE)
        df = df.withColumnsRenamed({"capture_date": "date", "area_fraction": "coverage"}).orderBy(F.desc("date"))
        return Answer(df, self._meta(zoom=zoom, provider=self.provider, n_aoi_tiles=None, method="footprints"))

    def release_catalogue(self) -> DataFrame:
        return Q.catalogue(self.releases)

    def mosaic_as_of(self, aoi: G.Box | bytes, zooms, as_of: str | dt.date, max_footprints: int = 500) -> Answer:
        """What one published release displayed: an ISO date means the latest release up to it, else an identifier."""
        levels = G.check_zooms(zooms, self.provider)
        try:
            day, name = as_date(as_of), None
        except ValueError:
            day, name = None, as_of
        one = Q.as_of(self.releases, day) if day else Q.exact(self.releases, name)
        own = self.footprints.where(F.col("zoom").isin(levels)).join(F.broadcast(one.select("release_id")), "release_id")  # one row
        if "complete" in own.columns:
            own = Q.require_complete(own)
        Q.at_most(own.select("object_id"), max_footprints)
        if isinstance(aoi, G.Box):
            df = mosaic.seam_map(own, aoi)
        else:
            keys = ["zoom", "capture_date", "release_id", *mosaic.SOURCE]
            df = polygons.clipped_union(_shaped(own), aoi, keys).withColumnRenamed("capture_date", "date").orderBy("zoom", F.desc("date"), *mosaic.SOURCE)
        meta = one.select("release_id", "release_date", F.lit(str(as_of)).alias("as_of"), F.lit(",".join(map(str, levels))).alias("zooms"))
        return Answer(df, meta)

    def _candidates(self, aoi, zoom, date, match, release_id, max_tiles) -> tuple[DataFrame, DataFrame]:
        if (date is None) == (release_id is None):
            raise ValueError("give a date or a release, not both")
        if release_id is not None and (self.provider != "esri" or match != "closest"):
            raise ValueError("a release is chosen without a date match, and only of the provider that has releases")
        check_match(match)
        G.check_zoom(self.provider, zoom)
        if isinstance(aoi, DataFrame):
            want = grid_tiles.tiles_of_points(aoi, self.scheme, zoom, max_tiles)
        elif isinstance(aoi, G.Box):
            want = grid_tiles.select_tiles(self.spark, aoi, self.scheme, zoom, max_tiles)
        else:
            want = polygons.select_tiles_in(self.spark, aoi, self.scheme, zoom, max_tiles)
        own = self.versions.join(F.broadcast(want), list(matching.TILE), "left_semi")  # at most max_tiles
        if release_id is not None:
            one = Q.exact(self.releases, release_id)
            return want, own.join(F.broadcast(one.select("release_id")), "release_id").withColumn("rank", F.lit(1))
        return want, matching.ranked(own, date, match, ties=("key",))

    def tiles(self, aoi, zoom: int, date=None, date_match: str = "closest", release_id: str | None = None, max_tiles: int = grid_tiles.MAX_TILES, include_metadata: bool = True) -> DataFrame:
        """Unchanged payloads of the best version of each tile, row by row; any tile without one is an error.

        Without ``include_metadata`` capture dates and sources are left null.
        """
        want, ranked = self._candidates(aoi, zoom, date, date_match, release_id, max_tiles)
        best = matching.require_all(want, ranked.where("rank = 1").drop("rank"))
        got = attach(best, self.payloads).withColumnRenamed("body", "content")
        got = got.withColumn("info", R.inspect(F.col("content")))
        bad = F.raise_error(F.lit("a payload is missing or is no tile")).cast("boolean")
        got = got.where(F.when(R.is_tile(F.col("info")), F.lit(True)).otherwise(bad))
        got = metadata.undated_if_not_asked(got, include_metadata)
        b = G.bounds(self.scheme, F.col("tile_col"), F.col("tile_row"), zoom)
        return got.select("*", "info.image_format", "info.media_type", F.struct(*[v.alias(k) for k, v in b.items()]).alias("bounds")).drop("info").orderBy("tile_row", "tile_col")

    def archive(self, aoi, zoom: int, output: str, date=None, table: str = "tiles", overwrite: bool = False, **choice) -> int:
        """The same tiles in an archive file with overviews."""
        got = self.tiles(aoi, zoom, date, **choice)
        a = A.address(self.scheme, F.col("tile_col"), F.col("tile_row"), F.lit(zoom))
        rows = got.select(*[v.alias(k) for k, v in a.items()], "content", "capture_date")
        return write_archive(rows, output, self.scheme, table, overwrite=overwrite)

    def raster(self, aoi: G.Box, zoom: int, date=None, date_match: str = "closest", release_id: str | None = None, max_tiles: int = grid_tiles.MAX_TILES, block: int = 1024) -> Answer:
        """The mosaic in blocks, from each tile's first version that can be decoded; tiles without one stay masked."""
        want, ranked = self._candidates(aoi, zoom, date, date_match, release_id, max_tiles)
        got = attach(ranked, self.payloads).withColumnRenamed("body", "content")
        used = R.first_decodable(got)
        x, y = G.pixel_origin(self.scheme, F.col("tile_col"), F.col("tile_row"), zoom)
        lit = [F.lit(v) for v in (aoi.west, aoi.south, aoi.east, aoi.north)]
        w = self.spark.range(1).select(*[v.alias(k) for k, v in G.pixel_window(self.scheme, *lit, zoom).items()]).first()
        placed = used.withColumn("left", x).withColumn("top", y)
        df = R.mosaic_blocks(placed.select("left", "top", "content"), (w.left, w.top, w.right, w.bottom), block)
        missing = matching.missing_tiles(want, used)
        inside = placed.where((F.col("left") < w.right) & (F.col("left") + G.TILE_PX > w.left) & (F.col("top") < w.bottom) & (F.col("top") + G.TILE_PX > w.top))
        none = F.raise_error(F.lit(f"no imagery found over this area at zoom {zoom}")).cast("long")
        dates = F.array_join(F.array_sort(F.collect_set(F.col("capture_date").cast("string"))), ",")
        tags = [F.when(F.count("*") > 0, F.count("*")).otherwise(none).alias("n_tiles"), F.count_if(F.col("capture_date").isNull()).alias("n_undated"), dates.alias("dates")]
        if "source" in inside.columns:
            tags.append(X.sources_json(F.col("source")).alias("sources"))
        meta = inside.agg(*tags)
        return Answer(df, meta.crossJoin(missing.agg(F.count("*").alias("n_missing"))))  # one row each

    def geotiff(self, aoi: G.Box, zoom: int, output: str, date=None, date_match: str = "closest", release_id: str | None = None, block: int = 1024, overwrite: bool = False, **choice) -> int:
        """The mosaic as a georeferenced file with a mask, and tags that say what it was made of."""
        answer = self.raster(aoi, zoom, date, date_match, release_id, block=block, **choice)
        meta = answer.meta.first().asDict()
        lit = [F.lit(v) for v in (aoi.west, aoi.south, aoi.east, aoi.north)]
        w = self.spark.range(1).select(*[v.alias(k) for k, v in G.pixel_window(self.scheme, *lit, zoom).items()]).first()
        a = self.spark.range(1).select(F.array(*G.affine(self.scheme, F.lit(w.left), F.lit(w.top), zoom)).alias("a")).first().a
        tags = {"dates": meta["dates"], "zoom": zoom, "provider": self.provider, "tiles_total": meta["n_tiles"] + meta["n_missing"], "tiles_missing": meta["n_missing"], "tiles_capture_date_unknown": meta["n_undated"]}
        if release_id is not None:
            tags |= {"selection_mode": "release", "release_id": release_id}
        else:
            tags |= {"selection_mode": "capture-date", "target_date": as_date(date).isoformat(), "date_match": date_match}
        if meta.get("sources"):
            tags["sources"] = meta["sources"]
        epsg = 4326 if self.scheme == G.KEYHOLE else 3857
        return write_geotiff(answer.df, output, (w.right - w.left, w.bottom - w.top), block, (a[2], a[5]), a[0], epsg, tags, overwrite)


def _shaped(footprints: DataFrame) -> DataFrame:
    """Footprints with ``geom``: their own, or else their box."""
    if "geom" in footprints.columns:
        return footprints
    return footprints.withColumn("geom", polygons.box_wkb(*[F.col(c) for c in ("west", "south", "east", "north")]))


def polygon(*rings) -> bytes:
    """A polygon as the WKB that the questions take."""
    return Y.to_wkb([list(rings)])
