"""Coverage of an area by capture date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grids as G
from ..functions.dates import as_date
from ..functions.values import joined_distinct, sorted_distinct
from .tiles import clip_share, in_range

#: A share this close to one is a whole area.
COMPLETE_TOLERANCE = 1e-9
PROVENANCE = (
    ("source_provider", "source_providers"),
    ("source_description", "source_descriptions"),
    ("source_resolution_m", "source_resolutions_m"),
    ("source_accuracy_m", "source_accuracies_m"),
    ("min_map_level", "min_map_levels"),
    ("max_map_level", "max_map_levels"),
)


def in_bounds(versions: DataFrame, min_date: str | dt.date | None = None, max_date: str | dt.date | None = None) -> DataFrame:
    """Dated versions within inclusive bounds; undated ones are dropped."""
    out = versions.where(F.col("capture_date").isNotNull())
    if min_date is not None:
        out = out.where(F.col("capture_date") >= F.lit(as_date(min_date)))
    if max_date is not None:
        out = out.where(F.col("capture_date") <= F.lit(as_date(max_date)))
    return out


def coverage_by_date(versions: DataFrame, aoi: G.Box, scheme: str, level: int) -> DataFrame:
    """``date, coverage, complete, n_tiles`` and provenance, newest first.

    ``versions(tile_col, tile_row, capture_date, provider, <provenance>)`` may hold a
    tile several times a date. Tiles of one zoom do not overlap, so the covered
    share is the sum of clipped tiles. Two partial aggregations: by tile and date,
    where the copies meet, then by date; the range of tiles is a pushed-down filter.
    """
    there = [p for p, _ in PROVENANCE if p in versions.columns]
    own = versions.where(in_range(aoi, scheme, level, F.col("tile_col"), F.col("tile_row")))
    sets = [F.collect_set(p).alias(p) for p in ["provider", *there]]
    by_tile = own.groupBy("capture_date", "tile_col", "tile_row").agg(*sets)
    share = clip_share(aoi, scheme, level, F.col("tile_col"), F.col("tile_row"))
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(p)))).alias(p) for p in ["provider", *there]]
    by_date = by_tile.groupBy("capture_date").agg(F.sum(share).alias("coverage"), F.count("*").alias("n_tiles"), *merged)
    names = F.array_join(F.filter("provider", lambda x: x != ""), ", ")
    return by_date.select(
        F.col("capture_date").alias("date"),
        "coverage",
        (F.col("coverage") >= 1 - COMPLETE_TOLERANCE).alias("complete"),
        "n_tiles",
        names.alias("providers"),
        *[F.col(p).alias(q) for p, q in PROVENANCE if p in there],
    ).orderBy(F.desc("date"))


__all__ = ["PROVENANCE", "coverage_by_date", "in_bounds", "joined_distinct", "sorted_distinct"]
