"""Choice of versions by date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import as_date, check_match, matches, nearest_first

TILE = ("tile_col", "tile_row", "zoom")


def ranked(versions: DataFrame, target: Column | str | dt.date, match: str = "closest", ties: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of every tile with ``rank`` from 1, the best first; ``ties`` order equals."""
    check_match(match)
    target = target if isinstance(target, Column) else F.lit(as_date(target))
    day = F.col("capture_date")
    order = Window.partitionBy(*TILE).orderBy(*nearest_first(day, target), *ties)
    return versions.where(matches(day, target, match)).withColumn("rank", F.row_number().over(order))


def nearest(versions: DataFrame, target: Column | str | dt.date, match: str = "closest", ties: tuple[str, ...] = ()) -> DataFrame:
    """The best candidate of every tile. The rank limit is pushed below the exchange by Spark,
    so each task sends one row a tile."""
    return ranked(versions, target, match, ties).where("rank = 1").drop("rank")


def first_usable(candidates: DataFrame, ok: Column, payload: str = "content") -> DataFrame:
    """The first candidate by ``rank`` of every tile whose payload is usable; tiles without one are left out."""
    best = F.min_by(F.struct("rank", payload, "capture_date"), F.when(ok, F.col("rank")))
    out = candidates.groupBy(*TILE).agg(best.alias("b"), F.count_if(ok).alias("n"))
    return out.where("n > 0").select(*TILE, "b.*")


def missing_tiles(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Wanted tiles that nothing was found for."""
    return wanted.join(found.select(*TILE).distinct(), list(TILE), "left_anti")


def require_all(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """``found``, or an error when it runs if a wanted tile has no row (the strict path)."""
    state = wanted.select(*TILE).distinct().join(found.withColumn("there__", F.lit(True)), list(TILE), "left")
    return state.where(F.when(F.col("there__"), F.lit(True)).otherwise(F.raise_error(F.lit("no version of a selected tile")).cast("boolean"))).drop("there__")


def uncovered(rows: DataFrame, of: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The distinct keys of ``of`` that ``rows`` lacks; none if ``rows`` is a superset."""
    return of.select(*keys).distinct().join(rows.select(*keys).distinct(), list(keys), "left_anti")
