"""Lookups in the release catalogue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import as_date

RELEASE = ("release_id", "release_date", "pos")


def catalogue(releases: DataFrame) -> DataFrame:
    """All releases, newest first."""
    return releases.select("release_id", "release_date", "pos").orderBy(F.desc("release_date"), F.desc("release_id"))


def as_of(releases: DataFrame, day: str | dt.date) -> DataFrame:
    """The latest release on or before a day; an error when it runs if there is none, which names the earliest."""
    order = F.struct("release_date", "release_id")
    old = F.when(F.col("release_date") <= F.lit(as_date(day)), order)
    one = releases.agg(F.max_by(F.struct(*RELEASE), old).alias("r"), F.min("release_date").alias("first"))
    earliest = F.coalesce(F.concat(F.lit("; the earliest release is "), F.col("first").cast("string")), F.lit(""))
    none = F.raise_error(F.concat(F.lit(f"no release on or before {as_date(day)}"), earliest)).cast("boolean")
    return one.where(F.when(F.col("r").isNotNull(), F.lit(True)).otherwise(none)).select("r.*")


def exact(releases: DataFrame, release_id: str) -> DataFrame:
    """One release by its identifier; an error when it runs if it is unknown."""
    one = releases.where(F.col("release_id") == release_id).agg(F.first(F.struct(*RELEASE)).alias("r"))
    none = F.raise_error(F.lit(f"unknown release {release_id}")).cast("boolean")
    return one.where(F.when(F.col("r").isNotNull(), F.lit(True)).otherwise(none)).select("r.*")


def as_of_each(rows: DataFrame, releases: DataFrame, day: Column) -> DataFrame:
    """``rows`` with the latest release on or before each one's ``day``; null fields where there is none.

    The days are reduced to the distinct ones, ordered together with the releases,
    and each takes the last release before it from a window over months: a day looks
    back in its own month, and to one carried release at the start of it. So neither
    a nested-loop join nor a single sorted partition of the rows is needed.
    """
    rows = rows.withColumn("day__", day)
    days = rows.select(F.col("day__").alias("d")).where("d is not null").distinct()
    line = F.array_sort(F.collect_list(F.struct("release_date", "release_id", "pos"))).alias("line")
    by_month = releases.groupBy(F.trunc("release_date", "month").alias("m")).agg(line)
    last = by_month.select("m", F.element_at("line", -1).alias("last"))
    months = days.select(F.trunc("d", "month").alias("m")).distinct()
    upto = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)  # one row a month, of all time
    carried = months.join(last, "m", "full_outer").withColumn("before", F.last("last", True).over(upto)).select("m", "before")
    found = days.withColumn("m", F.trunc("d", "month")).join(by_month, "m", "left").join(carried, "m", "left")
    here = F.filter(F.coalesce("line", F.array().cast("array<struct<release_date:date,release_id:string,pos:bigint>>")), lambda r: r["release_date"] <= F.col("d"))
    best = F.when(F.size(here) > 0, F.try_element_at(here, F.lit(-1))).otherwise(F.col("before").cast("struct<release_date:date,release_id:string,pos:bigint>"))
    found = found.select("d", best.alias("r")).select("d", "r.release_id", "r.release_date")
    return rows.join(found, rows.day__ == found.d, "left").drop("day__", "d")


def earliest_per_date(listing: DataFrame) -> DataFrame:
    """``capture_date, release_id, release_date``: the first release that lists each capture date.

    Equal release dates go by release id, so the choice does not depend on order of arrival.
    """
    best = F.min(F.struct("release_date", "release_id"))
    return listing.where(F.col("capture_date").isNotNull()).groupBy("capture_date").agg(best.alias("b")).select("capture_date", "b.release_id", "b.release_date")


def batches(ids: DataFrame, size: int = 100) -> DataFrame:
    """``release_id, object_id, batch``: the ids of each release in lots of ``size``, in order."""
    order = Window.partitionBy("release_id").orderBy("object_id")
    return ids.select("release_id", "object_id").distinct().withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("long"))


def require_complete(listing: DataFrame) -> DataFrame:
    """``listing``, or an error when it runs if any part of it is marked incomplete."""
    bad = F.raise_error(F.lit("a listing is incomplete")).cast("boolean")
    return listing.where(F.when(F.col("complete"), F.lit(True)).otherwise(bad))


def at_most(rows: DataFrame, limit: int, what: str = "footprints") -> DataFrame:
    """``rows``, or an error if there are more than ``limit``; at most ``limit + 1`` are counted."""
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} {what}; use a smaller area or a higher limit")
    return rows
