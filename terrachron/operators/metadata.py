"""Point metadata: what a release says about the imagery at the centre of a tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import lenient_date
from ..functions.values import optional_float, optional_int, optional_text
from .history import TILE, change_history, skip_chain

# The fields of a recorded answer.
_FIELDS = ("SRC_DATE2", "SRC_RES", "SRC_ACC", "NICE_NAME", "NICE_DESC", "MinMapLevel", "MaxMapLevel")
_ANSWER = f"features array<struct<attributes:struct<{','.join(f'{f}:string' for f in _FIELDS)}>>>"


def source_of(a: Column) -> Column:
    """A source record from the attributes of a recorded feature."""
    return F.struct(
        optional_text(a["NICE_NAME"]).alias("provider"),
        optional_text(a["NICE_DESC"]).alias("description"),
        optional_float(a["SRC_RES"]).alias("resolution_m"),
        optional_float(a["SRC_ACC"]).alias("accuracy_m"),
        optional_int(a["MinMapLevel"]).alias("min_map_level"),
        optional_int(a["MaxMapLevel"]).alias("max_map_level"),
    )


def point_metadata(payloads: DataFrame) -> DataFrame:
    """``payloads(release, tile, body)`` as ``release, tile, capture_date, source``: the first feature's.

    Answers without a feature, or without a date in it, give no row: a release date
    is never taken for a capture date. Repeats of a key give one row.
    """
    answer = F.from_json(F.col("body").cast("string"), _ANSWER)
    a = F.try_element_at(answer["features"], F.lit(1))["attributes"]
    rest = [c for c in payloads.columns if c != "body"]
    rows = payloads.select(*rest, lenient_date(a["SRC_DATE2"]).alias("capture_date"), source_of(a).alias("source"))
    return rows.where("capture_date is not null").dropDuplicates(rest)


def with_metadata(rows: DataFrame, metadata: DataFrame, on: list[str], required: bool = True) -> DataFrame:
    """``rows`` with the capture date and source of their key; those without are left out, or stay undated."""
    return rows.join(metadata, on, "inner" if required else "left")


def dated_tiles(tilemaps: DataFrame, metadata: DataFrame) -> DataFrame:
    """``tile, pos, effective, capture_date, source``: a tile's distinct versions, newest first.

    The releases that the skips lead to, dated by the effective release's answer,
    without those that have none, and of every run of equal dates the earliest.
    """
    looked = skip_chain(tilemaps)
    dated = looked.join(metadata.withColumnRenamed("pos", "effective"), [*TILE, "effective"])
    return change_history(dated)


def undated_if_not_asked(rows: DataFrame, include_metadata: bool) -> DataFrame:
    """``rows`` as they are, or with their capture date and source left out."""
    if include_metadata:
        return rows
    none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("capture_date", "source") if c in rows.columns}
    return rows.withColumns(none)


def titles_by_date(footprints: DataFrame, releases: DataFrame) -> DataFrame:
    """``capture_date, titles``: the distinct titles of the releases that the footprints of a date were taken from, in order.

    ``footprints(release_id, capture_date)`` and ``releases(release_id, title)``.
    """
    named = footprints.join(releases.select("release_id", "title"), "release_id")
    return named.groupBy("capture_date").agg(F.array_join(F.array_sort(F.collect_set(F.nullif("title", F.lit("")))), ", ").alias("titles"))


def source_or_name(source: Column, name: Column) -> Column:
    """A candidate's own source record, else one of its provider's name alone, else null."""
    kind = "struct<provider:string,description:string,resolution_m:double,accuracy_m:double,min_map_level:int,max_map_level:int>"
    none = {"description": "string", "resolution_m": "double", "accuracy_m": "double", "min_map_level": "int", "max_map_level": "int"}
    named = F.struct(F.nullif(name, F.lit("")).alias("provider"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    return F.coalesce(source.cast(kind), F.when(F.nullif(name, F.lit("")).isNotNull(), named))
