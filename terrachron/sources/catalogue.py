"""Release catalogues and tile maps from recorded documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import lenient_date
from ..functions.values import optional_float, optional_int, optional_text

_LAYER = "struct<Title:string,Identifier:string,ResourceURL:struct<_template:string>,TileMatrixSetLink:array<struct<TileMatrixSet:string>>>"
_DOCUMENT = f"struct<Contents:struct<Layer:array<{_LAYER}>>>"
DEFAULT_MATRIX_SET = "default028mm"


def releases(documents: DataFrame) -> DataFrame:
    """``pos, layer_id, release_id, release_date, title, template, matrix_set`` from ``documents(body string)``.

    ``body`` is a capabilities document. Layers without title, identifier or
    address, without a date in the title, without the imagery mark in the address, or
    whose address has no whole number after ``/MapServer/tile/`` are left out. ``pos`` is
    the document's order, the newest first, from 1. A document that can't be read, or
    has no contents, is an error when it runs, so that it is no empty catalogue.
    """
    plain = F.regexp_replace(F.col("body").cast("string"), r"(</?)\w+:", "$1")
    root = F.from_xml(plain, F.lit(_DOCUMENT), {"attributePrefix": "_"})
    bad = F.raise_error(F.lit("a capabilities document can't be read or has no contents")).cast("boolean")
    whole = F.rlike(plain, F.lit(r"<Contents[\s/>]")) & F.rlike(plain, F.lit(r"</Capabilities>\s*$"))
    read = documents.withColumn("root", root).where(F.when(F.coalesce(whole & F.col("root").isNotNull(), F.lit(False)), F.lit(True)).otherwise(bad))
    rows = read.select(F.posexplode("root.Contents.Layer").alias("at", "x"))
    url = F.col("x.ResourceURL._template")
    number = F.regexp_extract(url, r"/MapServer/tile/([^/]*)/", 1)
    day = F.regexp_extract("x.Title", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    out = rows.select(
        F.when(F.rlike(number, F.lit(r"^\d+$")), number).try_cast("int").alias("layer_id"),
        F.trim("x.Identifier").alias("release_id"),
        day.alias("release_date"),
        F.trim("x.Title").alias("title"),
        url.alias("template"),
        F.coalesce(F.try_element_at("x.TileMatrixSetLink", F.lit(1))["TileMatrixSet"], F.lit(DEFAULT_MATRIX_SET)).alias("matrix_set"),
        "at",
    )
    ok = out.dropna(subset=["layer_id", "release_id", "release_date", "title", "template"]).where(F.contains("template", F.lit("/World_Imagery")))
    ranked = ok.groupBy().agg(F.array_sort(F.collect_list(F.struct("at", *[c for c in ok.columns if c != "at"]))).alias("all"))
    return ranked.select(F.posexplode("all").alias("p", "r")).select((F.col("p") + 1).cast("long").alias("pos"), "r.layer_id", "r.release_id", "r.release_date", "r.title", "r.template", "r.matrix_set")


def tilemaps(payloads: DataFrame) -> DataFrame:
    """``payloads(..., body)`` with ``has`` (0 or 1) and ``sel``; a body that can't be read has neither imagery nor a skip."""
    x = F.from_json(F.col("body").cast("string"), "data array<int>, select array<int>")
    rest = [c for c in payloads.columns if c != "body"]
    return payloads.withColumn("x__", x).select(*rest, F.coalesce((F.try_element_at("x__.data", F.lit(1)) == 1).cast("int"), F.lit(0)).alias("has"), F.try_element_at("x__.select", F.lit(1)).alias("sel"))


def footprint_pages(payloads: DataFrame) -> DataFrame:
    """``release_id, object_id, capture_date, source, rings, complete`` from recorded query pages.

    ``payloads(release_id, body)``. Features without an id or a date are skipped; a
    page that can't be read gives one row without an id, marked incomplete.
    """
    names = ("OBJECTID", "SRC_DATE2", "SRC_RES", "SRC_ACC", "NICE_NAME", "NICE_DESC", "MinMapLevel", "MaxMapLevel")
    fields = ",".join(f"{n}:string" for n in names)
    page = F.from_json(F.col("body").cast("string"), f"error string, exceededTransferLimit boolean, features array<struct<attributes:struct<{fields}>,geometry:struct<rings:array<array<array<double>>>>>>")
    rows = payloads.select("release_id", page.alias("p"))
    bad = rows.where("p is null or p.error is not null or p.features is null")
    a = F.col("f.attributes")
    source = F.struct(
        optional_text(a["NICE_NAME"]).alias("provider"),
        optional_text(a["NICE_DESC"]).alias("description"),
        optional_float(a["SRC_RES"]).alias("resolution_m"),
        optional_float(a["SRC_ACC"]).alias("accuracy_m"),
        optional_int(a["MinMapLevel"]).alias("min_map_level"),
        optional_int(a["MaxMapLevel"]).alias("max_map_level"),
    )
    good = rows.where("p.error is null and p.features is not null").select("release_id", (~F.coalesce("p.exceededTransferLimit", F.lit(False))).alias("complete"), F.explode("p.features").alias("f"))
    out = good.select("release_id", a["OBJECTID"].try_cast("long").alias("object_id"), lenient_date(a["SRC_DATE2"]).alias("capture_date"), source.alias("source"), F.col("f.geometry.rings").alias("rings"), "complete")
    out = out.where("object_id is not null and capture_date is not null")
    lost = bad.select("release_id", F.lit(None).cast("long").alias("object_id"), F.lit(None).cast("date").alias("capture_date"), F.lit(None).cast(out.schema["source"].dataType).alias("source"), F.lit(None).cast(out.schema["rings"].dataType).alias("rings"), F.lit(False).alias("complete"))
    return out.unionByName(lost)


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``field, old_kind, new_kind, change, compatible`` of two schemas as rows ``(field, kind)``; only additions are compatible."""
    both = old.select("field", F.col("kind").alias("old_kind")).join(new.select("field", F.col("kind").alias("new_kind")), "field", "full_outer")
    change = F.when(F.col("old_kind").isNull(), "added").when(F.col("new_kind").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old_kind").eqNullSafe(F.col("new_kind"))).select("field", "old_kind", "new_kind", change.alias("change"), F.col("old_kind").isNull().alias("compatible"))
