"""Lenient values, provenance records, keys and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE = "struct<provider:string,description:string,resolution_m:double,accuracy_m:double,min_map_level:int,max_map_level:int>"


def optional_text(value: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def optional_float(value: Column) -> Column:
    """A finite double; anything else is null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def optional_int(value: Column) -> Column:
    """A whole number: text only in digits, numbers cut towards zero."""
    return value.try_cast("int")


def provenance_json(source: Column) -> Column:
    """A source record as JSON with its nulls and its field order."""
    return F.to_json(source, {"ignoreNullFields": "false"})


def joined_distinct(value: Column, sep: str = ", ") -> Column:
    """Aggregate: the sorted distinct values that are not null or empty, as one text."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(value, F.lit("")))), sep)


def sorted_distinct(value: Column) -> Column:
    """Aggregate: the sorted distinct values that are not null; an empty array if there are none."""
    return F.array_sort(F.collect_set(value))


def cache_key(url: Column, form: Column | None = None) -> Column:
    """The key of a stored response: sha256 of the url, with a form's sorted fields after a NUL."""
    if form is None:
        return F.sha2(url, 256)
    fields = F.array_join(F.transform(F.array_sort(F.map_entries(form)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return F.sha2(F.concat(url, F.lit("\x00"), fields), 256)


def metadata_scale(level: Column) -> Column:
    """The scale of the footprint layer that serves a zoom."""
    return F.least(F.lit(13), F.lit(23) - level)


def tile_url(template: Column, matrix_set: Column, level: Column, row: Column, col: Column) -> Column:
    """A release's address template filled in."""
    out = F.replace(template, F.lit("{TileMatrixSet}"), matrix_set)
    for name, x in (("{TileMatrix}", level), ("{TileRow}", row), ("{TileCol}", col)):
        out = F.replace(out, F.lit(name), x.cast("string"))
    return out


def tilemap_url(root: Column, release: Column, level: Column, row: Column, col: Column) -> Column:
    return F.concat_ws("/", root, F.lit("tilemap"), release, level, row, col)


def query_string(fields: dict[str, Column]) -> Column:
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in fields.items()])


def asset_key(path: Column, epoch: Column, packed: Column) -> Column:
    """The name of a dated image: tile path, epoch and the packed date in lower-case hex; without a date the default image."""
    plain = F.concat(F.lit("f1-"), path, F.lit("-i."), epoch.cast("string"))
    return F.when(packed.isNull(), plain).otherwise(F.concat(plain, F.lit("-"), F.lower(F.hex(packed.cast("long")))))


def generalisation(level: Column) -> tuple[Column, Column]:
    """Half a pixel in metres, and the decimals that keep a tenth of one, for a zoom's footprints."""
    px = F.lit(40075016.68557849) / (F.pow(F.lit(2.0), level) * 256)
    return px / 2, F.greatest(F.lit(0), F.ceil(-F.log10(px / 10))).cast("int")


def metadata_query_url(root: Column, layer: Column, level: Column) -> Column:
    """The footprint layer's query address for a release and zoom."""
    return F.concat_ws("/", root, layer.cast("string"), F.lit("MapServer"), metadata_scale(level).cast("string"), F.lit("query"))


def packet_url(path: Column, epoch: Column, database: str | None = None) -> Column:
    """The address of a quadtree packet, of the default imagery or of a named database."""
    if database is None:
        return F.concat(F.lit("https://kh.google.com/flatfile?q2-"), path, F.lit("-q."), epoch.cast("string"))
    return F.concat(F.lit(f"https://khmdb.google.com/flatfile?db={database}&qp-"), path, F.lit("-q."), epoch.cast("string"))


def root_url(database: str | None = None) -> str:
    """The address of a database's root document."""
    named = f"db={database}" if database else ""
    return f"https://khmdb.google.com/dbRoot.v5?{named}&hl=en&gl=us&output=proto"


def sources_json(source: Column) -> Column:
    """Aggregate: the distinct source records as one JSON list, by their text; null if there are none."""
    each = F.array_sort(F.collect_set(F.to_json(source, {"ignoreNullFields": "false"})))
    return F.when(F.size(each) > 0, F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))
