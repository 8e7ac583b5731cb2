"""Payload checks, mosaics by block, and overview levels.

Decoders are looked up by format; PNG and sequential JPEG are built in and others can be registered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import image_header, inflate, parse_packet, read_png, unmask, write_png
from ..functions.grids import TILE_PX
from ..functions.jpeg import read_jpeg

DECODERS: dict[str, Callable[[bytes], np.ndarray | None]] = {"png": read_png, "jpeg": read_jpeg}


def inspect(content):
    """Column: ``struct<image_format, media_type, width, height>`` of a payload, null if it is none."""

    @F.pandas_udf("image_format string, media_type string, width int, height int")
    def read(data: pd.Series) -> pd.DataFrame:
        found = [image_header(bytes(d)) if d is not None else None for d in data]
        return pd.DataFrame([f or (None,) * 4 for f in found], columns=["image_format", "media_type", "width", "height"])

    return read(content)


def is_tile(info):
    """A payload is a tile if it is an image of one tile's size."""
    return F.coalesce((info["width"] == TILE_PX) & (info["height"] == TILE_PX), F.lit(False))


def decode(data: bytes | None) -> np.ndarray | None:
    info = image_header(data)
    px = DECODERS[info[0]](data) if info and info[0] in DECODERS else None
    return px if px is not None and px.shape[:2] == (TILE_PX, TILE_PX) else None


def first_decodable(candidates: DataFrame, tile: tuple[str, ...] = ("tile_col", "tile_row")) -> DataFrame:
    """Each tile's first candidate, by ``rank``, whose ``content`` is a tile that can be read; the later ones are not.

    Candidates of a tile come to one task in order, and one row is held at a time. The
    number of tasks is stated: reading pixels takes long for few bytes.
    """

    def run(batches):
        done = None
        for b in batches:
            keys, keep = list(zip(*(b.column(c).to_pylist() for c in tile))), []
            for key, data in zip(keys, b.column("content")):
                ok = key != done and data.is_valid and decode(data.as_py()) is not None
                done = key if ok else done
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_()))

    n = max(1, int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = candidates.repartition(n, *tile).sortWithinPartitions(*tile, "rank")
    return dealt.mapInArrow(run, candidates.schema)


def mosaic_blocks(tiles: DataFrame, window: tuple[int, int, int, int], block: int = 1024) -> DataFrame:
    """``block_x, block_y, width, height, pixels, mask``: the raster of a pixel window in blocks.

    ``tiles(left, top, content)`` gives each tile's first pixel in the level. Tiles go
    to the blocks they overlap by arithmetic, so no task holds more than one block
    and no buffer of the whole raster exists. Payloads that can't be decoded leave
    their pixels unset.
    """
    x0, y0, x1, y1 = window
    span = lambda a, z, lo: F.sequence(F.floor((F.greatest(a, F.lit(lo)) - lo) / block).cast("int"), F.floor((F.least(a + TILE_PX, F.lit(z)) - 1 - lo) / block).cast("int"))
    own = tiles.where((F.col("left") < x1) & (F.col("left") + TILE_PX > x0) & (F.col("top") < y1) & (F.col("top") + TILE_PX > y0))
    dealt = own.withColumn("block_x", F.explode(span(F.col("left"), x1, x0))).withColumn("block_y", F.explode(span(F.col("top"), y1, y0)))

    def paste(pdf: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(pdf.block_x.iloc[0]), int(pdf.block_y.iloc[0])
        ox, oy = x0 + bx * block, y0 + by * block
        w, h = min(block, x1 - ox), min(block, y1 - oy)
        px, mask = np.zeros((h, w, 3), np.uint8), np.zeros((h, w), np.uint8)
        for left, top, data in zip(pdf.left, pdf.top, pdf.content):
            image = decode(bytes(data)) if data is not None else None
            if image is None:
                continue
            a, b = max(left, ox), max(top, oy)
            c, d = min(left + TILE_PX, ox + w), min(top + TILE_PX, oy + h)
            if a < c and b < d:
                px[b - oy : d - oy, a - ox : c - ox] = image[b - top : d - top, a - left : c - left]
                mask[b - oy : d - oy, a - ox : c - ox] = 255
        return pd.DataFrame({"block_x": [bx], "block_y": [by], "width": [w], "height": [h], "pixels": [px.tobytes()], "mask": [mask.tobytes()]})

    return dealt.select("block_x", "block_y", "left", "top", "content").groupBy("block_x", "block_y").applyInPandas(paste, "block_x int, block_y int, width int, height int, pixels binary, mask binary")


def _kernel() -> np.ndarray:
    """Weights of a three-lobed windowed sinc for halving, over twelve source pixels."""
    x = (np.arange(12) - 5.5) / 2
    w = np.sinc(x) * np.sinc(x / 3)
    return w / w.sum()


def halve(px: np.ndarray) -> np.ndarray:
    """Half the size along both axes, edges repeated."""
    out = px.astype(float)
    for axis in (0, 1):
        # the pair of pixels 2j, 2j+1 stands in the middle of twelve: five before it and five after
        padded = np.pad(out, [(5, 5) if a == axis else (0, 0) for a in range(out.ndim)], mode="edge")
        n = out.shape[axis] // 2
        out = sum(k * np.take(padded, np.arange(n) * 2 + i, axis) for i, k in enumerate(_kernel()))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def overview(tiles: DataFrame) -> DataFrame:
    """``zoom, column, row, content`` one level up: every four tiles become one PNG tile."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        px, mask = np.zeros((2 * TILE_PX, 2 * TILE_PX, 3), np.uint8), np.zeros((2 * TILE_PX, 2 * TILE_PX), np.uint8)
        for c, r, data in zip(pdf.column, pdf.row, pdf.content):
            image = decode(bytes(data))
            if image is not None:
                at = (slice((r % 2) * TILE_PX, (r % 2 + 1) * TILE_PX), slice((c % 2) * TILE_PX, (c % 2 + 1) * TILE_PX))
                px[at], mask[at] = image, 255
        small = np.dstack([halve(px), halve(mask)])
        return pd.DataFrame({"zoom": [int(pdf.zoom.iloc[0]) - 1], "column": [int(pdf.column.iloc[0]) // 2], "row": [int(pdf.row.iloc[0]) // 2], "content": [write_png(small if mask.min() == 0 else small[..., :3])]})

    keyed = tiles.withColumn("c2", F.expr("shiftright(column, 1)")).withColumn("r2", F.expr("shiftright(row, 1)"))
    return keyed.select("zoom", "column", "row", "content", "c2", "r2").groupBy("c2", "r2").applyInPandas(merge, "zoom int, column long, row long, content binary")


def packets(payloads: DataFrame, key: bytes | None = None) -> DataFrame:
    """``path, packet_epoch, number, children, cache_node_epoch, layers`` from ``payloads(path, body)``.

    Bodies are unmasked with ``key`` if it is given, and inflated. A body that can't
    be read gives no rows, like a tile without history.
    """
    schema = "path string, packet_epoch int, number int, children int, cache_node_epoch int, layers array<struct<type:int,epoch:int,provider:int>>"
    layer = pa.list_(pa.struct([("type", pa.int32()), ("epoch", pa.int32()), ("provider", pa.int32())]))

    def run(batches):
        for b in batches:
            rows = []
            for path, body in zip(b.column("path").to_pylist(), b.column("body").to_pylist()):
                try:
                    epoch, nodes = parse_packet(inflate(unmask(body, key) if key else body), path == "0")
                except Exception:  # noqa: BLE001  any damage means no nodes, as for a missing payload
                    continue
                rows += [(path, epoch, n, c, e, [dict(zip(("type", "epoch", "provider"), x)) for x in ls]) for n, c, e, ls in nodes]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.record_batch([pa.array(cols[0], pa.string()), *[pa.array(cols[i], pa.int32()) for i in range(1, 5)], pa.array(cols[5], layer)], ["path", "packet_epoch", "number", "children", "cache_node_epoch", "layers"])

    return payloads.select("path", "body").mapInArrow(run, schema)
