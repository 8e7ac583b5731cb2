"""Images: the JPEG decoder against the engine's own, fallbacks, overviews."""

import numpy as np
import pytest

from terrachron.functions import codecs as C
from terrachron.functions import grids as G
from terrachron.functions.jpeg import read_jpeg
from terrachron.operators import raster as R
from terrachron.plans.requests import Catalog


@pytest.fixture(scope="module")
def image_io(spark):
    jvm = spark._jvm

    def encode(px, kind=1):
        h, w = px.shape[:2]
        image = jvm.java.awt.image.BufferedImage(w, h, kind)
        values = spark.sparkContext._gateway.new_array(jvm.int, w * h)
        for i, (r, g, b) in enumerate(px.reshape(-1, 3).tolist()):
            values[i] = r << 16 | g << 8 | b
        image.setRGB(0, 0, w, h, values, 0, w)
        out = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(image, "jpg", out)
        return bytes(out.toByteArray())

    def decode(data):
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
        w, h = image.getWidth(), image.getHeight()
        v = np.array(list(image.getRGB(0, 0, w, h, None, 0, w))).reshape(h, w)
        return np.dstack([v >> 16 & 255, v >> 8 & 255, v & 255])

    return encode, decode


@pytest.mark.parametrize("shape", [(16, 16), (23, 41), (8, 64)])
def test_jpeg_is_that_of_another_decoder(image_io, shape):
    encode, decode = image_io
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    px = np.dstack([128 + 100 * np.sin(x / 9), 128 + 100 * np.cos(y / 7), 60 + x + y]).clip(0, 255).astype(np.uint8)
    data = encode(px)
    got = read_jpeg(data)
    assert got.shape == px.shape and np.abs(got.astype(int) - decode(data)).mean() < 4
    assert all(read_jpeg(data[:n]) is None for n in (0, 2, 100, len(data) // 2, len(data) - 2))
    assert read_jpeg(b"no image") is None
    grey = read_jpeg(encode(px, 10))
    assert (grey[..., 0] == grey[..., 1]).all() and (grey[..., 0] == grey[..., 2]).all()


def test_raster_takes_the_next_candidate(spark, image_io):
    encode, _ = image_io
    zoom, col, row = 17, 20975, 50653
    good = encode(np.full((256, 256, 3), (10, 200, 60), np.uint8))
    png = C.write_png(np.full((256, 256, 3), 7, np.uint8))
    bodies = [("a", bytearray(png[: len(png) // 2])), ("b", bytearray(good)), ("c", bytearray(good[:500])), ("d", bytearray(b"none"))]
    payloads = spark.createDataFrame(bodies, "key string, body binary")
    versions = spark.createDataFrame(
        [(col, row, zoom, "2001-01-01", "p", "a"), (col, row, zoom, "2002-01-01", "p", "b"), (col + 1, row, zoom, "2001-01-01", "p", "c"), (col + 1, row, zoom, "2002-01-01", "p", "d")],
        "tile_col int, tile_row int, zoom int, capture_date string, provider string, key string",
    ).selectExpr("tile_col", "tile_row", "zoom", "cast(capture_date as date) as capture_date", "provider", "key", "named_struct('provider', provider, 'resolution_m', 0.5D) as source")
    b = spark.range(1).select(*[v.alias(k) for k, v in G.bounds(G.MERCATOR, *(__import__("pyspark").sql.functions.lit(x) for x in (col, row)), zoom).items()]).first()
    width = b.east - b.west
    catalog = Catalog(spark, "esri", versions=versions, payloads=payloads)
    answer = catalog.raster(G.Box(b.west + width / 10, b.south + 1e-5, b.east + width / 2, b.north - 1e-5), zoom, "2001-01-01")
    meta = answer.meta.first()
    assert (meta.n_tiles, meta.n_missing, meta.dates) == (1, 1, "2002-01-01") and meta.sources == '[{"provider":"p","resolution_m":0.5}]'
    masks = [np.frombuffer(r.mask, np.uint8) for r in answer.df.collect()]
    assert sum((m > 0).sum() for m in masks) > 0
    nothing = catalog.raster(G.Box(b.east + width * 0.1, b.south + 1e-5, b.east + width * 0.9, b.north - 1e-5), zoom, "2001-01-01")
    with pytest.raises(Exception, match="no imagery found"):
        nothing.meta.collect()


def test_halving_is_even():
    """A filter without a side: mirrored pixels give mirrored halves, a flat image stays flat."""
    px = np.random.default_rng(1).integers(0, 256, (64, 64, 3)).astype(np.uint8)
    assert np.abs(R.halve(px[::-1, ::-1]).astype(int) - R.halve(px)[::-1, ::-1]).max() <= 1
    assert (R.halve(np.full((8, 8, 3), 77, np.uint8)) == 77).all()


@pytest.mark.parametrize("provider,zoom", [("esri", 17), ("google", 17)])
def test_geotiff_is_read_by_another_reader(spark, image_io, tmp_path, provider, zoom):
    encode, _ = image_io
    lit = __import__("pyspark").sql.functions.lit
    scheme = G.PROVIDER_SCHEME[provider]
    col, row = 20975, 50653 if scheme == G.MERCATOR else 79000
    colours = {0: (90, 120, 60), 1: (30, 160, 220)}
    payloads = spark.createDataFrame([(str(k), bytearray(encode(np.full((256, 256, 3), c, np.uint8)))) for k, c in colours.items()], "key string, body binary")
    versions = spark.createDataFrame([(col + k, row, zoom, "p", str(k)) for k in colours], "tile_col int, tile_row int, zoom int, provider string, key string").selectExpr("*", "date'2001-01-01' as capture_date")
    b = spark.range(1).select(*[v.alias(k) for k, v in G.bounds(scheme, lit(col), lit(row), zoom).items()]).first()
    w = b.east - b.west
    box = G.Box(b.west + w / 4, b.south + (b.north - b.south) / 4, b.east + w * 1.5, b.north - (b.north - b.south) / 4)
    catalog, path = Catalog(spark, provider, versions=versions, payloads=payloads), tmp_path / "mosaic.tif"
    assert catalog.geotiff(box, zoom, str(path), "2001-01-01", block=64) == 7 * 2
    data = path.read_bytes()
    assert b"<Item name=\"dates\">2001-01-01</Item>" in data and b"tiles_missing\">1<" in data
    jvm = spark._jvm
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("tiff").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.File(str(path))))
    assert reader.getNumImages(True) == 2
    image, mask = reader.read(0), reader.read(1)
    assert (image.getWidth(), image.getHeight()) == (192 + 256 + 128, 128) == (mask.getWidth(), mask.getHeight())
    at = lambda x: tuple(image.getRGB(x, 5) >> s & 255 for s in (16, 8, 0))
    seen = lambda x: mask.getRaster().getSample(x, 5, 0)
    assert at(3) == colours[0] and at(191) == colours[0] and at(192) == colours[1] and at(447) == colours[1]
    assert [seen(x) for x in (0, 191, 447, 448, 575)] == [1, 1, 1, 0, 0]
    scale = np.frombuffer(data, np.float64, 3, data.index(np.float64(G.EQUATOR_METRES / (256 << zoom) if scheme == G.MERCATOR else 360 / (256 << zoom)).tobytes()))
    assert scale[0] == scale[1] and scale[2] == 0
    with pytest.raises(FileExistsError):
        catalog.geotiff(box, zoom, str(path), "2001-01-01", block=64)
