import datetime as dt
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrachron.functions import archive as A
from terrachron.functions import codecs as C
from terrachron.functions import dates as D
from terrachron.functions import geometry as Y
from terrachron.functions import grids as G
from terrachron.functions import values as X


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize("row,col,level,path", [(0, 0, 0, "0"), (0, 1, 1, "01"), (1, 1, 1, "02"), (1, 0, 1, "03"), (475, 877, 10, "01232132132")])
def test_paths_go_both_ways(spark, row, col, level, path):
    c, r, z = G.path_position(F.lit(path))
    got = one(spark, p=G.path(F.lit(col).cast("long"), F.lit(row).cast("long"), level), c=c, r=r, z=z)
    assert tuple(got) == (path, col, row, level)


def test_packet_numbers(spark):
    got = one(
        spark,
        a=G.root_subindex(F.lit("00")),
        b=G.root_subindex(F.lit("0000")),
        c=G.tree_subindex(F.lit("0")),
        d=G.tree_subindex(F.lit("3")),
        e=G.index_paths(F.lit("0123213213012")),
        f=G.index_paths(F.lit("012")),
        g=G.parent(F.lit("012")),
        h=G.parent(F.lit("0")),
    )
    assert tuple(got)[:4] == (1, 21, 1, 256)
    assert got.e == ["0123", "01232132", "012321321301"] and got.f == [] and (got.g, got.h) == ("01", None)


@pytest.mark.parametrize("bad", ["1", "01234", "", " 02322"])
def test_bad_paths(spark, bad):
    assert not one(spark, ok=G.valid_path(F.lit(bad))).ok


def test_points(spark):
    cases = [(0.0, 0.0, 1, 1, 1), (0.0, -1e-8, 1, 1, 0), (0.0, 90.0, 1, 1, 1), (180.0, 90.0, 3, 7, 6), (-180.0, -90.0, 3, 0, 2)]
    for lon, lat, z, c, r in cases:
        col, row = G.tile_of_point(G.KEYHOLE, F.lit(lon), F.lit(lat), z)
        assert tuple(one(spark, c=col, r=row)) == (c, r)
    col, row = G.tile_of_point(G.MERCATOR, F.lit(180.0), F.lit(-90.0), 4)
    assert tuple(one(spark, c=col, r=row)) == (15, 15)


def test_mercator_bounds(spark):
    b = one(spark, **G.bounds(G.MERCATOR, F.lit(0), F.lit(0), 1))
    assert b.west == -180 and b.south == pytest.approx(0) and b.north == pytest.approx(85.0511, abs=1e-4)


def test_levels_and_zooms():
    for args in (("keyhole", -1), ("keyhole", 31), ("mercator", 24), ("other", 1), ("mercator", True)):
        with pytest.raises(ValueError):
            G.check_level(*args)
    assert G.check_zooms([3, 1, 3]) == [1, 3] and G.check_zooms(5) == [5]
    for bad in (True, "5", [True]):
        with pytest.raises(TypeError):
            G.check_zooms(bad)
    with pytest.raises(ValueError):
        G.check_zooms([21])
    for z, provider in ((22, "google"), (21, "esri")):
        with pytest.raises(ValueError):
            G.check_zoom(provider, z)
    assert G.check_zoom("nobody", 99) == 99


@pytest.mark.parametrize("box", [(0, 0, 0, 1), (1, 0, 0, 1), (-181, 0, 1, 1), (0, -91, 1, 1)])
def test_bad_areas(box):
    with pytest.raises(ValueError):
        G.Box(*box)


@settings(max_examples=40, deadline=None)
@given(st.floats(-179, 178), st.floats(-84, 83), st.floats(0.001, 1), st.floats(0.001, 1))
def test_tile_range_holds_the_box(west, south, w, h):
    box = G.Box(west, south, west + w, south + h)
    for scheme in G.SCHEMES:
        c0, c1, r0, r1 = box.tile_range(scheme, 9)
        x0, y0, x1, y1 = box.units(scheme, 9)
        assert c0 <= x0 and x1 <= c1 + 1 and r0 <= y0 + 1e-9 and y1 <= r1 + 1 + 1e-9


def test_window_has_a_pixel(spark):
    lit = [F.lit(x) for x in (10.0, 10.0, 10.0000001, 10.0000001)]
    for scheme in G.SCHEMES:
        w = one(spark, **G.pixel_window(scheme, *lit, 5))
        assert w.right == w.left + 1 and w.bottom == w.top + 1


@pytest.mark.parametrize("day", ["1938-08-01", "1993-07-10", "2023-04-30", "2000-12-31"])
def test_packed_dates(spark, day):
    got = one(spark, p=D.packed_date(D.pack_date(F.lit(day).cast("date"))))
    assert got.p == dt.date.fromisoformat(day)


def test_packed_dates_that_do_not_exist(spark):
    none = [0, (2001 << 9) + (2 << 5) + 30, (2001 << 9) + (13 << 5) + 1, (2001 << 9) + (1 << 5)]
    assert [one(spark, p=D.packed_date(F.lit(x))).p for x in none] == [None] * 4


def test_lenient_dates(spark):
    for text, day in (("2010-10-26T00:00:00", dt.date(2010, 10, 26)), ("1288051200000", dt.date(2010, 10, 26)), ("soon", None), (None, None)):
        assert one(spark, d=D.lenient_date(F.lit(text).cast("string"))).d == day
    assert D.as_date(dt.datetime(2020, 1, 2, 3)) == dt.date(2020, 1, 2) == D.as_date("2020-01-02")
    with pytest.raises(ValueError):
        D.check_match("nearest")


def test_lenient_values(spark):
    got = one(
        spark,
        a=X.optional_text(F.lit("  ")), b=X.optional_text(F.lit(" x ")), c=X.optional_float(F.lit("NaN")), d=X.optional_float(F.lit("inf")),
        e=X.optional_float(F.lit("0.5")), f=X.optional_int(F.lit("3.7")), g=X.optional_int(F.lit(3.7)), h=X.optional_int(F.lit("12")),
    )
    assert tuple(got) == (None, "x", None, None, 0.5, None, 3, 12)


def test_scales_and_urls(spark):
    for z, s in ((17, 6), (5, 13), (23, 0), (19, 4)):
        assert one(spark, s=X.metadata_scale(F.lit(z))).s == s
    url = X.tile_url(F.lit("http://t/{TileMatrixSet}/{TileMatrix}/{TileRow}/{TileCol}"), F.lit("m"), F.lit(3), F.lit(2), F.lit(1))
    assert one(spark, u=url).u == "http://t/m/3/2/1"
    assert one(spark, a=X.asset_key(F.lit("012"), F.lit(7), F.lit(1023))).a == "f1-012-i.7-3ff"
    assert one(spark, a=X.asset_key(F.lit("012"), F.lit(7), F.lit(None).cast("int"))).a == "f1-012-i.7"


def test_archive_addresses(spark):
    z, c, r = 5, 9, 20
    got = one(spark, **A.address(G.KEYHOLE, F.lit(c).cast("long"), F.lit(r).cast("long"), F.lit(z)))
    assert tuple(got) == (z - 1, c, 2**z - 1 - r - 2**z // 4)
    with pytest.raises(Exception):
        one(spark, **A.address(G.KEYHOLE, F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(5)))
    with pytest.raises(ValueError):
        A.matrix(G.KEYHOLE, 1)


def test_overview_factors():
    assert A.overview_factors(256, 256, 3) == [2, 4, 8]
    assert A.overview_factors(3, 1, 17) == [2, 4]
    assert A.overview_factors(1024, 512, 0) == []


def test_unmasking():
    key = bytes(range(1, 33)) * 3
    off, places = 16, []
    for _ in range(5000):
        places.append(off)
        off += 1
        if off % 8 == 0:
            off += 16
        if off >= len(key):
            off = (off + 8) % 24
    for n in (0, 1, 7, 100, 5000):
        assert C.key_places(n, len(key)).tolist() == places[:n]
    data = bytes(range(256)) * 3
    assert C.unmask(C.unmask(data, key), key) == data
    with pytest.raises(ValueError):
        C.unmask(b"x", b"")


def test_inflate_both_orders():
    body = b"tile" * 50
    assert C.inflate(C.deflate(body)) == body
    big = C.PACKED_MAGIC.to_bytes(4, "big") + len(body).to_bytes(4, "big") + zlib.compress(body)
    assert C.inflate(big) == body
    for bad in (b"", b"12345678", C.deflate(body)[:4] + (3).to_bytes(4, "little") + zlib.compress(body)):
        with pytest.raises(ValueError):
            C.inflate(bad)


def test_packets():
    image = 1 << C.IMAGE_BIT
    data = C.build_packet([(0b0011, 5, 0), (image, 0, 9), (0b1000, 6, 0), (image, 7, 8)], epoch=42)
    epoch, nodes = C.parse_packet(data, root=False)
    assert epoch == 42 and [n[0] for n in nodes] == [0, 1, 86, 90] and nodes[1][3] == [(0, 9, 0)]
    assert [n[0] for n in C.parse_packet(data, root=True)[1]] == [0, 1, 2, 12]
    for bad in (b"", b"x" * 32, data[:40]):
        with pytest.raises(ValueError):
            C.parse_packet(bad, False)


def test_png_round_trip():
    px = np.random.default_rng(1).integers(0, 255, (256, 256, 3), dtype=np.uint8)
    data = C.write_png(px)
    assert C.image_header(data) == ("png", "image/png", 256, 256)
    assert (C.read_png(data) == px).all()
    assert (C.read_png(C.write_png(px[..., 0]))[..., 2] == px[..., 0]).all()
    assert C.read_png(data[:200]) is None and C.image_header(b"nothing") is None and C.image_header(None) is None


def _area(polys):
    return sum(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2 for rings in polys for r in rings[:1])


def test_overlay_of_boxes():
    a, b = Y.box(0, 0, 2, 2), Y.box(1, 1, 3, 3)
    assert _area(Y.overlay([a, b])) == pytest.approx(7)
    assert _area(Y.overlay([a, b], [Y.box(0, 0, 1.5, 3)])) == pytest.approx(3.5)
    assert Y.overlay([a], [Y.box(2, 0, 3, 1)]) == [] and Y.intersects([a], [Y.box(2, 0, 3, 1)]) and not Y.intersects([a], [Y.box(5, 5, 6, 6)])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 4), st.integers(1, 4)), min_size=1, max_size=6))
def test_overlay_against_cells(boxes):
    cells = {(x, y) for a, b, w, h in boxes for x in range(a, a + w) for y in range(b, b + h)}
    assert _area(Y.overlay([Y.box(a, b, a + w, b + h) for a, b, w, h in boxes])) == pytest.approx(len(cells))


def test_holes_and_crossings():
    ring = [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]]
    assert _area(Y.overlay([ring])) == pytest.approx(12)
    triangles = [[[(0, 0), (4, 0), (2, 4), (0, 0)]], [[(0, 3), (4, 3), (2, -1), (0, 3)]]]
    n = 400
    x, y = np.meshgrid((np.arange(n) + 0.5) / n * 6 - 1, (np.arange(n) + 0.5) / n * 6 - 1)
    inside = (y > 0) & (y < 2 * x) & (y < 8 - 2 * x) | (y < 3) & (y > 3 - 2 * x) & (y > 2 * x - 5)
    assert _area(Y.overlay(triangles)) == pytest.approx(inside.sum() * (6 / n) ** 2, rel=0.01)


def test_wkb():
    polys = [Y.box(0, 0, 1, 1), [[(0, 0), (4, 0), (4, 4), (0, 0)], [(1, 0.5), (2, 0.5), (2, 1), (1, 0.5)]]]
    assert Y.from_wkb(Y.to_wkb(polys)) == [[[tuple(map(float, p)) for p in r] for r in rings] for rings in polys]
    shell = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    assert len(Y.rings_to_polygons([shell, hole])) == 1
    with pytest.raises(ValueError):
        Y.from_wkb(b"\x01\x01\x00\x00\x00" + b"\0" * 16)
    with pytest.raises(ValueError):
        Y.check_area([])
    r = 6378137.0
    assert Y.mercator_area([Y.box(0, 0, 1, 1)]) == pytest.approx(math.radians(1) * r * math.asinh(math.tan(math.radians(1))) * r)
