import datetime as dt
import json
import sqlite3
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.functions import codecs as C
from terrachron.functions import geometry as Y
from terrachron.functions import grids as G
from terrachron.operators import coverage, history, matching, mosaic, polygons, quadtree, raster, releases, tiles
from terrachron.plans.requests import Catalog
from terrachron.sources import catalogue, dbroot, listing, payloads
from terrachron.sources.archive import quoted, write_archive

D = dt.date.fromisoformat
VERSION = "tile_col long, tile_row long, zoom int, capture_date date, provider string, key string"


def png(colour, size=256):
    return C.write_png(np.full((size, size, 3), colour, np.uint8))


def versions(spark, rows):
    return spark.createDataFrame([(c, r, z, D(d) if d else None, p, k) for c, r, z, d, p, k in rows], VERSION)


def box_of(scheme, c0, r0, c1, r1, z):
    n = 1 << z
    if scheme == G.KEYHOLE:
        return G.Box(c0 / n * 360 - 180, r0 / n * 360 - 180, c1 / n * 360 - 180, r1 / n * 360 - 180)
    lat = lambda y: np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * y / n))))
    return G.Box(c0 / n * 360 - 180, float(lat(r1)), c1 / n * 360 - 180, float(lat(r0)))


def test_select_tiles_edges_and_limit(spark):
    aoi = box_of(G.KEYHOLE, 4, 4, 6, 5, 4)
    got = {tuple(r) for r in tiles.select_tiles(spark, aoi, G.KEYHOLE, 4).collect()}
    assert got == {(c, r, 4) for c in (4, 5, 6) for r in (4, 5)}  # edges that touch count
    with pytest.raises(ValueError):
        tiles.select_tiles(spark, aoi, G.KEYHOLE, 4, max_tiles=5)


@pytest.mark.parametrize("scheme", G.SCHEMES)
def test_coverage_is_area_not_tiles(spark, scheme):
    rows = [(4, 5, 4, "2010-01-01", "B", "a"), (4, 5, 4, "2010-01-01", "A", "b"), (5, 5, 4, "2010-01-01", "A", "c"), (5, 5, 4, "2012-01-01", "A", "d"), (5, 5, 4, None, "A", "e")]
    aoi = box_of(scheme, 4.5, 5.25, 5.5, 5.75, 4)
    v = versions(spark, rows)
    got = coverage.coverage_by_date(coverage.in_bounds(v), aoi, scheme, 4).collect()
    assert [(str(r.date), round(r.coverage, 9), r.complete, r.providers) for r in got] == [("2012-01-01", 0.5, False, "A"), ("2010-01-01", 1.0, True, "A, B")]
    assert coverage.in_bounds(v, "2012-01-01", "2012-01-01").count() == 1
    empty = coverage.coverage_by_date(v.where("false"), aoi, scheme, 4)
    assert empty.columns[:4] == ["date", "coverage", "complete", "n_tiles"] and empty.count() == 0


@pytest.mark.parametrize(
    "match,order",
    [("closest", ["2010-06-01", "2015-01-01", "2001-01-01", None]), ("before", ["2010-06-01", "2001-01-01", None]), ("after", ["2015-01-01", None]), ("exact", [])],
)
def test_nearest_order(spark, match, order):
    v = versions(spark, [(0, 0, 1, d, "A", str(d)) for d in ("2001-01-01", "2010-06-01", "2015-01-01", None)])
    got = matching.ranked(v, "2011-01-01", match).orderBy("rank").collect()
    assert [str(r.capture_date) if r.capture_date else None for r in got] == order


def test_older_wins_ties_and_missing(spark):
    v = versions(spark, [(0, 0, 1, "2010-01-11", "A", "x"), (0, 0, 1, "2010-01-01", "A", "y")])
    assert matching.nearest(v, "2010-01-06").first().key == "y"
    want = spark.createDataFrame([(0, 0, 1), (1, 0, 1)], "tile_col long, tile_row long, zoom int")
    assert [tuple(r) for r in matching.missing_tiles(want, v).collect()] == [(1, 0, 1)]
    with pytest.raises(Exception, match="no version"):
        matching.require_all(want, v).collect()


def test_change_history(spark):
    rows = [(1, "2015-01-01"), (2, "2015-01-01"), (3, None), (4, "2015-01-01"), (5, "2012-01-01"), (6, "2015-01-01")]
    t = spark.createDataFrame([(0, 0, p, D(d) if d else None) for p, d in rows], "tile_col int, tile_row int, pos int, capture_date date")
    assert sorted((r.pos, str(r.capture_date)) for r in history.change_history(t).collect()) == [(4, "2015-01-01"), (5, "2012-01-01"), (6, "2015-01-01")]


def walk(rows):
    want, out, known = None, [], {p for p, _, _ in rows}
    for pos, has, sel in sorted(rows):
        if want is not None and want != pos:
            continue
        want = sel
        if has == 1:
            out.append((pos, sel if sel in known else pos))
    return out


@pytest.mark.parametrize(
    "rows",
    [
        [(1, 1, 4), (2, 1, None), (3, 1, None), (4, 1, None), (5, 1, None), (6, 1, None)],
        [(1, 1, 99), (2, 1, None)],
        [(1, 1, None), (2, 1, 1), (3, 1, None)],
        [(1, 0, 3), (2, 1, None), (3, 1, 3), (4, 1, None)],
        [(1, 1, 2), (2, 0, None), (3, 1, None)],
    ],
)
def test_skip_chain_and_its_edges(spark, rows):
    t = spark.createDataFrame([(0, 0, *r) for r in rows], "tile_col int, tile_row int, pos int, has int, sel int")
    assert sorted((r.pos, r.effective) for r in history.skip_chain(t).collect()) == sorted(walk(rows))


def test_releases(spark):
    r = spark.createDataFrame([("B", D("2015-01-01"), 1), ("A", D("2010-01-01"), 2)], "release_id string, release_date date, pos long")
    assert [x.release_id for x in releases.catalogue(r).collect()] == ["B", "A"]
    assert releases.as_of(r, "2014-12-31").first().release_id == "A" and releases.exact(r, "B").first().pos == 1
    for bad in (releases.as_of(r, "2009-01-01"), releases.exact(r, "C")):
        with pytest.raises(Exception):
            bad.collect()
    days = spark.createDataFrame([(D(d) if d else None,) for d in ("2009-01-01", "2010-01-01", "2013-06-01", "2020-01-01", None)], "d0 date")
    got = {str(x.d0): x.release_id for x in releases.as_of_each(days, r, F.col("d0")).collect()}
    assert got == {"2009-01-01": None, "2010-01-01": "A", "2013-06-01": "A", "2020-01-01": "B", "None": None}
    ids = spark.range(250).select(F.lit("A").alias("release_id"), F.col("id").alias("object_id"))
    assert [x["count"] for x in releases.batches(ids).groupBy("batch").count().orderBy("batch").collect()] == [100, 100, 50]
    with pytest.raises(ValueError):
        releases.at_most(ids, 249)
    with pytest.raises(Exception, match="incomplete"):
        releases.require_complete(spark.createDataFrame([(True,), (False,)], "complete boolean")).collect()


FOOT = "zoom int, release_id string, object_id long, capture_date date, west double, south double, east double, north double, " + ", ".join(f"{c} {t}" for c, t in zip(mosaic.SOURCE, ("string", "string", "double", "double", "int", "int")))


def test_seam_map(spark):
    day = D("2014-01-01")
    rows = [
        (17, "A", 1, day, 0.0, 0.0, 1.0, 2.0, "P", None, 0.5, None, 1, 2),
        (17, "A", 2, day, 0.5, 0.0, 1.0, 2.0, "P", None, 0.5, None, 1, 2),  # inside the first: counts once
        (17, "A", 3, day, 1.0, 0.0, 2.0, 2.0, "Q", None, 0.5, None, 1, 2),  # another source of that date
        (17, "A", 4, D("2013-01-01"), 2.0, 0.0, 3.0, 2.0, "P", None, None, None, 1, 2),  # touches the edge
        (18, "A", 5, day, 5.0, 5.0, 6.0, 6.0, "P", None, None, None, 1, 2),  # off the area
    ]
    got = mosaic.seam_map(spark.createDataFrame(rows, FOOT), G.Box(0, 0, 2, 2)).collect()
    assert [(r.zoom, str(r.date), r.source_provider, round(r.area_fraction, 9)) for r in got] == [(17, "2014-01-01", "P", 0.5), (17, "2014-01-01", "Q", 0.5), (17, "2013-01-01", "P", 0.0)]


def lattice(aoi, n, boxes):
    """The share of an area that boxes on its n by n lattice of degrees cover, square by square."""
    seen = np.zeros((n, n), bool)
    for i0, j0, i1, j1 in boxes:
        seen[max(j0, 0) : max(j1, 0), max(i0, 0) : max(i1, 0)] = True
    y = np.array([G._lat_y(aoi.south + (aoi.north - aoi.south) * k / n) for k in range(n + 1)])
    return float((seen.mean(axis=1) * (y[:-1] - y[1:])).sum() / (y[0] - y[-1]))


def on_lattice(spark, aoi, n, boxes):
    at = lambda lo, hi, k: lo + (hi - lo) * k / n
    rows = [(g, at(aoi.west, aoi.east, i0), at(aoi.south, aoi.north, j0), at(aoi.west, aoi.east, i1), at(aoi.south, aoi.north, j1)) for g, own in boxes.items() for i0, j0, i1, j1 in map(lambda b: map(int, b), own)]
    return spark.createDataFrame(rows, "k string, west double, south double, east double, north double")


def test_covered_is_the_union(spark):
    """Boxes larger than cells, heaps of small ones and of strips inside a few cells, none at all but one that touches, and a null group."""
    rng, n, aoi = np.random.default_rng(7), 640, G.Box(10.0, 40.0, 11.0, 41.0)
    corner = lambda k, lo, hi: rng.integers(lo, hi, (k, 2))
    spread = lambda at, wide, tall: np.hstack([at, at + np.stack([rng.integers(*wide, len(at)), rng.integers(*tall, len(at))], 1)])
    boxes = {
        "large": spread(corner(60, -40, n), (20, 150), (20, 150)),
        "small": spread(corner(3000, 100, 190), (1, 3), (1, 3)),
        "level": spread(corner(400, 300, 400), (1, 300), (1, 2)),
        "upright": spread(corner(400, 300, 400), (1, 2), (1, 300)),
        "corners": np.array([(321, 321, 322 + k, 640 - k) for k in range(300)]),
        "edge": np.array([(n, 0, n + 5, 5)]),
        None: np.array([(0, 0, n, n // 2)]),
    }
    got = {r.k: r for r in mosaic.covered(on_lattice(spark, aoi, n, boxes), aoi, ["k"], ()).collect()}
    assert set(got) == set(boxes)
    for k, own in boxes.items():
        assert got[k].area_fraction == pytest.approx(lattice(aoi, n, own), abs=1e-9), k
        assert got[k].n_footprints == len({tuple(np.clip(b, 0, n)) for b in own if min(b[2:]) >= 0})


def test_covered_takes_many_boxes_of_a_group(spark):
    """Boxes that cover whole cells are not compared with each other; when they were, this took 85 s where it now takes 18."""
    aoi, k = G.Box(-122.41, 37.783, -122.385, 37.796), F.col("id")
    west, south = (F.lit(-122420000) + k * 7919 % 40000) / 1e6, (F.lit(37780000) + k * 104729 % 20000) / 1e6
    wide, tall = (F.lit(2000) + k % 7 * 500) / 1e6, (F.lit(1500) + k % 5 * 400) / 1e6
    rows = spark.range(400_000).select((k % 2).alias("k"), west.alias("west"), south.alias("south"), (west + wide).alias("east"), (south + tall).alias("north"))
    began = time.perf_counter()
    got = mosaic.covered(rows, aoi, ["k"], ()).collect()
    assert [round(r.area_fraction, 9) for r in got] == [1.0, 1.0] and time.perf_counter() - began < 60


def test_seam_map_counts_an_object_once(spark):
    """Two sources with equal fields may show one object by one box."""
    row = lambda i, east, p="P": (17, "A", i, D("2014-01-01"), 0.0, 0.0, east, 2.0, p, None, 0.5, None, 1, 2)
    rows = [row(1, 1.0), row(1, 1.0), row(1, 1.5), row(2, 1.0), row(1, 1.0, "Q"), row(3, 2.0, "Q"), row(3, 9.0, "Q"), row(None, 1.0, "R"), row(None, 1.0, "R")]
    got = mosaic.seam_map(spark.createDataFrame(rows, FOOT), G.Box(0, 0, 2, 2)).collect()
    assert [(r.source_provider, round(r.area_fraction, 9), r.n_footprints) for r in got] == [("P", 0.75, 3), ("Q", 1.0, 2), ("R", 0.5, 1)]


def test_polygon_coverage_agrees_with_boxes(spark):
    aoi = G.Box(0.1, 0.2, 2.3, 1.9)
    wkb = Y.to_wkb([Y.box(aoi.west, aoi.south, aoi.east, aoi.north)])
    rows = [("d", 0.0, 0.0, 1.0, 1.0), ("d", 0.5, 0.5, 1.5, 2.5), ("e", 2.0, 1.0, 3.0, 1.5), ("f", 9.0, 9.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "k string, west double, south double, east double, north double")
    geo = df.select("k", polygons.box_wkb(F.col("west"), F.col("south"), F.col("east"), F.col("north")).alias("geom"))
    got = {r.k: r.area_fraction for r in polygons.clipped_union(geo, wkb, ["k"]).collect()}
    left, top, right, bottom = mosaic._projected(aoi)
    area = (aoi.east - aoi.west) / 360 * (G._lat_y(aoi.south) - G._lat_y(aoi.north))
    b = df.withColumns({"x0": left, "y0": top, "x1": right, "y1": bottom}).where("x0 <= x1 and y0 <= y1")
    want = {r.k: r.a for r in b.groupBy("k").agg((mosaic.union_area(F.collect_set(F.struct("x0", "y0", "x1", "y1"))) / area).alias("a")).collect()}
    assert set(got) == set(want) == {"d", "e"}
    assert all(got[k] == pytest.approx(want[k], rel=1e-4) for k in got)


def test_sparse_polygon_selects_its_tiles(spark):
    wkb = Y.to_wkb([Y.box(0.1, 0.1, 0.2, 0.2), Y.box(80.1, 40.1, 80.2, 40.2)])
    assert polygons.select_tiles_in(spark, wkb, G.MERCATOR, 6).count() == 2


def varint(n):
    out = b""
    while True:
        out, n = out + bytes([n & 127 | (128 if n > 127 else 0)]), n >> 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def group(number, body):
    return varint(number << 3 | 3) + body + varint(number << 3 | 4)


def test_record_packets_and_root(spark):
    key = bytes(range(40))
    dated = lambda d, e, p: field(1, field(1, d) + field(2, e) + field(3, p))
    good, old = (2010 << 9) + (5 << 5) + 3, 500
    history_layer = field(1, 3) + field(2, 1) + field(4, dated(good, 7, 2) + dated(old, 8, 2) + dated(good + 1, 9, 0))
    node = field(1, 64) + field(2, 5) + field(3, field(1, 0) + field(2, 77)) + field(3, history_layer)
    packet = field(1, 3) + group(2, field(3, 21) + field(4, node))
    body = C.unmask(C.deflate(packet), key)
    nodes = quadtree.decoded_nodes(spark.createDataFrame([("0", bytearray(body)), ("0", bytearray(b"junk"))], "packet string, body binary"), key)
    t = spark.createDataFrame([("0000",), ("0001",)], "path string")
    own = quadtree.nodes_of_tiles(t, nodes)
    got = quadtree.dated_versions(t, own).orderBy("capture_date").collect()
    assert [(r.path, str(r.capture_date), r.provider, r.epoch) for r in got] == [("0000", "2010-05-03", 2, 7), ("0000", "2010-05-04", 0, 77)]
    root = field(3, field(1, 2) + field(2, field(2, b"Someone"))) + field(13, field(1, 9))
    found = dbroot.read_root(field(2, key) + field(3, C.unmask(C.deflate(root), key)))
    assert found["quadtree_version"] == 9 and found["providers"] == [(2, "Someone")]


def test_packet_rows(spark):
    image = 1 << C.IMAGE_BIT
    df = spark.createDataFrame([("0", bytearray(C.deflate(C.build_packet([(1, 2, 0), (image, 0, 4)])))), ("01", bytearray(b"bad"))], "path string, body binary")
    assert [(r.path, r.number, len(r.layers)) for r in raster.packets(df).collect()] == [("0", 0, 0), ("0", 1, 1)]


CAPS = """<Capabilities xmlns="http://a" xmlns:ows="http://b"><Contents>
<Layer><ows:Title>World Imagery (Wayback 2020-02-03)</ows:Title><ows:Identifier>WB_2020_R01</ows:Identifier><ResourceURL template="http://x/World_Imagery/MapServer/tile/20/{TileMatrixSet}"/><TileMatrixSetLink><TileMatrixSet>m</TileMatrixSet></TileMatrixSetLink></Layer>
<Layer><ows:Title>No date</ows:Title><ows:Identifier>WB_X</ows:Identifier><ResourceURL template="http://x/World_Imagery/MapServer/tile/21/"/></Layer>
<Layer><ows:Title>World Imagery (Wayback 2019-02-03)</ows:Title><ows:Identifier>WB_2019_R01</ows:Identifier><ResourceURL template="http://x/World_Imagery/MapServer/tile/10/"/></Layer>
</Contents></Capabilities>"""


def test_capabilities_and_tilemaps(spark):
    got = catalogue.releases(spark.createDataFrame([(CAPS,)], "body string")).orderBy("pos").collect()
    assert [(r.pos, r.layer_id, r.release_id, str(r.release_date), r.matrix_set) for r in got] == [(1, 20, "WB_2020_R01", "2020-02-03", "m"), (2, 10, "WB_2019_R01", "2019-02-03", catalogue.DEFAULT_MATRIX_SET)]
    for broken in (CAPS[:200], "<Capabilities></Capabilities>", "busy", None):
        with pytest.raises(Exception, match="capabilities document"):
            catalogue.releases(spark.createDataFrame([(broken,)], "body string")).collect()
    t = spark.createDataFrame([(1, '{"data":[1],"select":[7]}'), (2, '{"data":[0]}'), (3, "oops")], "id int, body string")
    assert [(r.has, r.sel) for r in catalogue.tilemaps(t).orderBy("id").collect()] == [(1, 7), (0, None), (0, None)]


def test_footprint_pages(spark):
    page = {"features": [{"attributes": {"OBJECTID": 1, "SRC_DATE2": 1288051200000, "SRC_RES": "0.5", "NICE_NAME": " "}, "geometry": {"rings": [[[0, 0], [0, 1], [1, 1], [0, 0]]]}}, {"attributes": {"OBJECTID": None, "SRC_DATE2": 1}}]}
    rows = catalogue.footprint_pages(spark.createDataFrame([("A", json.dumps(page)), ("B", "broken")], "release_id string, body string")).orderBy("release_id").collect()
    assert [(r.release_id, r.object_id, str(r.capture_date), r.complete) for r in rows] == [("A", 1, "2010-10-26", True), ("B", None, "None", False)]
    assert rows[0].source.provider is None and rows[0].source.resolution_m == 0.5 and rows[0].rings == [[[0, 0], [0, 1], [1, 1], [0, 0]]]


def test_listing_source(spark, tmp_path):
    feature = lambda i: {"attributes": {"OBJECTID": i, "SRC_DATE2": 1288051200000}}
    for part, pages in {"A": [([1, 2], True), ([3], False)], "B": [([4], True)]}.items():
        (tmp_path / part).mkdir()
        at = 0
        for ids, more in pages:
            (tmp_path / part / f"page-{at}.json").write_text(json.dumps({"features": [feature(i) for i in ids], "exceededTransferLimit": more}))
            at += len(ids)
    spark.dataSource.register(listing.PagedListing)
    rows = spark.read.format("paged_listing").option("root", str(tmp_path)).load().collect()
    assert sorted((r.part, r.object_id or 0, r.complete) for r in rows) == [("A", 1, True), ("A", 2, True), ("A", 3, True), ("B", 0, False), ("B", 4, False)]


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    waits = []
    assert listing.with_retries(flaky, sleep=waits.append) == "ok" and waits == [0.5, 1.0]
    with pytest.raises(listing.NotFound):
        listing.with_retries(lambda: (_ for _ in ()).throw(listing.NotFound("x")), sleep=waits.append)
    with pytest.raises(listing.RequestFailed):
        listing.with_retries(lambda: (_ for _ in ()).throw(OSError("x")), sleep=lambda s: None)


def test_payload_table(spark, tmp_path):
    rows = [(b"a", b"1", dt.datetime(2024, 1, 1)), (b"a", b"2", dt.datetime(2024, 1, 3)), (b"b", b"3", dt.datetime(2024, 1, 2))]
    payloads.append(spark.createDataFrame([(bytearray(k), bytearray(v), t) for k, v, t in rows], payloads.SCHEMA), str(tmp_path / "t"))
    new = payloads.latest(payloads.read_table(spark, str(tmp_path / "t")))
    assert {bytes(r.key): bytes(r.body) for r in new.collect()} == {b"a": b"2", b"b": b"3"}
    assert [bytes(r.key) for r in payloads.fresh(new, "1 day", "2024-01-03 12:00:00").collect()] == [b"a"]
    assert payloads.fresh(new, None).count() == 2
    name = "ab" * 32
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / name).write_bytes(b"body")
    assert bytes(payloads.read_files(spark, str(tmp_path / "f")).first().body) == b"body"
    assert str(payloads.default_folder({"TERRACHRON_CACHE_DIR": "/x"})) == "/x" and str(payloads.default_folder({"XDG_CACHE_HOME": "/y"})) == "/y/terrachron"


def catalog(spark):
    rows = [(c, r, 4, d, "A", f"{c}{r}{d}") for c in (4, 5) for r in (5, 6) for d in ("2005-05-05", "2015-09-09") if (c, r, d) != (5, 6, "2015-09-09")]
    body = spark.createDataFrame([(k, bytearray(png(50 if "2005" in k else 200) if k != "462015-09-09" else b"broken")) for *_, k in rows], "key string, body binary")
    return Catalog(spark, "google", versions=versions(spark, rows), payloads=body)


def test_tiles_archive_and_raster(spark, tmp_path):
    cat, aoi = catalog(spark), box_of(G.KEYHOLE, 4.5, 5.5, 5.5, 6.5, 4)
    got = cat.tiles(aoi, 4, "2004-01-01").collect()
    assert [(r.tile_row, r.tile_col, str(r.capture_date)) for r in got] == [(5, 4, "2005-05-05"), (5, 5, "2005-05-05"), (6, 4, "2005-05-05"), (6, 5, "2005-05-05")]
    assert got[0].image_format == "png" and bytes(got[0].content) == png(50)
    with pytest.raises(Exception):
        cat.tiles(aoi, 4, "2015-09-09").collect()  # one payload is broken
    out = tmp_path / "a.gpkg"
    assert cat.archive(aoi, 4, str(out), "2004-01-01") == 4
    with sqlite3.connect(out) as db:
        base = db.execute("SELECT tile_column, tile_row, tile_data FROM tiles WHERE zoom_level = 3 ORDER BY 2, 1").fetchall()
        assert [(c, r) for c, r, _ in base] == [(4, 5), (5, 5), (4, 6), (5, 6)] and base[0][2] == png(50)
        assert db.execute("SELECT count(*) FROM tiles WHERE zoom_level < 3").fetchone()[0] > 0
        assert db.execute("SELECT count(*) FROM gpkg_metadata_reference").fetchone()[0] == 4
    with pytest.raises(FileExistsError):
        cat.archive(aoi, 4, str(out), "2004-01-01")
    answer = cat.raster(aoi, 4, "2015-09-09", block=200)
    blocks = answer.df.collect()
    assert sum(b.width * b.height for b in blocks) == 256 * 256 and all(set(b.mask) == {255} for b in blocks)
    values = {v for b in blocks for v in set(b.pixels)}
    assert values == {50, 200}
    meta = answer.meta.first()
    assert (meta.n_tiles, meta.n_missing, meta.dates) == (4, 0, "2005-05-05,2015-09-09")


def test_missing_tiles_stay_masked(spark):
    cat = catalog(spark)
    answer = cat.raster(box_of(G.KEYHOLE, 4.5, 5.5, 5.5, 6.5, 4), 4, "2015-09-09", "exact")
    m = answer.meta.first()
    assert (m.n_tiles, m.n_missing) == (2, 2)
    assert sum(x == 255 for b in answer.df.collect() for x in b.mask) == 2 * 128 * 128


def test_requests_check_first(spark):
    cat = catalog(spark)
    aoi = G.Box(0, 0, 1, 1)
    for bad in (
        lambda: cat.availability(aoi, 22),
        lambda: cat.tiles(aoi, 4),
        lambda: cat.tiles(aoi, 4, "2010-01-01", release_id="A"),
        lambda: cat.tiles(aoi, 4, "2010-01-01", "nearest"),
        lambda: Catalog(spark, "other").availability(aoi, 3),
        lambda: cat.availability(aoi, 20, max_tiles=3),
    ):
        with pytest.raises(ValueError):
            bad()


def test_availability_by_footprint(spark):
    day = D("2014-01-01")
    f = [(17, rel, i, day, 0.0, 0.0, 1.0 + i, 2.0, "P", None, 0.5, None, 1, 2) for rel, i in (("A", 1), ("B", 1), ("B", 0))]
    f.append((17, "B", 9, D("2011-01-01"), 0.0, 0.0, 2.0, 2.0, "Q", None, None, None, 1, 2))
    r = spark.createDataFrame([("A", D("2015-01-01"), 2), ("B", D("2016-01-01"), 1)], "release_id string, release_date date, pos long")
    cat = Catalog(spark, "esri", releases=r, footprints=spark.createDataFrame(f, FOOT))
    box, wkb = G.Box(0, 0, 2, 2), Y.to_wkb([Y.box(0, 0, 2, 2)])
    for aoi in (box, wkb):
        got = cat.availability(aoi, 17).df.collect()
        assert [(str(x.date), round(x.coverage, 6), x.complete, x.release_id) for x in got] == [("2014-01-01", 1.0, True, "A"), ("2011-01-01", 1.0, True, "B")]
        one = cat.mosaic_as_of(aoi, [17], "2015-06-01")
        assert [round(x.area_fraction, 6) for x in one.df.collect()] == [1.0] and one.meta.first().release_id == "A"
    assert cat.availability(box, 17, "2012-01-01").df.count() == 1
    assert cat.mosaic_as_of(box, 17, "B").df.count() == 2
    with pytest.raises(ValueError):
        cat.mosaic_as_of(box, 17, "B", max_footprints=1)


def test_polygon_availability(spark):
    cat = catalog(spark)
    b = box_of(G.KEYHOLE, 4.5, 5.5, 5.5, 6.5, 4)
    wkb = Y.to_wkb([Y.box(b.west, b.south, b.east, b.north)])
    a = {r.date: r.coverage for r in cat.availability(b, 4).df.collect()}
    p = {r.date: r.coverage for r in cat.availability(wkb, 4).df.collect()}
    assert a.keys() == p.keys() and all(a[k] == pytest.approx(p[k], rel=1e-3) for k in a)


def test_names_of_tables():
    assert quoted('a"b') == '"a""b"'
    for bad in ("", "gpkg_x", "SQLITE_x", "a\0"):
        with pytest.raises(ValueError):
            quoted(bad)


def test_archive_refuses(spark, tmp_path):
    t = spark.createDataFrame([(3, 1, 1, bytearray(b"no image"))], "zoom int, column long, row long, content binary")
    with pytest.raises(ValueError):
        write_archive(t, str(tmp_path / "x"), G.KEYHOLE)
    with pytest.raises(ValueError):
        write_archive(t.where("false"), str(tmp_path / "x"), G.KEYHOLE)
    assert not list(tmp_path.iterdir())
