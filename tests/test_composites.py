"""Composite operators against brute force, vector files, and streams against their batch twins."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilefabric.operators import audit, features, raster, spatial
from tilefabric.sources import vectors
from tilefabric.streaming import residency


def shoelace(points):
    x, y = np.array(points).T
    return abs(np.dot(x, np.roll(y, 1)) - np.dot(y, np.roll(x, 1))) / 2


def test_clipped_polygons_keep_area_and_bounds(spark):
    rng = np.random.default_rng(3)
    rings = {p: [(900 * np.cos(a) * r - 300, 700 * np.sin(a) * r + 200) for a, r in zip(np.linspace(0, 6, 9), rng.uniform(0.3, 1, 9), strict=True)] for p in range(4)}
    df = spark.createDataFrame([(p, 0, k, float(e), float(n)) for p, ring in rings.items() for k, (e, n) in enumerate(ring)], "poly_id long, ring_no int, seq int, e double, n double")
    pieces = {}
    for r in spatial.clip_polygons_to_tiles(df, 256.0).orderBy("seq").collect():
        pieces.setdefault((r["poly_id"], r["ei"], r["ni"]), []).append((r["e"], r["n"]))
    for (_, ei, ni), points in pieces.items():
        assert all(ei * 256 - 1e-6 <= e <= ei * 256 + 256 + 1e-6 and ni * 256 - 1e-6 <= n <= ni * 256 + 256 + 1e-6 for e, n in points)
    for p, ring in rings.items():
        assert sum(shoelace(v) for k, v in pieces.items() if k[0] == p) == pytest.approx(shoelace(ring))


def test_colour_fill_is_the_nearest_real_pixel(spark):
    rng = np.random.default_rng(4)
    rows = [(t, 0, r, c, *((255, 255, 255) if rng.random() < 0.8 else tuple(map(int, rng.integers(20, 190, 3))))) for t in range(3) for r in range(9) for c in range(7)]
    rows += [(9, 0, r, c, 255, 255, 255) for r in range(2) for c in range(2)]
    got = {tuple(r)[:4]: tuple(r)[4:] for r in raster.fill_rgb_nearest(spark.createDataFrame(rows, "ei int, ni int, prow int, pcol int, r int, g int, b int")).collect()}
    for t in (0, 1, 2, 9):
        real = {x[2:4]: x[4:] for x in rows if x[0] == t and x[4:] != (255, 255, 255)}
        mean = np.mean(list(real.values()), axis=0) if real else None
        for x in (x for x in rows if x[0] == t):
            if x[2:4] in real or not real:
                assert got[x[:4]] == x[4:]
                continue
            far = {k: abs(k[0] - x[2]) + abs(k[1] - x[3]) for k in real}
            w = min(1, min(far.values()) / 2)
            assert got[x[:4]] in [tuple(int(v) for v in np.floor(np.array(real[k]) * (1 - w) + mean * w + 0.5)) for k, d in far.items() if d == min(far.values())]


def test_small_rules(spark):
    tris = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 1.0, 2.0, 2.0)], "ax double, az double, bx double, bz double, cx double, cz double")
    assert features.drop_degenerate(tris).count() == 1
    tags = [({"natural": "water"}, "polygon"), ({"landuse": "basin"}, "polygon"), ({"waterway": "river"}, "12"), ({"waterway": "canal"}, "8"), ({"waterway": "canal", "area": "yes"}, None), ({"waterway": "river", "area": "yes"}, None), ({"waterway": "river", "area": "no"}, "12"), ({"waterway": "canal", "area": "yes", "natural": "water"}, "polygon"), ({"highway": "path"}, None)]
    df = spark.createDataFrame(tags, "t map<string, string>, want string")
    assert df.where(~features.classify_water(F.col("t")).eqNullSafe(F.col("want"))).count() == 0
    zones = spark.createDataFrame([(1, ["trees"], 1.0, 1.0, 5.0), (2, ["all"], 1.0, 1.0, 5.0), (3, ["roads"], 1.0, 1.0, 5.0), (4, ["all"], 1.0, 1.0, None)], "id int, kinds array<string>, e double, n double, r double").withColumn("ring", F.lit(None).cast("array<double>"))
    assert sorted(r["id"] for r in features.zones_for(zones, "trees").collect()) == [1, 2]
    tiles = spark.createDataFrame([(0, 0)], "ei int, ni int")
    same = audit.tiles_to_cells(tiles, lambda p: p.withColumns({"ue": F.col("e"), "un": F.col("n")}))
    assert sorted(map(tuple, same.collect())) == [(0, 0, -1, 0), (0, 0, 1, 0)]


def test_landcover_files(spark, tmp_path):
    ring = lambda *p: struct.pack("<I", len(p)) + np.array(p, "<f4").tobytes()
    head = lambda n: b"FOR1" + struct.pack("<IIIdd", 1, n, 0, 10.0, 20.0)
    poly = struct.pack("<B3xffI", 4, 0.5, 0.0, 2) + ring((0, 0), (9, 0), (9, 9)) + ring((1, 1), (2, 1), (2, 2))
    thin = struct.pack("<B3xffI", 4, 0.5, 9.0, 1) + ring((0, 0), (9, 0))
    road = struct.pack("<B3xffI", 3, 6.0, 9.0, 1) + ring((0, 0), (9, 0))
    (tmp_path / "a.for").write_bytes(head(3) + poly + thin + road)
    (tmp_path / "b.for").write_bytes((head(1) + poly)[:-4])
    got = vectors.read_landcover_polygons(spark, str(tmp_path)).collect()
    assert sorted((r["poly_id"], r["ring_no"], r["seq"], r["dx"], r["height"]) for r in got) == [(0, 0, 0, 0.0, 20.0), (0, 0, 1, 9.0, 20.0), (0, 0, 2, 9.0, 20.0), (0, 1, 0, 1.0, 20.0), (0, 1, 1, 2.0, 20.0), (0, 1, 2, 2.0, 20.0), (2, 0, 0, 0.0, 9.0), (2, 0, 1, 9.0, 9.0)]


def test_xml_and_boundaries(spark, tmp_path):
    face = lambda kind, text: f"<bldg:boundedBy><bldg:{kind}><bldg:lod2MultiSurface><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{text}</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod2MultiSurface></bldg:{kind}></bldg:boundedBy>"
    part = f"<bldg:consistsOfBuildingPart><bldg:BuildingPart>{face('RoofSurface', '0 0 5 1 0 5 1 1 5')}</bldg:BuildingPart></bldg:consistsOfBuildingPart>"
    (tmp_path / "b.gml").write_text(f'<m xmlns:bldg="b" xmlns:gml="g"><bldg:Building gml:id="h1">{face("WallSurface", "0 0 0 1 0 0 1 0 3")}{face("GroundSurface", "0 0 0 1")}{part}</bldg:Building></m>')
    got = vectors.read_citygml(spark, str(tmp_path / "b.gml")).orderBy("surface", "seq").collect()
    assert [(r["building_id"], r["surface"], r["ring_no"], r["seq"], r["x"], r["z"]) for r in got] == [("h1", "roof", 0, 0, 0.0, 5.0), ("h1", "roof", 0, 1, 1.0, 5.0), ("h1", "roof", 0, 2, 1.0, 5.0), ("h1", "wall", 0, 0, 0.0, 0.0), ("h1", "wall", 0, 1, 1.0, 0.0), ("h1", "wall", 0, 2, 1.0, 3.0)]
    (tmp_path / "m.osm").write_text('<osm><node id="1" lat="47.0" lon="8.0"/><node id="2" lat="47.5" lon="8.5"/><way id="7"><nd ref="2"/><nd ref="1"/><nd ref="99"/><tag k="highway" v="path"/></way><way id="8"><nd ref="1"/><nd ref="98"/></way></osm>')
    path = str(tmp_path / "m.osm")
    ways = vectors.read_osm_ways(spark, path)
    assert {r["way_id"]: r["tags"] for r in ways.collect()} == {7: {"highway": "path"}, 8: {}}
    assert sorted(map(tuple, vectors.assemble_ways(ways, vectors.read_osm_nodes(spark, path)).collect())) == [(7, 0, 47.5, 8.5), (7, 1, 47.0, 8.0)]
    (tmp_path / "a.poly").write_text("area\n1\n   7.5 47.5\n   8.5 4.85E+01\n   9 47\nEND\n!2\n   8 47.6\n   8.1 47.7\nEND\nEND\n")
    rows = vectors.read_boundary_poly(spark, str(tmp_path / "a.poly")).collect()
    assert sorted((r["ring_no"], r["name"], r["hole"], r["seq"], r["lon"], r["lat"]) for r in rows) == [(0, "1", False, 0, 7.5, 47.5), (0, "1", False, 1, 8.5, 48.5), (0, "1", False, 2, 9.0, 47.0), (1, "2", True, 0, 8.0, 47.6), (1, "2", True, 1, 8.1, 47.7)]


def test_levels_and_textures_far_out(spark):
    """Levels of detail within sixteen tiles, where textures change too, against a plain loop."""
    rows = [(1, k, k, e, n) for k, (e, n) in enumerate([(0, 0), (3, 0), (3, 0), (3, -2), (20, 1)])]
    df = spark.createDataFrame(rows, "track_id long, fix_id long, ts int, te int, tn int")
    lod = lambda d: next(v for r, v in ((1, 0), (2, 1), (4, 2), (8, 3), (12, 4), (99, 6)) if d <= r)
    want, before = set(), {}
    for _, fix, _, e, n in rows:
        now = {(i, j): lod(max(abs(i - e), abs(j - n))) for i in range(e - 16, e + 17) for j in range(n - 16, n + 17)}
        want |= {(1, fix, *t, before[t], v, (before[t] >= 5) != (v >= 5)) for t, v in now.items() if before.get(t, v) != v}
        before = now
    got = residency.lod_changes_batch(df, 16).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) and {r["texture"] for r in got} == {True, False}
