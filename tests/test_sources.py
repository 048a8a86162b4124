"""Small sources and sinks: cell files, reference systems, resuming, stale outputs."""

import os
import struct
import zlib

from pyspark.sql import functions as F

from tilefabric.sources import sink, tiles, vectors


def test_cells_go_out_and_come_back(spark, tmp_path):
    rows = [(3, 1, 404), (-2, 5, None), (3, 1, 404), (None, 4, 200)]
    tiles.write_cells(spark.createDataFrame(rows, "e_km int, n_km int, status int"), str(tmp_path / "cells"))
    got = tiles.read_cells(spark, str(tmp_path / "cells"))
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(3, 1, 404), (-2, 5, None)], "e_km int, n_km int, status int").collect()))
    empty = spark.createDataFrame([], "e_km int, n_km int, status int")
    tiles.write_cells(empty, str(tmp_path / "none"))
    assert tiles.read_cells(spark, str(tmp_path / "none")).count() == 0


def test_other_reference_systems_go(spark):
    rows = [(1, "EPSG:2056"), (2, "epsg:25832"), (3, None), (4, ""), (5, "urn:ogc:def:crs:EPSG::2056"), (6, "local"), (7, "EPSG:99999999999")]
    got = tiles.filter_crs(spark.createDataFrame(rows, "id int, crs string"))
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4, 5, 6]


def test_resume_and_stale_inputs(spark, tmp_path):
    todo = spark.createDataFrame([(k, k % 3) for k in range(9)], "ei int, ni int")
    done = spark.createDataFrame([(0, 0), (4, 1), (4, 1), (5, 0)], "ei int, ni int")
    assert sorted(r["ei"] for r in vectors.resume(todo, done, ["ei", "ni"]).collect()) == [1, 2, 3, 5, 6, 7, 8]
    for folder, name, at in (("in", "a.xyz", 100), ("in", "b.xyz", 300), ("in", "c.xyz", 100), ("out", "a.raw", 200), ("out", "b.raw", 200)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("x")
        os.utime(tmp_path / folder / name, (1_700_000_000 + at, 1_700_000_000 + at))
    got = vectors.stale_inputs(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(r["stem"] for r in got.collect()) == ["b", "c"]


def png(rows):
    """A small picture of (r, g, b) rows."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_colour_tiles(spark, tmp_path):
    (tmp_path / "ortho_2048_-1024.png").write_bytes(png([[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (250, 0, 1)]]))
    (tmp_path / "other.png").write_bytes(png([[(9, 9, 9)]]))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    got = sorted(map(str, (tuple(r)[1:] for r in vectors.read_rgb_tiles(spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, [(2, -1, 0, 0, 1, 2, 3), (2, -1, 0, 1, 4, 5, 6), (2, -1, 1, 0, 7, 8, 9), (2, -1, 1, 1, 250, 0, 1), (None, None, 0, 0, 9, 9, 9)]))


def test_xyz_grids(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("100.5 200.5 1\n101.5 200.5 2.5\n\nheader here x\n100.5  199.5 3\n")
    (tmp_path / "b.xyz").write_text("7.5 8.5 9\n")
    got = tiles.read_xyz(spark, str(tmp_path)).collect()
    assert sorted((r["path"][-5:], r["col"], r["row"], r["z"]) for r in got) == [("a.xyz", 0, 0, 1.0), ("a.xyz", 0, 1, 3.0), ("a.xyz", 1, 0, 2.5), ("b.xyz", 0, 0, 9.0)]


def test_inventories_by_product(spark, tmp_path):
    for name in ("ortho_1024_2048.jpg", "ortho_1000_0.jpg", "tile_0_0.raw", "vegetation_1024_0.veg", "x_32_495_5288_2_bw.zip", "buildings_495_5288.glb"):
        (tmp_path / name).write_bytes(b"x")
    got = {p: sorted(map(tuple, tiles.inventory(spark, str(tmp_path), product=p).collect())) for p in tiles.PRODUCTS}
    assert got == {"height": [(0, 0)], "ortho": [(1, 2)], "vegetation": [(1, 0)], "buildings": [(495, 5288)], "archive": [(495, 5288)]}


def test_written_tiles_come_back(spark, tmp_path):
    rows = [(ei, -1, r, c, None if (r, c) == (2, 1) else float(10 * r + c + ei)) for ei in (0, 3) for r in range(3) for c in range(3) if (ei, r, c) != (3, 2, 2)]
    px = spark.createDataFrame(rows, "ei int, ni int, prow int, pcol int, h double")
    sink.write_height_tiles(px, str(tmp_path / "raw"), 3)
    sink.write_height_tiles(px.where("ei = 3"), f"file://{tmp_path}/raw", 3)  # again: replaced
    want = {(ei, -1, r, c): 0.0 for ei in (0, 3) for r in range(3) for c in range(3)} | {r[:4]: r[4] or 0.0 for r in rows}
    assert sorted(os.listdir(tmp_path / "raw")) == ["tile_0_-1024.raw", "tile_3072_-1024.raw"]
    assert {tuple(r)[1:5]: r["h"] for r in tiles.read_height_tiles(spark, str(tmp_path / "raw"), 3).collect()} == want
    sink.write_heightmap_v2(px.where("ei = 0"), str(tmp_path / "v2"), 3)
    assert {(r["prow"], r["pcol"]): r["h"] for r in tiles.read_heightmap_v2(spark, str(tmp_path / "v2")).collect()} == {k[2:]: v for k, v in want.items() if k[0] == 0}
    trees = spark.createDataFrame([(1024.0, 0.0, 1030.0, 5.0, 400.0, 20.0, 1.0, 6.0), (1024.0, 0.0, 1025.5, 9.0, float("nan"), 20.0, 1.0, 6.0), (0.0, 0.0, 1.5, 2.5, 300.0, 10.0, 0.5, 3.0), (0.0, 0.0, 3.0, 3.0, None, 1.0, 1.0, 1.0)], "tile_e double, tile_n double, e double, n double, ground_z double, height_m double, yaw_rad double, crown_radius_m double")
    sink.write_tree_points(trees, str(tmp_path / "veg"))
    back = tiles.read_tree_points(spark, str(tmp_path / "veg")).collect()
    assert sorted((r["tile_e"], r["dx"], r["dz"], r["ground_z"], r["crown_radius_m"]) for r in back) == [(0.0, 1.5, 2.5, 300.0, 3.0), (1024.0, 6.0, 5.0, 400.0, 6.0)]


def test_manifests_go_out_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a.glb", 1, 2, 3.0, 4.0), ("b.glb", 5, 6, 7.0, 8.0)], "file string, tile_e int, tile_n int, center_e double, center_n double")
    sink.write_manifest(df, str(tmp_path / "m"), F.concat_ws("_", "tile_e", "tile_n"), tile_size_m=4096.0, elevation_baked=True)
    got = tiles.read_manifest(spark, str(tmp_path / "m" / "manifest.json")).collect()
    assert sorted(map(tuple, got)) == [(0.0, 0.0, 4096.0, True, "1_2", "a.glb", 1, 2, 3.0, 4.0), (0.0, 0.0, 4096.0, True, "5_6", "b.glb", 5, 6, 7.0, 8.0)]


def test_buildings_with_pos_rings_parts_of_parts_and_other_surfaces(spark, tmp_path):
    ring = "".join(f"<gml:pos>{p}</gml:pos>" for p in ("0 0 1", "2 0 1", "2 2 1", "0 0 1"))
    face = lambda kind, body: f"<bldg:boundedBy><bldg:{kind}><bldg:lod2MultiSurface><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing>{body}</gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod2MultiSurface></bldg:{kind}></bldg:boundedBy>"
    part = lambda body: f"<bldg:consistsOfBuildingPart><bldg:BuildingPart>{body}</bldg:BuildingPart></bldg:consistsOfBuildingPart>"
    text = face("ClosureSurface", ring) + part(face("WallSurface", ring) + part(face("RoofSurface", "<gml:posList>0 0 5 1 0 5 1 1 5</gml:posList>")))
    (tmp_path / "b.gml").write_text(f'<m xmlns:bldg="b" xmlns:gml="g"><bldg:Building gml:id="h">{text}</bldg:Building></m>')
    got = vectors.read_citygml(spark, str(tmp_path / "b.gml")).collect()
    assert {s: sorted((r["seq"], r["x"], r["z"]) for r in got if r["surface"] == s) for s in ("other", "wall", "roof")} == {"other": [(0, 0.0, 1.0), (1, 2.0, 1.0), (2, 2.0, 1.0), (3, 0.0, 1.0)], "wall": [(0, 0.0, 1.0), (1, 2.0, 1.0), (2, 2.0, 1.0), (3, 0.0, 1.0)], "roof": [(0, 0.0, 5.0), (1, 1.0, 5.0), (2, 1.0, 5.0)]}


def test_roads_and_water_of_a_map_extract(spark, tmp_path):
    place = {1: (0, 0), 2: (0, 10), 3: (10, 10), 4: (10, 0), 5: (2, 2), 6: (2, 4), 7: (4, 4), 8: (20, 20), 9: (20, 30), 10: (30, 30)}
    nodes = "".join(f'<node id="{k}" lat="{a}" lon="{b}"/>' for k, (a, b) in place.items())
    way = lambda k, refs, **tags: f'<way id="{k}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + "".join(f'<tag k="{a}" v="{b}"/>' for a, b in tags.items()) + "</way>"
    ways = way(20, [1, 2], highway="primary") + way(21, [2, 3], railway="rail", tunnel="yes") + way(22, [2, 3], railway="tram") + way(23, [1, 99], highway="primary") + way(24, [3, 4], waterway="river") + way(25, [8, 9, 10, 8], natural="water") + way(26, [1, 2, 3]) + way(27, [1, 4, 3]) + way(28, [5, 6, 7, 5]) + way(29, [8, 9, 10, 8], landuse="forest")
    rel = '<relation id="40"><member type="way" ref="26" role="outer"/><member type="way" ref="27" role="outer"/><member type="way" ref="28" role="inner"/><tag k="type" v="multipolygon"/><tag k="natural" v="water"/></relation>'
    (tmp_path / "m.osm").write_text(f"<osm>{nodes}{ways}{rel}</osm>")
    roads, water, areas = vectors.read_osm(spark, str(tmp_path / "m.osm"))
    assert sorted((r["line_id"], r["cls"], r["seq"], r["lat"]) for r in roads.collect()) == [(20, "primary", 0, 0.0), (20, "primary", 1, 0.0), (22, "railway:tram", 0, 0.0), (22, "railway:tram", 1, 10.0)]
    assert {(r["line_id"], r["cls"]) for r in water.collect()} == {(24, "river")}
    got = {}
    for r in areas.collect():
        got.setdefault((r["area"], r["ring_no"]), set()).add((r["lat"], r["lon"]))
    assert got == {("w25_0", 0): {(20.0, 20.0), (20.0, 30.0), (30.0, 30.0)}, ("r40_0", 0): {(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)}, ("r40_0", 1): {(2.0, 2.0), (2.0, 4.0), (4.0, 4.0)}}
