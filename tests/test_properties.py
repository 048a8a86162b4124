"""Golden points, round trips, properties and binary files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilefabric.functions import geodesy, grid
from tilefabric.operators import lines, raster
from tilefabric.sources import tiles
from tilefabric.streaming import residency

GOLDEN = [(46.951082877, 7.438632495, 2600000.006, 1200000.013, 381188.821, 5200911.311), (46.0441305, 8.7304972, 2700000.017, 1100000.030, 479148.374, 5098986.015), (47.69, 8.635, 2689818.576, 1282837.796, 472609.944, 5281910.465), (48.0, 7.85, 2630705.095, 1316706.297, 414215.766, 5316940.039), (49.0, 9.0, 2714317.234, 1429006.452, 500000.000, 5427455.781)]


def test_golden_points(spark):
    df = spark.createDataFrame([g[:2] for g in GOLDEN], "lat double, lon double")
    out = geodesy.wgs84_to_utm(geodesy.wgs84_to_lv95(df)).orderBy("n").collect()
    for r, g in zip(out, sorted(GOLDEN, key=lambda g: g[3]), strict=True):
        assert (r["e"], r["n"], r["ue"], r["un"]) == pytest.approx(g[2:], abs=2e-3)
    back = geodesy.lv95_to_wgs84(geodesy.wgs84_to_lv95(df.select(F.col("lat").alias("a"), F.col("lon").alias("b")), "a", "b")).collect()
    assert all(abs(r["lat"] - r["a"]) < 3e-8 and abs(r["lon"] - r["b"]) < 3e-8 for r in back)
    utm = geodesy.utm_to_wgs84(geodesy.wgs84_to_utm(df.select(F.col("lat").alias("a"), F.col("lon").alias("b")), 32, "a", "b")).collect()
    assert all(abs(r["lat"] - r["a"]) < 1e-9 and abs(r["lon"] - r["b"]) < 1e-9 for r in utm)


def test_tile_key_round_trip(spark):
    df = spark.createDataFrame([(0, 0), (-1, 5), (5, -1), (-7, -9), (2**31 - 1, -(2**31))], "a int, b int")
    a, b = grid.tile_unkey(F.col("k"))
    assert df.withColumn("k", grid.tile_key(F.col("a"), F.col("b"))).where((a != F.col("a")) | (b != F.col("b"))).count() == 0


def test_hash_product(spark):
    got = spark.range(1).select(grid.hash32(F.lit(4294967295), F.lit(0)).alias("h")).first()["h"]
    x = 1640531535  # 4294967295 * 2654435761 mod 2^32
    x ^= x >> 15
    assert got == x * 3266489917 % 2**32


def test_lines_keep_length(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(int(i), int(k), float(e), float(n), "x") for i in range(5) for k, (e, n) in enumerate(rng.uniform(-9000, 9000, (8, 2)))], "line_id long, seq int, e double, n double, cls string")
    whole = lines.segments(v).agg(F.sum("length")).first()[0]
    cut = lines.split_at_tiles(v, 1024.0)
    assert cut.agg(F.sum(F.hypot(F.col("e1") - F.col("e0"), F.col("n1") - F.col("n0")))).first()[0] == pytest.approx(whole)
    fine = lines.segments(lines.densify(v, 10.0).withColumn("seq", F.col("seq") * 100000 + F.col("part")).select("line_id", "seq", "e", "n"))
    assert fine.agg(F.max("length")).first()[0] <= 10 + 1e-6
    assert fine.agg(F.sum("length")).first()[0] == pytest.approx(whole)


def test_fill_keeps_valid_and_mosaic_of_one(spark):
    rng = np.random.default_rng(1)
    px = spark.createDataFrame([(0, 0, int(r), int(c), 0, float(h)) for (r, c), h in np.ndenumerate(np.where(rng.random((8, 8)) < 0.4, 0, rng.uniform(1, 9, (8, 8))))], "ei int, ni int, prow int, pcol int, source int, h double")
    own = {(r["prow"], r["pcol"]): r["h"] for r in px.collect() if r["h"]}
    for fill in (raster.fill_gaps_idw, raster.fill_gaps_sweep):
        got = {(r["prow"], r["pcol"]): r["h"] for r in fill(px).collect()}
        assert all(got[k] == v for k, v in own.items()) and all(v is not None for v in got.values())
    for rule in ("first", "last"):
        assert {(r["prow"], r["pcol"]): r["h"] for r in raster.mosaic(px, rule).collect()} == own


def test_binary_files(spark, tmp_path):
    h = np.arange(16, dtype="<f4").reshape(4, 4)
    (tmp_path / "tile_2048_-1024.raw").write_bytes(h.tobytes())
    (tmp_path / "tile_0_0.raw").write_bytes(b"short")
    (tmp_path / "tile_5_0.raw").write_bytes(b"")
    got = {(r["ei"], r["ni"], r["prow"], r["pcol"]): r["h"] for r in tiles.read_height_tiles(spark, str(tmp_path), 4).collect()}
    assert got == {(2, -1, r, c): v for (r, c), v in np.ndenumerate(h)}
    assert sorted(map(tuple, tiles.inventory(spark, str(tmp_path)).collect())) == [(0, 0), (2, -1)]
    (tmp_path / "v2").mkdir()
    (tmp_path / "v2" / "a.raw").write_bytes(struct.pack("<II", 2, 3) + np.arange(6, dtype="<f4").tobytes())
    assert sorted((r["prow"], r["pcol"], r["h"]) for r in tiles.read_heightmap_v2(spark, str(tmp_path / "v2")).collect()) == [(r, c, 2.0 * r + c) for r in range(3) for c in range(2)]
    rec = np.arange(12, dtype="<f4")
    (tmp_path / "a.veg").write_bytes(b"VEG1" + struct.pack("<IIIdd", 1, 2, 0, 10.0, 20.0) + rec.tobytes())
    (tmp_path / "b.veg").write_bytes(b"VEG1" + struct.pack("<IIIdd", 1, 9, 0, 10.0, 20.0) + rec.tobytes())
    rows = tiles.read_tree_points(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["tile_e"], r["idx"], r["dx"], r["crown_radius_m"]) for r in rows] == [(10.0, 0, 0.0, 5.0), (10.0, 1, 6.0, 11.0)]


def test_text_files(spark, tmp_path):
    (tmp_path / "cells").write_text("# c\n389 5262 200\n389 5262 200\nx y\n391 5264 # end\n")
    assert sorted(map(tuple, tiles.read_cells(spark, str(tmp_path / "cells")).collect())) == [(389, 5262, 200), (391, 5264, None)]
    (tmp_path / "index").write_text("1 2 f\n3 4 v\nbad\n5 6 z\n")
    assert sorted(map(tuple, tiles.read_tile_index(spark, str(tmp_path / "index")).collect())) == [(1, 2, "f"), (3, 4, "v")]
    (tmp_path / "m.json").write_text('{"tiles": {"a": {"file": "a.glb", "tile_e": 1, "tile_n": 2, "center_e": 3, "center_n": 4}}}')
    assert tuple(tiles.read_manifest(spark, str(tmp_path / "m.json")).first()) == (0.0, 0.0, 1024.0, False, "a", "a.glb", 1, 2, 3.0, 4.0)
