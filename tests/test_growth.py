"""Edge cases and plans of queries that failed on larger tables."""

import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilefabric.operators import bakes, features, raster, spatial
from tilefabric.plans.queries import QUERIES, SQL
from tilefabric.streaming import residency

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

PX = "ei int, ni int, prow int, pcol int, h double"
BOX = "building_id long, x0 double, y0 double, z0 double, w double, d double, hgt double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_gap_whose_known_neighbours_have_no_weight_is_0(spark):
    fine = spark.createDataFrame([(0, 0, 0, 0, 0.0), (0, 0, 0, 1, 5.0), (0, 0, 1, 1, 0.0)], PX)
    coarse = spark.createDataFrame([(0, 0, 0, 0, 0.0), (0, 0, 0, 1, 7.0), (0, 0, 1, 0, 0.0), (0, 0, 1, 1, 9.0)], PX)
    got = {(r["prow"], r["pcol"]): r["h"] for r in raster.fill_from_coarser(fine, coarse, 2, 2).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 5.0, (1, 1): 9.0}


def test_neighbours_of_a_gap_are_added_row_by_row(spark):
    """They were added in the order of the join, so that a mean halfway between two rounded values was rounded either way."""
    rng = np.random.default_rng(5)
    at = lambda n: [(t, 0, r, c) for t in range(40) for r in range(n) for c in range(n)]
    fine = spark.createDataFrame([(*k, 0.0) for k in at(16)], PX).repartition(7, "pcol")
    known = {k: round(float(h), 3) * (rng.random() > 0.2) for k, h in zip(at(8), rng.uniform(310, 500, 40 * 64), strict=True)}
    coarse = spark.createDataFrame([(*k, h) for k, h in known.items()], PX).repartition(5, "prow")
    got = raster.fill_from_coarser(fine, coarse, 16, 8).collect()
    for t, _, r, c, h in got:
        x, y, total, weight = c * (7 / 15), r * (7 / 15), 0.0, 0.0
        for dr in (0, 1):
            for dc in (0, 1):
                near = known[t, 0, min(int(y) + dr, 7), min(int(x) + dc, 7)]
                w = (x % 1 if dc else 1 - x % 1) * (y % 1 if dr else 1 - y % 1)
                total, weight = total + near * w * (near != 0), weight + w * (near != 0)
        assert h == (total / weight if weight else 0.0)
    assert len(got) == 40 * 256


@pytest.mark.parametrize("made", [features.oriented_faces, features.weld_vertices])
def test_faces_of_a_building_are_never_joined_with_each_other(spark, made):
    """A table of faces looks small to Spark (by its boxes, before they were exploded), so a join would broadcast it."""
    faces = features.box_faces(spark.createDataFrame([(k, 10.0 * k, 0.0, 1.0, 4.0, 2.0, 3.0) for k in range(9)], BOX)).withColumn("face_no", F.length("face"))
    assert "Join" not in plan(made(faces))
    assert made(faces).count() == 54


@pytest.mark.parametrize("name", ["split_at_tiles", "tiles_by_source"])
def test_twins_agree_on_keys_of_larger_tables(spark, tmp_path, name):
    """Their SQL had ranges of tiles that fit the small tables only."""
    c = duckdb.connect()
    for table, shift in (("events", "user_id + 9000 as user_id"), ("supplier", "s_suppkey + 6000 as s_suppkey")):
        c.execute(f"copy (select * replace ({shift}) from '{SF}/{table}.parquet') to '{tmp_path}/{table}.parquet'")
        c.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = c.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert want and Counter(map(tuple, df.select(*columns).collect())) == Counter(want)


def test_near_segments_against_brute_force(spark):
    """Each pair once, steep and flat and pointlike segments, and none of those beyond the points goes to cells."""
    rng = np.random.default_rng(3)
    points = [(k, *map(float, p)) for k, p in enumerate(rng.uniform(-400, 400, (150, 2)))]
    lines = [(k, *map(float, s)) for k, s in enumerate(rng.uniform(-900, 900, (40, 4)))] + [(50, 5.0, -900.0, 5.0, 900.0), (51, -900.0, 7.0, 900.0, 7.0), (52, 1.0, 1.0, 1.0, 1.0), (53, 9e8, 0.0, 9e8, 9e9)]
    df, segs = spark.createDataFrame(points, "id long, e double, n double"), spark.createDataFrame(lines, "line long, e0 double, n0 double, e1 double, n1 double")

    def near(p, s):
        de, dn = s[3] - s[1], s[4] - s[2]
        t = min(1.0, max(0.0, ((p[1] - s[1]) * de + (p[2] - s[2]) * dn) / ((de * de + dn * dn) or 1.0)))
        return math.hypot(p[1] - s[1] - t * de, p[2] - s[2] - t * dn) < 30

    got = spatial.near_segments(df, segs, F.lit(30.0), 64.0)
    assert Counter((r["id"], r["line"]) for r in got.collect()) == Counter((p[0], s[0]) for p in points for s in lines if near(p, s))


#: Times as many rows over twice the tables: pairs of fixes and polygons grow with the square, and fixes near tiles in proportion.
TIMES = {"points_in_polygons": 4, "tiles_in_radius": 2}
CROWDED = ["points_in_polygons", "rasterise_classes", "tiles_in_radius", "surface_height", "apply_patches", "paint_corridors", "landcover_fallback", "clip_to_boundary"]


@pytest.mark.parametrize("name", CROWDED)
def test_jobs_grow_with_tables_of_further_keys(spark, tmp_path, name):
    """Further keys once lay farther east, away from the other rows, and the job over a larger table grew less than it does in one area."""
    assert "fx_line_vertex" not in SQL[name] or "(user_id % 50) * 400e0" in SQL[name]
    assert "fx_fix" not in SQL[name] or "(user_id % 50) * 400e0" in SQL[name]
    assert "fx_ring_vertex" not in SQL[name] or "(p.c_custkey % 40) * 500e0" in SQL[name]
    assert "fx_zone" not in SQL[name] or "(s_suppkey % 20) * 1000e0" in SQL[name]
    if name not in TIMES:
        return
    c = duckdb.connect()
    for table, shift in (("events", "user_id + 5000 as user_id, event_id + 16384 * 50 as event_id"), ("customer", "c_custkey + 40 * 33 * 13 * 5 as c_custkey"), ("orders", None)):
        more = f" union all select * replace ({shift}) from '{SF}/{table}.parquet'" if shift else ""
        c.execute(f"copy (select * from '{SF}/{table}.parquet'{more}) to '{tmp_path}/{table}.parquet'")
    assert QUERIES[name](spark, str(tmp_path)).count() == TIMES[name] * QUERIES[name](spark, SF).count() > 0


def test_stays_and_pixels_are_not_broadcast(spark):
    """Rows that an explode made look few to Spark."""
    fix = spark.createDataFrame([(t, k, k, k % 5, k % 3) for t in range(3) for k in range(20)], "track_id long, fix_id long, ts long, te int, tn int")
    assert "BroadcastHashJoin" not in plan(residency.residency_batch(fix, 2, 1))
    assert "Join" not in plan(residency.lod_changes_batch(fix, 4)) and "Join" not in plan(bakes.good_tiles(spark.createDataFrame([(0, 0, 0, 0, 1.0)], PX), 2, 0.25))


def test_chunk_resolutions_by_bands(spark):
    """Only moves on which a chunk's distance comes into another band are rows, dealt to all tasks; small and large steps to and fro over all borders."""
    rng = np.random.default_rng(7)
    rows, want = [], Counter()
    for t in range(3):
        e = n = 0
        held = {}
        for k in range(60):
            e, n = e + int(rng.integers(-6, 7)) * (1 + 9 * (k % 13 == 0)), n + int(rng.integers(-3, 4))
            rows.append((t, k, k, e, n))
            now = {}
            for i in range((e - 76) // 8, (e + 76) // 8 + 1):
                for j in range((n - 76) // 8, (n + 76) // 8 + 1):
                    d, old = max(i * 8 - e, e - i * 8 - 7, j * 8 - n, n - j * 8 - 7, 0), held.get((i, j))
                    if d <= 76:
                        now[i, j] = 129 if d <= 32 + 4 * (old == 129) else 65 if d <= 64 + 4 * (old == 65) else 33
                        if now[i, j] != old:
                            want[t, k, i, j, old, now[i, j]] += 1
            held = now
    got = residency.chunk_resolution_batch(spark.createDataFrame(rows, "track_id long, fix_id long, ts long, te int, tn int"), 76)
    assert "collect_list" not in plan(got) and "REPARTITION_BY_NUM" in plan(got)
    assert Counter(map(tuple, got.collect())) == want


def test_road_manifests_move_lines_only(spark):
    """Their vertices were sent to the height tiles and back, and sorted in as few tasks as the lines had."""
    roads = spark.createDataFrame([(1, "primary", 0, 0.0, 0.0), (1, "primary", 1, 5000.0, 100.0)], "line_id long, cls string, seq int, e double, n double")
    height = spark.createDataFrame([(0, 0, r, c, 500.0) for r in (0, 1) for c in (0, 1)], PX)
    vertices, manifest = bakes.road_tiles(roads, height, 2, most=50.0)
    text = plan(manifest)
    assert text.count("LeftOuter") == 1 and "REPARTITION_BY_NUM" in text
    assert sum(r["vertices"] for r in manifest.collect()) == vertices.count() > 200


@pytest.mark.parametrize(("load", "few"), [(10**9, 10**9), (10**9, 0), (50, 0)])
def test_tiles_go_only_to_cells_within_the_extent_of_fixes(spark, monkeypatch, load, few):
    """Tiles far from all fixes went to cells too, and all those rows were broadcast, as an explode's rows look few to Spark."""
    rng = np.random.default_rng(11)
    places = [(k, *map(float, p)) for k, p in enumerate(rng.uniform(0, 900, (300, 2)))]
    at = [(i, j) for i in range(-8, 9) for j in [*range(-8, 9), *range(100, 2_000)]]
    fixes = spark.createDataFrame([*places, (300, None, 5.0)], "fix_id long, e double, n double")
    tiles = spark.createDataFrame([(i, j, i * 200.0, j * 200.0) for i, j in at], "ei int, ni int, ce double, cn double")
    rows, keep = [], spatial.written

    def counted(df):
        rows.append(df.count())
        return keep(df)

    monkeypatch.setattr(spatial, "written", counted)
    got = spatial.tiles_in_radius(fixes, tiles, 400.0, ["fix_id"], load=load, few=few)
    assert len(rows) == 1 and 0 < rows[0] <= 17 * 17 * 19 * 19  # 17 x 17 tiles come near, each to 19 x 19 cells of 50 m at most
    if not few:
        assert re.search(r"\w+Join", plan(got)).group() == "SortMergeJoin" and plan(got).count("REPARTITION_BY_NUM") == 2
    want = Counter((k, i, j) for k, e, n in places for i, j in at if math.hypot(i * 200 - e, j * 200 - n) <= 400)
    assert want and Counter((r["fix_id"], r["ei"], r["ni"]) for r in got.collect()) == want
    assert spatial.tiles_in_radius(fixes.where("e is null"), tiles, 400.0, ["fix_id"], load=load, few=few).collect() == [] and rows[1] == 0


def test_pairs_of_points_and_polygons_are_not_shuffled(spark, monkeypatch):
    """Each crossing of a pair was a row, and all of them were sent by pair and counted there; polygons that lie on each other were tested one by one."""
    rng = np.random.default_rng(13)
    outer = [(0.0, 0.0), (900.0, 50.0), (700.0, 800.0), (100.0, 700.0)]
    hole = [(300.0, 300.0), (500.0, 300.0), (400.0, 500.0)]
    rows = [(p, r, k, p % 13, e + 150.0 * (p % 3), n) for p in range(40) for r, ring in enumerate((outer, hole)) for k, (e, n) in enumerate(ring)]
    rings = spark.createDataFrame(rows, "poly_id long, ring_no int, seq int, kind int, e double, n double")
    places = [(k, *map(float, p)) for k, p in enumerate(rng.uniform(-50, 1300, (300, 2)))]
    twice = [(400, 200.0, 200.0), (400, 210.0, 200.0), (400, -900.0, 0.0), (401, 200.0, 200.0), (401, -900.0, 0.0), (None, 200.0, 200.0)]
    points = spark.createDataFrame([*places, *twice, (402, None, 1.0)], "fix_id long, e double, n double")

    def inside(e, n, p):
        odd = False
        for ring in (outer, hole):
            for (a, b), (c, d) in zip(ring, ring[-1:] + ring[:-1], strict=True):
                odd ^= (b > n) != (d > n) and e - 150 * (p % 3) < (c - a) * (n - b) / (d - b) + a
        return odd

    want = Counter((k, p) for k, e, n in [*places, *twice] for p in range(40) if inside(e, n, p))
    want = Counter(pair for pair, times in want.items() if times % 2)  # points with the same key count as one
    shapes, cells = [], spatial.polygon_cells
    monkeypatch.setattr(spatial, "polygon_cells", lambda r, cell: shapes.append(r.select("poly_id").distinct().count()) or cells(r, cell))
    for load in (10**9, 40):
        got = spatial.points_in_polygons(points, rings, ["fix_id"], 256.0, load)
        assert Counter((r["fix_id"], r["poly_id"]) for r in got.collect()) == want
    alone = spatial.points_in_polygons(points.where("fix_id < 400"), rings, ["fix_id"], 256.0)
    after = re.split(r"\w+Join", plan(alone))[0]
    assert "SortMergeJoin" in plan(alone) and "Exchange" not in after and "Aggregate" not in after
    assert set(shapes) == {3}  # of 40 polygons
    kinds = {}
    for k, p in want:
        rank = {12: 0, 5: 1, 6: 2, 7: 3, 8: 4, 9: 5, 10: 6, 11: 7, 4: 9}.get(p % 13, 8)
        if p % 13 != 3:
            kinds[k] = max(kinds.get(k, (-1, -1)), (rank, p))
    got = spatial.rasterise_classes(points, rings, ["fix_id"])
    assert Counter(map(tuple, got.collect())) == Counter((k, p % 13) for k, (_, p) in kinds.items())
    assert "SortAggregate" not in plan(got)  # its input would be sorted before a pixel has one row
    any_of = spatial.in_any_polygon(points.where("fix_id < 400"), rings, ["fix_id"])
    assert sorted(r["fix_id"] for r in any_of.collect()) == sorted({k for k, _ in want if k is not None and k < 400})
    own = points.where("fix_id < 400").selectExpr("*", "fix_id % 50 as own")
    own = spatial.points_in_polygons(own, rings, ["own", "fix_id"], own="own")
    assert Counter((r["fix_id"], r["poly_id"]) for r in own.collect()) == Counter(x for x in want.elements() if x[0] is not None and x[0] < 400 and x[0] % 50 == x[1])


def test_triangles_beyond_all_hints_go_to_no_cell(spark, monkeypatch):
    """All triangles went to cells of a kilometre, and most of the pairs were beyond the tolerance."""
    rng = np.random.default_rng(17)
    points = [(k, *map(float, p), 100.0 + k % 7) for k, p in enumerate(rng.uniform(0, 1500, (120, 2)))]
    corner = lambda t, x, z: (float(x), t * 5.0 + float(rng.uniform(0, 9)), float(z))
    tris = [sum((corner(t, x + dx, z + dz) for dx, dz in ((0, 0), (500, 40), (90, 400))), ()) for t, (x, z) in enumerate(rng.uniform(-200, 1500, (90, 2)))]
    tris.append((0.0, 100.0, 0.0, 9.0, 100.0, 9.0, 18.0, 100.0, 18.0))  # no area
    sent, join = [], spatial.cell_join
    monkeypatch.setattr(spatial, "cell_join", lambda p, t, *a: sent.append(t.count()) or join(p, t, *a))
    df = spark.createDataFrame(tris, ", ".join(f"{a}{b} double" for a in "abc" for b in "xyz"))
    got = spatial.surface_height_at(spark.createDataFrame(points, "id long, e double, n double, hint double"), df, ["id"], 20.0)
    want = {}
    for k, e, n, hint in points:
        for ax, ay, az, bx, by, bz, cx, cy, cz in tris[:-1]:
            area = (bx - ax) * (cz - az) - (cx - ax) * (bz - az)
            u, v = ((bx - e) * (cz - n) - (cx - e) * (bz - n)) / area, ((cx - e) * (az - n) - (ax - e) * (cz - n)) / area
            y = u * ay + v * by + (1 - u - v) * cy
            if min(u, v, 1 - u - v) >= -1e-4 and abs(y - hint) <= 20:
                want[k] = max(want.get(k, y), y)
    assert {r["id"]: round(r["y"], 9) for r in got.collect()} == {k: round(y, 9) for k, y in want.items()} and want
    assert sent == [sum(min(t[1::3]) <= 126.1 and max(t[1::3]) >= 79.9 for t in tris[:-1])] and sent[0] < 20


def test_buildings_beyond_the_projection_are_counted_without_a_tile(spark):
    """NaN was cast to the number of a tile, which ended the job."""
    wall = lambda name, x, y: [(name, s, f, 0, k, x + 9 * (k in (1, 2)), y + 9 * (k > 1), 5.0 * f) for f, s in enumerate(("wall", "roof")) for k in range(4)]
    rows = wall("near", 472_609.0, 5_281_910.0) + wall("far", math.nan, math.nan) + wall("farther", 1e300, -1e300)
    faces = spark.createDataFrame(rows, "building_id string, surface string, face int, ring_no int, seq int, x double, y double, z double")
    sides, boxes, stats = bakes.building_tiles(faces, spark.createDataFrame([(0, 0, 0, 0, 450.0)], PX), 2)
    got = {r["tile_id"]: (r["buildings"], r["roof_triangles"], r["wall_triangles"], r["no_ground"]) for r in stats.collect()}
    assert got.pop(None) == (2, 4, 4, None) and [*got.values()] == [(1, 2, 2, 1)]
    assert [r["building_id"] for r in boxes.collect()] == ["near"] and sides.count() == 2
