"""Operators against plain Python: polygons, packed tiles, gaps, bakes, chunks and hand-off."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilefabric.functions import geodesy, grid
from tilefabric.operators import audit, bakes, features, lines, raster, spatial
from tilefabric.streaming import residency

RINGS = "poly_id long, ring_no int, seq int, e double, n double"


def inside(ring_list, x, y):
    hits = 0
    for ring in ring_list:
        for (x1, y1), (x0, y0) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
            if (y1 > y) != (y0 > y) and x < (x0 - x1) * (y - y1) / (y0 - y1) + x1:
                hits += 1
    return hits % 2 == 1


def ring_rows(polys):
    return [(p, r, k, float(e), float(n)) for p, rings in polys.items() for r, ring in enumerate(rings) for k, (e, n) in enumerate(ring)]


@pytest.mark.parametrize("cell", [64.0, 700.0])
def test_points_in_polygons_by_cells(spark, cell):
    rng = np.random.default_rng(11)
    polys = {}
    for p in range(12):
        at, turn = rng.uniform(-900, 900, 2), np.sort(rng.uniform(0, 2 * np.pi, 17))
        star = [(at[0] + r * np.cos(a), at[1] + r * np.sin(a)) for a, r in zip(turn, rng.uniform(60, 700, 17), strict=True)]
        hole = [(at[0] + 30 * np.cos(a), at[1] + 30 * np.sin(a)) for a in np.linspace(0, 6, 7)]
        polys[p] = [star, hole]
    polys[50] = [[(-500, -500), (500, -500), (500, 500), (-500, 500)], [(-128, -128), (128, -128), (128, 128), (-128, 128)]]  # along the cells' edges
    polys[51] = [[(0, 0), (640, 0), (640, 64), (320, 64), (320, 128), (0, 128)]]
    points = [(k, float(e), float(n)) for k, (e, n) in enumerate(rng.uniform(-1600, 1600, (700, 2)))]
    points += [(1000 + k, float(e), float(n)) for k, (e, n) in enumerate((a, b) for a in (-500, -128, -64, 0, 64, 128, 320, 500, 640) for b in (-500, -128, -64, 0, 64, 128, 500))]
    got = spatial.points_in_polygons(spark.createDataFrame(points, "id long, e double, n double"), spark.createDataFrame(ring_rows(polys), RINGS), ["id"], cell)
    assert Counter(map(tuple, got.collect())) == Counter((k, p) for k, e, n in points for p, rings in polys.items() if inside(rings, e, n))


def test_big_polygons_do_not_carry_their_edges_to_every_cell(spark):
    turn = np.linspace(0, 2 * np.pi, 4000, endpoint=False)
    ring = spark.createDataFrame(ring_rows({1: [[(20_000 * np.cos(a), 20_000 * np.sin(a)) for a in turn]]}), RINGS)
    edges = spatial.ring_edges(ring).select("poly_id", "e", "n", "e0", "n0")
    assert spatial._edges_by_cell(edges, 200.0).count() < 4 * 4000
    assert spatial._cells_inside(edges, 200.0).count() == pytest.approx(np.pi * 100**2, rel=0.01)


def test_polygon_clip_drops_holes_with_their_outer_ring(spark):
    polys = {1: [[(0, 0), (100, 0), (100, 100), (0, 100)], [(300, 10), (310, 10), (310, 20), (300, 20)]], 2: [[(0, 0), (300, 0), (300, 50), (0, 50)], [(10, 10), (290, 10), (290, 40), (10, 40)]], 3: [[(0, 0), (10, 10)], [(1, 1), (5, 1), (5, 5)]]}
    got = spatial.clip_polygons_to_tiles(spark.createDataFrame(ring_rows(polys), RINGS), 256.0)
    have = Counter((r["poly_id"], r["ring_no"], r["ei"]) for r in got.collect())
    assert have == {(1, 0, 0): 4, (2, 0, 0): 4, (2, 1, 0): 4, (2, 0, 1): 4, (2, 1, 1): 4}


def test_packed_tiles_have_nulls_where_pixels_are_missing(spark):
    rng = random.Random(12)
    px = [(t, 0, r, c, float(10 * r + c)) for t in range(3) for r in range(5) for c in range(5) if t == 0 or rng.random() < 0.5]
    df = spark.createDataFrame(px, "ei int, ni int, prow int, pcol int, h double")
    got = {r["ei"]: r["tile"] for r in raster.packed(df, 5).collect()}
    for t in range(3):
        have = {(r, c): h for ei, _, r, c, h in px if ei == t}
        assert got[t] == [have.get((r, c)) for r in range(5) for c in range(5)]
    points = spark.createDataFrame([(k, rng.uniform(0, 4096), rng.uniform(-100, 1100)) for k in range(300)], "id long, e double, n double")
    both = raster.sample_height(points, df, ["id"], 5), raster.sample_height(points, raster.packed(df, 5), ["id"], 5)
    assert Counter(map(tuple, both[0].collect())) == Counter(map(tuple, both[1].collect()))
    plan = both[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 0 and plan.count("Join LeftOuter") == 1


def test_gaps_fill_until_nothing_changes(spark):
    rng = np.random.default_rng(13)
    rows = []
    for t, share in enumerate((0.5, 0.9, 0.98, 1.0)):
        rows += [(t, 0, r, c, float(rng.uniform(1, 9)) if rng.random() >= share and not (t == 1 and r > 5) else None if (r + c) % 2 else 0.0) for r in range(12) for c in range(9) if (t, r, c) != (0, 11, 8)]
    df = spark.createDataFrame(rows, "ei int, ni int, prow int, pcol int, h double")
    got = {tuple(r)[:4]: r["h"] for r in raster.fill_gaps_neighbours(df).collect()}
    for t in range(4):
        now = {(r, c): h or None for ei, _, r, c, h in rows if ei == t}
        while True:
            new = {}
            for (r, c), h in now.items():
                near = [now.get((r + i, c + j)) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
                near = [x for x in near if x is not None]
                if h is None and near:
                    new[r, c] = sum(near) / len(near)
            if not new:
                break
            now |= new
        assert {k[2:]: v for k, v in got.items() if k[0] == t} == pytest.approx({k: v or 0.0 for k, v in now.items()})


def test_inverse_distance_stops_at_its_reach(spark):
    df = spark.createDataFrame([(0, 0, 0, c, 5.0 if c == 0 else 9.0 if c == 9 else 0.0) for c in range(10)], "ei int, ni int, prow int, pcol int, h double")
    got = {r["pcol"]: r["h"] for r in raster.fill_gaps_idw(df, 3).collect()}
    assert got[3] == pytest.approx(5) and got[4] is None and got[5] is None and got[6] == pytest.approx(9)
    assert {r["pcol"]: r["h"] for r in raster.fill_gaps_idw(df).collect()}[3] == pytest.approx((5 / 3 + 9 / 6) / (1 / 3 + 1 / 6))


def brute_means(have, size, windows):
    out = {}
    for key, r0, r1, c0, c1 in windows:
        v = [have[r, c] for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if (r, c) in have]
        if v:
            v = [x for x in v if x is not None]
            out[key] = sum(v) / len(v) if v else None
    return out


@pytest.mark.parametrize(("size", "stride"), [(16, 5), (17, 4), (9, 8), (8, 1)])
def test_level_means_from_summed_areas(spark, size, stride):
    """Tiles with holes and nulls, against means of each window's own pixels."""
    rng = random.Random(size * 31 + stride)
    tiles = {(ei, -3): {(r, c): None if rng.random() < 0.3 else rng.uniform(-5, 4000) for r in range(size) for c in range(size) if rng.random() < 0.6} for ei in (-2, 7)}
    df = spark.createDataFrame([(*t, r, c, h) for t, px in tiles.items() for (r, c), h in px.items()], "ei int, ni int, prow int, pcol int, h double")
    got = {(x["ei"], x["ni"], x["prow"], x["pcol"]): x["h"] for x in raster.lod_downsample(df, size, stride).collect()}
    want, last = {}, size - 1
    for t, have in tiles.items():
        windows = []
        for r in range(0, size, stride):
            for c in range(0, size, stride):
                k = 0 if r in (0, last) or c in (0, last) else stride // 2
                windows.append(((*t, r, c), max(r - k, 0), min(r + k, last), max(c - k, 0), min(c + k, last)))
        want |= brute_means(have, size, windows)
    assert got.keys() == want.keys()
    assert all(got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    border = {k: v for k, v in want.items() if k[2] in (0, last) or k[3] in (0, last)}
    assert border and all(got[k] == v for k, v in border.items())  # as they are, to the bit
    assert raster.lod_downsample(df.where("false"), size, stride).collect() == []


def test_window_means_move_each_pixel_once(spark):
    df = spark.range(4).selectExpr("0 AS ei", "0 AS ni", "int(id div 2) AS prow", "int(id % 2) AS pcol", "1D AS h")
    plan = raster.lod_downsample(df, 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def same_place(p):
    return p.withColumns({"se": F.col("e"), "sn": F.col("n")})


def swiss_to_utm(p):
    return geodesy.lv95_to_utm32(p, "e", "n", "se", "sn")


def bent(p):
    """A projection that bends far too much for a lattice in tiles from 3 on."""
    return p.withColumns({"se": F.col("e") + F.when(F.col("e") > 3072, 40 * F.sin(F.col("e") / 90)).otherwise(0.0), "sn": F.col("n")})


def exact_pixels(tiles, px, to):
    k = F.sequence(F.lit(0), F.lit(px - 1))
    p = to(raster.pixel_centres(tiles.withColumn("prow", F.explode(k)).withColumn("pcol", F.explode(k)), px))
    return {(r["ei"], r["ni"], r["prow"], r["pcol"]): (r["se"], r["sn"]) for r in p.collect()}


def lattice_pixels(tiles, px, to, **how):
    return {(r["_ei"], r["_ni"], r["prow"], r["pcol"]): (r["e"], r["n"]) for r in bakes.destination_pixels(tiles, px, to, **how).collect()}


def test_lattice_places_are_within_a_tenth_of_a_millimetre(spark):
    """Corners and middle of the country; the stated bound holds and is not far from the truth."""
    tiles = spark.createDataFrame([(2426, 1050), (2539, 1171), (2760, 1264), (2760, 1050), (2426, 1264)], "ei int, ni int")
    want, got = exact_pixels(tiles, 24, swiss_to_utm), lattice_pixels(tiles, 24, swiss_to_utm)
    assert got.keys() == want.keys() and len(got) == 5 * 24 * 24
    off = {}
    for k, v in want.items():
        off[k[:2]] = max(off.get(k[:2], 0.0), math.dist(v, got[k]))
    bound = {(r["ei"], r["ni"]): r["off"] for r in bakes.tile_lattices(tiles, swiss_to_utm).collect()}
    assert max(off.values()) < 1e-4
    assert all(off[t] <= bound[t] < 1e-3 for t in off)
    assert lattice_pixels(tiles, 24, swiss_to_utm, most_off=-1.0) == want  # all of them one by one


def test_tiles_that_bend_too_much_are_projected_pixel_by_pixel(spark):
    tiles = spark.createDataFrame([(1, 0), (4, 0), (4, 0)], "ei int, ni int")
    bound = {r["ei"]: r["off"] for r in bakes.tile_lattices(tiles, bent).collect()}
    assert bound[1] == 0 and bound[4] > 1
    want, got = exact_pixels(tiles.distinct(), 16, bent), lattice_pixels(tiles, 16, bent)
    assert got.keys() == want.keys()
    assert all(got[k] == v if k[0] == 4 else math.dist(got[k], v) < 1e-9 for k, v in want.items())


@pytest.mark.parametrize("hole", [None, float("nan"), float("inf")])
def test_a_lattice_with_a_node_without_a_place_is_not_used(spark, hole):
    to = lambda p: p.withColumns({"se": F.when(F.col("e") > 900, F.lit(hole).cast("double")).otherwise(F.col("e")), "sn": F.col("n")})
    tiles = spark.createDataFrame([(0, 0)], "ei int, ni int")
    assert bakes.tile_lattices(tiles, to).collect()[0]["off"] == float("inf")
    got = lattice_pixels(tiles, 16, to)
    assert len(got) == 256 and got[0, 0, 3, 15][0] == pytest.approx(32.0) and repr(got[0, 0, 3, 0][0]) == repr(hole)


def test_height_bake_takes_the_first_source_and_leaves_sparse_tiles_out(spark):
    rng = random.Random(14)
    rows = [(s, ei, 0, r, c, 0.0 if rng.random() < (0.3 if ei < 2 else 0.97) else 100.0 * (s + 1) + r) for s in (0, 1) for ei in range(3) for r in range(16) for c in range(16)]
    src = spark.createDataFrame(rows, "source int, ei int, ni int, prow int, pcol int, h double")
    tiles = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (9, 9)], "ei int, ni int")
    got = {(r["ei"], r["prow"], r["pcol"]): r["h"] for r in bakes.render_height_tiles(src, tiles, same_place, 8, 16, 0.3).collect()}
    have = {(s, ei, r, c): h for s, ei, _, r, c, h in rows}
    step, share = 1024 / 8, Counter()
    for ei in range(3):
        for r in range(8):
            for c in range(8):
                x, y = (1 - (1024 - (c + 0.5) * step) / 1024) * 15, (r + 0.5) * step / 1024 * 15
                c0, r0 = int(x), int(y)
                corners = [(min(r0 + i, 15), min(c0 + j, 15), (y - r0 if i else 1 - y + r0) * (x - c0 if j else 1 - x + c0)) for i in (0, 1) for j in (0, 1)]
                for s in (0, 1):
                    v = [(have[s, ei, i, j], w) for i, j, w in corners]
                    if all(h for h, _ in v):
                        share[ei] += 1
                        if (ei, r, c) in got:
                            assert got[ei, r, c] == pytest.approx(sum(h * w for h, w in v))
                        break
    assert {k[0] for k in got} == {ei for ei in range(3) if share[ei] >= 0.3 * 64} and 0 < len(got) < 3 * 64 and all(v is not None for v in got.values())


def test_photo_bake(spark):
    rows = [(s, ei, 0, r, c, 40 * s + 10 * ei + 9, r, c) for s in (0, 1) for ei in (0, 1) for r in range(16) for c in range(16) if (s, ei) != (0, 1) and not (s == 0 and r in (7, 8) and c in (7, 8))]
    src = spark.createDataFrame(rows, "source int, ei int, ni int, prow int, pcol int, r int, g int, b int")
    tiles = spark.createDataFrame([(0, 0), (1, 0), (5, 5)], "ei int, ni int")
    got = defaultdict(dict)
    for r in bakes.render_rgb_tiles(src, tiles, same_place, 16, 16, levels=(1, 4)).collect():
        got[r["level"], r["ei"]][r["prow"], r["pcol"]] = (r["r"], r["g"], r["b"])
    assert sorted(got) == [(1, 0), (1, 1), (4, 0), (4, 1)] and all(len(v) == (256 if k[0] == 1 else 16) for k, v in got.items())
    assert set(x[0] for x in got[1, 1].values()) == {59} and got[1, 0][0, 0][0] == 9  # the first source where it covers, else the second
    assert got[1, 0][7, 7][0] == 49 and got[1, 0][3, 3][1] == pytest.approx(3, abs=1)


def test_road_bake_counts_what_it_makes(spark):
    rng = np.random.default_rng(15)
    v = [(k, ["primary", "railway:tram", "path"][k % 3], i, float(e), float(n)) for k in range(9) for i, (e, n) in enumerate(rng.uniform(0, 9000, (4, 2)))]
    roads = spark.createDataFrame(v, "line_id long, cls string, seq int, e double, n double")
    height = spark.createDataFrame([(ei, ni, r, c, 500.0) for ei in range(4) for ni in range(9) for r in range(2) for c in range(2)], "ei int, ni int, prow int, pcol int, h double")
    vertices, manifest = bakes.road_tiles(roads, height, 2, most=50.0)
    rows, tiles = vertices.collect(), {(r["ei"], r["ni"]): r for r in manifest.collect()}
    assert {r["line_id"] % 3 for r in rows} == {0, 1}
    sides = defaultdict(dict)
    for r in rows:
        sides[r["line_id"], r["piece"], r["seq"]][r["side"]] = r
    for (line, _, _), s in sides.items():
        a, b, width = s["left"], s["right"], 12.0 if line % 3 == 0 else 2.0
        assert width - 1e-6 <= math.hypot(a["e"] - b["e"], a["n"] - b["n"]) <= 2.5 * width + 1e-6
        assert a["y"] == pytest.approx(500.4) or a["y"] == pytest.approx(0.4)
    assert {round(a["y"], 6) for s in sides.values() for a in s.values()} == {500.4, 0.4}
    for t, m in tiles.items():
        own = [r for r in rows if (r["ei"], r["ni"]) == t]
        pieces = Counter((r["line_id"], r["piece"]) for r in own)
        assert (m["vertices"], m["segments"]) == (len(own), sum(n // 2 - 1 for n in pieces.values()))
        assert m["center_e"] == pytest.approx(np.mean([r["e"] for r in own]), abs=0.51) and m["file"] == f"roads_{t[0] * 4096}_{t[1] * 4096}.glb"
    middles = lines.tile_pieces(lines.densify(roads.where("cls <> 'path'"), 50.0).withColumn("seq", F.col("seq") * 1000 + F.col("part")), 4096.0)
    length = lines.segments(middles.withColumn("line_id", F.struct("line_id", "piece"))).agg(F.sum("length")).first()[0]
    assert length == pytest.approx(lines.segments(roads.where("cls <> 'path'")).agg(F.sum("length")).first()[0])


def test_water_bake(spark):
    streams = spark.createDataFrame([(1, "river", 0, 100.0, 100.0), (1, "river", 1, 5000.0, 100.0), (2, "ditch", 0, 0.0, 0.0), (2, "ditch", 1, 9.0, 9.0)], "line_id long, cls string, seq int, e double, n double")
    lake = spark.createDataFrame(ring_rows({7: [[(4000, 0), (4200, 0), (4200, 900), (4000, 900)]]}), RINGS)
    height = spark.createDataFrame([(ei, 0, r, c, 100.0 * ei) for ei in (3, 4) for r in (0, 1) for c in (0, 1)], "ei int, ni int, prow int, pcol int, h double")
    lakes, ribbons, manifest = bakes.water_tiles(streams, lake, height, 2)
    assert {r["ei"]: r["level"] for r in lakes.collect()} == pytest.approx({0: 351.5, 1: 401.5})  # the shared edge lies in tile 4 of the heights
    assert {(r["ei"], r["streams"], r["polygons"], r["vertices"]) for r in manifest.collect()} == {(0, 1, 1, 8), (1, 1, 1, 8)}
    assert {r["line_id"] for r in ribbons.collect()} == {1}


def test_building_bake(spark):
    def box(name, x, y, z, w, d, h, ground=True):
        corner = lambda s: (x + w * int(s[0]), y + d * int(s[1]), z + h * int(s[2]))
        sides = {("roof", 1): "001 101 111 011", ("wall", 2): "000 100 101 001", ("wall", 3): "010 011 111 110", ("wall", 4): "000 001 011 010", ("wall", 5): "100 110 111 101"} | ({("ground", 0): "000 010 110 100"} if ground else {})
        return [(name, s, f, 0, k, *map(float, corner(c))) for (s, f), text in sides.items() for k, c in enumerate(text.split())]

    x, y = 472_609.944, 5_281_910.465
    rows = box("{a-1}", x, y, 400, 10, 8, 5) + box("b", x + 30, y, 390, 0.5, 0.5, 3) + [("c", "ground", 9, 0, k, x + k, y + k % 2, 1.0) for k in range(4)] + box("d", x + 3000, y, 7, 10, 8, 5)
    rows = [r for r in rows if r[1] != "wall" or r[2] != 3] + [("{a-1}", "wall", 3, 0, k, r[5], r[6], r[7]) for k, r in enumerate(reversed([r for r in rows if r[0] == "{a-1}" and r[2] == 3]))] + [r for r in rows if r[0] != "{a-1}" and r[2] == 3]
    faces = spark.createDataFrame(rows, "building_id string, surface string, face int, ring_no int, seq int, x double, y double, z double")
    e, n = (int(v // 1024) for v in (2_689_818.576, 1_282_837.796))
    height = spark.createDataFrame([(e, n, r, c, 450.0) for r in (0, 1) for c in (0, 1)], "ei int, ni int, prow int, pcol int, h double")
    sides, boxes, stats = bakes.building_tiles(faces, height, 2)
    b = {r["building_id"]: r for r in boxes.collect()}
    assert sorted(b) == ["a1", "d"] and b["a1"]["min_z"] == 450.0 and b["a1"]["max_z"] == 455.0 and b["a1"]["shifted"] and not b["d"]["shifted"] and b["d"]["min_z"] == 7.0
    parts = Counter((r["building_id"], r["part"]) for r in sides.collect())
    assert parts == {("a1", "roof"): 1, ("a1", "wall"): 4, ("d", "roof"): 1, ("d", "wall"): 4}
    assert all(r["nz"] > 0.99 if r["part"] == "roof" else abs(r["nz"]) < 1e-6 for r in sides.collect())
    s = {(r["ei"], r["ni"]): r for r in stats.collect()}
    own = s[e, n]
    assert (own["buildings"], own["roof_triangles"], own["wall_triangles"], own["skipped_empty"], own["skipped_tiny"], own["shifted"], own["no_ground"]) == (1, 2, 8, 1, 1, 1, 0)
    holed = spark.createDataFrame([("h", "roof", 0, r, k, 10.0 * k % 20 + r, 10.0 * (k // 2) + r, 0.0) for r in (0, 1) for k in range(4)], faces.schema)
    assert features.building_stats(holed, 1024.0).first()["roof_triangles"] == 8  # eight corners, less two, and two for the hole


def test_vegetation_bake(spark):
    rings = ring_rows({1: [[(100, 100), (900, 100), (900, 900), (100, 900)]], 2: [[(0, 0), (50, 0), (50, 50)]]})
    df = spark.createDataFrame(rings, RINGS).withColumn("objektart", F.when(F.col("poly_id") == 1, "Wald").otherwise("See"))
    single = spark.createDataFrame([(30.0, 40.0), (950.0, 950.0), (5000.0, 40.0)], "e double, n double")
    height = spark.createDataFrame([(0, 0, r, c, 0.0 if (r, c) == (3, 0) else 600.0) for r in range(4) for c in range(4)], "ei int, ni int, prow int, pcol int, h double")
    got = bakes.extract_vegetation(df, single, height, 4, 25.0)
    rows = got.collect()
    assert len(rows) > 200 and all(r["ground_z"] == 600.0 and 4 <= r["height_m"] <= 45 and r["crown_radius_m"] == pytest.approx(0.3 * r["height_m"]) and 0 <= r["yaw_rad"] < 6.2832 for r in rows)
    at = np.array([(r["e"], r["n"]) for r in rows])
    assert (30.0, 40.0) in {tuple(x) for x in at} and (950.0, 950.0) not in {tuple(x) for x in at}  # no data there
    wood = at[(at >= 100).all(axis=1)]
    d = np.hypot(*(wood[:, None] - wood[None]).transpose(2, 0, 1)) + 1e9 * np.eye(len(wood))
    assert d.min() >= 25 and np.mean([r["height_m"] for r in rows]) == pytest.approx(22, abs=1)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, bakes.extract_vegetation(df.repartition(3), single, height, 4, 25.0).collect()))


def test_raster_catalog(spark):
    px = spark.createDataFrame([("a", "EPSG:2056", None, 1.0, 2.0), ("a", "EPSG:2056", None, 5.0, 9.0), ("b", None, -9.0, 472_000.0, 5_281_000.0), ("b", None, -9.0, 474_000.0, 5_283_000.0)], "path string, crs string, nodata double, x double, y double")
    to = {"EPSG:2056": None, "EPSG:25832": lambda p: geodesy.utm32_to_lv95(p, "fe", "fn", "te", "tn")}
    got = {r["path"]: r for r in bakes.raster_catalog(px, to, "EPSG:25832").collect()}
    assert tuple(got["a"])[1:] == ("EPSG:2056", 0.0, 1.0, 2.0, 5.0, 9.0)
    assert got["b"]["nodata"] == -9.0 and got["b"]["right"] - got["b"]["left"] > 2000 and 2_680_000 < got["b"]["left"] < 2_700_000
    with pytest.raises(Exception, match="no known reference system"):
        bakes.raster_catalog(px, to).collect()


def test_coverage_report(spark):
    same = lambda a, b: lambda p: p.withColumns({b[0]: F.col(a[0]), b[1]: F.col(a[1])})
    there, back = same(("e", "n"), ("ue", "un")), same(("ue", "un"), ("e", "n"))
    tiles = spark.createDataFrame([(i, j) for i in range(8) for j in range(8) if (i, j) != (4, 1)], "ei int, ni int")
    probes = spark.createDataFrame([("2024-01-01", 1, 2, 200), ("2024-01-01", 3, 0, 200), ("2024-01-02", 3, 0, 0), ("2024-01-01", 7, 4, 404), ("2024-01-01", 99, 0, 200)], "ts string, e_km int, n_km int, status int")
    bounds, reference = spark.createDataFrame([(0, 0, 9, 8)], "e0 int, n0 int, e1 int, n1 int"), spark.createDataFrame([(7, 6), (1, 0)], "e_km int, n_km int")
    missing, by_column = bakes.coverage_report(bounds, probes, tiles, reference, there, back)
    assert sorted(map(tuple, missing.collect())) == [(3, 0), (7, 6)] and sorted(map(tuple, by_column.collect())) == [(3, 1), (7, 1)]
    cells, box = bakes.gap_report(tiles, None, there)
    assert sorted(map(tuple, cells.collect())) == [(3, 0), (3, 2), (5, 0), (5, 2)] and tuple(box.first()) == (3, 0, 7, 4)


def test_degenerate_positions_and_draping_on_a_round_earth(spark):
    r = geodesy.ecef_to_geodetic(spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")).first()
    assert (r["lat"], r["lon"], r["h"]) == (0.0, 0.0, -6378137.0)
    v = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (2, 0, 0, 6000.0, 8000.0), (3, 1, 0, 0.0, 0.0)], "id int, ei int, ni int, e double, n double").withColumns({"ce": F.lit(0.0), "cn": F.lit(0.0)})
    h = spark.createDataFrame([(1, 100.0), (2, None), (3, None)], "id int, h double")
    got = {x["id"]: (x["y"], x["pending"]) for x in lines.drape(v, h, ["id"], ["ei", "ni"], 1.0, ("ce", "cn")).collect()}
    assert got[1] == (101.0, False) and got[2][0] == pytest.approx(101 - 1e8 / (2 * 6_371_000)) and got[3] == (None, True)


def test_numbers_and_places(spark):
    rng = random.Random(16)
    rows = [(rng.randint(-20, 20), rng.randint(-20, 20)) for _ in range(200)]
    df = spark.createDataFrame(sorted(set(rows)), "ei int, ni int").repartition(5)
    want = sorted(((max(abs(a), abs(b)), a, b) for a, b in set(rows)))
    assert [(r["distance"], r["ei"], r["ni"]) for r in audit.nearest_first(df, F.lit(0), F.lit(0)).orderBy("place").collect()] == want
    ranged = [[(r["ni"], r["ei"]) for r in part] for part in audit.locality_sort(df, 4).rdd.glom().collect()]
    assert all(p == sorted(p) for p in ranged) and sum(map(len, ranged)) == len(want)
    named = spark.createDataFrame([("LoD2_32_495_5288_2_bw", "495_5288"), ("tile_1", "tile_1"), ("lod_1", "lod_1")], "a string, b string")
    assert named.where(grid.parse_lod_tile_id(F.col("a")) != F.col("b")).count() == 0


def test_chunk_resolutions_are_remembered(spark):
    rng = np.random.default_rng(17)
    rows = [(t, 100 * t + k, f"2024-01-01 00:{k:02d}:00", int(e), int(n)) for t in range(2) for k, (e, n) in enumerate(np.cumsum(rng.integers(-9, 10, (20, 2)), axis=0))]
    df = spark.createDataFrame(rows, "track_id long, fix_id long, ts string, te int, tn int").withColumn("ts", F.col("ts").cast("timestamp"))
    want = Counter()
    for t in range(2):
        held = {}
        for _, fix, _, e, n in (r for r in rows if r[0] == t):
            now = {}
            for i in range((e - 70) // 8, (e + 70) // 8 + 1):
                for j in range((n - 70) // 8, (n + 70) // 8 + 1):
                    d, old = max(i * 8 - e, e - i * 8 - 7, j * 8 - n, n - j * 8 - 7, 0), held.get((i, j))
                    if d > 70:
                        continue
                    near, mid = 32 + (4 if old == 129 else 0), 64 + (4 if old == 65 else 0)  # only coarsening waits
                    new = 129 if d <= near else 65 if d <= mid else 33
                    now[i, j] = new
                    if new != old:
                        want[t, fix, i, j, old, new] += 1
            held = now
    batch = Counter(map(tuple, residency.chunk_resolution_batch(df, 70).collect()))
    assert batch == want and any(k[4] == 65 for k in want)


def test_tiles_and_chunks_wait_for_each_other(spark):
    events = [(0, "fix", 0, 0), *((k, "tile", i, j) for k, (i, j) in enumerate(((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)), 1)), (20, "fix", 6, 0), (21, "chunk", -1, -1), (22, "chunk", 0, 0), (23, "fix", 40, 0)]
    rows = [(5, 100 + k, f"2024-01-01 00:{k:02d}:00", *r[1:]) for k, r in enumerate(events)]
    df = spark.createDataFrame(rows, "track_id long, event_id long, ts string, kind string, a int, b int").withColumn("ts", F.col("ts").cast("timestamp"))
    args = (1, 1, 6, 2)
    batch = Counter(map(tuple, residency.handoff_batch(df, *args).collect()))
    moved = {k[1:] for k in batch}
    # After the move, tile (0, 0) stays until the chunk over it is there; tile (-1, -1) is too far for chunks.
    gone = {(a, b): event for event, kind, a, b, action in moved if kind == "tile" and action == "unload"}
    assert gone[-1, -1] == 110 and gone[0, 0] == gone[1, 1] == 112 and gone[0, 1] == 112
    assert {k for k in moved if k[0] == 113 and k[4] == "unload" and k[1] == "chunk"} and all(n == 1 for n in batch.values())


def test_a_small_chunk_goes_once_its_tiles_are_there(spark):
    near = [("fix", 0, 0), *(("tile", i, j) for i in range(-4, 5) for j in range(-4, 5))]
    far_first = [("fix", 9, 0), ("fix", 0, 0), *near[1:]]
    df = spark.createDataFrame([(1, k, k, *e) for k, e in enumerate(far_first)], "track_id long, event_id long, ts int, kind string, a int, b int")
    got = residency.handoff_batch(df, 4, 1, 12, 2).where("kind = 'chunk' and a = 0 and b = 0").orderBy("event_id").collect()
    assert [r["action"] for r in got] == ["load", "unload"] and got[1]["event_id"] == 2 + 9 * 5 + 5  # when tile (1, 1), the last of the four, came


def test_probe_status_stream(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", 1, 2, 404), ("2024-01-01 00:02:00", 1, 2, 200), ("2024-01-01 00:09:00", 1, 2, 0), ("2024-01-01 00:08:00", 3, 4, 404), ("2024-01-01 00:01:00", 3, 4, 200)]
    df = spark.createDataFrame(rows, "ts string, e_km int, n_km int, status int").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (df.where("minute(ts) < 7"), df.where("minute(ts) >= 7")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = residency.probe_status_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("status_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, audit.last_status(df).collect()))
    assert sorted(map(tuple, spark.table("status_out").collect())) == want == [(1, 2, 200), (3, 4, 404)]


def test_draining_takes_each_file_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    work = lambda df: df.groupBy("k").agg(F.sum("v").alias("v"))
    for k in (1, 2):
        spark.createDataFrame([(k, 10 * k), (k, 1)], "k int, v long").coalesce(1).write.mode("append").parquet(src)
        residency.drain(spark, src, "k int, v long", work, out, cp)
    residency.drain(spark, src, "k int, v long", work, out, cp)
    assert sorted((r["batch"], r["k"], r["v"]) for r in spark.read.parquet(f"{out}/data").collect()) == [(0, 1, 11), (1, 2, 21)]
    released = spark.read.parquet(f"{out}/released")
    assert released.count() == 2 and {r["file"].rsplit("/", 1)[0].replace("file://", "file:") for r in released.collect()} == {f"file:{src}"}


def test_what_is_there_stands_in_for_a_probe_and_counts_once_converted(spark):
    """What is there was added to what is wanted and taken away again, without any effect."""
    cells = lambda *e: spark.createDataFrame([(k, 0) for k in e], "e_km int, n_km int")
    every, have, published, reference = cells(1, 3, 5, 7, 9), cells(1, 3, 3), cells(3, 5, 11), cells(7, 7, 1)
    found = lambda *a: sorted(r["e_km"] for r in audit.audit(*a).collect())
    assert found(every, have, published, reference) == [5, 7]
    assert found(every, have, None, reference) == [7]
    assert found(every, have, None, reference, cells(3)) == [1, 7]
    assert found(every, have, published, reference, cells(3, 7)) == [1, 5]
