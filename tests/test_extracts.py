"""A small map extract baked into road and water tiles, step by step against plain rules."""

import math

import numpy as np
from pyspark.sql import functions as F

from tilefabric.functions import geodesy
from tilefabric.sources import extracts


def test_an_extract_becomes_tiles(spark, tmp_path):
    # A grid of nodes near Zurich; about 75 m a step in longitude, 111 m in latitude.
    at = {100 * i + j: (47.40 + i * 0.001, 8.50 + j * 0.001) for i in range(40) for j in range(40)}
    nodes = "".join(f'<node id="{k}" lat="{a}" lon="{b}"/>' for k, (a, b) in at.items())
    way = lambda k, refs, **tags: f'<way id="{k}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + "".join(f'<tag k="{a}" v="{b}"/>' for a, b in tags.items()) + "</way>"
    row = lambda i, a, b: [100 * i + j for j in range(a, b)]
    ring = lambda i, j, s: [100 * i + j, 100 * i + j + s, 100 * (i + s) + j + s, 100 * (i + s) + j, 100 * i + j]
    ways = [
        way(1, row(3, 0, 30), highway="primary"), way(2, row(5, 0, 9), highway="footway"), way(3, row(6, 1, 12), railway="rail"),
        way(4, row(7, 1, 12), railway="rail", tunnel="yes"), way(5, row(38, 2, 30), highway="primary"),  # beyond the boundary
        way(10, row(10, 0, 20), waterway="river"), way(11, row(12, 0, 9), waterway="canal", area="yes"), way(12, row(13, 0, 9), waterway="stream"),
        way(20, ring(15, 4, 4), natural="water"), way(21, ring(20, 4, 4), waterway="river", area="yes"), way(22, ring(35, 30, 3), natural="water"),
    ]
    (tmp_path / "m.osm").write_text(f"<osm>{nodes}{''.join(ways)}</osm>")
    (tmp_path / "b.poly").write_text("area\n1\n   8.4 47.3\n   8.6 47.3\n   8.6 47.43\n   8.4 47.43\nEND\nEND\n")
    lv = {k: geodesy_lv95(spark, at) for k in (0,)}[0]
    tiles = {(math.floor(e / 1024), math.floor(n / 1024)) for e, n in lv.values()}
    px = [(i, j, r, c, 400.0) for i, j in tiles for r in range(4) for c in range(4)]
    height = spark.createDataFrame(px, "ei int, ni int, prow int, pcol int, h double")
    out = extracts.extract_tiles(spark, str(tmp_path / "m.osm"), height, 4, str(tmp_path / "b.poly"), most=1e9, size=1024.0)
    roads = out["road_vertices"].collect()
    assert {(r["line_id"], r["cls"]) for r in roads} == {(1, "primary"), (3, "railway:rail")}
    assert {round(r["y"], 6) for r in roads} == {round(400.0 + extracts.bakes.ROAD_OFFSET, 6)}
    # A vertex of the primary road stands half a width beside the projected node, where the road runs straight.
    left = np.array([(r["e"], r["n"]) for r in roads if r["line_id"] == 1])
    width = {r["line_id"]: r for r in extracts.bakes.lines.classify_roads(spark.createDataFrame([(1, "primary", 0, 0.0, 0.0)], "line_id long, cls string, seq int, e double, n double")).collect()}[1]["width"]
    for k in row(3, 2, 28):
        assert abs(np.hypot(*(left - lv[k]).T).min() - width / 2) < 0.05
    streams = out["streams"].collect()
    assert {(r["line_id"], r["cls"]) for r in streams} == {(10, "river")}
    lakes = out["lakes"].collect()
    assert {r["poly_id"] for r in lakes} == {"w20_0"} and {round(r["level"], 6) for r in lakes} == {round(400.0 + extracts.bakes.WATER_OFFSET, 6)}
    # The tiles of the manifest are those that the lines and areas reach.
    of = lambda k: (math.floor(lv[k][0] / 1024), math.floor(lv[k][1] / 1024))
    manifest = {(r["ei"], r["ni"]): r for r in out["roads"].collect()}
    assert {of(k) for k in [*row(3, 0, 30), *row(6, 1, 12)]} <= set(manifest)
    # Cutting at tile borders adds segments, by one a border crossed.
    assert sum(r["segments"] for r in manifest.values()) >= 29 + 10
    water = {(r["ei"], r["ni"]): r for r in out["water"].collect()}
    assert sum(r["polygons"] for r in water.values()) == len({(r["ei"], r["ni"]) for r in lakes}) and {of(k) for k in row(10, 0, 20)} <= set(water)


def geodesy_lv95(spark, at):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in at.items()], "k int, lat double, lon double")
    return {r["k"]: (r["e"], r["n"]) for r in geodesy.wgs84_to_lv95(df).select("k", F.col("e"), F.col("n")).collect()}


def test_areas_without_an_outer_ring_go(spark):
    rings = [("a", 0, s, *p) for s, p in enumerate([(47.0, 8.0), (47.0, 8.1), (47.1, 8.1)])] + [("a", 1, 0, 47.01, 8.05), ("b", 0, 0, 47.0, 8.0), ("b", 0, 1, 47.0, 8.1)] + [("b", 1, s, *p) for s, p in enumerate([(47.0, 8.0), (47.0, 8.1), (47.1, 8.1)])]
    got = extracts.projected_areas(spark.createDataFrame(rings, "area string, ring_no int, seq int, lat double, lon double")).collect()
    assert {(r["poly_id"], r["ring_no"]) for r in got} == {("a", 0)} and len(got) == 3
