"""Crowded cells: the same answers as without leaves, and no key above its load."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilefabric.operators import audit, quadtree, spatial

POINTS = "fix_id long, e double, n double"


def crowd(spark, n=3_000, same=400):
    """Nine in ten points in one cell of 1,024, a part of them in the very same place."""
    rng = np.random.default_rng(31)
    near = rng.random((n * 9 // 10, 2)) ** 3 * 1_000 + 10
    far = rng.random((n - len(near), 2)) * 9_000 - 3_000
    at = np.concatenate([near, far])
    at[:same] = (321.5, 654.25)
    return spark.createDataFrame([(k, float(e), float(x)) for k, (e, x) in enumerate(at)], POINTS).repartition(6)


def shapes(spark, n=60):
    rng = np.random.default_rng(32)
    rows = []
    for k in range(n):
        e, x, r = rng.random() * 3_000 - 1_000, rng.random() * 3_000 - 1_000, 50 + rng.random() * 1_500
        turn = np.sort(rng.random(int(rng.integers(3, 9)))) * 2 * np.pi
        rows += [(k, 0, s, float(e + r * np.cos(t)), float(x + r * np.sin(t))) for s, t in enumerate(turn)]
        if k % 3 == 0:
            rows += [(k, 1, s, float(e + r / 9 * np.cos(t)), float(x + r / 9 * np.sin(t))) for s, t in enumerate(turn)]
    return spark.createDataFrame(rows, "poly_id int, ring_no int, seq int, e double, n double")


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_no_key_holds_more_than_its_load(spark):
    points = spatial.in_cells(crowd(spark), 1_024.0)
    tree = quadtree.quadtree(points, 1_024.0, load=100, depth=6)
    keyed = tree.key_points(points).cache()
    assert rows(keyed.select(*points.columns)) == rows(points)
    biggest = keyed.groupBy(*quadtree.KEY).count().agg(F.max("count")).first()[0]
    assert biggest <= 150  # the hash deals the 400 in one place to five parts, about
    assert keyed.select("_leaf").distinct().count() > 20
    # A leaf's points lie in its own square: one leaf a place.
    assert keyed.groupBy("e", "n").agg(F.countDistinct("_leaf").alias("k")).agg(F.max("k")).first()[0] == 1
    whole = quadtree.quadtree(points, 1_024.0)
    assert whole.quarters is None and rows(whole.key_points(points).select(*points.columns)) == rows(points)


@pytest.mark.parametrize("depth", [1, 3, 8])
def test_morton_codes_are_prefixes_of_finer_ones(spark, depth):
    side = 1 << depth
    at = [(x * 7 % side, x * 13 % side) for x in range(200)]
    df = spark.createDataFrame(at, "x long, y long").withColumn("c", quadtree.morton(F.col("x"), F.col("y"), depth))
    want = lambda x, y: sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(depth))
    assert all(r["c"] == want(r["x"], r["y"]) for r in df.collect())


def test_boxes_and_polygons_answer_alike_in_leaves(spark):
    points, rings = crowd(spark), shapes(spark)
    boxes = rings.groupBy("poly_id").agg(F.min("e").alias("x0"), F.min("n").alias("y0"), F.max("e").alias("x1"), F.max("n").alias("y1"))
    split, plain = (rows(spatial.cell_join(points, boxes, 1_024.0, load=load).select("fix_id", "poly_id")) for load in (60, 10**9))
    assert split == plain and max(plain.values()) == 1 and len(plain) > 1_000
    split, plain = (rows(spatial.points_in_polygons(points, rings, ["fix_id"], load=load)) for load in (60, 10**9))
    assert split == plain and len(plain) > 1_000
    # The even-odd rule over all rings, point by point.
    ring = {}
    for r in rings.collect():
        ring.setdefault((r["poly_id"], r["ring_no"]), []).append((r["seq"], r["e"], r["n"]))
    got = {k[:2] for k in plain}
    for p in points.where("fix_id % 37 = 0").collect():
        for k in range(60):
            inside = False
            for (poly, _), vertices in ring.items():
                if poly == k:
                    v = [x[1:] for x in sorted(vertices)]
                    for (e, n), (e0, n0) in zip(v, v[-1:] + v[:-1]):
                        if (n > p["n"]) != (n0 > p["n"]) and p["e"] < (e0 - e) * (p["n"] - n) / (n0 - n) + e:
                            inside = not inside
            assert ((p["fix_id"], k) in got) == inside


@pytest.mark.parametrize("load", [50, 10**9])
def test_tiles_in_radius_of_a_crowd(spark, load):
    fixes = crowd(spark, 1_500, 200)
    tiles = spark.createDataFrame([(i, j, i * 500.0, j * 500.0) for i in range(-6, 7) for j in range(-6, 7)], "ei int, ni int, ce double, cn double")
    radius = F.when(F.col("ei") % 2 == 0, 2_000.0).otherwise(700.0)
    got = Counter((r["fix_id"], r["ei"], r["ni"], round(r["distance"], 6)) for r in spatial.tiles_in_radius(fixes, tiles, radius, ["fix_id"], 2_000.0, load=load).collect())
    want = Counter()
    for f in fixes.collect():
        for t in tiles.collect() if f["fix_id"] % 50 == 0 else ():
            d = ((t["ce"] - f["e"]) ** 2 + (t["cn"] - f["n"]) ** 2) ** 0.5
            if d <= (2_000 if t["ei"] % 2 == 0 else 700):
                want[f["fix_id"], t["ei"], t["ni"], round(d, 6)] += 1
    assert Counter({k: n for k, n in got.items() if k[0] % 50 == 0}) == want and want and max(got.values()) == 1


def test_numbers_without_a_window_over_the_rows(spark):
    df = spark.createDataFrame([(k * 7_919 % 1_000, k % 3) for k in range(1_000)], "a int, b int").repartition(7)
    got = audit.numbered(df, ["b", "a"])
    want = {r: k + 1 for k, r in enumerate(sorted((k % 3, k * 7_919 % 1_000) for k in range(1_000)))}
    assert {(r["b"], r["a"]): r["place"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = plan.count("Window [")
    assert windows <= 2 and "_range" in plan.split("Window [")[1].split("]")[0]  # over the list of ranges alone
    assert audit.numbered(df.limit(0), ["b", "a"]).collect() == []
