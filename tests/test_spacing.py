"""Spaced points to which none can be added, and photos whose bands are filled together."""

import numpy as np
from pyspark.sql import functions as F

from tilefabric.operators import raster, spatial


def test_spaced_points_are_those_of_taking_one_by_one(spark):
    rng = np.random.default_rng(41)
    rows = [(int(p), k, float(e), float(n), int(h)) for p in range(3) for k, (e, n, h) in enumerate(np.column_stack([rng.random((400, 2)) * 100, rng.permutation(400)]))]
    df = spark.createDataFrame(rows, "poly_id int, k int, e double, n double, hash int").repartition(5)
    got = {(r["poly_id"], r["k"]) for r in spatial.maximal_spacing(df, 7.0, ["hash", "k"]).collect()}
    want = set()
    for p in range(3):
        kept = []
        for _, k, e, n, _ in sorted((r for r in rows if r[0] == p), key=lambda r: (r[4], r[1])):
            if all((e - a) ** 2 + (n - b) ** 2 >= 49 for a, b in kept):
                kept.append((e, n))
                want.add((p, k))
    assert got == want
    # Nothing could be added, and one round alone leaves holes.
    one = {(r["poly_id"], r["k"]) for r in spatial.min_spacing(df, 7.0, ["hash", "k"]).collect()}
    assert one < got
    at = {(r[0], r[1]): r[2:4] for r in rows}
    near = lambda a, b: (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2 < 49
    assert all(any(near(x, y) for y in got if y[0] == x[0]) for x in at if x not in got)
    assert spatial.maximal_spacing(df.limit(0), 7.0, ["hash", "k"]).collect() == []


def test_bands_filled_together_are_those_filled_apart(spark):
    rng = np.random.default_rng(42)
    rows = [(e, 0, r, c, *(None,) * 3) if rng.random() < 0.4 else (e, 0, r, c, *map(float, rng.integers(1, 256, 3))) for e in range(2) for r in range(8) for c in range(8)]
    px = spark.createDataFrame(rows, "ei int, ni int, prow int, pcol int, r double, g double, b double")
    both = {tuple(x[k] for k in raster.PIXEL): (x["r"], x["g"], x["b"]) for x in raster.fill_gaps_idw(px, 3, ("r", "g", "b"), F.col("r").isNotNull()).collect()}
    for k, band in enumerate("rgb"):
        one = raster.fill_gaps_idw(px.select(*raster.PIXEL, F.coalesce(band, F.lit(0.0)).alias("h")), 3)
        assert {tuple(x[k2] for k2 in raster.PIXEL): x["h"] for x in one.collect()} == {p: v[k] for p, v in both.items()}
    plan = raster.fill_gaps_idw(px, 3, ("r", "g", "b"), F.col("r").isNotNull())._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_close_points_are_all_found_with_few_copies(spark):
    """A point went to nine cells; places on the borders of cells, far west and south too."""
    rng = np.random.default_rng(5)
    rows = [(0, k, float(e), float(n)) for k, (e, n) in enumerate(np.vstack([rng.random((500, 2)) * 300 - 150, rng.integers(-5, 6, (60, 2)) * 28.0, rng.integers(-5, 6, (60, 2)) * 7.0]))]
    p = spatial.in_cells(spark.createDataFrame(rows, "poly_id int, k int, e double, n double"), 7.0 * spatial.BLOCK).withColumn("_rank", F.struct("k"))
    assert spatial.near_cells(p, 7.0).count() < 3 * len(rows)
    near = lambda a, b: (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 < 49
    some = p.where("k % 9 = 4")
    for others, lower, want in ((p, True, [a[1] for a in rows if not any(near(a, b) and b[1] < a[1] for b in rows)]), (some, False, [a[1] for a in rows if not any(near(a, b) for b in rows if b[1] % 9 == 4)])):
        left = spatial.without_close(p, others, 7.0, lower)
        assert left._jdf.queryExecution().executedPlan().toString().count("Join") == 1
        assert sorted(r["k"] for r in left.collect()) == want
