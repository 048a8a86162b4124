"""Queries of extents, inventories, zones, classes and tags, names, colours and demand, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilefabric.functions import geodesy, grid
from tilefabric.operators import audit, bakes, features, lines, raster, spatial
from tilefabric.streaming import residency

from .composites import CENTRES, RINGS
from .frames import N, from_lv95, stages, to_lv95, to_utm
from .queries import INSIDE, PX, TREES, _trees, query, rounded

PIXEL = raster.PIXEL
FIX_TILES = "t AS (SELECT DISTINCT CAST(floor(e / 1024) AS INTEGER) AS ei, CAST(floor(n / 1024) AS INTEGER) AS ni FROM fx_fix)"


def _tiles(df, size: float = 1024.0):
    return df.select(grid.tile_of(F.col("e"), size).alias("ei"), grid.tile_of(F.col("n"), size).alias("ni")).distinct()


# ---- extents and sets of tiles

@query("""WITH z AS (SELECT zone_id, e - r AS l, n - r AS b, e + r AS r2, n + r AS t FROM fx_zone), x AS (SELECT *, floor(l / 1024) AS e0, floor(b / 1024) AS n0, floor((r2 - 1) / 1024) AS e1, floor((t - 1) / 1024) AS n1 FROM z)
SELECT zone_id, CAST(e0 AS INTEGER) AS e0, CAST(n0 AS INTEGER) AS n0, CAST(e1 AS INTEGER) AS e1, CAST(n1 AS INTEGER) AS n1, e0 * 1024e0 AS "left", n0 * 1024e0 AS bottom, (floor((r2 - 1e-3) / 1024) + 1) * 1024 AS "right", (floor((t - 1e-3) / 1024) + 1) * 1024 AS top,
NOT (r2 <= 2603000 OR l >= 2609000 OR t <= 1203000 OR b >= 1209000) AS overlaps FROM x""", "fx_zone")
def extents(zones):
    e, n, r = F.col("e"), F.col("n"), F.col("r")
    box = (e - r, n - r, e + r, n + r)
    tiles = audit.extent_tiles(*box, 1024.0)
    whole = audit.snap_extent(*box, 1024.0)
    near = grid.bbox_overlaps(*box, *map(F.lit, (2_603_000.0, 1_203_000.0, 2_609_000.0, 1_209_000.0)))
    return zones.select("zone_id", *(t.alias(k) for t, k in zip(tiles, ("e0", "n0", "e1", "n1"), strict=True)), *(w.alias(k) for w, k in zip(whole, ("left", "bottom", "right", "top"), strict=True)), near.alias("overlaps"))


@query(f"WITH {FIX_TILES} SELECT * FROM t WHERE ei BETWEEN floor(2603000 / 1024e0) AND floor((2610240 - 1) / 1024e0) AND ni BETWEEN floor(1202000 / 1024e0) AND floor((1209344 - 1) / 1024e0)", "fx_fix")
def filter_extent(fix):
    return audit.filter_extent(_tiles(fix), *map(F.lit, (2_603_000.0, 1_202_000.0, 2_610_240.0, 1_209_344.0)), 1024.0)


@query("""WITH b AS (SELECT min(e_km) - 1 AS a, max(e_km) + 1 AS b, min(n_km) + 1 AS c, max(n_km) AS d FROM fx_probe), s AS (SELECT *, a + (CASE WHEN a % 2 = 0 THEN 1 ELSE 0 END) AS a1, c + c % 2 AS c1 FROM b),
g AS (SELECT e, unnest(range(c1, d + 1, 2)) AS n, b, d FROM (SELECT unnest(range(a1, b + 1, 2)) AS e, c1, b, d FROM s)) SELECT CAST(e AS INTEGER) AS e_km, CAST(n AS INTEGER) AS n_km, e < b AND n < d AS inner FROM g""", "fx_probe")
def lattice_cells(probe):
    """Cells of an extent with the upper bound, and whether they are there without it."""
    i = lambda c, d: (c + d).cast("int")
    b = probe.agg(i(F.min("e_km"), -1).alias("e0"), i(F.min("n_km"), 1).alias("n0"), i(F.max("e_km"), 1).alias("e1"), i(F.max("n_km"), 0).alias("n1"))
    inner = audit.lattice_cells(b, False).withColumn("inner", F.lit(True))
    return audit.lattice_cells(b).join(inner, ["e_km", "n_km"], "left").select("e_km", "n_km", F.coalesce("inner", F.lit(False)).alias("inner"))


@query("""WITH p AS (SELECT DISTINCT ei, ni FROM fx_height_px), b AS (SELECT min(ei) + 1 a, max(ei) - 1 b, min(ni) + 1 c, max(ni) - 1 d FROM p), o AS (SELECT DISTINCT CAST(floor(e / 1024) AS INTEGER) AS ei, CAST(floor(n / 1024) AS INTEGER) AS ni FROM fx_zone),
g AS (SELECT ei, unnest(range(c, d + 1)) AS ni FROM (SELECT unnest(range(a, b + 1)) AS ei, c, d FROM b)) SELECT CAST(ei AS INTEGER) AS ei, CAST(ni AS INTEGER) AS ni FROM g WHERE (ei, ni) NOT IN (SELECT (ei, ni) FROM o) ORDER BY ei, ni LIMIT 7""", "fx_height_px", "fx_zone")
def limit_missing(px, zones):
    """The first seven tiles without a zone, inside the rasters' extent less a tile on each side: the report's limit is its feature."""
    e = audit.extent(px.select("ei", "ni").distinct())
    b = e.select((F.col("e0") + 1).alias("e0"), (F.col("n0") + 1).alias("n0"), (F.col("e1") - 1).alias("e1"), (F.col("n1") - 1).alias("n1"))
    return audit.limit_missing(audit.missing_tiles(_tiles(zones), b), 7)


@query("SELECT *, row_number() OVER (ORDER BY ni, ei) - 1 AS place FROM fx_tile_present", "fx_tile_present")
def locality_sort(tiles):
    """Tiles by row and column; the place is found without one task that sorts them all."""
    return audit.numbered(tiles, ["ni", "ei"]).withColumn("place", F.col("place") - 1)


@query(f"""WITH {FIX_TILES}, p AS (SELECT DISTINCT ei, ni FROM fx_height_px), z AS (SELECT DISTINCT CAST(floor(e / 1024) AS INTEGER) AS ei, CAST(floor(n / 1024) AS INTEGER) AS ni FROM fx_zone),
u AS (SELECT * FROM p UNION SELECT * FROM z) SELECT 'union' AS op, * FROM u UNION ALL SELECT 'within', * FROM (SELECT * FROM u INTERSECT SELECT * FROM t) UNION ALL SELECT 'missing', * FROM (SELECT * FROM t EXCEPT SELECT * FROM u)""", "fx_fix", "fx_height_px", "fx_zone")
def inventory_sets(fix, px, zones):
    """What two inventories have between them, what of that is wanted, and what wanted tiles neither has."""
    wanted, have = _tiles(fix), audit.union_inventory(px.select("ei", "ni"), _tiles(zones))
    out = have.withColumn("op", F.lit("union")).unionByName(audit.clip_to_candidates(have, wanted).withColumn("op", F.lit("within")))
    return out.unionByName(audit.missing_from(wanted, have).withColumn("op", F.lit("missing"))).select("op", "ei", "ni")


@query("SELECT 0 AS part, fix_id AS id, e, n FROM fx_fix UNION ALL SELECT 1, zone_id, e, n FROM fx_zone", "fx_fix", "fx_zone")
def union_points(fix, zones):
    return audit.union_points(fix.select(F.col("fix_id").alias("id"), "e", "n"), zones.select(F.col("zone_id").alias("id"), "e", "n")).select("part", "id", "e", "n")


@query("SELECT DISTINCT CAST(floor(e / 4096) AS INTEGER) AS ei, CAST(floor(n / 4096) AS INTEGER) AS ni FROM (SELECT e, n FROM fx_line_vertex UNION ALL SELECT e, n FROM fx_ring_vertex)", "fx_line_vertex", "fx_ring_vertex")
def union_tiles(v, rings):
    return audit.union_inventory(_tiles(v, 4096.0), _tiles(rings, 4096.0))


def _source_cells(lattice: int) -> str:
    step = lattice - 1
    at = f"(SELECT ei, ni, (ei + i / {step}e0) * 1024e0 AS e, (ni + j / {step}e0) * 1024e0 AS n FROM t, range(0, {lattice}) a(i), range(0, {lattice}) b(j))"
    p = stages(to_utm(from_lv95(at, "e", "n", "lat", "lon", "a"), "lat", "lon", "ue", "un", "b"), ek="floor(ue / 1000)", nk="floor(un / 1000)")
    return f"SELECT DISTINCT ei, ni, CAST(ek - (CASE WHEN ek % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS e_km, CAST(nk - nk % 2 AS INTEGER) AS n_km FROM {p}"


def _fed_tiles() -> str:
    at = "(SELECT e_km, n_km, (e_km + i / 2e0) * 1000e0 AS ue, (n_km + j / 2e0) * 1000e0 AS un FROM c, range(0, 5) a(i), range(0, 5) b(j))"
    num = N
    _, radius, _, beta, delta = geodesy._krueger()
    rows = stages(at, x=f"un / {num(0.9996 * radius)}", y=f"(ue - 500000) / {num(0.9996 * radius)}")
    rows = stages(rows, xi="x" + "".join(f" - {num(b)} * sin({2 * j} * x) * cosh({2 * j} * y)" for j, b in enumerate(beta, 1)), et="y" + "".join(f" - {num(b)} * cos({2 * j} * x) * sinh({2 * j} * y)" for j, b in enumerate(beta, 1)))
    rows = stages(rows, cc="asin(sin(xi) / cosh(et))")
    rows = stages(rows, lat="degrees(cc" + "".join(f" + {num(d)} * sin({2 * j} * cc)" for j, d in enumerate(delta, 1)) + ")", lon="9 + degrees(atan2(sinh(et), cos(xi)))")
    return f"SELECT DISTINCT e_km, n_km, CAST(floor(e / 1024) AS INTEGER) AS ei, CAST(floor(n / 1024) AS INTEGER) AS ni FROM {to_lv95(rows, 'lat', 'lon', 'e', 'n', 'a')}"


#: All tiles, in bands of 400 columns one north of the other, so that they stay where the projections hold.
TILES = "t AS (SELECT CAST(ei % 400 + 2560 AS INTEGER) AS ei, CAST(ni + 1240 + 31 * floor(ei / 400e0) AS INTEGER) AS ni FROM fx_tile_present)"
NEED = f"{TILES}, need AS ({_source_cells(3)})"


def _in_bands(tiles):
    band = F.floor(F.col("ei") / 400.0).cast("int")
    return tiles.select((F.col("ei") % 400 + 2560).alias("ei"), (F.col("ni") + 1240 + 31 * band).alias("ni"))


@query(f"WITH {TILES} {_source_cells(3)}", "fx_tile_present")
def tiles_to_cells(tiles):
    """Source cells of each tile."""
    return audit.tiles_to_cells(_in_bands(tiles), geodesy.lv95_to_utm32)


@query(f"WITH c AS (SELECT DISTINCT e_km, n_km FROM fx_probe) {_fed_tiles()}", "fx_probe")
def cells_to_tiles(probe):
    """Tiles that each probed source cell feeds."""
    return audit.cells_to_tiles(probe.select("e_km", "n_km").distinct(), geodesy.utm32_to_lv95)


HAVE = "h AS (SELECT e_km, n_km FROM need WHERE (e_km * 7 + n_km * 3) % 11 > 0 GROUP BY ALL)"


@query(f"""WITH {NEED}, {HAVE}, i AS (SELECT * FROM need WHERE e_km >= 460 AND e_km < 560 AND n_km >= 5200 AND n_km < 5300), w AS (SELECT ei, ni FROM i GROUP BY ALL HAVING bool_and((e_km, n_km) IN (SELECT (e_km, n_km) FROM h)))
SELECT ei, ni, (ei, ni) IN (SELECT (ei, ni) FROM w) AS complete FROM (SELECT DISTINCT ei, ni FROM need)""", "fx_tile_present")
def complete_tiles(tiles):
    """Tiles all of whose source cells in a region are there; the others are deferred."""
    need = audit.tiles_to_cells(_in_bands(tiles), geodesy.lv95_to_utm32)
    have = need.where((F.col("e_km") * 7 + F.col("n_km") * 3) % 11 > 0).select("e_km", "n_km").distinct()
    whole, deferred = audit.complete_tiles(need, have, (460, 5200, 560, 5300))
    return whole.withColumn("complete", F.lit(True)).unionByName(deferred.withColumn("complete", F.lit(False)))


@query(f"""WITH t AS (SELECT DISTINCT CAST(floor(e / 1024) AS INTEGER) AS ei, CAST(floor(n / 1024) AS INTEGER) AS ni FROM fx_ring_vertex), b AS (SELECT min(ei) a, max(ei) b, min(ni) c, max(ni) d FROM t), g AS (SELECT ei, unnest(range(c, d + 1)) AS ni FROM (SELECT unnest(range(a, b + 1)) AS ei, c, d FROM b)), m AS (SELECT CAST(ei AS INTEGER) AS ei, CAST(ni AS INTEGER) AS ni FROM g WHERE (ei, ni) NOT IN (SELECT (ei, ni) FROM t)
UNION SELECT ei, ni FROM fx_height_px WHERE source = 0 GROUP BY ALL HAVING avg(CASE WHEN h <> 0 THEN 1e0 ELSE 0e0 END) < 0.86e0), c AS ({_source_cells(9).replace("FROM t,", "FROM m,")})
SELECT DISTINCT e_km, n_km FROM c""", "fx_ring_vertex", "fx_height_px")
def gap_cells(rings, px):
    """The source cells of tiles that are missing or poor."""
    cells, _ = bakes.gap_report(_tiles(rings), px.where("source = 0"), geodesy.lv95_to_utm32, 0.86)
    return cells


# ---- zones, boundaries, classes

@query("""WITH z AS (SELECT zone_id, min_dir, e, n, r, CASE zone_id % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'trees,roads' WHEN 2 THEN 'roads' ELSE 'trees' END AS kinds FROM fx_zone) SELECT zone_id, kinds FROM z WHERE zone_id % 4 <> 2 AND zone_id % 5 <> 0""", "fx_zone")
def zones_for(zones):
    """Zones for trees, by array and by text alike; every fifth has no radius and counts for nothing."""
    kinds = F.element_at(F.array(F.lit("all"), F.lit("trees,roads"), F.lit("roads"), F.lit("trees")), (F.col("zone_id") % 4 + 1).cast("int"))
    z = zones.withColumns({"kinds": kinds, "r": F.when(F.col("zone_id") % 5 != 0, F.col("r")), "ring": F.array().cast("array<struct<e: double, n: double>>")})
    listed = features.zones_for(z.withColumn("kinds", F.split("kinds", ",")), "trees").select("zone_id")
    return features.zones_for(z, "trees").join(listed, "zone_id", "left_semi").select("zone_id", "kinds")


@query(f"""WITH {INSIDE}, gone AS (SELECT fix_id FROM i WHERE fix_id % 3 >= poly_id % 3 UNION SELECT fix_id FROM fx_fix f JOIN fx_zone z ON f.fix_id % 3 >= z.min_dir AND (f.e - z.e) * (f.e - z.e) + (f.n - z.n) * (f.n - z.n) <= z.r * z.r)
SELECT fix_id, e, n FROM fx_fix WHERE fix_id NOT IN (SELECT fix_id FROM gone)""", "fx_fix", "fx_zone", "fx_ring_vertex")
def exclude_in_polygon_zones(fix, zones, rings):
    """Zones that are circles, and zones that are polygons."""
    circles = zones.select((-F.col("zone_id") - 1).alias("zone_id"), "min_dir", "e", "n", "r")
    shapes = rings.select(F.col("poly_id").alias("zone_id"), (F.col("poly_id") % 3).alias("min_dir")).distinct()
    shapes = shapes.selectExpr("zone_id", "min_dir", "cast(null as double) as e", "cast(null as double) as n", "cast(null as double) as r")
    f = fix.select("fix_id", "e", "n").withColumn("priority", F.col("fix_id") % 3)
    return spatial.exclude_in_zones(f, circles.unionByName(shapes), ["fix_id"], rings).drop("priority")


@query(f"""WITH m AS (SELECT poly_id AS fix_id, avg(e) AS e, avg(n) AS n FROM fx_ring_vertex WHERE ring_no = 0 GROUP BY poly_id), {INSIDE.replace("FROM fx_fix f", "FROM m f").replace("FROM fx_ring_vertex", "FROM (SELECT * FROM fx_ring_vertex WHERE kind = 4)")}
SELECT poly_id, ring_no, seq FROM fx_ring_vertex WHERE poly_id IN (SELECT fix_id FROM i)""", "fx_ring_vertex")
def clip_polygons_to_boundary(rings):
    """Polygons whose mean corner lies in a polygon of kind 4."""
    return spatial.clip_polygons_to_boundary(rings, rings.where("kind = 4")).select("poly_id", "ring_no", "seq")


@query("""WITH t AS (SELECT DISTINCT ei, ni, ei * 1024e0 + 512 AS ce, ni * 1024e0 + 512 AS cn, (ei + ni) % 3 AS polygons FROM fx_height_px)
SELECT fix_id, ei, ni, round(sqrt(pow(ce - e, 2) + pow(cn - n, 2)), 5) AS distance FROM fx_fix, t WHERE sqrt(pow(ce - e, 2) + pow(cn - n, 2)) <= CASE WHEN polygons > 0 THEN 50000 ELSE 8000 END""", "fx_fix", "fx_height_px")
def water_tiles_in_radius(fix, px):
    t = px.select("ei", "ni").distinct().withColumns({"ce": F.col("ei") * 1024.0 + 512, "cn": F.col("ni") * 1024.0 + 512, "polygons": (F.col("ei") + F.col("ni")) % 3})
    return rounded(spatial.water_tiles_in_radius(fix, t, ["fix_id"]), 5, "distance")


TAGS = """w AS (SELECT fix_id, CASE fix_id % 9 WHEN 0 THEN 'water' END AS nat, CASE fix_id % 9 WHEN 1 THEN 'reservoir' WHEN 2 THEN 'forest' END AS landuse, CASE fix_id % 9 WHEN 3 THEN 'riverbank' WHEN 4 THEN 'river' WHEN 5 THEN 'canal' WHEN 6 THEN 'ditch' END AS waterway, CASE WHEN fix_id % 2 = 0 THEN 'yes' ELSE 'no' END AS area,
CASE fix_id % 9 WHEN 7 THEN 'primary' WHEN 8 THEN 'path' END AS highway, CASE fix_id % 9 WHEN 6 THEN 'tram' END AS railway, CASE fix_id % 5 WHEN 0 THEN 'true' END AS tunnel, CASE fix_id % 6 WHEN 0 THEN 'Wald' WHEN 1 THEN 'Wald offen' WHEN 2 THEN 'Gehoelz' WHEN 3 THEN 'See' WHEN 4 THEN 'Wald_offen' END AS objektart FROM fx_fix)"""


@query(f"""WITH {TAGS} SELECT fix_id, CASE WHEN nat = 'water' OR landuse = 'reservoir' OR waterway = 'riverbank' THEN 'polygon' WHEN area = 'yes' THEN NULL WHEN waterway = 'river' THEN '12' WHEN waterway = 'canal' THEN '8' END AS water,
CASE WHEN highway = 'primary' THEN 'primary' WHEN railway = 'tram' AND tunnel IS NULL THEN 'railway:tram' END AS road FROM w WHERE objektart IN ('Wald', 'Gehoelz', 'Wald_offen', 'Wald offen')""", "fx_fix")
def classify_tags(fix):
    """Water and roads by tag maps, of features of a forest class."""
    k = lambda m, *pairs: F.coalesce(*(F.when(F.col("fix_id") % m == i, F.lit(v)) for i, v in pairs))
    tags = {"natural": k(9, (0, "water")), "landuse": k(9, (1, "reservoir"), (2, "forest")), "waterway": k(9, (3, "riverbank"), (4, "river"), (5, "canal"), (6, "ditch")), "area": F.when(F.col("fix_id") % 2 == 0, "yes").otherwise("no"), "highway": k(9, (7, "primary"), (8, "path")), "railway": k(9, (6, "tram")), "tunnel": k(5, (0, "true"))}
    f = fix.select("fix_id", F.map_filter(F.create_map(*(x for n, v in tags.items() for x in (F.lit(n), v))), lambda _, v: v.isNotNull()).alias("tags"), k(6, (0, "Wald"), (1, "Wald offen"), (2, "Gehoelz"), (3, "See"), (4, "Wald_offen")).alias("objektart"))
    return features.filter_landuse(f).select("fix_id", features.classify_water(F.col("tags")).alias("water"), lines.road_class(F.col("tags")).alias("road"))


TRIS = """v AS (SELECT *, lead(e) OVER w AS e1, lead(n) OVER w AS n1, lead(e, 2) OVER w AS e2, lead(n, 2) OVER w AS n2 FROM fx_line_vertex WINDOW w AS (PARTITION BY line_id ORDER BY seq))"""


@query(f"""WITH {TRIS}, t AS (SELECT line_id, seq, seq % 18 AS kind, seq % 90 * 1e0 AS ay, CASE WHEN seq % 11 <> 0 THEN 0e0 END AS b_y, 10e0 AS cy, seq % 4 AS a, seq % 3 AS b, 2 AS c, e, n, e1, n1, e2, n2 FROM v WHERE e2 IS NOT NULL)
SELECT line_id, seq FROM t WHERE kind NOT IN (7, 14, 15, 17) AND b_y IS NOT NULL AND greatest(ay, b_y, cy) - least(ay, b_y, cy) <= 50 AND pow((e1 - e) * (n2 - n) - (e2 - e) * (n1 - n), 2) >= 1e-3 AND a <> b AND b <> c AND a <> c""", "fx_line_vertex")
def sound_triangles(v):
    """Triangles of three vertices in a row: no structures, none too steep or with a corner missing, none degenerate."""
    w = Window.partitionBy("line_id").orderBy("seq")
    t = v.withColumns({"bx": F.lead("e").over(w), "bz": F.lead("n").over(w), "cx": F.lead("e", 2).over(w), "cz": F.lead("n", 2).over(w)}).where("cx is not null")
    t = t.withColumnsRenamed({"e": "ax", "n": "az"}).withColumns({"kind": F.col("seq") % 18, "ay": (F.col("seq") % 90).cast("double"), "by": F.when(F.col("seq") % 11 != 0, 0.0), "cy": F.lit(10.0), "a": F.col("seq") % 4, "b": F.col("seq") % 3, "c": F.lit(2)})
    return features.drop_degenerate(features.drop_overtilted(features.drop_structures(t)), ["a", "b", "c"]).select("line_id", "seq")


@query("WITH t AS (SELECT DISTINCT source, ei, ni FROM fx_height_px WHERE (ei + ni + source) % 3 > 0) SELECT source, ei, ni, row_number() OVER (PARTITION BY ei, ni ORDER BY source DESC) AS rank FROM t", "fx_height_px")
def priority_rank(px):
    """The order in which the sources that have a tile are asked for it."""
    t = px.where("(ei + ni + source) % 3 > 0").select("source", "ei", "ni").distinct()
    return audit.priority_rank(t, ["ei", "ni"], [F.desc("source")]).withColumn("rank", F.col("rank").cast("long"))


# ---- names and codes

@query("""SELECT fix_id, 400 + fix_id % 200 AS e_km, 5200 + track_id % 100 AS n_km, CASE WHEN fix_id % 2 = 0 THEN (400 + fix_id % 200) || '_' || (5200 + track_id % 100) ELSE 'tile_' || fix_id END AS tile_id,
'https://example.org/cells/x_32_' || (400 + fix_id % 200) || '_' || (5200 + track_id % 100) || '_2_bw.zip' AS url, CASE WHEN fix_id % 3 = 0 THEN 'building_' || fix_id ELSE 'ab' || fix_id END AS uuid FROM fx_fix""", "fx_fix")
def source_names(fix):
    """Cells and tile ids out of names, addresses of sources, names of buildings."""
    e, n = (400 + F.col("fix_id") % 200).cast("long"), (5200 + F.col("track_id") % 100).cast("long")
    url = grid.source_url("https://example.org/cells", "x_32_%d_%d_2_bw", e, n)
    stem = F.when(F.col("fix_id") % 2 == 0, F.format_string("LoD2_32_%d_%d_2_bw", e, n)).otherwise(F.concat(F.lit("tile_"), F.col("fix_id")))
    uuid = F.when(F.col("fix_id") % 6 == 0, F.lit("{-}")).when(F.col("fix_id") % 3 != 0, F.concat(F.lit("{ab-"), F.col("fix_id"), F.lit("}")))
    ce, cn = grid.parse_cell_name(url)
    return fix.select("fix_id", ce.cast("long").alias("e_km"), cn.cast("long").alias("n_km"), grid.parse_lod_tile_id(stem).alias("tile_id"), url.alias("url"), features.clean_uuid(uuid, F.col("fix_id")).alias("uuid"))


@query("SELECT fix_id, 2600000 - (2600000 - e) AS e, (n - 1200000) + 1200000 AS n FROM fx_fix", "fx_fix")
def flat_round_trip(fix):
    x, z = grid.grid_to_flat(F.col("e"), F.col("n"), 2_600_000.0, 1_200_000.0)
    e, n = grid.flat_to_grid(F.col("x"), F.col("z"), 2_600_000.0, 1_200_000.0)
    return fix.select("fix_id", x.alias("x"), z.alias("z")).select("fix_id", e.alias("e"), n.alias("n"))


# ---- rasters

@query("""WITH c AS (SELECT source, ei, ni, prow, pcol, (prow * 37 + pcol * 11) % 200 AS r, (prow * 17 + pcol * 51 + ei) % 200 AS g, (pcol * 23 + ni + source) % 200 AS b, CASE WHEN h = 0 THEN 0 ELSE (prow * 41 + pcol * (29 + source)) % 256 END AS q FROM fx_height_px),
u AS (SELECT *, arg_max(source, (q, -source)) OVER (PARTITION BY ei, ni, prow, pcol) AS best FROM c WHERE q > 0), w AS (SELECT * FROM u WHERE source = best)
SELECT ei, ni, prow, pcol, CAST(CASE WHEN q < 255 THEN least(255, floor(r * 255e0 / q + 0.5e0)) ELSE r END AS INTEGER) AS r, CAST(CASE WHEN q < 255 THEN least(255, floor(g * 255e0 / q + 0.5e0)) ELSE g END AS INTEGER) AS g, CAST(CASE WHEN q < 255 THEN least(255, floor(b * 255e0 / q + 0.5e0)) ELSE b END AS INTEGER) AS b, CAST(q AS INTEGER) AS q FROM w""", "fx_height_px")
def mosaic_rgb(px):
    return raster.mosaic_rgb(px.selectExpr("source", "ei", "ni", "prow", "pcol", "(prow * 37 + pcol * 11) % 200 as r", "(prow * 17 + pcol * 51 + ei) % 200 as g", "(pcol * 23 + ni + source) % 200 as b", "if(h = 0, 0, (prow * 41 + pcol * (29 + source)) % 256) as q"))


@query(f"""WITH {TREES}, pt AS (SELECT *, floor(e / 1024) AS ei, floor(n / 1024) AS ni, (1 - (e - floor(e / 1024) * 1024) / 1024) * 15 AS c, (n - floor(n / 1024) * 1024) / 1024 * 15 AS r FROM k),
co AS (SELECT poly_id, i, j, ei, ni, least(floor(c) + dc, 15) AS pcol, least(floor(r) + dr, 15) AS prow, (CASE WHEN dc = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) * (CASE WHEN dr = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) AS w FROM pt, (VALUES (0), (1)) a(dc), (VALUES (0), (1)) b(dr)),
s AS (SELECT poly_id, i, j, source, CASE WHEN count(h) = 4 THEN sum(h * w) END AS h FROM co JOIN fx_height_px p USING (ei, ni, prow, pcol) WHERE source = 1 OR (ei + ni) % 2 = 0 GROUP BY ALL)
SELECT poly_id, i, j, round(coalesce(CASE WHEN (pt.ei + pt.ni) % 2 = 0 AND (pt.ei, pt.ni) IN (SELECT (ei, ni) FROM fx_height_px) THEN a.h ELSE b.h END, hash % 900), 6) AS ground_z, CASE WHEN (pt.ei + pt.ni) % 2 = 0 AND (pt.ei, pt.ni) IN (SELECT (ei, ni) FROM fx_height_px) THEN a.h ELSE b.h END IS NOT NULL AS snapped, (pt.ei, pt.ni) NOT IN (SELECT (ei, ni) FROM fx_height_px) AS pending
FROM pt LEFT JOIN (SELECT * FROM s WHERE source = 0) a USING (poly_id, i, j) LEFT JOIN (SELECT * FROM s WHERE source = 1) b USING (poly_id, i, j)""", "fx_ring_vertex", "fx_height_px")
def snap_trees(rings, px):
    """Trees on the terrain: the finer raster has every other tile."""
    t = _trees(rings).withColumn("ground_z", (F.col("hash") % 900).cast("double"))
    out = features.snap_trees(t, px.where("source = 0 and (ei + ni) % 2 = 0"), px.where("source = 1"), ["poly_id", "i", "j"], PX)
    return rounded(out.select("poly_id", "i", "j", "ground_z", "snapped", "pending"), 6, "ground_z")


# ---- demand

@query(f"""WITH {RINGS}, m AS (SELECT *, lag(te) OVER w AS pe, lag(tn) OVER w AS pn FROM f WINDOW w AS (PARTITION BY track_id ORDER BY k)), v AS (SELECT track_id, te, tn FROM m WHERE pe IS NULL OR pe <> te OR pn <> tn),
x AS (SELECT track_id, te, tn, unnest(range(CAST(floor((te - 40) / 8e0) AS BIGINT), CAST(floor((te + 40) / 8e0) AS BIGINT) + 1)) AS cei FROM v), y AS (SELECT *, unnest(range(CAST(floor((tn - 40) / 8e0) AS BIGINT), CAST(floor((tn + 40) / 8e0) AS BIGINT) + 1)) AS cni FROM x),
d AS (SELECT track_id, cei, cni, greatest(cei * 8 - te, te - cei * 8 - 7, cni * 8 - tn, tn - cni * 8 - 7, 0) AS d FROM y)
SELECT track_id, CAST(cei AS INTEGER) AS cei, CAST(cni AS INTEGER) AS cni, CAST(min(d) AS INTEGER) AS distance, CASE WHEN min(d) <= 32 THEN 129 WHEN min(d) <= 64 THEN 65 ELSE 33 END AS res FROM d WHERE d <= 40 GROUP BY ALL""", "fx_fix")
def chunk_demand(fix):
    f = fix.withColumns({"te": grid.tile_of(F.col("e")), "tn": grid.tile_of(F.col("n"))})
    return residency.chunk_demand(f, 40)


@query(f"""WITH RECURSIVE {RINGS.replace("AS te", "* 3 AS te").replace("AS tn", "* 3 AS tn")}, m AS (SELECT *, lag(te) OVER w AS pe, lag(tn) OVER w AS pn FROM f WINDOW w AS (PARTITION BY track_id ORDER BY k)),
v AS (SELECT track_id, fix_id, te, tn, row_number() OVER (PARTITION BY track_id ORDER BY k) AS k FROM m WHERE pe IS NULL OR pe <> te OR pn <> tn),
x AS (SELECT *, unnest(range(CAST(floor((te - 40) / 8e0) AS BIGINT), CAST(floor((te + 40) / 8e0) AS BIGINT) + 1)) AS cei FROM v),
y AS (SELECT *, unnest(range(CAST(floor((tn - 40) / 8e0) AS BIGINT), CAST(floor((tn + 40) / 8e0) AS BIGINT) + 1)) AS cni FROM x),
d AS (SELECT track_id, fix_id, k, cei, cni, greatest(cei * 8 - te, te - cei * 8 - 7, cni * 8 - tn, tn - cni * 8 - 7, 0) AS d FROM y WHERE greatest(cei * 8 - te, te - cei * 8 - 7, cni * 8 - tn, tn - cni * 8 - 7, 0) <= 40),
r AS (SELECT d.*, CAST(NULL AS INTEGER) AS old_res, CASE WHEN d <= 32 THEN 129 WHEN d <= 64 THEN 65 ELSE 33 END AS new_res FROM d WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.track_id = d.track_id AND b.cei = d.cei AND b.cni = d.cni AND b.k = d.k - 1)
UNION ALL SELECT d.*, r.new_res, CASE WHEN d.d <= 32 OR r.new_res = 129 AND d.d <= 36 THEN 129 WHEN d.d <= 64 OR r.new_res = 65 AND d.d <= 68 THEN 65 ELSE 33 END FROM r JOIN d ON d.track_id = r.track_id AND d.cei = r.cei AND d.cni = r.cni AND d.k = r.k + 1)
SELECT track_id, fix_id, CAST(cei AS INTEGER) AS cei, CAST(cni AS INTEGER) AS cni, old_res, new_res FROM r WHERE old_res IS NULL OR old_res <> new_res""", "fx_fix")
def chunk_resolution_batch(fix):
    """Each resolution depends on the one before."""
    f = fix.withColumns({"te": grid.tile_of(F.col("e")) * 3, "tn": grid.tile_of(F.col("n")) * 3})
    return residency.chunk_resolution_batch(f, 40)


# ---- bakes

def _lines(v):
    return v.select("line_id", "cls", "seq", "e", "n")


@query(None, "fx_line_vertex", "fx_height_px")
def road_tiles(v, px):
    """The manifest of the whole bake; a test holds its parts against each other and against plain Python."""
    return bakes.road_tiles(_lines(v), raster.mosaic(px, "first"), PX, most=200.0)[1]


@query(None, "fx_line_vertex", "fx_ring_vertex", "fx_height_px")
def water_tiles(v, rings, px):
    cls = F.when(F.col("cls") == "primary", "river").when(F.col("cls") == "track", "canal").otherwise("ditch")
    return bakes.water_tiles(_lines(v.withColumn("cls", cls)), rings, raster.mosaic(px, "first"), PX)[2]


@query(None, "fx_height_px")
def render_height_tiles(px):
    """Tiles in national coordinates out of two rasters in UTM 32, which stand where the national ones do."""
    source = px.withColumns({"ei": F.col("ei") - 2539 + 370, "ni": F.col("ni") - 1171 + 5078})
    tiles = px.select("ei", "ni").distinct()
    to = lambda p: geodesy.lv95_to_utm32(p, "e", "n", "se", "sn")
    return rounded(bakes.render_height_tiles(source, tiles, to, PX, PX, 0.5), 3, "h")


@query(None, "fx_ring_vertex", "fx_fix", "fx_height_px")
def extract_vegetation(rings, fix, px):
    wood = rings.withColumn("objektart", F.when(F.col("kind") < 3, "Wald").otherwise("See"))
    return bakes.extract_vegetation(wood, fix.select("e", "n"), raster.mosaic(px, "first"), PX, 60.0)


@query(None, "fx_height_px")
def render_rgb_tiles(px):
    """Photo tiles out of two photos in UTM 32, which stand where the national ones do; colours follow the heights."""
    h = F.floor(F.col("h")).cast("int")
    colour = {"r": h % 256, "g": h * 7 % 256, "b": h * 13 % 256}
    source = px.where("h <> 0").withColumns({"ei": F.col("ei") - 2539 + 370, "ni": F.col("ni") - 1171 + 5078, **colour})
    to = lambda p: geodesy.lv95_to_utm32(p, "e", "n", "se", "sn")
    return bakes.render_rgb_tiles(source, px.select("ei", "ni").distinct(), to, PX, PX, 0.5, levels=(1, 4))


@query(None, "fx_box", "fx_height_px")
def building_tiles(boxes, px):
    """The counts of the whole bake, of buildings in UTM 32; every seventeenth has only its ground face."""
    f = features.box_faces(boxes).where("building_id % 17 <> 0 or face = 'bottom'")
    kind = F.when(F.col("face") == "bottom", "ground").when(F.col("face") == "top", "roof").otherwise("wall")
    f = f.select(F.col("building_id").cast("string").alias("building_id"), kind.alias("surface"), F.xxhash64("face").alias("face"), F.lit(0).alias("ring_no"), "seq", "x", "y", "z")
    f = geodesy.settled(geodesy.lv95_to_utm32(f, "x", "y", "ue", "un"), "ue", "un").drop("x", "y").withColumnsRenamed({"ue": "x", "un": "y"})
    return bakes.building_tiles(f, raster.mosaic(px, "first"), PX)[2]


@query(None, "fx_probe", "fx_tile_present")
def coverage_report(probes, tiles):
    """Cells that a probe found but whose tiles are not all there, by the whole chain from tiles to cells and back."""
    bounds = probes.agg(F.min("e_km").alias("e0"), F.min("n_km").alias("n0"), F.max("e_km").alias("e1"), F.max("n_km").alias("n1"))
    reference = probes.where("status = 0").select("e_km", "n_km").distinct()
    return bakes.coverage_report(bounds, probes, _in_bands(tiles), reference, geodesy.lv95_to_utm32, geodesy.utm32_to_lv95)[0]


@query(None, "fx_ring_vertex")
def maximal_spacing_points(rings):
    """Spaced points to which no other could be added; a test holds them against taking points one by one."""
    return spatial.maximal_spacing(_trees(rings), 200.0, ["hash", "i", "j"]).select("poly_id", "i", "j", "hash")
