"""Queries of the composite jobs: patches, clipping, land cover, reprojection, buildings, catalogues, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilefabric.functions import geodesy, grid
from tilefabric.operators import audit, features, lines, raster, spatial
from tilefabric.streaming import residency

from .fixtures import CROWDED
from .queries import INSIDE, NEAR, PX, SAMPLE, TREES, _corridors, _geodetic_sql, _trees, _utm_sql, query, rounded

D2 = "pow({e} - (g.e + t * (g.e1 - g.e)), 2) + pow({n} - (g.n + t * (g.n1 - g.n)), 2)"
#: Every pair of a pixel p and a segment g, with the place t on the segment that is nearest and the distance d.
PAIRS = f"""s AS (SELECT line_id, seq, cls, e, n, lead(e) OVER w AS e1, lead(n) OVER w AS n1 FROM fx_line_vertex WINDOW w AS (PARTITION BY line_id ORDER BY seq)), g AS (SELECT * FROM s WHERE e1 IS NOT NULL),
k AS (SELECT p.ei, p.ni, p.prow, p.pcol, p.e AS pe, p.n AS pn, g.*, least(1, greatest(0, coalesce(((p.e - g.e) * (g.e1 - g.e) + (p.n - g.n) * (g.n1 - g.n)) / nullif((g.e1 - g.e) * (g.e1 - g.e) + (g.n1 - g.n) * (g.n1 - g.n), 0), 0))) AS t FROM p, g),
d AS (SELECT *, sqrt({D2.replace("g.", "").format(e="pe", n="pn")}) AS d FROM k)"""
NODES = "p AS (SELECT ei, ni, prow, pcol, (ei + 1) * 1024e0 - pcol * (1024e0 / 15) AS e, ni * 1024e0 + prow * (1024e0 / 15) AS n FROM fx_height_px WHERE source = 1)"
CENTRES = "p AS (SELECT ei, ni, prow, pcol, (ei + 1) * 1024e0 - (pcol + 0.5e0) * 64 AS e, ni * 1024e0 + (prow + 0.5e0) * 64 AS n FROM fx_height_px WHERE source = 1)"
#: Which points p lie in which polygons.
IN = INSIDE[: INSIDE.index("i AS (")] + """i AS (SELECT ei, ni, prow, pcol, poly_id, kind FROM p JOIN r ON (r.n > p.n) <> (r.n0 > p.n) AND p.e < (r.e0 - r.e) * (p.n - r.n) / (r.n0 - r.n) + r.e GROUP BY ALL HAVING count(*) % 2 = 1)"""
PIXEL = raster.PIXEL


@query(f"""WITH {NODES}, {PAIRS}, {IN},
b AS (SELECT ei, ni, prow, pcol, line_id, arg_min(seq * 10e0 + t * 10, (d, seq)) AS h, min(d) AS d FROM d WHERE d < 10 GROUP BY ALL),
laid AS (SELECT ei, ni, prow, pcol, sum(h / pow(greatest(0, d - 3) + 3, 2)) / sum(1 / pow(greatest(0, d - 3) + 3, 2)) AS h FROM b WHERE (ei, ni, prow, pcol) NOT IN (SELECT (ei, ni, prow, pcol) FROM i WHERE kind IN (5, 6)) GROUP BY ALL),
flat AS (SELECT ei, ni, prow, pcol, max(500e0 + poly_id) AS level FROM i WHERE kind IN (4, 7, 11) GROUP BY ALL)
SELECT ei, ni, prow, pcol, round(coalesce(level, h), 6) AS h FROM laid FULL JOIN flat USING (ei, ni, prow, pcol)""", "fx_height_px", "fx_line_vertex", "fx_ring_vertex", fixtures=CROWDED)
def apply_patches(px, v, rings):
    s = _corridors(v).withColumns({"h0": F.col("seq") * 10.0, "h1": F.col("seq") * 10.0 + 10, "reach": F.lit(10.0), "half_width": F.lit(3.0)})
    plateaus = rings.where("kind in (4, 7, 11)").withColumn("level", 500.0 + F.col("poly_id"))
    nodes = raster.pixel_nodes(px.where("source = 1"), PX).select(*PIXEL, "e", "n")
    return rounded(spatial.apply_patches(nodes, s, plateaus, rings.where("kind in (5, 6)"), PIXEL), 6, "h")


@query(f"WITH {CENTRES}, {PAIRS} SELECT DISTINCT ei, ni, prow, pcol FROM d WHERE cls = 'primary' AND d < 6", "fx_height_px", "fx_line_vertex", fixtures=CROWDED)
def paint_corridors(px, v):
    s = lines.segments(lines.classify_roads(v)).select("line_id", "seq", F.col("e").alias("e0"), F.col("n").alias("n0"), "e1", "n1", (F.col("width") / 2).alias("half_width"))
    return spatial.paint_corridors(raster.pixel_centres(px.where("source = 1"), PX), s, PIXEL, side=64)  # as if of a finer raster


@query(f"""WITH {CENTRES}, {IN}, z AS (SELECT DISTINCT floor(e / 1024) AS ei, floor(n / 1024) AS ni FROM fx_zone),
k AS (SELECT *, CASE kind WHEN 12 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 3 WHEN 8 THEN 4 WHEN 9 THEN 5 WHEN 10 THEN 6 WHEN 11 THEN 7 WHEN 4 THEN 9 ELSE 8 END AS rank FROM i WHERE kind <> 3),
c AS (SELECT ei, ni, prow, pcol, arg_max(kind, (rank, poly_id)) AS kind FROM k GROUP BY ALL)
SELECT ei, ni, prow, pcol, coalesce(kind, 0) AS kind FROM p LEFT JOIN c USING (ei, ni, prow, pcol) WHERE (ei, ni) NOT IN (SELECT (ei, ni) FROM z)""", "fx_height_px", "fx_ring_vertex", "fx_zone", fixtures=CROWDED)
def landcover_fallback(px, rings, zones):
    """Tiles without a photo (here: without a zone's centre) get land cover, the base class where there is none."""
    photo = _tiles(zones)
    bare = raster.pixel_centres(px.where("source = 1").join(photo, ["ei", "ni"], "left_anti"), PX)
    return bare.select(*PIXEL).join(spatial.rasterise_classes(bare, rings, PIXEL), PIXEL, "left").select(*PIXEL, F.coalesce("kind", F.lit(0)).alias("kind"))


@query(f"""WITH m AS (SELECT v.line_id AS fix_id, v.e, v.n FROM fx_line_vertex v JOIN (SELECT line_id, CAST(floor(count(*) / 2e0) AS INTEGER) AS seq FROM fx_line_vertex GROUP BY line_id) USING (line_id, seq)), {INSIDE.replace("FROM fx_fix f", "FROM m f")}
SELECT * FROM fx_line_vertex WHERE line_id IN (SELECT fix_id FROM i)""", "fx_line_vertex", "fx_ring_vertex", fixtures=CROWDED)
def clip_to_boundary(v, rings):
    return spatial.clip_to_boundary(v, lines.middle_vertex(v).select("line_id", "e", "n"), rings)


@query(None, "fx_ring_vertex")
def clip_polygons_to_tiles(rings):
    """Beyond plain SQL; a test holds areas and bounds of the pieces against the rings."""
    return spatial.clip_polygons_to_tiles(rings, 1024.0)


@query(f"WITH {TREES} SELECT poly_id, i, j, hash FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE a.poly_id = b.poly_id AND (b.hash, b.i, b.j) < (a.hash, a.i, a.j) AND (a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n) < 40000)", "fx_ring_vertex")
def min_spacing_points(rings):
    return spatial.min_spacing(_trees(rings), 200.0, ["hash", "i", "j"]).select("poly_id", "i", "j", "hash")


@query(_geodetic_sql(_utm_sql("SELECT ei * 4294967296 + ni * 65536 + prow * 256 + pcol AS fix_id, 380000e0 + (ei - 2539) * 1024 + pcol * 64 AS ue, 5200000e0 + (ni - 1171) * 1024 + prow * 64 AS un FROM fx_height_px WHERE source = 0")).replace(", 3) AS", ", 9) AS").replace("SELECT fix_id, round(", ", spot AS (SELECT fix_id, round(") + " FROM t), " + SAMPLE.replace("FROM fx_fix", "FROM spot").strip() + " SELECT fix_id AS pixel, round(CASE WHEN count(h) = 4 THEN sum(h * w) END, 3) AS h FROM co LEFT JOIN (SELECT * FROM fx_height_px WHERE source = 1) q USING (ei, ni, prow, pcol) GROUP BY fix_id", "fx_height_px")
def reproject_raster(px):
    """A UTM 32 lattice filled from the raster in national coordinates."""
    target = px.where("source = 0").select((F.col("ei") * F.lit(4294967296) + F.col("ni") * 65536 + F.col("prow") * 256 + F.col("pcol")).alias("pixel"), (380000.0 + (F.col("ei") - 2539) * 1024 + F.col("pcol") * 64).alias("ue"), (5200000.0 + (F.col("ni") - 1171) * 1024 + F.col("prow") * 64).alias("un"))
    return rounded(raster.reproject_raster(target, px.where("source = 1"), geodesy.utm32_to_lv95, ["pixel"], PX), 3, "h")


@query(None, "fx_height_px")
def fill_rgb_nearest(px):
    """Beyond plain SQL; a test holds it against brute force."""
    return raster.fill_rgb_nearest(px.where("source = 0").selectExpr("ei", "ni", "prow", "pcol", "if(h = 0, 255, (prow * 37 + pcol * 11) % 200) as r", "if(h = 0, 255, 20 + ei % 100) as g", "if(h = 0, 255, 30 + ni % 100) as b"))


# ---- buildings

FACE_NO = {"bottom": 0, "top": 1, "south": 2, "north": 3, "west": 4, "east": 5}


@query("""WITH b AS (SELECT CASE WHEN building_id % 17 = 0 THEN 'empty' WHEN w * d < 1 THEN 'tiny' ELSE 'ok' END AS kind, floor((x0 + w / 2) / 1024) AS ei, floor((y0 + d / 2) / 1024) AS ni FROM fx_box)
SELECT CAST(ei AS INTEGER) AS ei, CAST(ni AS INTEGER) AS ni, count(*) FILTER (kind = 'ok') AS buildings, 2 * count(*) FILTER (kind = 'ok') AS roof_triangles, 8 * count(*) FILTER (kind = 'ok') AS wall_triangles, count(*) FILTER (kind = 'empty') AS skipped_empty, count(*) FILTER (kind = 'tiny') AS skipped_tiny FROM b GROUP BY ALL""", "fx_box")
def building_stats(boxes):
    """Every seventeenth building has only its ground face."""
    f = features.box_faces(boxes).where("building_id % 17 <> 0 or face = 'bottom'")
    kind = F.when(F.col("face") == "bottom", "ground").when(F.col("face") == "top", "roof").otherwise("wall")
    return features.building_stats(f.withColumn("surface", kind), 1024.0)


@query("""WITH f(face, nx, ny, nz) AS (VALUES ('bottom', 0e0, 0e0, -1e0), ('top', 0e0, 0e0, 1e0), ('south', 0e0, -1e0, 0e0), ('north', 0e0, 1e0, 0e0), ('west', -1e0, 0e0, 0e0), ('east', 1e0, 0e0, 0e0))
SELECT building_id, face, nx, ny, nz, round(CASE WHEN nz <> 0 THEN w * d WHEN nx <> 0 THEN d * hgt ELSE w * hgt END, 5) AS area, CASE WHEN nz > 0.5 THEN 'roof' ELSE 'wall' END AS part FROM fx_box, f""", "fx_box")
def oriented_faces(boxes):
    """Normals look outward even where a face's corners run the wrong way round, as in every other building."""
    f = features.box_faces(boxes).withColumn("seq", F.when(F.col("building_id") % 2 == 0, F.col("seq")).otherwise(-F.col("seq")))
    out = rounded(features.oriented_faces(f), 6, "nx", "ny", "nz")
    return rounded(out, 5, "area").withColumns({c: F.col(c) + 0.0 for c in ("nx", "ny", "nz")})


@query("""SELECT building_id, face, a, b, c FROM fx_box, (VALUES ('bottom', 0, 1, 2), ('top', 3, 4, 5), ('south', 0, 6, 4), ('north', 1, 7, 5), ('west', 0, 3, 7), ('east', 6, 2, 5)) f(face, a, b, c)""", "fx_box")
def weld_vertices(boxes):
    no = F.create_map(*(F.lit(x) for kv in FACE_NO.items() for x in kv))
    return features.weld_vertices(features.box_faces(boxes).withColumn("face_no", no[F.col("face")]))


@query("""WITH b AS (SELECT building_id, CAST(floor(x0 / 1024) AS INTEGER) AS ei, CAST(floor(y0 / 1024) AS INTEGER) AS ni, x0 + w / 2 AS x, y0 + d / 2 AS y FROM fx_box)
SELECT ei, ni, CAST(trunc(avg(x)) AS BIGINT) AS center_e, CAST(trunc(avg(y)) AS BIGINT) AS center_n FROM b GROUP BY ALL""", "fx_box")
def tile_center(boxes):
    f = features.box_faces(boxes).join(boxes.select("building_id", grid.tile_of(F.col("x0")).alias("ei"), grid.tile_of(F.col("y0")).alias("ni")), "building_id")
    return features.tile_center(f, "building_id", ["ei", "ni"], True)


@query(f"""WITH o AS (SELECT poly_id * 100 + seq AS fix_id, e, n FROM fx_ring_vertex WHERE ring_no = 0), {SAMPLE.replace("FROM fx_fix", "FROM o").strip()},
hh AS (SELECT fix_id, CASE WHEN count(h) = 4 THEN sum(h * w) END AS h FROM co LEFT JOIN (SELECT * FROM fx_height_px WHERE source = 1) q USING (ei, ni, prow, pcol) GROUP BY fix_id)
SELECT CAST(floor(fix_id / 100) AS INTEGER) AS poly_id, round(coalesce(avg(h), 0) + 1.5e0, 6) AS level FROM hh GROUP BY ALL""", "fx_ring_vertex", "fx_height_px")
def flat_level(rings, px):
    outer = rings.where("ring_no = 0").select("poly_id", "seq", "e", "n")
    h = raster.sample_height(outer, px.where("source = 1"), ["poly_id", "seq"], PX)
    return rounded(features.flat_level(outer, h, ["poly_id", "seq"], 1.5), 6, "level").withColumn("poly_id", F.col("poly_id").cast("int"))


# ---- catalogues

ZONE_TILES = "z AS (SELECT DISTINCT CAST(floor(e / 1024) AS INTEGER) AS ei, CAST(floor(n / 1024) AS INTEGER) AS ni FROM fx_zone)"


def _tiles(df: DataFrame) -> DataFrame:
    return df.select(grid.tile_of(F.col("e")).alias("ei"), grid.tile_of(F.col("n")).alias("ni")).distinct()


@query(f"WITH {ZONE_TILES} SELECT ei, ni, min(source) AS source FROM fx_height_px WHERE (ei, ni) NOT IN (SELECT (ei, ni) FROM z) GROUP BY ALL", "fx_height_px", "fx_zone")
def stand_down(px, zones):
    return audit.stand_down(px.select("source", "ei", "ni").distinct(), _tiles(zones))


@query("SELECT * FROM fx_line_vertex WHERE line_id = 0 OR line_id NOT IN (SELECT zone_id FROM fx_zone)", "fx_line_vertex", "fx_zone")
def hide(v, zones):
    return audit.hide(v, zones.select(F.col("zone_id").alias("line_id")), "line_id").select(*v.columns)


@query("SELECT source, count(*) AS tiles FROM (SELECT ei, ni, min(source) AS source FROM fx_height_px WHERE h <> 0 GROUP BY ALL) GROUP BY source", "fx_height_px")
def catalog_counts(px):
    return audit.catalog_counts(px.where("h <> 0").select("source", "ei", "ni").distinct())


@query(f"""WITH {NEAR}, {ZONE_TILES}, ch AS (SELECT DISTINCT CAST(floor(ei / 8e0) AS INTEGER) AS cei, CAST(floor(ni / 8e0) AS INTEGER) AS cni FROM (SELECT CAST(floor(e / 1024) AS INTEGER) AS ei, CAST(floor(n / 1024) AS INTEGER) AS ni FROM fx_ring_vertex)),
g AS (SELECT fix_id, CAST(floor(e / 1024) + a.i AS INTEGER) AS ei, CAST(floor(n / 1024) + b.i AS INTEGER) AS ni FROM fx_fix, range(-2, 3) a(i), range(-2, 3) b(i))
SELECT fix_id, ei, ni, (ei, ni) IN (SELECT (ei, ni) FROM t) OR (CAST(floor(ei / 8e0) AS INTEGER), CAST(floor(ni / 8e0) AS INTEGER)) IN (SELECT (cei, cni) FROM ch) AS covered FROM g""", "fx_height_px", "fx_ring_vertex", "fx_fix")
def coverage_mask(px, rings, fix):
    chunks = _tiles(rings).select(grid.chunk_of(F.col("ei")).alias("cei"), grid.chunk_of(F.col("ni")).alias("cni")).distinct()
    at = fix.select("fix_id", grid.tile_of(F.col("e")).alias("ei"), grid.tile_of(F.col("n")).alias("ni"))
    return audit.coverage_mask(px.select("ei", "ni").distinct(), chunks, at, 2, ["fix_id"])


@query("""WITH b AS (SELECT min(ei) a, max(ei) b, min(ni) c, max(ni) d FROM fx_tile_present), g AS (SELECT ei, unnest(range(c, d + 1)) AS ni FROM (SELECT unnest(range(a, b + 1)) AS ei, c, d FROM b)), m AS (SELECT ei, ni, 'missing' AS why FROM g WHERE (ei, ni) NOT IN (SELECT (ei, ni) FROM fx_tile_present)),
x AS (SELECT ei - 2539 AS ei, ni - 1171 AS ni, 'poor' AS why FROM fx_height_px GROUP BY ALL HAVING avg(CASE WHEN h <> 0 THEN 1e0 ELSE 0e0 END) < 0.83e0)
SELECT why, count(*) AS tiles, CAST(min(ei) AS INTEGER) AS e0, CAST(min(ni) AS INTEGER) AS n0, CAST(max(ei) + 2 AS INTEGER) AS e1, CAST(max(ni) + 2 AS INTEGER) AS n1 FROM (SELECT * FROM m UNION ALL SELECT * FROM x) GROUP BY why""", "fx_tile_present", "fx_height_px")
def gap_report(tiles, px):
    """Missing and poor tiles with the box that encloses them, two units more on the upper side."""
    poor = raster.valid_fraction(px).where("fraction < 0.83D").select((F.col("ei") - 2539).alias("ei"), (F.col("ni") - 1171).alias("ni"), F.lit("poor").alias("why"))
    gaps = audit.missing_tiles(tiles).withColumn("why", F.lit("missing")).unionByName(poor)
    box = gaps.groupBy("why").agg(F.count("*").alias("tiles"), F.min("ei").alias("e0"), F.min("ni").alias("n0"), F.max("ei").alias("e1"), F.max("ni").alias("n1"))
    return box.withColumns({"e1": F.col("e1") + 2, "n1": F.col("n1") + 2})


@query("WITH t AS (SELECT DISTINCT source, ei, ni FROM fx_height_px) SELECT source = 1 AS is_chunk, ei, ni, CAST(greatest(abs(ei - 2543), abs(ni - 1174)) AS INTEGER) AS distance, row_number() OVER (ORDER BY source = 1, greatest(abs(ei - 2543), abs(ni - 1174)), ei, ni) AS place FROM t", "fx_height_px")
def batch_order(px):
    """Requests by distance; chunk requests queue after all tiles."""
    return audit.nearest_first(px.select((F.col("source") == 1).alias("is_chunk"), "ei", "ni").distinct(), F.lit(2543), F.lit(1174), ["is_chunk"])


# ---- streams' batch twins

RINGS = "f AS (SELECT track_id, fix_id, row_number() OVER (PARTITION BY track_id ORDER BY ts, fix_id) AS k, CAST(floor(e / 1024) AS INTEGER) AS te, CAST(floor(n / 1024) AS INTEGER) AS tn FROM fx_fix)"


@query(f"""WITH {RINGS}, r AS (SELECT track_id, fix_id, k, te + CAST(a.i AS INTEGER) AS ei, tn + CAST(b.i AS INTEGER) AS ni, greatest(abs(a.i), abs(b.i)) AS d FROM f, range(-4, 5) a(i), range(-4, 5) b(i)),
l AS (SELECT *, CASE WHEN d <= 1 THEN 0 WHEN d <= 2 THEN 1 ELSE 2 END AS lod FROM r), p AS (SELECT *, lag(k) OVER w AS k0, lag(lod) OVER w AS lod0 FROM l WINDOW w AS (PARTITION BY track_id, ei, ni ORDER BY k))
SELECT track_id, fix_id, ei, ni, lod0 AS old_lod, lod AS new_lod, (CASE WHEN lod >= 5 THEN 256 ELSE 1024 END) <> (CASE WHEN lod0 >= 5 THEN 256 ELSE 1024 END) AS texture FROM p WHERE k0 = k - 1 AND lod <> lod0""", "fx_fix")
def lod_changes_batch(fix):
    """Within four tiles, where no texture changes; a test goes as far as they do."""
    f = fix.withColumns({"te": grid.tile_of(F.col("e")), "tn": grid.tile_of(F.col("n"))})
    return residency.lod_changes_batch(f, 4)


@query(f"""WITH {RINGS}, p AS (SELECT *, lag(te) OVER w AS pe, lag(tn) OVER w AS pn FROM f WINDOW w AS (PARTITION BY track_id ORDER BY k)),
c AS (SELECT *, CASE WHEN pe IS NULL OR (te, tn) <> (pe, pn) THEN 1 ELSE 0 END AS c FROM p) SELECT track_id, fix_id, CAST(sum(c) OVER (PARTITION BY track_id ORDER BY k) AS BIGINT) AS generation FROM c""", "fx_fix")
def coverage_generation_batch(fix):
    f = fix.withColumns({"te": grid.tile_of(F.col("e")), "tn": grid.tile_of(F.col("n"))})
    return residency.coverage_generation_batch(f)


# ---- scalar functions

@query("""SELECT fix_id, 2600000 - e AS x, n - 1200000 AS z, ((2600000 - e) * (2600000 - e) + (n - 1200000) * (n - 1200000)) / (2 * 6371000e0) AS sag,
CASE fix_id % 7 WHEN 0 THEN 'LV95' WHEN 1 THEN 'UTM32N' WHEN 2 THEN 'UTM17S' WHEN 3 THEN 'UTM33N' END AS crs FROM fx_fix""", "fx_fix")
def flat_world(fix):
    x, z = grid.grid_to_flat(F.col("e"), F.col("n"), 2_600_000.0, 1_200_000.0)
    code = F.element_at(F.array(*map(F.lit, (2056, 32632, 32717, 25833, 4326, 25839, 32661))), (F.col("fix_id") % 7 + 1).cast("int"))
    return fix.select("fix_id", x.alias("x"), z.alias("z"), grid.sag(x, z).alias("sag"), grid.crs_of_epsg(code).alias("crs"))


@query("""WITH d AS (SELECT fix_id, CAST(floor(e / 1024) AS INTEGER) AS ei, CAST(floor(n / 1024) AS INTEGER) AS ni FROM fx_fix), c AS (SELECT *, CAST(floor(2545 / 8e0) * 8 AS INTEGER) AS a, CAST(floor(1175 / 8e0) * 8 AS INTEGER) AS b FROM d)
SELECT fix_id, greatest(greatest(a - ei, ei - a - 7, 0), greatest(b - ni, ni - b - 7, 0)) AS nearest, greatest(greatest(abs(ei - a), abs(ei - a - 7)), greatest(abs(ni - b), abs(ni - b - 7))) AS farthest FROM c""", "fx_fix")
def chunk_distance(fix):
    near, far = grid.chunk_distance(grid.tile_of(F.col("e")), grid.tile_of(F.col("n")), grid.chunk_of(F.lit(2545)), grid.chunk_of(F.lit(1175)))
    return fix.select("fix_id", near.alias("nearest"), far.alias("farthest"))


@query("""WITH c AS (SELECT fix_id, fix_id * 7 % 256 AS v, fix_id * 13 % 256 AS a, fix_id % 3000 AS z FROM fx_fix)
SELECT fix_id, CAST(CASE WHEN a > 0 AND a < 255 THEN least(255, floor(v * 255e0 / a + 0.5e0)) ELSE v END AS INTEGER) AS v, least(0.97e0, greatest(0.2e0, 0.25e0 + (z - 700) / 900e0)) AS conifer, round(least(1e0, greatest(0.45e0, 1 - (z - 1300) / 1000e0 * 0.55e0)), 12) AS factor FROM c""", "fx_fix")
def colour_and_altitude(fix):
    z = F.col("fix_id") % 3000
    v = grid.unpremultiply(F.col("fix_id") * 7 % 256, F.col("fix_id") * 13 % 256)
    return fix.select("fix_id", v.alias("v"), features.conifer_probability(z).alias("conifer"), F.round(features.altitude_factor(z), 12).alias("factor"))


@query("""SELECT fix_id, 'tile_' || CAST(floor(e / 1024) * 1024 AS BIGINT) || '_' || CAST(floor(n / 1024) * 1024 AS BIGINT) || '.raw' AS file, CAST(floor(e / 1024) * 1024 AS BIGINT) AS te, CAST(floor(n / 1024) * 1024 AS BIGINT) AS tn,
CAST(fix_id AS VARCHAR) || 'ab' AS uuid, CASE WHEN fix_id % 3 < 2 THEN 2056 END AS epsg FROM fx_fix""", "fx_fix")
def names_and_codes(fix):
    f = fix.withColumn("file", grid.tile_file_name(grid.tile_of(F.col("e")), grid.tile_of(F.col("n"))))
    te, tn = grid.parse_tile_name(F.col("file"))
    code = F.element_at(F.array(F.lit(" epsg:2056"), F.lit("2056"), F.lit("none")), (F.col("fix_id") % 3 + 1).cast("int"))
    return f.select("fix_id", "file", te.alias("te"), tn.alias("tn"), features.clean_uuid(F.concat(F.lit("{"), F.col("fix_id"), F.lit("-ab}")), F.col("fix_id")).alias("uuid"), grid.parse_epsg(code).alias("epsg"))
