"""Queries over the derived views, one for each operator or small group of them, with SQL twins.

Doubles that pass through sums or means are rounded in both, as the order of
additions differs between engines.
"""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilefabric.functions import geodesy, grid
from tilefabric.operators import audit, features, lines, raster, spatial
from tilefabric.streaming import residency

from .fixtures import CROWDED, FIXTURES, view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
PX = 16


def query(sql: str | None, *views: str, fixtures: dict[str, str] = FIXTURES):
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v, fixtures) for v in views))
        if sql:
            SQL[name] = with_views(sql, fixtures)
        return f

    return add


def rounded(df: DataFrame, places: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def merged(px: DataFrame) -> DataFrame:
    return raster.mosaic(px, "first")


MERGED = "m AS (SELECT ei, ni, prow, pcol, arg_min(h, source) AS h FROM fx_height_px WHERE h <> 0 GROUP BY ALL)"
#: Tiles of the first source with enough data; the other ones count as absent from it.
GOOD = "good AS (SELECT ei, ni FROM fx_height_px WHERE source = 0 GROUP BY ALL HAVING count(*) FILTER (h <> 0) * 100 >= count(*) * 86)"


def _without_poor(px: DataFrame) -> DataFrame:
    """Without the first source's tiles of which less than 86 % is data."""
    good = px.where("source = 0").groupBy("ei", "ni").agg((F.count_if(F.col("h") != 0) * 100 >= F.count("*") * 86).alias("_ok")).where("_ok").select("ei", "ni")
    return px.where("source = 0").join(good, ["ei", "ni"], "left_semi").unionByName(px.where("source <> 0"))


SAMPLE = """
pt AS (SELECT fix_id, e, n, floor(e / 1024) AS ei, floor(n / 1024) AS ni, (1 - (e - floor(e / 1024) * 1024) / 1024) * 15 AS c, (n - floor(n / 1024) * 1024) / 1024 * 15 AS r FROM fx_fix),
co AS (SELECT fix_id, ei, ni, least(floor(c) + dc, 15) AS pcol, least(floor(r) + dr, 15) AS prow,
              (CASE WHEN dc = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) * (CASE WHEN dr = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) AS w
       FROM pt, (VALUES (0), (1)) a(dc), (VALUES (0), (1)) b(dr))"""


@query(f"WITH {SAMPLE} SELECT fix_id, round(CASE WHEN count(h) = 4 THEN sum(h * w) END, 6) AS h FROM co LEFT JOIN (SELECT * FROM fx_height_px WHERE source = 0) p USING (ei, ni, prow, pcol) GROUP BY fix_id", "fx_fix", "fx_height_px")
def elevation_at(fix, px):
    return rounded(raster.sample_height(fix, px.where("source = 0"), ["fix_id"], PX), 6, "h")


@query(f"WITH {SAMPLE} SELECT fix_id, round(CASE WHEN count(h) = 4 AND max(abs(h)) > 0 THEN sum(h * w) END, 6) AS h FROM co LEFT JOIN (SELECT * FROM fx_height_px WHERE source = 0) p USING (ei, ni, prow, pcol) GROUP BY fix_id", "fx_fix", "fx_height_px")
def elevation_zero_aware(fix, px):
    return rounded(raster.sample_height(fix, px.where("source = 0"), ["fix_id"], PX, "zero_aware"), 6, "h")


@query("""WITH pt AS (SELECT fix_id, floor(e / 1024) AS ei, floor(n / 1024) AS ni, 15 - least(floor((e - floor(e / 1024) * 1024) / 64), 15) AS pcol, least(floor((n - floor(n / 1024) * 1024) / 64), 15) AS prow FROM fx_fix)
SELECT fix_id, CASE WHEN h <> 0 THEN h END AS h FROM pt LEFT JOIN (SELECT * FROM fx_height_px WHERE source = 0) p USING (ei, ni, prow, pcol)""", "fx_fix", "fx_height_px")
def elevation_nearest(fix, px):
    return raster.sample_height(fix, px.where("source = 0"), ["fix_id"], PX, "nearest")


@query(f"""WITH {SAMPLE}, {GOOD}, s AS (SELECT fix_id, source, CASE WHEN count(h) = 4 THEN sum(h * w) END AS h FROM co JOIN fx_height_px p USING (ei, ni, prow, pcol) WHERE source = 1 OR (ei, ni) IN (SELECT (ei, ni) FROM good) GROUP BY fix_id, source)
SELECT f.fix_id, round(CASE WHEN (floor(f.e / 1024), floor(f.n / 1024)) IN (SELECT (ei, ni) FROM good) THEN a.h ELSE b.h END, 6) AS h FROM fx_fix f LEFT JOIN s a ON a.fix_id = f.fix_id AND a.source = 0 LEFT JOIN s b ON b.fix_id = f.fix_id AND b.source = 1""", "fx_fix", "fx_height_px")
def elevation_fine_or_coarse(fix, px):
    return rounded(raster.sample_height_any(fix, _without_poor(px).where("source = 0"), px.where("source = 1"), ["fix_id"], PX), 6, "h")


@query("SELECT fix_id, CAST(floor(e / 1024) AS INTEGER) AS ei, CAST(floor(n / 1024) AS INTEGER) AS ni, CAST(floor(-e / 1024) AS INTEGER) AS west FROM fx_fix", "fx_fix")
def tile_index(fix):
    return fix.select("fix_id", grid.tile_of(F.col("e")).alias("ei"), grid.tile_of(F.col("n")).alias("ni"), grid.tile_of(-F.col("e")).alias("west"))


@query("SELECT fix_id, CAST(floor(e / 1024) AS BIGINT) * 4294967296 + CAST(floor(n / 1024) AS BIGINT) AS k, CAST(floor(e / 1024) AS INTEGER) AS ei, CAST(floor(n / 1024) AS INTEGER) AS ni FROM fx_fix", "fx_fix")
def tile_key(fix):
    k = fix.select("fix_id", grid.tile_key(grid.tile_of(F.col("e")), grid.tile_of(F.col("n"))).alias("k"))
    ei, ni = grid.tile_unkey(F.col("k"))
    return k.withColumns({"ei": ei, "ni": ni})


@query("SELECT fix_id, CAST(floor(floor(e / 1024) / 8) AS INTEGER) AS ce, CAST(floor(floor(n / 1024) / 8) AS INTEGER) AS cn, CAST(greatest(abs(floor(e / 1024) - 2545), abs(floor(n / 1024) - 1175)) AS INTEGER) AS d FROM fx_fix", "fx_fix")
def chunk_of(fix):
    ei, ni = grid.tile_of(F.col("e")), grid.tile_of(F.col("n"))
    return fix.select("fix_id", grid.chunk_of(ei).alias("ce"), grid.chunk_of(ni).alias("cn"), grid.chebyshev(ei - 2545, ni - 1175).alias("d"))


@query("""WITH d AS (SELECT fix_id, CAST(greatest(abs(floor(e / 1024) - 2545), abs(floor(n / 1024) - 1175)) AS INTEGER) * 5 AS d, CASE fix_id % 4 WHEN 0 THEN 129 WHEN 1 THEN 65 WHEN 2 THEN 33 END AS had FROM fx_fix),
l AS (SELECT *, CASE WHEN d <= 1 THEN 0 WHEN d <= 2 THEN 1 WHEN d <= 4 THEN 2 WHEN d <= 8 THEN 3 WHEN d <= 16 THEN 4 WHEN d <= 30 THEN 6 ELSE 8 END AS far_lod FROM d)
SELECT fix_id, CASE WHEN d <= 1 THEN 0 WHEN d <= 2 THEN 1 WHEN d <= 4 THEN 2 WHEN d <= 8 THEN 3 WHEN d <= 12 THEN 4 ELSE 6 END AS lod, CASE WHEN d <= 1 THEN 0 WHEN d <= 2 THEN 1 WHEN d <= 4 THEN 2 ELSE 3 END AS near_lod, far_lod,
CASE WHEN d <= 32 THEN 129 WHEN d <= 64 THEN 65 ELSE 33 END AS res,
CASE WHEN d <= 32 OR had = 129 AND d <= 36 THEN 129 WHEN d <= 64 OR had = 65 AND d <= 68 THEN 65 ELSE 33 END AS steady,
CASE WHEN far_lod >= 7 THEN 64 WHEN far_lod >= 5 THEN 256 ELSE 1024 END AS pixels, CASE WHEN far_lod >= 7 THEN 2 ELSE 0 END AS mip, greatest(0, far_lod - 2) AS effective, CAST(pow(floor(256 / least(pow(2, greatest(0, far_lod - 2)), 256)) + 1, 2) AS BIGINT) AS vertices FROM l""", "fx_fix")
def lod_by_distance(fix):
    """Levels by three load radiuses, chunk resolutions plain and with the one before, and what follows for textures and meshes of 257 pixels."""
    d = grid.chebyshev(grid.tile_of(F.col("e")) - 2545, grid.tile_of(F.col("n")) - 1175) * 5
    had = F.element_at(F.array(F.lit(129), F.lit(65), F.lit(33), F.lit(None).cast("int")), (F.col("fix_id") % 4 + 1).cast("int"))
    far, lod = grid.lod_for_distance(d, 100), grid.effective_lod(grid.lod_for_distance(d, 100), 257)
    return fix.select("fix_id", grid.lod_for_distance(d, 50).alias("lod"), grid.lod_for_distance(d, 15).alias("near_lod"), far.alias("far_lod"), grid.chunk_resolution(d, F.lit(None).cast("int")).alias("res"), grid.chunk_resolution(d, had).alias("steady"), grid.ortho_pixels(far).alias("pixels"), grid.ortho_mip(far).alias("mip"), lod.alias("effective"), grid.mesh_vertices(lod, 257).alias("vertices"))


@query("""WITH x AS (SELECT fix_id, xor(CAST((CAST(fix_id AS HUGEINT) * 2654435761) % 4294967296 AS BIGINT), CAST((CAST(track_id AS HUGEINT) * 2246822519) % 4294967296 AS BIGINT)) AS x FROM fx_fix),
h AS (SELECT fix_id, CAST((CAST(xor(x, x >> 15) AS HUGEINT) * 3266489917) % 4294967296 AS BIGINT) AS h FROM x)
SELECT fix_id, h, h <= 1073741824 AS kept FROM h""", "fx_fix")
def density_sample(fix):
    h = grid.hash32(F.col("fix_id"), F.col("track_id"))
    return fix.select("fix_id", h.alias("h"), features.keep_by_hash(F.col("fix_id"), F.col("track_id"), 0.25).alias("kept"))


@query("""WITH b AS (SELECT min(ei) a, max(ei) b, min(ni) c, max(ni) d FROM fx_tile_present), g AS (SELECT ei, unnest(range(c, d + 1)) AS ni FROM (SELECT unnest(range(a, b + 1)) AS ei, c, d FROM b))
SELECT CAST(ei AS INTEGER) AS ei, CAST(ni AS INTEGER) AS ni FROM g WHERE (ei, ni) NOT IN (SELECT (ei, ni) FROM fx_tile_present)""", "fx_tile_present")
def missing_tiles(tiles):
    return audit.missing_tiles(tiles)


@query("""WITH b AS (SELECT min(ei) a, max(ei) b, min(ni) c, max(ni) d FROM fx_tile_present), g AS (SELECT ei, unnest(range(c, d + 1)) AS ni FROM (SELECT unnest(range(a, b + 1)) AS ei, c, d FROM b)), m AS (SELECT ei, ni FROM g WHERE (ei, ni) NOT IN (SELECT (ei, ni) FROM fx_tile_present))
SELECT CAST(min(ei) AS INTEGER) AS e0, CAST(min(ni) AS INTEGER) AS n0, CAST(max(ei) + 2 AS INTEGER) AS e1, CAST(max(ni) + 2 AS INTEGER) AS n1 FROM m""", "fx_tile_present")
def bbox_of_missing(tiles):
    return audit.extent(audit.missing_tiles(tiles)).withColumns({"e1": F.col("e1") + 2, "n1": F.col("n1") + 2})


@query("""WITH b AS (SELECT min(e_km) a, max(e_km) b, min(n_km) c, max(n_km) d FROM fx_probe) SELECT CAST(e.i AS INTEGER) AS e_km, CAST(n.i AS INTEGER) AS n_km FROM b, range(1, 6000, 2) e(i), range(0, 6000, 2) n(i) WHERE e.i BETWEEN a AND b AND n.i BETWEEN c AND d""", "fx_probe")
def grid_cells(probe):
    e, n = grid.snap_cell(F.col("e_km"), F.col("n_km"))
    b = probe.select(e.alias("e"), n.alias("n")).agg(F.min("e").cast("int").alias("e0"), F.min("n").cast("int").alias("n0"), F.max("e").cast("int").alias("e1"), F.max("n").cast("int").alias("n1"))
    return audit.grid_tiles(b, out=("e_km", "n_km"), step=2)


@query("SELECT fix_id, CAST(floor(e / 1000) - (CASE WHEN floor(e / 1000) % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS e_km, CAST(floor(n / 1000) - floor(n / 1000) % 2 AS INTEGER) AS n_km FROM fx_fix", "fx_fix")
def snap_cell(fix):
    e, n = grid.snap_cell(F.floor(F.col("e") / 1000).cast("int"), F.floor(F.col("n") / 1000).cast("int"))
    return fix.select("fix_id", e.alias("e_km"), n.alias("n_km"))


LAST = "l AS (SELECT e_km, n_km, arg_max(status, (ts, status)) AS status FROM fx_probe WHERE status <> 0 GROUP BY ALL)"


@query(f"WITH {LAST} SELECT count(*) FILTER (status = 200) AS present, count(*) FILTER (status = 404) AS absent, count(*) FILTER (status IS NULL) AS unresolved FROM (SELECT DISTINCT e_km, n_km FROM fx_probe) LEFT JOIN l USING (e_km, n_km)", "fx_probe")
def probe_summary(probe):
    return audit.probe_summary(probe)


AUDIT = f"""{LAST}, have AS (SELECT e_km, n_km FROM fx_probe WHERE status <> 0 GROUP BY ALL HAVING arg_min(status, (ts, status)) = 200),
a AS ((SELECT e_km, n_km FROM l WHERE status = 200 UNION SELECT e_km, n_km FROM fx_probe WHERE status = 200) INTERSECT SELECT e_km, n_km FROM fx_probe EXCEPT SELECT * FROM have)"""


def _audit(probe):
    """Had: cells first found present; published: last found present; reference: ever found present."""
    cell = ["e_km", "n_km"]
    have = probe.where("status <> 0").groupBy(*cell).agg(F.min(F.struct("ts", "status")).alias("m")).where("m.status = 200").select(*cell)
    return audit.audit(probe.select(*cell), have, audit.last_status(probe).where("status = 200").select(*cell), probe.where("status = 200").select(*cell))


@query(f"WITH {AUDIT} SELECT * FROM a", "fx_probe")
def coverage_audit(probe):
    return _audit(probe)


@query(f"WITH {AUDIT} SELECT e_km, count(*) AS missing FROM a GROUP BY e_km", "fx_probe")
def missing_by_column(probe):
    return _audit(probe).groupBy("e_km").agg(F.count("*").alias("missing"))


@query("SELECT CAST(floor(ei / 2e0) AS INTEGER) AS ce, CAST(floor(ni / 2e0) AS INTEGER) AS cn FROM fx_tile_present GROUP BY ALL HAVING count(*) = 4", "fx_tile_present")
def complete_cells(tiles):
    b = tiles.select(F.floor(F.col("ei") / 2).cast("int").alias("ce"), F.floor(F.col("ni") / 2).cast("int").alias("cn")).distinct()
    need = b.select("ce", "cn", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select("ce", "cn", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("j")).select("ce", "cn", (F.col("ce") * 2 + F.col("i")).alias("ei"), (F.col("cn") * 2 + F.col("j")).alias("ni"))
    return audit.complete_groups(need, tiles, ["ei", "ni"], ["ce", "cn"])


@query("SELECT source, ei, ni, round(avg(CASE WHEN h <> 0 THEN 1e0 ELSE 0e0 END), 9) AS fraction FROM fx_height_px GROUP BY ALL", "fx_height_px")
def valid_fraction(px):
    return rounded(raster.valid_fraction(px, ("source", "ei", "ni")), 9, "fraction")


@query("SELECT source, ei, ni, round(avg(CASE WHEN h <> 0 THEN 1e0 ELSE 0e0 END), 9) AS fraction FROM fx_height_px GROUP BY ALL ORDER BY fraction, source, ei, ni LIMIT 5", "fx_height_px")
def worst_tiles(px):
    return valid_fraction(px).orderBy("fraction", "source", "ei", "ni").limit(5)


@query("SELECT ei, ni, prow, pcol, arg_min(h, source) AS h FROM fx_height_px WHERE h <> 0 GROUP BY ALL", "fx_height_px")
def mosaic_first(px):
    return raster.mosaic(px, "first")


@query("SELECT ei, ni, prow, pcol, arg_max(h, source) AS h FROM fx_height_px WHERE h <> 0 GROUP BY ALL", "fx_height_px")
def mosaic_last(px):
    return raster.mosaic(px, "last")


@query("SELECT ei, ni, prow, pcol, arg_max(h, ((prow * 7 + pcol * (3 + source)) % 5, -source)) AS h FROM fx_height_px WHERE h <> 0 GROUP BY ALL", "fx_height_px")
def mosaic_best(px):
    return raster.mosaic(px.withColumn("q", (F.col("prow") * 7 + F.col("pcol") * (3 + F.col("source"))) % 5), "best", quality="q")


@query(f"WITH {GOOD}, p AS (SELECT * FROM fx_height_px WHERE source = 1 OR (ei, ni) IN (SELECT (ei, ni) FROM good)), s AS (SELECT ei, ni, min(source) AS source FROM p GROUP BY ALL) SELECT p.* FROM p JOIN s USING (ei, ni, source)", "fx_height_px")
def first_source_wins(px):
    return raster.first_source_wins(_without_poor(px))


@query("""WITH g AS (SELECT *, CASE WHEN h <> 0 THEN h END AS v FROM fx_height_px WHERE source = 0),
s AS (SELECT a.ei, a.ni, a.prow, a.pcol, a.v,
  (SELECT struct_pack(v := b.v, d := a.pcol - b.pcol) FROM g b WHERE b.ei = a.ei AND b.ni = a.ni AND b.prow = a.prow AND b.pcol < a.pcol AND b.v IS NOT NULL ORDER BY b.pcol DESC LIMIT 1) AS l,
  (SELECT struct_pack(v := b.v, d := b.pcol - a.pcol) FROM g b WHERE b.ei = a.ei AND b.ni = a.ni AND b.prow = a.prow AND b.pcol > a.pcol AND b.v IS NOT NULL ORDER BY b.pcol LIMIT 1) AS r,
  (SELECT struct_pack(v := b.v, d := a.prow - b.prow) FROM g b WHERE b.ei = a.ei AND b.ni = a.ni AND b.pcol = a.pcol AND b.prow < a.prow AND b.v IS NOT NULL ORDER BY b.prow DESC LIMIT 1) AS u,
  (SELECT struct_pack(v := b.v, d := b.prow - a.prow) FROM g b WHERE b.ei = a.ei AND b.ni = a.ni AND b.pcol = a.pcol AND b.prow > a.prow AND b.v IS NOT NULL ORDER BY b.prow LIMIT 1) AS o FROM g a)
SELECT ei, ni, prow, pcol, round(coalesce(v, (coalesce(l.v / l.d, 0) + coalesce(r.v / r.d, 0) + coalesce(u.v / u.d, 0) + coalesce(o.v / o.d, 0)) / (coalesce(1e0 / l.d, 0) + coalesce(1e0 / r.d, 0) + coalesce(1e0 / u.d, 0) + coalesce(1e0 / o.d, 0))), 9) AS h FROM s""", "fx_height_px")
def fill_gaps_idw(px):
    return rounded(raster.fill_gaps_idw(px.where("source = 0")), 9, "h")


@query("""WITH a AS (SELECT ei, ni, prow, pcol, last_value(CASE WHEN h <> 0 THEN h END IGNORE NULLS) OVER (PARTITION BY ei, ni, prow ORDER BY pcol) AS h FROM fx_height_px WHERE source = 0),
b AS (SELECT ei, ni, prow, pcol, last_value(h IGNORE NULLS) OVER (PARTITION BY ei, ni, prow ORDER BY pcol DESC) AS h FROM a),
c AS (SELECT ei, ni, prow, pcol, last_value(h IGNORE NULLS) OVER (PARTITION BY ei, ni, pcol ORDER BY prow) AS h FROM b)
SELECT ei, ni, prow, pcol, last_value(h IGNORE NULLS) OVER (PARTITION BY ei, ni, pcol ORDER BY prow DESC) AS h FROM c""", "fx_height_px")
def fill_gaps_sweep(px):
    return raster.fill_gaps_sweep(px.where("source = 0"))


@query("""WITH d AS (SELECT ei, ni, prow, pcol, coalesce(lead(h) OVER c, h) - coalesce(lag(h) OVER c, h) AS dx, coalesce(lead(h) OVER r, h) - coalesce(lag(h) OVER r, h) AS dz FROM fx_height_px WHERE source = 1
WINDOW c AS (PARTITION BY ei, ni, prow ORDER BY pcol), r AS (PARTITION BY ei, ni, pcol ORDER BY prow)), l AS (SELECT *, sqrt(dx * dx + dz * dz + 128e0 * 128e0) AS l FROM d)
SELECT ei, ni, prow, pcol, round(-dx / l, 9) + 0e0 AS nx, round(128e0 / l, 9) AS ny, round(-dz / l, 9) + 0e0 AS nz FROM l""", "fx_height_px")
def slope_normals(px):
    n = rounded(raster.slope_normals(px.where("source = 1"), 64.0), 9, "nx", "ny", "nz")
    return n.withColumns({c: F.col(c) + 0.0 for c in ("nx", "nz")})


@query("SELECT source, ei, ni, CAST(floor(prow / 4e0) AS INTEGER) AS prow, CAST(floor(pcol / 4e0) AS INTEGER) AS pcol, round(avg(h), 9) AS h FROM fx_height_px WHERE source = 1 GROUP BY ALL", "fx_height_px")
def mip_pyramid(px):
    return rounded(raster.mip_pyramid(px.where("source = 1"), 4), 9, "h").withColumn("source", F.lit(1))


@query("""WITH s AS (SELECT CAST(i AS INTEGER) AS i FROM range(0, 16, 5) t(i)), w AS (SELECT p.ei, p.ni, p.prow, p.pcol, h, a.i AS r, b.i AS c FROM fx_height_px p, s a, s b WHERE source = 1 AND abs(a.i - prow) <= 2 AND abs(b.i - pcol) <= 2)
SELECT ei, ni, r AS prow, c AS pcol, round(avg(h), 7) AS h FROM w WHERE NOT (r IN (0, 15) OR c IN (0, 15)) OR (r = prow AND c = pcol) GROUP BY ALL""", "fx_height_px")
def lod_downsample(px):
    return rounded(raster.lod_downsample(px.where("source = 1"), PX, 5), 7, "h")


@query("""WITH co AS (SELECT ei, ni, CAST(floor(prow / 2e0) AS INTEGER) AS r, CAST(floor(pcol / 2e0) AS INTEGER) AS c, avg(h) AS ch FROM fx_height_px WHERE source = 1 GROUP BY ALL),
g AS (SELECT *, pcol * (7e0 / 15e0) AS x, prow * (7e0 / 15e0) AS y FROM fx_height_px WHERE source = 0 AND h = 0),
k AS (SELECT ei, ni, prow, pcol, least(floor(x) + dc, 7) AS c, least(floor(y) + dr, 7) AS r, (CASE WHEN dc = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN dr = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM g, (VALUES (0), (1)) a(dc), (VALUES (0), (1)) b(dr)),
f AS (SELECT ei, ni, prow, pcol, sum(ch * w) / sum(w) AS f FROM k JOIN co USING (ei, ni, r, c) WHERE ch <> 0 GROUP BY ALL)
SELECT ei, ni, prow, pcol, round(CASE WHEN h <> 0 THEN h ELSE coalesce(f, 0) END, 9) AS h FROM (SELECT * FROM fx_height_px WHERE source = 0) LEFT JOIN f USING (ei, ni, prow, pcol)""", "fx_height_px")
def fill_from_coarser(px):
    return rounded(raster.fill_from_coarser(px.where("source = 0"), raster.mip_pyramid(px.where("source = 1"), 2), PX, 8), 9, "h")


RGB = "c AS (SELECT ei, ni, prow, pcol, (prow * 37 + pcol * 11) % 256 AS r, (prow * 17 + pcol * 51 + ei) % 256 AS g, (pcol * 23 + ni) % 256 AS b FROM fx_height_px WHERE source = 0)"


@query(f"""WITH {RGB}, w AS (SELECT *, greatest(least(1e0, greatest(0e0, (least(r, g, b) - 200) / 50e0)), least(1e0, greatest(0e0, (14 - greatest(r, g, b)) / 8e0))) < 1 AS ok FROM c)
SELECT ei, ni, round(avg(r) FILTER (ok), 7) AS r, round(avg(g) FILTER (ok), 7) AS g, round(avg(b) FILTER (ok), 7) AS b, count(*) FILTER (ok) AS valid, count(*) FILTER (ok) * 10 >= count(*) AS kept FROM w GROUP BY ALL""", "fx_height_px")
def mean_color(px):
    c = px.where("source = 0").selectExpr("ei", "ni", "prow", "pcol", "(prow * 37 + pcol * 11) % 256 as r", "(prow * 17 + pcol * 51 + ei) % 256 as g", "(pcol * 23 + ni) % 256 as b")
    return rounded(raster.mean_color(c), 7, "r", "g", "b")


# ---- projections

@query(None, "fx_fix")
def wgs84_to_lv95(fix):
    ll = fix.select("fix_id", (45.9 + (F.col("fix_id") % 1000) / 500).alias("lat"), (6.0 + (F.col("track_id") % 100) / 25).alias("lon"))
    return rounded(geodesy.wgs84_to_lv95(ll), 3, "e", "n")


@query(None, "fx_fix")
def lv95_to_wgs84(fix):
    return rounded(geodesy.lv95_to_wgs84(fix.select("fix_id", "e", "n")), 8, "lat", "lon")


@query(None, "fx_fix")
def utm32_to_lv95(fix):
    u = fix.select("fix_id", (400000.0 + F.col("fix_id") % 90000).alias("ue"), (5_200_000.0 + F.col("track_id") * 100).alias("un"))
    return rounded(geodesy.utm32_to_lv95(u), 3, "e", "n")


def _geodetic_sql(rows: str) -> str:
    """The geocentric datum shift and the oblique Mercator, stage by stage, as SQL over rows(fix_id, lat, lon)."""
    g, (wa, wf), (ba, bf) = geodesy, geodesy.WGS84, geodesy.BESSEL
    we, be = wf * (2 - wf), bf * (2 - bf)
    out = f"""WITH p AS ({rows}), a AS (SELECT fix_id, radians(lat) AS f, radians(lon) AS l, {wa} / sqrt(1 - {we!r}e0 * sin(radians(lat)) * sin(radians(lat))) AS nn FROM p),
c AS (SELECT fix_id, nn * cos(f) * cos(l) - {g.SHIFT[0]} AS x, nn * cos(f) * sin(l) - {g.SHIFT[1]} AS y, nn * {1 - we!r}e0 * sin(f) - {g.SHIFT[2]} AS z FROM a),
i0 AS (SELECT fix_id, x, y, z, sqrt(x * x + y * y) AS r, atan2(z, sqrt(x * x + y * y) * {1 - be!r}e0) AS q FROM c)"""
    for k in range(4):
        out += f",\nj{k} AS (SELECT *, {ba}e0 / sqrt(1 - {be!r}e0 * sin(q) * sin(q)) AS nn FROM i{k}), i{k + 1} AS (SELECT fix_id, x, y, z, r, atan2(z, r * (1 - {be!r}e0 * nn / (r / cos(q)))) AS q FROM j{k})"
    out += f""",
s AS (SELECT fix_id, {g.ALPHA!r}e0 * (atan2(y, x) - {g.LAM0!r}e0) AS d, 2 * (atan(exp({g.ALPHA!r}e0 * ln(tan({pi / 4!r}e0 + q / 2)) - {g.ALPHA * g._E / 2!r}e0 * ln((1 + {g._E!r}e0 * sin(q)) / (1 - {g._E!r}e0 * sin(q))) + {g.K!r}e0)) - {pi / 4!r}e0) AS b FROM i4),
t AS (SELECT fix_id, atan2(sin(d), {sin(g.B0)!r}e0 * tan(b) + {cos(g.B0)!r}e0 * cos(d)) AS lb, asin({cos(g.B0)!r}e0 * sin(b) - {sin(g.B0)!r}e0 * cos(b) * cos(d)) AS bb FROM s)
SELECT fix_id, round({g.R!r}e0 * lb + 2600000e0, 3) AS e, round({g.R / 2!r}e0 * ln((1 + sin(bb)) / (1 - sin(bb))) + 1200000e0, 3) AS n"""
    return out


SQL["wgs84_to_lv95"] = with_views(_geodetic_sql("SELECT fix_id, 45.9e0 + (fix_id % 1000) / 500e0 AS lat, 6e0 + (track_id % 100) / 25e0 AS lon FROM fx_fix").replace("SELECT fix_id, round(", "SELECT fix_id, lat, lon, round(") + " FROM t JOIN p USING (fix_id)")


def _number(x: float) -> str:
    """A double literal."""
    return repr(x) if "e" in repr(x) else f"{x!r}e0"


def _utm_sql(rows: str) -> str:
    """The inverse Krueger series over rows(fix_id, ue, un), zone 32."""
    _, radius, _, beta, delta = geodesy._krueger()
    k = _number(0.9996 * radius)
    xi = "".join(f" - {_number(b)} * sin({2 * j} * x) * cosh({2 * j} * y)" for j, b in enumerate(beta, 1))
    eta = "".join(f" - {_number(b)} * cos({2 * j} * x) * sinh({2 * j} * y)" for j, b in enumerate(beta, 1))
    phi = "".join(f" + {_number(d)} * sin({2 * j} * c)" for j, d in enumerate(delta, 1))
    stage = f"SELECT fix_id, ue, un, x{xi} AS xi, y{eta} AS eta FROM (SELECT *, un / {k} AS x, (ue - 500000) / {k} AS y FROM ({rows}))"
    return f"SELECT fix_id, ue, un, degrees(c{phi}) AS lat, 9 + degrees(atan2(sinh(eta), cos(xi))) AS lon FROM (SELECT *, asin(sin(xi) / cosh(eta)) AS c FROM ({stage}))"


def _lv95_sql(rows: str) -> str:
    """The inverse oblique Mercator and datum shift over rows(fix_id, e, n)."""
    g, (wa, wf), (ba, bf) = geodesy, geodesy.WGS84, geodesy.BESSEL
    we, be, num = wf * (2 - wf), bf * (2 - bf), _number
    out = f"""WITH p AS ({rows}), a AS (SELECT fix_id, (e - 2600000) / {num(g.R)} AS lb, 2 * (atan(exp((n - 1200000) / {num(g.R)})) - {num(pi / 4)}) AS bb FROM p),
f0 AS (SELECT fix_id, atan2(sin(lb), {num(cos(g.B0))} * cos(lb) - {num(sin(g.B0))} * tan(bb)) AS l, asin({num(cos(g.B0))} * sin(bb) + {num(sin(g.B0))} * cos(bb) * cos(lb)) AS f FROM a),
s0 AS (SELECT *, (ln(tan({num(pi / 4)} + f / 2)) - {num(g.K)}) / {num(g.ALPHA)} AS s FROM f0)"""
    for k in range(5):
        out += f",\ns{k + 1} AS (SELECT fix_id, l, s, 2 * atan(exp(s + {num(g._E)} * ln(tan({num(pi / 4)} + asin({num(g._E)} * sin(f)) / 2)))) - {num(pi / 2)} AS f FROM s{k})"
    out += f""",
b AS (SELECT fix_id, f, {num(g.LAM0)} + l / {num(g.ALPHA)} AS l, {num(ba)} / sqrt(1 - {num(be)} * sin(f) * sin(f)) AS nn FROM s5),
i0 AS (SELECT *, atan2(z, r * {num(1 - we)}) AS q FROM (SELECT fix_id, x, y, z, sqrt(x * x + y * y) AS r FROM (SELECT fix_id, nn * cos(f) * cos(l) + {g.SHIFT[0]} AS x, nn * cos(f) * sin(l) + {g.SHIFT[1]} AS y, nn * {num(1 - be)} * sin(f) + {g.SHIFT[2]} AS z FROM b)))"""
    for k in range(4):
        out += f",\ni{k + 1} AS (SELECT fix_id, x, y, z, r, atan2(z, r * (1 - {num(we)} * nn / (r / cos(q)))) AS q FROM (SELECT *, {num(wa)} / sqrt(1 - {num(we)} * sin(q) * sin(q)) AS nn FROM i{k}))"
    return out + "\nSELECT fix_id, e, n, round(degrees(q), 8) AS lat, round(degrees(atan2(y, x)), 8) AS lon FROM i4 JOIN p USING (fix_id)"


SQL["lv95_to_wgs84"] = with_views(_lv95_sql("SELECT fix_id, e, n FROM fx_fix"))
SQL["utm32_to_lv95"] = with_views(_geodetic_sql(_utm_sql("SELECT fix_id, 400000e0 + fix_id % 90000 AS ue, 5200000e0 + track_id * 100 AS un FROM fx_fix")).replace("SELECT fix_id, round(", "SELECT fix_id, ue, un, round(") + " FROM t JOIN p USING (fix_id)")


# ---- lines

SEG = "s AS (SELECT line_id, seq, e, n, lead(e) OVER w AS e1, lead(n) OVER w AS n1 FROM fx_line_vertex WINDOW w AS (PARTITION BY line_id ORDER BY seq)), g AS (SELECT *, sqrt((e1 - e) * (e1 - e) + (n1 - n) * (n1 - n)) AS length FROM s WHERE e1 IS NOT NULL)"


@query(f"WITH {SEG} SELECT line_id, seq, round(length, 6) AS length, round(sum(length) OVER (PARTITION BY line_id ORDER BY seq) - length, 5) + 0e0 AS chainage FROM g", "fx_line_vertex")
def line_segments(v):
    s = rounded(lines.segments(v), 6, "length").withColumn("chainage", F.round("chainage", 5) + 0.0)
    return s.select("line_id", "seq", "length", "chainage")


@query(f"""WITH {SEG}, k AS (SELECT *, greatest(1, CAST(ceil(length / 500e0) AS INTEGER)) AS parts FROM g)
SELECT line_id, seq, CAST(i AS INTEGER) AS part, e + i * 1e0 / parts * (e1 - e) AS e, n + i * 1e0 / parts * (n1 - n) AS n FROM k, range(0, 1000) t(i) WHERE i < parts
UNION ALL SELECT line_id, seq, 0, e, n FROM s WHERE e1 IS NULL""", "fx_line_vertex")
def densify(v):
    return lines.densify(v, 500.0)


@query("""WITH d AS (SELECT *, lead(e) OVER w - e AS de, lead(n) OVER w - n AS dn FROM fx_line_vertex WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
u AS (SELECT *, de / nullif(sqrt(de * de + dn * dn), 0) AS t1e, dn / nullif(sqrt(de * de + dn * dn), 0) AS t1n FROM d),
p AS (SELECT *, lag(t1e) OVER w AS t0e, lag(t1n) OVER w AS t0n FROM u WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
q AS (SELECT line_id, seq, e, n, coalesce(t0e, t1e) AS ae, coalesce(t0n, t1n) AS an, coalesce(t1e, t0e) AS be, coalesce(t1n, t0n) AS bn FROM p),
k AS (SELECT *, 1 + ae * be + an * bn AS k FROM q),
o AS (SELECT *, CASE WHEN k < 1e-4 THEN -an * 6e0 ELSE (-an - bn) * 6e0 / k END AS oe, CASE WHEN k < 1e-4 THEN ae * 6e0 ELSE (ae + be) * 6e0 / k END AS o_n FROM k),
m AS (SELECT *, CASE WHEN sqrt(oe * oe + o_n * o_n) > 15 THEN 15 / sqrt(oe * oe + o_n * o_n) ELSE 1 END AS s FROM o)
SELECT line_id, seq, round(e + oe * s, 4) AS left_e, round(n + o_n * s, 4) AS left_n, round(e - oe * s, 4) AS right_e, round(n - o_n * s, 4) AS right_n FROM m""", "fx_line_vertex")
def ribbon(v):
    return rounded(lines.ribbon(v, 6.0), 4, "left_e", "left_n", "right_e", "right_n")


@query(f"""WITH {SEG}, t AS (SELECT line_id, seq, e, n, e1, n1, unnest([0e0, 1e0]) AS t FROM g
UNION SELECT line_id, seq, e, n, e1, n1, (i * 4096e0 - e) / (e1 - e) FROM (SELECT *, unnest(range(CAST(floor(least(e, e1) / 4096) AS BIGINT) + 1, CAST(ceil(greatest(e, e1) / 4096) AS BIGINT))) AS i FROM g WHERE e <> e1)
UNION SELECT line_id, seq, e, n, e1, n1, (i * 4096e0 - n) / (n1 - n) FROM (SELECT *, unnest(range(CAST(floor(least(n, n1) / 4096) AS BIGINT) + 1, CAST(ceil(greatest(n, n1) / 4096) AS BIGINT))) AS i FROM g WHERE n <> n1)),
p AS (SELECT *, lead(t) OVER (PARTITION BY line_id, seq ORDER BY t) AS t1, row_number() OVER (PARTITION BY line_id, seq ORDER BY t) - 1 AS part FROM t)
SELECT line_id, seq, CAST(part AS INTEGER) AS part, round(e + t * (e1 - e), 4) AS e0, round(n + t * (n1 - n), 4) AS n0, round(e + t1 * (e1 - e), 4) AS e1, round(n + t1 * (n1 - n), 4) AS n1,
CAST(floor((e + t * (e1 - e) + e + t1 * (e1 - e)) / 2 / 4096) AS INTEGER) AS ei, CAST(floor((n + t * (n1 - n) + n + t1 * (n1 - n)) / 2 / 4096) AS INTEGER) AS ni FROM p WHERE t1 IS NOT NULL""", "fx_line_vertex")
def split_at_tiles(v):
    return rounded(lines.split_at_tiles(v, 4096.0), 4, "e0", "n0", "e1", "n1")


@query("""SELECT v.*, CASE WHEN line_id % 8 = 2 THEN 'yes' ELSE 'no' END AS tunnel, c.* EXCLUDE (cls) FROM fx_line_vertex v JOIN (VALUES ('primary', 12e0, 0.72e0, 0.66e0, 0.58e0, 8), ('residential', 5e0, 0.8e0, 0.78e0, 0.74e0, 4), ('railway:rail', 3e0, 0.3e0, 0.3e0, 0.3e0, 8)) c(cls, width, red, green, blue, priority) USING (cls)
WHERE NOT (cls = 'railway:rail' AND line_id % 8 = 2)""", "fx_line_vertex")
def classify_roads(v):
    return lines.classify_roads(v.withColumn("tunnel", F.when(F.col("line_id") % 8 == 2, "yes").otherwise("no")))


@query("SELECT v.* FROM fx_line_vertex v JOIN (SELECT line_id, CAST(floor(count(*) / 2e0) AS INTEGER) AS seq FROM fx_line_vertex GROUP BY line_id) m USING (line_id, seq)", "fx_line_vertex")
def middle_vertex(v):
    return lines.middle_vertex(v)


# ---- areas

INSIDE = """r AS (SELECT *, coalesce(lag(e) OVER w, last_value(e) OVER x) AS e0, coalesce(lag(n) OVER w, last_value(n) OVER x) AS n0 FROM fx_ring_vertex
WINDOW w AS (PARTITION BY poly_id, ring_no ORDER BY seq), x AS (PARTITION BY poly_id, ring_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
i AS (SELECT fix_id, poly_id, kind FROM fx_fix f JOIN r ON (r.n > f.n) <> (r.n0 > f.n) AND f.e < (r.e0 - r.e) * (f.n - r.n) / (r.n0 - r.n) + r.e GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(f"WITH {INSIDE} SELECT fix_id, poly_id FROM i", "fx_fix", "fx_ring_vertex", fixtures=CROWDED)
def points_in_polygons(fix, rings):
    return spatial.points_in_polygons(fix, rings, ["fix_id"])


@query(f"""WITH {INSIDE}, k AS (SELECT *, CASE kind WHEN 12 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 3 WHEN 8 THEN 4 WHEN 9 THEN 5 WHEN 10 THEN 6 WHEN 11 THEN 7 WHEN 4 THEN 9 ELSE 8 END AS rank FROM i WHERE kind <> 3)
SELECT fix_id, arg_max(kind, (rank, poly_id)) AS kind FROM k GROUP BY fix_id""", "fx_fix", "fx_ring_vertex", fixtures=CROWDED)
def rasterise_classes(fix, rings):
    return spatial.rasterise_classes(fix, rings, ["fix_id"])


@query("SELECT f.* FROM fx_fix f WHERE NOT EXISTS (SELECT 1 FROM fx_zone z WHERE f.fix_id % 3 >= z.min_dir AND (f.e - z.e) * (f.e - z.e) + (f.n - z.n) * (f.n - z.n) <= z.r * z.r)", "fx_fix", "fx_zone")
def exclude_in_zones(fix, zones):
    return spatial.exclude_in_zones(fix.withColumn("priority", F.col("fix_id") % 3), zones, ["fix_id"]).drop("priority")


def _corridors(v):
    return lines.segments(v).select("line_id", "seq", F.col("e").alias("e0"), F.col("n").alias("n0"), "e1", "n1")


@query(f"""WITH {SEG}, h AS (SELECT *, (e1 - e) * (e1 - e) + (n1 - n) * (n1 - n) AS l2 FROM g)
SELECT f.fix_id, f.e, f.n FROM fx_fix f WHERE NOT EXISTS (SELECT 1 FROM h WHERE sqrt(pow(f.e - (h.e + least(1, greatest(0, coalesce(((f.e - h.e) * (e1 - h.e) + (f.n - h.n) * (n1 - h.n)) / nullif(l2, 0), 0))) * (e1 - h.e)), 2)
 + pow(f.n - (h.n + least(1, greatest(0, coalesce(((f.e - h.e) * (e1 - h.e) + (f.n - h.n) * (n1 - h.n)) / nullif(l2, 0), 0))) * (n1 - h.n)), 2)) < 0.5e0)""", "fx_fix", "fx_line_vertex")
def clear_corridors(fix, v):
    s = _corridors(v).withColumn("half_width", F.lit(0.25))
    return spatial.clear_corridors(fix.select("fix_id", "e", "n"), s, "fix_id", 0.25)


NEAR = "t AS (SELECT DISTINCT ei, ni, ei * 1024e0 + 512 AS ce, ni * 1024e0 + 512 AS cn FROM fx_height_px)"


@query(f"WITH {NEAR} SELECT fix_id, ei, ni, round(sqrt(pow(ce - e, 2) + pow(cn - n, 2)), 5) AS distance FROM fx_fix, t WHERE sqrt(pow(ce - e, 2) + pow(cn - n, 2)) <= 3000", "fx_fix", "fx_height_px", fixtures=CROWDED)
def tiles_in_radius(fix, px):
    t = px.select("ei", "ni").distinct().withColumns({"ce": F.col("ei") * 1024.0 + 512, "cn": F.col("ni") * 1024.0 + 512})
    return rounded(spatial.tiles_in_radius(fix, t, 3000.0, ["fix_id"]), 5, "distance")


RING = "r AS (SELECT track_id, fix_id, CAST(floor(e / 1024) + a.i AS INTEGER) AS ei, CAST(floor(n / 1024) + b.i AS INTEGER) AS ni, CAST(greatest(abs(a.i), abs(b.i)) AS INTEGER) AS distance FROM fx_fix, range(-4, 5) a(i), range(-4, 5) b(i)), l AS (SELECT *, CASE WHEN distance <= 1 THEN 0 WHEN distance <= 2 THEN 1 ELSE 2 END AS lod FROM r)"


def _rings(fix):
    f = fix.withColumns({"ei": grid.tile_of(F.col("e")), "ni": grid.tile_of(F.col("n"))})
    return spatial.tiles_in_ring(f, 4, ["track_id", "fix_id"], lambda d: grid.lod_for_distance(d, 4))


@query(f"WITH {RING} SELECT * FROM l", "fx_fix")
def tiles_in_ring(fix):
    return _rings(fix)


@query(f"WITH {RING} SELECT track_id, ei, ni, min(lod) AS lod, count(*) AS fixes, CAST(pow(floor(1023 / pow(2, min(lod))) + 1, 2) AS BIGINT) AS vertices FROM l GROUP BY ALL", "fx_fix")
def tile_demand(fix):
    f = fix.withColumns({"te": grid.tile_of(F.col("e")), "tn": grid.tile_of(F.col("n"))})
    return residency.tile_demand(f, 4)


@query("""WITH RECURSIVE f AS (SELECT track_id, fix_id, row_number() OVER (PARTITION BY track_id ORDER BY ts, fix_id) AS k, CAST(floor(e / 1024) AS INTEGER) AS te, CAST(floor(n / 1024) AS INTEGER) AS tn FROM fx_fix),
near AS (SELECT track_id, k, te + a.i AS ei, tn + b.i AS ni, greatest(abs(a.i), abs(b.i)) AS d FROM f, range(-3, 4) a(i), range(-3, 4) b(i)),
st AS (SELECT *, k - row_number() OVER (PARTITION BY track_id, ei, ni ORDER BY k) AS stay FROM near),
run AS (SELECT track_id, ei, ni, min(k) FILTER (d <= 2) AS a, max(k) + 1 AS b FROM st GROUP BY track_id, ei, ni, stay HAVING min(k) FILTER (d <= 2) IS NOT NULL),
ev AS (SELECT track_id, ei, ni, a AS k, 'load' AS action FROM run UNION ALL SELECT track_id, ei, ni, b, 'unload' FROM run)
SELECT track_id, fix_id, CAST(ei AS INTEGER) AS ei, CAST(ni AS INTEGER) AS ni, action FROM ev JOIN f USING (track_id, k)""", "fx_fix")
def residency_batch(fix):
    f = fix.withColumns({"te": grid.tile_of(F.col("e")), "tn": grid.tile_of(F.col("n"))})
    return residency.residency_batch(f, 2, 1)


# ---- buildings

@query("SELECT building_id, x0 AS min_x, x0 + w AS max_x, y0 AS min_y, y0 + d AS max_y, z0 AS min_z, z0 + hgt AS max_z, round(z0 + hgt - z0, 6) AS height, round((x0 + w - x0) * (y0 + d - y0), 6) AS footprint FROM fx_box WHERE round((x0 + w - x0) * (y0 + d - y0), 6) >= 1", "fx_box")
def building_box(boxes):
    return features.drop_tiny(rounded(features.building_box(features.box_faces(boxes)), 6, "height", "footprint"))


@query("SELECT building_id, round(w * d, 5) AS roof_area, round(2 * (w + d) * hgt, 5) AS wall_area FROM fx_box", "fx_box")
def wall_roof_area(boxes):
    return rounded(features.wall_roof_area(features.box_faces(boxes)), 5, "roof_area", "wall_area")


@query("""WITH r AS (SELECT *, coalesce(lead(e) OVER w, first_value(e) OVER w) AS e1, coalesce(lead(n) OVER w, first_value(n) OVER w) AS n1 FROM fx_ring_vertex WINDOW w AS (PARTITION BY poly_id, ring_no ORDER BY seq)),
a AS (SELECT poly_id, ring_no, sum((e - e1) * (n + n1)) AS s FROM r GROUP BY ALL) SELECT poly_id, ring_no, CAST(sign(s) AS DOUBLE) AS nz, round(abs(s) / 2, 2) AS area FROM a""", "fx_ring_vertex")
def newell(rings):
    r = rings.select("poly_id", "ring_no", "seq", F.col("e").alias("x"), F.col("n").alias("y"), F.lit(0.0).alias("z"))
    return rounded(features.newell(r, ["poly_id", "ring_no"]).select("poly_id", "ring_no", F.round("nz").alias("nz"), "area"), 2, "area")


@query(SAMPLE.join(["WITH ", " SELECT building_id, round(coalesce(h, z0), 6) AS seated_z, h IS NOT NULL AS shifted FROM fx_box LEFT JOIN (SELECT fix_id AS building_id, CASE WHEN count(h) = 4 THEN sum(h * w) END AS h FROM co LEFT JOIN (SELECT * FROM fx_height_px WHERE source = 1) p USING (ei, ni, prow, pcol) GROUP BY fix_id) USING (building_id)"]).replace("FROM fx_fix)", "FROM (SELECT building_id AS fix_id, x0 + w / 2 AS e, y0 + d / 2 AS n FROM fx_box))"), "fx_box", "fx_height_px")
def seat_buildings(boxes, px):
    centre = boxes.select("building_id", (F.col("x0") + F.col("w") / 2).alias("e"), (F.col("y0") + F.col("d") / 2).alias("n"))
    ground = raster.sample_height(centre, px.where("source = 1"), ["building_id"], PX)
    seated = features.seat_buildings(boxes.withColumnRenamed("z0", "min_z"), ground)
    return rounded(seated.select("building_id", "seated_z", "shifted"), 6, "seated_z")


DRAPE = SAMPLE.replace("SELECT fix_id, e, n, floor", "SELECT line_id * 100000 + seq AS fix_id, e, n, floor").replace("FROM fx_fix)", "FROM fx_line_vertex)") + ", hh AS (SELECT fix_id, CASE WHEN count(h) = 4 THEN sum(h * w) END AS h FROM co LEFT JOIN (SELECT * FROM fx_height_px WHERE source = 1) p USING (ei, ni, prow, pcol) GROUP BY fix_id), v AS (SELECT line_id, seq, CAST(floor(e / 4096) AS INTEGER) AS ei, CAST(floor(n / 4096) AS INTEGER) AS ni, h FROM fx_line_vertex JOIN hh ON fix_id = line_id * 100000 + seq)"


def _draped(v, px, op, *more):
    h = raster.sample_height(v, px.where("source = 1"), ["line_id", "seq"], PX)
    t = v.withColumns({"ei": grid.tile_of(F.col("e"), 4096.0), "ni": grid.tile_of(F.col("n"), 4096.0)})
    return op(t, h, ["line_id", "seq"], ["ei", "ni"], *more)


@query(f"WITH {DRAPE} SELECT line_id, seq, round(coalesce(h, avg(h) OVER (PARTITION BY ei, ni)) + 0.4e0, 6) AS y FROM v", "fx_line_vertex", "fx_height_px")
def drape(v, px):
    return rounded(_draped(v, px, lines.drape, 0.4).select("line_id", "seq", "y"), 6, "y")


@query(f"WITH {DRAPE} SELECT ei, ni, count(h) AS resolved, round(avg(h), 6) AS mean_h, bool_and(h IS NOT NULL) AS complete FROM v GROUP BY ALL", "fx_line_vertex", "fx_height_px")
def drape_summary(v, px):
    return rounded(_draped(v, px, lines.drape_summary), 6, "mean_h")


# ---- trees

def _trees(rings):
    """Trees of every polygon, 200 or 250 metres apart by its density."""
    outer = rings.where("ring_no = 0").groupBy("poly_id", "kind").agg(F.min("e").alias("x0"), F.min("n").alias("y0"), F.max("e").alias("x1"), F.max("n").alias("y1"))
    outer = outer.withColumn("density", F.when(F.col("kind") % 2 == 0, 1.6e-5).otherwise(2.5e-5))
    t = features.tree_grid(outer).withColumnRenamed("poly_id", "own")
    return spatial.points_in_polygons(t, rings, ["own", "i", "j", "hash", "e", "n"], own="own").drop("own")


def _mix(a: str, b: str) -> str:
    return f"xor(CAST((CAST({a} AS HUGEINT) * 2654435761) % 4294967296 AS BIGINT), CAST((CAST({b} AS HUGEINT) * 2246822519) % 4294967296 AS BIGINT))"


TREES = f"""b AS (SELECT poly_id, min(e) AS x0, min(n) AS y0, max(e) AS x1, max(n) AS y1, 1 / sqrt(CASE WHEN kind % 2 = 0 THEN 1.6e-5 ELSE 2.5e-5 END) AS step FROM fx_ring_vertex WHERE ring_no = 0 GROUP BY poly_id, kind),
bi AS (SELECT *, unnest(range(CAST(floor(x0 / step) AS BIGINT), CAST(floor(x1 / step) AS BIGINT) + 1)) AS i FROM b), bj AS (SELECT *, unnest(range(CAST(floor(y0 / step) AS BIGINT), CAST(floor(y1 / step) AS BIGINT) + 1)) AS j FROM bi),
c AS (SELECT poly_id AS own, step, i, j, {_mix("i", "j")} AS x FROM bj),
h AS (SELECT own, step, i, j, CAST((CAST(xor(x, x >> 15) AS HUGEINT) * 3266489917) % 4294967296 AS BIGINT) AS hash FROM c),
t AS (SELECT own, i, j, hash, (i + (hash % 1024) / 1024e0) * step AS e, (j + (floor(hash / 1024e0) % 1024) / 1024e0) * step AS n FROM h),
r AS (SELECT *, coalesce(lag(e) OVER w, last_value(e) OVER x) AS e0, coalesce(lag(n) OVER w, last_value(n) OVER x) AS n0 FROM fx_ring_vertex
WINDOW w AS (PARTITION BY poly_id, ring_no ORDER BY seq), x AS (PARTITION BY poly_id, ring_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
k AS (SELECT poly_id, i, j, hash, t.e, t.n FROM t JOIN r ON own = poly_id AND (r.n > t.n) <> (r.n0 > t.n) AND t.e < (r.e0 - r.e) * (t.n - r.n) / (r.n0 - r.n) + r.e GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(f"WITH {TREES} SELECT poly_id, i, j, hash, round(e, 5) AS e, round(n, 5) AS n FROM k", "fx_ring_vertex")
def tree_fill(rings):
    return rounded(_trees(rings), 5, "e", "n")


@query(f"""WITH {TREES}, g AS (SELECT *, 400e0 + hash % 2000 AS z, CASE poly_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS hint FROM k),
s AS (SELECT *, CASE hint WHEN 1 THEN true WHEN 0 THEN false ELSE (hash % 65536) / 65535e0 < least(0.97e0, greatest(0.2e0, 0.25e0 + (z - 700) / 900e0)) END AS conifer FROM g),
p AS (SELECT *, CASE WHEN conifer THEN [1, 3] ELSE [0, 2, 4] END AS pool FROM s),
th AS (SELECT floor(e / 1024) AS ei, floor(n / 1024) AS ni, pool[1 + (hash >> 16) % len(pool)] AS species, conifer, z, 20e0 * (0.75e0 + 0.5e0 * ((hash % 1024) / 1024e0)) * least(1e0, greatest(0.45e0, 1 - (z - 1300) / 1000e0 * 0.55e0)) AS height, hash % 7 = 0 AS snapped FROM p)
SELECT CAST(ei AS INTEGER) AS ei, CAST(ni AS INTEGER) AS ni, count(*) AS trees, round(min(height), 4) AS min_height, round(max(height), 4) AS max_height, round(count(*) FILTER (z < 700 AND conifer) * 1e0 / nullif(count(*) FILTER (z < 700), 0), 9) AS low_conifers, round(count(*) FILTER (z > 1300 AND conifer) * 1e0 / nullif(count(*) FILTER (z > 1300), 0), 9) AS high_conifers,
round(avg(height) FILTER (z < 700), 4) AS low_height, round(avg(height) FILTER (z > 1900), 4) AS alpine_height, min(z) AS ground_min, max(z) AS ground_max, count(*) FILTER (snapped) AS snapped, {", ".join(f"count(*) FILTER (species = {k}) AS species_{k}" for k in range(5))}, round(max(height) * 0.3e0, 4) AS crown FROM th GROUP BY ALL""", "fx_ring_vertex")
def tree_stats(rings):
    """Trees with a ground, a species (five, of which 1 and 3 are conifers) and a height that the altitude lessens."""
    h, z = F.col("hash"), F.col("ground_z")
    hint = F.when(F.col("poly_id") % 3 == 0, 0).when(F.col("poly_id") % 3 == 1, 1).otherwise(-1)
    kinds = [False, True, False, True, False]
    t = _trees(rings).withColumn("ground_z", 400.0 + h % 2000).withColumn("species", features.pick_species(h, z, hint, kinds))
    t = t.withColumns({"conifer": F.col("species").isin(1, 3), "height": features.tree_height(F.lit(20.0), (h % 1024) / 1024.0) * features.altitude_factor(z), "snapped": h % 7 == 0, "ei": grid.tile_of(F.col("e")), "ni": grid.tile_of(F.col("n"))})
    s = features.tree_stats(t, ["ei", "ni"]).withColumn("crown", features.crown_radius(F.col("max_height")))
    s = rounded(rounded(s, 4, "min_height", "max_height", "low_height", "alpine_height", "crown"), 9, "low_conifers", "high_conifers")
    return s.select("*", *(F.coalesce(F.col("species")[k], F.lit(0)).cast("long").alias(f"species_{k}") for k in range(5))).drop("species")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts, fix_id) - 1 AS k FROM fx_fix) SELECT track_id, fix_id FROM r WHERE k % 3 = 0", "fx_fix")
def thin_every_nth(fix):
    return features.thin_every_nth(fix, 0.3, ["track_id"], ["ts", "fix_id"]).select("track_id", "fix_id")


# ---- catalogues

@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY line_id % 40 ORDER BY seq DESC, line_id) AS k FROM fx_line_vertex) SELECT line_id, seq FROM r WHERE k = 1", "fx_line_vertex")
def latest_version(v):
    item = v.withColumn("item", F.col("line_id") % 40)
    return audit.suppress_duplicates(item, ["item"], [F.desc("seq"), F.asc("line_id")]).select("line_id", "seq")


@query(f"WITH {GOOD} SELECT ei, ni, min(source) AS source FROM fx_height_px WHERE source = 1 OR (ei, ni) IN (SELECT (ei, ni) FROM good) GROUP BY ei, ni", "fx_height_px")
def suppress_duplicate_tiles(px):
    t = _without_poor(px).select("source", "ei", "ni").distinct()
    return audit.suppress_duplicates(t, ["ei", "ni"], [F.asc("source")])


@query("""WITH n AS (SELECT DISTINCT CAST(floor(e / 1024) AS INTEGER) AS ei, CAST(floor(n / 1024) AS INTEGER) AS ni, 'new' AS origin FROM fx_zone), o AS (SELECT DISTINCT CAST(floor(e / 1024) AS INTEGER) AS ei, CAST(floor(n / 1024) AS INTEGER) AS ni, 'old' AS origin FROM fx_fix)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.ei = o.ei AND n.ni = o.ni)""", "fx_zone", "fx_fix")
def upsert_manifest(zones, fix):
    tiles = lambda df, name: df.select(grid.tile_of(F.col("e")).alias("ei"), grid.tile_of(F.col("n")).alias("ni"), F.lit(name).alias("origin")).distinct()
    return audit.upsert(tiles(fix, "old"), tiles(zones, "new"), ["ei", "ni"])


@query("WITH d AS (SELECT ei, ni, CAST(greatest(abs(ei - 20), abs(ni - 15)) AS INTEGER) AS distance FROM fx_tile_present) SELECT *, row_number() OVER (ORDER BY distance, ei, ni) AS place FROM d", "fx_tile_present")
def nearest_first(tiles):
    return audit.nearest_first(tiles, F.lit(20), F.lit(15))


@query("WITH s AS (SELECT DISTINCT ei % 8 AS src, ei, ni FROM fx_tile_present) SELECT src FROM s GROUP BY src HAVING bool_and(ni % 31 < 30 OR ei % 8 < 4)", "fx_tile_present")
def release_sources(tiles):
    deps = tiles.withColumn("src", F.col("ei") % 8)
    return audit.release_sources(deps, tiles.where((F.col("ni") % 31 < 30) | (F.col("ei") % 8 < 4)), ["src"])


# ---- composites

@query("""WITH c AS (SELECT source, ei, ni, prow, pcol, CASE WHEN h = 0 THEN 255 - prow ELSE (prow * 37 + pcol * 11) % 256 END AS r, CASE WHEN h = 0 THEN 250 - pcol ELSE (prow * 17 + pcol * 51 + ei) % 256 END AS g, CASE WHEN h = 0 THEN 240 ELSE (pcol * 23 + ni + source) % 256 END AS b FROM fx_height_px),
a AS (SELECT *, greatest(least(1e0, greatest(0e0, (least(r, g, b) - 200) / 50e0)), least(1e0, greatest(0e0, (14 - greatest(r, g, b)) / 8e0))) AS w FROM c WHERE source = 0)
SELECT ei, ni, prow, pcol, CAST(floor(a.r * (1 - w) + z.r * w + 0.5e0) AS INTEGER) AS r, CAST(floor(a.g * (1 - w) + z.g * w + 0.5e0) AS INTEGER) AS g, CAST(floor(a.b * (1 - w) + z.b * w + 0.5e0) AS INTEGER) AS b FROM a JOIN (SELECT * FROM c WHERE source = 1) z USING (ei, ni, prow, pcol)""", "fx_height_px")
def merge_rgb(px):
    c = px.selectExpr("source", "ei", "ni", "prow", "pcol", "if(h = 0, 255 - prow, (prow * 37 + pcol * 11) % 256) as r", "if(h = 0, 250 - pcol, (prow * 17 + pcol * 51 + ei) % 256) as g", "if(h = 0, 240, (pcol * 23 + ni + source) % 256) as b")
    return raster.merge_rgb(c)


def _passes(start: str, key: str, row: str, col: str, n: int = 5) -> str:
    """``n`` passes of the neighbours' fill over the rows of ``start`` (h null where missing), the last one as q{n}."""
    out = f"q0 AS MATERIALIZED ({start})"
    for k in range(n):
        on = " AND ".join(f"a.{c} = b.{c}" for c in key.split(", "))
        out += f""",
q{k + 1} AS MATERIALIZED (SELECT {key}, {row}, {col}, coalesce(h, m) AS h FROM q{k} LEFT JOIN (SELECT {", ".join("a." + c for c in key.split(", "))}, a.{row}, a.{col}, avg(b.h) AS m FROM q{k} a JOIN q{k} b ON {on} AND abs(a.{row} - b.{row}) <= 1 AND abs(a.{col} - b.{col}) <= 1 WHERE a.h IS NULL AND b.h IS NOT NULL GROUP BY ALL) USING ({key}, {row}, {col}))"""
    return out


@query("""WITH k AS (SELECT i AS c, least(floor(i / 8e0 * 8e0), 7) AS t, floor((i / 8e0 * 8e0 - least(floor(i / 8e0 * 8e0), 7)) * 15 + 0.5e0) AS p FROM range(0, 9) r(i)),
z AS (SELECT floor(ei / 8e0) AS cei, floor(ni / 8e0) AS cni, x.c AS cx, y.c AS cy, avg(h) AS h FROM fx_height_px, k x, k y WHERE source = 1 AND h <> 0 AND 7 - x.t = ei % 8 AND abs(x.p - pcol) <= 1 AND y.t = ni % 8 AND abs(y.p - prow) <= 1 GROUP BY ALL),
l AS (SELECT cei, cni, x.c AS cx, y.c AS cy FROM (SELECT DISTINCT floor(ei / 8e0) AS cei, floor(ni / 8e0) AS cni FROM fx_height_px WHERE source = 1), k x, k y),
""" + _passes("SELECT cei, cni, cx, cy, h FROM l LEFT JOIN z USING (cei, cni, cx, cy)", "cei, cni", "cy", "cx", 9) + """
SELECT CAST(cei AS INTEGER) AS cei, CAST(cni AS INTEGER) AS cni, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy, round(coalesce(h, 0) + 3.14159e-8, 6) AS h FROM q9""", "fx_height_px")
def chunk_composite(px):
    """Heights are means of short decimals, so they are moved off the middle before they are rounded."""
    c = raster.chunk_composite(px.where("source = 1"), PX, 9)
    return rounded(c.withColumn("h", F.col("h") + 3.14159e-8), 6, "h")


@query(f"WITH {_passes('SELECT ei, ni, prow, pcol, CASE WHEN h <> 0 THEN h END AS h FROM fx_height_px WHERE source = 0', 'ei, ni', 'prow', 'pcol')} SELECT ei, ni, prow, pcol, round(coalesce(h, 0), 9) AS h FROM q5", "fx_height_px")
def fill_gaps_neighbours(px):
    """The twin's five passes are more than the data need; a test holds wider gaps against brute force."""
    return rounded(raster.fill_gaps_neighbours(px.where("source = 0")), 9, "h")


@query("""WITH t AS (SELECT e AS ax, seq * 10e0 AS ay, n AS az, e + 400 AS bx, seq * 10e0 + 5 AS b_y, n + 50 AS bz, e + 100 AS cx, seq * 10e0 + 8 AS cy, n + 300 AS cz FROM fx_line_vertex),
a AS (SELECT *, (bx - ax) * (cz - az) - (cx - ax) * (bz - az) AS area FROM t),
u AS (SELECT fix_id, ay, b_y, cy, ((bx - e) * (cz - n) - (cx - e) * (bz - n)) / area AS u, ((cx - e) * (az - n) - (ax - e) * (cz - n)) / area AS v FROM fx_fix JOIN a ON abs(area) >= 1e-3 AND e BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND n BETWEEN least(az, bz, cz) AND greatest(az, bz, cz)),
y AS (SELECT fix_id, u * ay + v * b_y + (1 - u - v) * cy AS y FROM u WHERE least(u, v, 1 - u - v) >= -1e-4)
SELECT fix_id, round(max(y), 6) AS y FROM y WHERE abs(y - 150e0) <= 60 GROUP BY fix_id""", "fx_fix", "fx_line_vertex", fixtures=CROWDED)
def surface_height(fix, v):
    e, n, y = F.col("e"), F.col("n"), F.col("seq") * 10.0
    t = v.select(e.alias("ax"), y.alias("ay"), n.alias("az"), (e + 400).alias("bx"), (y + 5).alias("by"), (n + 50).alias("bz"), (e + 100).alias("cx"), (y + 8).alias("cy"), (n + 300).alias("cz"))
    return rounded(spatial.surface_height_at(fix.select("fix_id", "e", "n", F.lit(150.0).alias("hint")), t, ["fix_id"], 60.0), 6, "y")


@query("""WITH a AS (SELECT *, unnest(range(CAST(floor((e - r) / 1024) AS BIGINT), CAST(ceil((e + r) / 1024) AS BIGINT))) AS ei FROM fx_zone), b AS (SELECT *, unnest(range(CAST(floor((n - r) / 1024) AS BIGINT), CAST(ceil((n + r) / 1024) AS BIGINT))) AS ni FROM a)
SELECT zone_id, CAST(ei AS INTEGER) AS ei, CAST(ni AS INTEGER) AS ni FROM b""", "fx_zone")
def tiles_by_source(zones):
    box = zones.select("zone_id", (F.col("e") - F.col("r")).alias("left"), (F.col("n") - F.col("r")).alias("bottom"), (F.col("e") + F.col("r")).alias("right"), (F.col("n") + F.col("r")).alias("top"))
    return spatial.tiles_by_source(box, 1024.0).select("zone_id", "ei", "ni")


@query("SELECT fix_id, round((1 - (e - floor(e / 1024) * 1024) / 1024) * 15, 6) AS col, round((n - floor(n / 1024) * 1024) / 1024 * 15, 6) AS r, 15 - CAST(fix_id % 16 AS INTEGER) AS flipped FROM fx_fix", "fx_fix")
def pixel_of(fix):
    c, r = grid.pixel_place(F.col("e"), F.col("n"), PX)
    return fix.select("fix_id", F.round(c, 6).alias("col"), F.round(r, 6).alias("r"), grid.flip_axes((F.col("fix_id") % 16).cast("int"), PX).alias("flipped"))
