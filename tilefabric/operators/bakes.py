"""Whole bakes, tile by tile: terrain, photos, roads, water, buildings, vegetation, and the two reports on what is missing.

Each one is a composition of this package's operators; tables of vertices and of
tiles come out, for a sink to write. Rasters are SE-origin pixel tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilefabric.functions import geodesy
from tilefabric.functions.grid import hash32, tile_of

from tilefabric.tables import dealt, grown

from . import audit, features, lines, raster, spatial

#: Metres that roads and water lie above the ground, distance of road vertices, tile of vector bakes, widths of water lines.
ROAD_OFFSET, WATER_OFFSET, DENSE, VECTOR_TILE = 0.4, 1.5, 10.0, 4096.0
WATER_WIDTHS = {"river": 12.0, "canal": 8.0}
PIXEL = raster.PIXEL
Project = Callable[[DataFrame], DataFrame]


def raster_catalog(px: DataFrame, to_target: dict[str, Project | None], override: str | None = None) -> DataFrame:
    """(path, crs, nodata, left, bottom, right, top) of rasters, from points or corners (path, crs, nodata, x, y) of theirs.

    Bounds are in the target system: ``to_target`` has for each system a function
    that adds te and tn to fe and fn, or None for the target's own. A raster
    without a system gets ``override``; without that, or with one that is not in
    ``to_target``, it is an error. No ``nodata`` is 0.
    """
    crs = F.coalesce(F.max("crs"), F.lit(override))
    b = px.groupBy("path").agg(crs.alias("crs"), F.coalesce(F.max("nodata"), F.lit(0.0)).alias("nodata"), F.min("x").alias("left"), F.min("y").alias("bottom"), F.max("x").alias("right"), F.max("y").alias("top"))
    wrong = F.raise_error(F.concat(F.col("path"), F.lit(": no known reference system"))).cast("string")
    b = b.withColumn("crs", F.when(F.coalesce(F.col("crs").isin(*to_target), F.lit(False)), F.col("crs")).otherwise(wrong))
    out = None
    for name, to in to_target.items():
        own = b.where(F.col("crs") == name)
        own = own if to is None else geodesy.transform_bbox(own, ["path", "crs", "nodata"], to)
        out = own if out is None else out.unionByName(own)
    return out


#: Cells a side of a tile's lattice, metres that a place between its nodes may be off.
CELLS, MOST_OFF = 8, 1e-3


def tile_lattices(tiles: DataFrame, to_source: Project, cells: int = CELLS, size: float = raster.TILE) -> DataFrame:
    """(ei, ni, nodes, off): each tile's lattice, its nodes (e, n in the source's system) row by row from the south-west, and how far a place between them may be off.

    ``off`` is that of the lattice of every second node, at which the nodes between
    are known exactly: the worst one along rows plus the worst one along columns.
    The lattice itself is nearer by about four. The middles of cells would tell
    nothing: of a conformal projection the errors along rows and columns cancel
    there. ``off`` is infinite where a node has no place.
    """
    side, step = cells + 1, size / cells
    at = F.sequence(F.lit(0), F.lit(cells))
    nodes = dealt(tiles.select("ei", "ni").distinct(), "ni", "ei").withColumn("node_row", F.explode(at)).withColumn("node_col", F.explode(at))
    # (In another order than the distinct's own, or Spark takes the dealing for superfluous.)
    nodes = to_source(nodes.withColumns({"e": F.col("ei") * size + F.col("node_col") * step, "n": F.col("ni") * size + F.col("node_row") * step}))
    place = F.struct((F.col("node_row") * side + F.col("node_col")).alias("i"), F.col("se").alias("e"), F.col("sn").alias("n"))
    t = nodes.groupBy("ei", "ni").agg(F.transform(F.sort_array(F.collect_list(place)), lambda p: F.struct(p["e"].alias("e"), p["n"].alias("n"))).alias("nodes"))
    node = lambda i: F.get("nodes", i)

    def worst(stride: int, between: Callable[[Column], Column]) -> Column:
        def one(i: Column) -> Column:
            e, n = (node(i)[c] - (node(i - stride)[c] + node(i + stride)[c]) / 2 for c in "en")
            off = F.hypot(e, n)
            return F.when(between(i), F.coalesce(F.when(F.isnan(off), None).otherwise(off), F.lit(float("inf"))))

        return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), one))

    along = worst(1, lambda i: i % side % 2 == 1)
    across = worst(side, lambda i: F.floor(i / side) % 2 == 1)
    return t.withColumn("off", along + across)


def destination_pixels(tiles: DataFrame, px: int, to_source: Project, cells: int = CELLS, most_off: float = MOST_OFF) -> DataFrame:
    """The pixel centres of tiles as points (_ei, _ni, prow, pcol) with e, n in the source's system, which ``to_source`` adds as se and sn.

    Places come from each tile's lattice, bilinear between its nodes; the pixels of
    tiles where those may be off by more than ``most_off`` are projected one by one.
    ``cells`` is even; a tile that is listed twice counts once.
    """
    t = tile_lattices(tiles, to_source, cells)
    k = F.sequence(F.lit(0), F.lit(px - 1))
    near = F.col("off") <= most_off

    def share(x: Column) -> tuple[Column, Column]:
        """The cell, and the share of the way through it."""
        cell = F.least(F.floor(x), F.lit(cells - 1)).cast("int")
        return cell, x - cell

    def mix(a: Column, b: Column, f: Column) -> Column:
        return F.struct(*((a[c] + (b[c] - a[c]) * f).alias(c) for c in "en"))

    rows = t.where(near).select("ei", "ni", "nodes", F.explode(k).alias("prow"))
    low, f = share((F.col("prow") + 0.5) * (cells / px))
    between = F.transform(F.sequence(F.lit(0), F.lit(cells)), lambda c: mix(F.get("nodes", low * (cells + 1) + c), F.get("nodes", (low + 1) * (cells + 1) + c), f))
    p = rows.select("ei", "ni", "prow", between.alias("line")).withColumn("pcol", F.explode(k))
    low, f = share((px - F.col("pcol") - 0.5) * (cells / px))  # column 0 is at the east edge
    place = mix(F.get("line", low), F.get("line", low + 1), f)
    p = p.select("ei", "ni", "prow", "pcol", place.alias("at")).select("ei", "ni", "prow", "pcol", F.col("at.e").alias("se"), F.col("at.n").alias("sn"))
    far = t.where(~near).select("ei", "ni", F.explode(k).alias("prow")).withColumn("pcol", F.explode(k))
    p = p.unionByName(to_source(raster.pixel_centres(far, px)).select(*p.columns))
    return p.select(F.col("ei").alias("_ei"), F.col("ni").alias("_ni"), "prow", "pcol", F.col("se").alias("e"), F.col("sn").alias("n"))


DEST = ["_ei", "_ni", "prow", "pcol"]


def good_tiles(found: DataFrame, px: int, least: float) -> DataFrame:
    """Every pixel (ei, ni, prow, pcol, h) of the tiles with a value on at least ``least`` of them; h is null elsewhere.

    The pixels found become one array a tile and are taken out again with the gaps,
    so no table of pixels is joined.
    """
    tiles = raster.packed(found, px).where(F.size(F.filter("tile", Column.isNotNull)) >= least * px * px)
    at = tiles.select(*raster.TILE_KEY, F.posexplode("tile").alias("_i", "h"))
    return at.select(*raster.TILE_KEY, F.floor(F.col("_i") / px).cast("int").alias("prow"), (F.col("_i") % px).alias("pcol"), "h")


def render_height_tiles(source: DataFrame, tiles: DataFrame, to_source: Project, px: int, source_px: int, least: float = 0.5, max_dist: int = 100) -> DataFrame:
    """Height tiles (ei, ni, prow, pcol, h) from rasters ``source`` (source, ei, ni, prow, pcol, h) in another system.

    Each pixel takes the first source that has data at all four of its
    neighbours. Tiles with data on less than ``least`` of their pixels are left
    out; gaps of others are filled from up to ``max_dist`` pixels away, what is
    left is 0.
    """
    p, read = raster.placed(destination_pixels(tiles, px, to_source), px=source_px, mode="bilinear", size=raster.TILE)
    stock = raster.packed(source.withColumn("h", raster.valid(F.col("h"))), source_px, ("source", "ei", "ni"))
    found = grown(p).join(stock, raster.TILE_KEY).select(*DEST, "source", read("tile").alias("h")).where("h is not null")
    found = dealt(found.withColumnsRenamed({"_ei": "ei", "_ni": "ni"}), *raster.TILE_KEY).groupBy(*PIXEL).agg(F.min_by("h", "source").alias("h"))
    filled = raster.fill_gaps_idw(good_tiles(found, px, least).withColumn("h", F.coalesce("h", F.lit(0.0))), max_dist)
    return filled.select(*PIXEL, F.coalesce("h", F.lit(0.0)).alias("h"))


def render_rgb_tiles(source: DataFrame, tiles: DataFrame, to_source: Project, px: int, source_px: int, least: float = 0.5, max_dist: int = 8, levels=(1, 16, 64)) -> DataFrame:
    """Photo tiles (level, ei, ni, prow, pcol, r, g, b) from photos ``source`` (source, ei, ni, prow, pcol, r, g, b) in another system.

    A source covers a pixel by the share of its four neighbours there; the best
    covered one gives the colour (see ``mosaic_rgb``). Tiles covered on less than
    ``least`` of their pixels are left out, small holes are filled. ``levels``
    are the pyramid's box factors.
    """
    p, _ = raster.placed(destination_pixels(tiles, px, to_source), px=source_px, mode="bilinear", size=raster.TILE)
    coded = source.select("source", *PIXEL, ((F.col("r") * 256 + F.col("g")) * 256 + F.col("b")).alias("h"))
    seen = grown(p).join(raster.packed(coded, source_px, ("source", "ei", "ni")), raster.TILE_KEY)
    last, corners = F.lit(source_px - 1), [(c, r) for r in (0, 1) for c in (0, 1)]
    at = [F.get("tile", F.least(F.col("_r0") + r, last) * source_px + F.least(F.col("_c0") + c, last)) for c, r in corners]
    share = [(F.col("_fc") if c else 1 - F.col("_fc")) * (F.col("_fr") if r else 1 - F.col("_fr")) for c, r in corners]
    seen = seen.select(*DEST, "source", *(v.cast("long").alias(f"_v{k}") for k, v in enumerate(at)), *(w.alias(f"_w{k}") for k, w in enumerate(share)))
    zero = F.lit(0.0)
    dark = lambda shift: F.floor(sum((F.coalesce(F.col(f"_w{k}") * F.shiftright(f"_v{k}", shift).bitwiseAND(F.lit(255)), zero) for k in range(4)), zero) + 0.5).cast("int")
    cover = sum((F.when(F.col(f"_v{k}").isNotNull(), F.col(f"_w{k}")).otherwise(zero) for k in range(4)), zero)
    seen = seen.select(F.col("_ei").alias("ei"), F.col("_ni").alias("ni"), "prow", "pcol", "source", dark(16).alias("r"), dark(8).alias("g"), dark(0).alias("b"), F.floor(cover * 255 + 0.5).cast("int").alias("q"))
    best = raster.mosaic_rgb(dealt(seen, *raster.TILE_KEY))
    whole = good_tiles(best.select(*PIXEL, ((F.col("r") * 256 + F.col("g")) * 256 + F.col("b")).alias("h")), px, least)
    byte = lambda shift: F.shiftright(F.col("h").cast("long"), shift).bitwiseAND(F.lit(255)).cast("int")
    whole = whole.select(*PIXEL, byte(16).alias("r"), byte(8).alias("g"), byte(0).alias("b"))
    whole = raster.fill_gaps_idw(whole, max_dist, ("r", "g", "b"), F.col("r").isNotNull())
    whole = whole.select(*PIXEL, *(F.coalesce(F.floor(F.col(c) + 0.5), F.lit(0)).cast("int").alias(c) for c in "rgb"))
    out = None
    for level in levels:
        mip = whole if level == 1 else raster.mip_pyramid(whole, level, ("r", "g", "b")).withColumns({c: F.floor(F.col(c) + 0.5).cast("int") for c in "rgb"})
        mip = mip.select(F.lit(level).alias("level"), *PIXEL, "r", "g", "b")
        out = mip if out is None else out.unionByName(mip)
    return out


#: Size of a grid cell where places are in degrees.
DEGREES = 0.02


def projected_lines(vertices: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """Lines (line_id, seq, e, n ..) from vertices (line_id, seq, lat, lon ..), those whose middle vertex is outside the boundary left out.

    The boundary is rings (poly_id, ring_no, seq, lon, lat). ``seq`` is dense afterwards.
    """
    own = Window.partitionBy("line_id").orderBy("seq")
    v = vertices.withColumn("seq", (F.row_number().over(own) - 1).cast("int"))
    if boundary is not None:
        middle = lines.middle_vertex(v).select("line_id", F.col("lon").alias("e"), F.col("lat").alias("n"))
        rings = boundary.select("poly_id", "ring_no", "seq", F.col("lon").alias("e"), F.col("lat").alias("n"))
        v = v.join(spatial.in_any_polygon(middle, rings, ["line_id"], DEGREES), "line_id", "left_semi")
    return geodesy.settled(geodesy.wgs84_to_lv95(v), "e", "n").drop("lat", "lon")


def strips(pieces: DataFrame, info: DataFrame) -> DataFrame:
    """Ribbons along ``pieces`` (see ``tile_pieces``): their vertices with both sides (left_e, left_n, right_e, right_n); ``info`` has width (and more) for each line.

    Heights play no part, so nothing moves but lines.
    """
    rest = [c for c in info.columns if c not in ("line_id", "width")]
    return lines.ribbon(pieces.join(info, "line_id"), F.col("width") * 0.5, line=["line_id", "piece"], keep=("ei", "ni", "e", "n", *rest))


def both_sides(strips: DataFrame) -> DataFrame:
    """A row (side, e, n) for each side of a ribbon's vertices; e, n of the middle go."""
    side = lambda k: F.struct(F.lit(k).alias("side"), F.col(f"{k}_e").alias("e"), F.col(f"{k}_n").alias("n"))
    rest = [c for c in strips.columns if c not in ("e", "n", "left_e", "left_n", "right_e", "right_n")]
    return strips.withColumn("p", F.explode(F.array(side("left"), side("right")))).select(*rest, "p.side", "p.e", "p.n")


def raised(strips: DataFrame, height: DataFrame, px: int, offset: float) -> DataFrame:
    """Vertices of ribbons: (line_id, piece, seq, side, ei, ni, e, n, y ..): the ground's height at the middle, 0 where unknown, plus ``offset``."""
    own = strips.withColumnsRenamed({"ei": "_ei", "ni": "_ni"})
    v = raster.sample_height(own, height, own.columns, px).withColumnsRenamed({"_ei": "ei", "_ni": "ni"})
    return both_sides(v.withColumn("y", F.coalesce("h", F.lit(0.0)) + offset).drop("h"))


def manifest(vertices: DataFrame, counts: DataFrame, prefix: str, size: float) -> DataFrame:
    """One row a tile: file, corner, rounded centre of its vertices, their number, and the ``counts`` (ei, ni ..), 0 where missing."""
    m = vertices.groupBy("ei", "ni").agg(F.round(F.avg("e")).cast("long").alias("center_e"), F.round(F.avg("n")).cast("long").alias("center_n"), F.count("*").alias("vertices"))
    corner = {"tile_e": (F.col("ei") * size).cast("long"), "tile_n": (F.col("ni") * size).cast("long")}
    m = m.withColumns(corner).withColumn("file", F.format_string(f"{prefix}_%d_%d.glb", "tile_e", "tile_n"))
    more = [c for c in counts.columns if c not in ("ei", "ni")]
    m = m.join(counts, ["ei", "ni"], "left")
    return m.select("ei", "ni", "file", "tile_e", "tile_n", "center_e", "center_n", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in more), "vertices")


def road_tiles(roads: DataFrame, height: DataFrame, px: int, most: float = DENSE, size: float = VECTOR_TILE, offset: float = ROAD_OFFSET) -> tuple[DataFrame, DataFrame]:
    """Road and rail ribbons by tile from lines (line_id, cls, seq, e, n): their vertices, and the manifest, which needs no heights."""
    v = dealt(lines.classify_roads(roads), "line_id")
    info = v.select("line_id", "cls", "width", "red", "green", "blue").distinct()
    d = lines.densify(v.select("line_id", "seq", "e", "n"), most)
    d = d.withColumn("seq", F.row_number().over(Window.partitionBy("line_id").orderBy("seq", "part")) - 1).drop("part")
    pieces = lines.tile_pieces(d, size)
    ribbons = strips(pieces, info)
    segments = pieces.groupBy("ei", "ni").agg((F.count("*") - F.countDistinct("line_id", "piece")).alias("segments"))
    return raised(ribbons, height, px, offset), manifest(both_sides(ribbons), segments, "roads", size)


def water_tiles(streams: DataFrame, rings: DataFrame, height: DataFrame, px: int, size: float = VECTOR_TILE, offset: float = WATER_OFFSET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Water by tile from lines (line_id, cls, seq, e, n) and polygons (poly_id, ring_no, seq, e, n).

    Gives the polygons' clipped rings with their flat ``level`` in the tile, the
    lines' ribbon vertices, and the manifest. Lines of other classes are dropped.
    """
    width = F.create_map(*(F.lit(x) for kv in WATER_WIDTHS.items() for x in kv))[F.col("cls")]
    known = streams.where(F.col("cls").isin(*WATER_WIDTHS))
    info = known.select("line_id", "cls", width.alias("width")).distinct()
    pieces = lines.tile_pieces(known.select("line_id", "seq", "e", "n"), size)
    flat = strips(pieces, info)
    ribbons = raised(flat, height, px, offset)
    cut = spatial.clip_polygons_to_tiles(rings, size).withColumnsRenamed({"ei": "te", "ni": "tn"})
    key = ["poly_id", "te", "tn"]
    shore = cut.where("ring_no = 0").select(*key, "seq", "e", "n")
    ground = raster.sample_height(shore, height, [*key, "seq"], px)
    level = ground.groupBy(*key).agg((F.coalesce(F.avg("h"), F.lit(0.0)) + offset).alias("level"))
    lakes = cut.join(level, key).withColumnsRenamed({"te": "ei", "tn": "ni"})
    vertices = both_sides(flat).select("ei", "ni", "e", "n").unionByName(lakes.select("ei", "ni", "e", "n"))
    counts = audit.union_inventory(pieces.select("ei", "ni"), lakes.select("ei", "ni"))
    counts = counts.join(pieces.groupBy("ei", "ni").agg(F.countDistinct("line_id", "piece").alias("streams")), ["ei", "ni"], "left").join(lakes.groupBy("ei", "ni").agg(F.countDistinct("poly_id").alias("polygons")), ["ei", "ni"], "left")
    return lakes, ribbons, manifest(vertices, counts, "water", size)


#: Metres from the origin at which a tile's index still is an int.
BEYOND = 1e12


def building_tiles(faces: DataFrame, height: DataFrame, px: int, size: float = raster.TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Buildings by tile from faces (building_id, surface, face, ring_no, seq, x, y, z) in UTM 32.

    Ground faces are left out, buildings of no other face too, and tiny ones. The
    others stand on the ground at their mean corner. Gives the seated faces'
    normals and parts, the buildings with their boxes, and the counts of tiles.

    Corners so far away that the projection gives no number for them have no place;
    buildings without any are counted in a row of stats without a tile.
    """
    f = geodesy.utm32_to_lv95(faces.withColumnsRenamed({"x": "ue", "y": "un"}), "ue", "un", "x", "y").drop("ue", "un")
    f = geodesy.settled(f, "x", "y")
    there = (F.abs("x") < BEYOND) & (F.abs("y") < BEYOND)  # false for NaN
    f = f.withColumns({c: F.when(there, F.col(c)) for c in "xy"})
    f = dealt(f.withColumn("building_id", features.clean_uuid(F.col("building_id"), F.lit(""))), "building_id")
    body = f.where("surface <> 'ground'")
    boxes = features.drop_tiny(features.building_box(body))
    centre = body.groupBy("building_id").agg(F.avg("x").alias("e"), F.avg("y").alias("n"))
    ground = raster.sample_height(centre, height, ["building_id"], px, "zero_aware")
    boxes = features.seat_buildings(boxes, ground).withColumn("_lift", F.col("seated_z") - F.col("min_z"))
    seated = grown(body).join(boxes.select("building_id", "_lift"), "building_id").withColumn("z", F.col("z") + F.col("_lift")).drop("_lift")
    sides = features.oriented_faces(seated.where("ring_no = 0"))
    tile = [tile_of(F.col(a), size).alias(t) for a, t in (("e", "ei"), ("n", "ni"))]
    boxes = boxes.join(grown(centre), "building_id").select("building_id", *tile, "e", "n", "min_x", "min_y", "max_x", "max_y", F.col("seated_z").alias("min_z"), (F.col("max_z") + F.col("_lift")).alias("max_z"), "height", "footprint", "shifted")
    stats = features.building_stats(f, size).withColumn("tile_id", F.when(F.col("ei").isNotNull(), F.format_string("%d_%d", (F.col("ei") * size).cast("long"), (F.col("ni") * size).cast("long"))))
    middle = boxes.groupBy("ei", "ni").agg(F.avg("e").cast("long").alias("center_e"), F.avg("n").cast("long").alias("center_n"), F.count_if("shifted").alias("shifted"), F.count_if(~F.col("shifted")).alias("no_ground"))
    return sides, boxes, stats.join(middle, ["ei", "ni"], "left")


def _normal(a: Column, b: Column, mean: float, sd: float, low: float, high: float) -> Column:
    """A clipped normal draw from two uint32 hashes."""
    u, v = (a + 1) / float((1 << 32) + 1), b / float(1 << 32)
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
    return F.least(F.lit(high), F.greatest(F.lit(low), mean + sd * z))


def extract_vegetation(rings: DataFrame, isolated: DataFrame, height: DataFrame, px: int, spacing: float = 8.0, size: float = raster.TILE) -> DataFrame:
    """Trees (ei, ni, e, n, ground_z, height_m, yaw_rad, crown_radius_m) of forest polygons and single trees.

    ``rings`` are (poly_id, objektart, ring_no, seq, e, n), ``isolated`` (e, n).
    Forest trees are at least ``spacing`` apart; heights are drawn by the hash of
    the place, 22 +- 4 metres in forests and 14 +- 3 for single trees, clipped.
    Trees without ground go.
    """
    forest = features.filter_landuse(rings)
    box = forest.where("ring_no = 0").groupBy("poly_id").agg(F.min("e").alias("x0"), F.min("n").alias("y0"), F.max("e").alias("x1"), F.max("n").alias("y1"), F.lit(1 / spacing**2).alias("density"))
    t = features.tree_grid(box).withColumnRenamed("poly_id", "own")
    t = spatial.points_in_polygons(t, forest, ["own", "i", "j", "hash", "e", "n"], own="own").drop("own")
    t = spatial.maximal_spacing(t, spacing, ["hash", "i", "j"]).select("e", "n")
    all_trees = audit.union_points(t, isolated.select("e", "n"))
    a = hash32(F.floor(F.col("e") * 100), F.floor(F.col("n") * 100))
    all_trees = all_trees.withColumn("_a", a).withColumn("_b", hash32(F.col("_a"), F.lit(77)))
    draw = F.when(F.col("part") == 0, _normal(F.col("_a"), F.col("_b"), 22.0, 4.0, 4.0, 45.0)).otherwise(_normal(F.col("_a"), F.col("_b"), 14.0, 3.0, 4.0, 35.0))
    all_trees = all_trees.select("part", "e", "n", draw.alias("height_m"), (hash32(F.col("_b"), F.lit(78)) / float(1 << 32) * 2 * F.pi()).alias("yaw_rad"))
    ground = raster.sample_height(all_trees, height, ["part", "e", "n", "height_m", "yaw_rad"], px, "nearest", size).where("h is not null")
    tile = [tile_of(F.col(a), size).alias(t) for a, t in (("e", "ei"), ("n", "ni"))]
    return ground.select(*tile, "e", "n", F.col("h").alias("ground_z"), "height_m", "yaw_rad", features.crown_radius(F.col("height_m")).alias("crown_radius_m"))


def covered_cells(tiles: DataFrame, to_source: Project, from_source: Project) -> DataFrame:
    """Source cells (e_km, n_km) all of whose tiles are there."""
    cells = audit.tiles_to_cells(tiles, to_source).select("e_km", "n_km").distinct()
    return audit.complete_groups(audit.cells_to_tiles(cells, from_source), tiles, ["ei", "ni"], ["e_km", "n_km"])


def coverage_report(bounds: DataFrame, probes: DataFrame, tiles: DataFrame, reference: DataFrame, to_source: Project, from_source: Project) -> tuple[DataFrame, DataFrame]:
    """Missing cells (e_km, n_km) in ``bounds`` (km), and their number by column.

    A cell is wanted if its last probe found it or a reference product has it,
    and there if all its tiles are.
    """
    cells = audit.lattice_cells(bounds)
    have = covered_cells(tiles, to_source, from_source)
    published = audit.last_status(probes).where("status = 200").select("e_km", "n_km")
    missing = audit.audit(cells, have, published, reference.select("e_km", "n_km"))
    return missing, missing.groupBy("e_km").agg(F.count("*").alias("missing"))


def gap_report(tiles: DataFrame, px: DataFrame | None, to_source: Project, least: float = 0.5, shrink: int = 0, lattice: int = 9) -> tuple[DataFrame, DataFrame]:
    """The source cells of missing tiles, and of those with data on less than ``least`` of their pixels; and the box (km) around the cells."""
    gaps = audit.missing_tiles(tiles, shrink=shrink)
    if px is not None:
        gaps = audit.union_inventory(gaps, raster.valid_fraction(px).where(F.col("fraction") < least).select("ei", "ni"))
    cells = audit.tiles_to_cells(gaps, to_source, lattice).select("e_km", "n_km").distinct()
    box = cells.agg(F.min("e_km").alias("e0"), F.min("n_km").alias("n0"), (F.max("e_km") + 2).alias("e1"), (F.max("n_km") + 2).alias("n1"))
    return cells, box
