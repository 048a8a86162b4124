"""Spatial joins: everything goes through ``cell_join``, an equi-join on grid cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilefabric.operators.audit import numbered
from tilefabric.operators.quadtree import CELL, KEY, LOAD, SMALL, counted, quadtree
from tilefabric.tables import dealt, grown, written


def in_cells(points: DataFrame, cell: float, at=("e", "n")) -> DataFrame:
    """Points with their grid cell as ``_cx`` and ``_cy``."""
    return points.withColumns({k: F.floor(F.col(c) / cell).cast("long") for k, c in zip(CELL, at, strict=True)})


def cell_join(points: DataFrame, boxes: DataFrame, cell: float, box=("x0", "y0", "x1", "y1"), at=("e", "n"), load: int = LOAD) -> DataFrame:
    """Pairs of points and boxes (inclusive) that hold them.

    Boxes are exploded to the cells they touch and joined with the points' cell,
    so there is no nested loop and each pair comes once. Choose ``cell`` near the
    size of the common boxes; cells of more than ``load`` points are cut into the
    leaves of a quadtree.
    """
    c = lambda x: F.floor(F.col(x) / cell).cast("long")
    b = boxes.withColumn("_cx", F.explode(F.sequence(c(box[0]), c(box[2])))).withColumn("_cy", F.explode(F.sequence(c(box[1]), c(box[3]))))
    p = in_cells(points, cell, at)
    tree = quadtree(p, cell, at, load)
    key = CELL if tree.quarters is None else KEY  # a constant in the key of whole cells would cost a second shuffle
    pairs = dealt(tree.key_points(p, at), *key).join(grown(dealt(tree.key_shapes(b, box), *key)), key)
    return pairs.where(F.col(at[0]).between(F.col(box[0]), F.col(box[2])) & F.col(at[1]).between(F.col(box[1]), F.col(box[3]))).drop(*KEY)


def ring_edges(rings: DataFrame) -> DataFrame:
    """(poly_id, ring_no, seq, e, n, e0, n0): each vertex with the one before it, circular."""
    w = Window.partitionBy("poly_id", "ring_no").orderBy("seq")
    last = Window.partitionBy("poly_id", "ring_no").orderBy(F.desc("seq"))
    before = lambda x: F.coalesce(F.lag(x).over(w), F.first(x).over(last))
    return rings.withColumns({"e0": before("e"), "n0": before("n")})


#: Where in a cell its anchor is: a fraction that no coordinate hits.
ANCHOR = 0.41421356237309515


def _cells_inside(edges: DataFrame, cell: float) -> DataFrame:
    """(poly_id, _cx, _cy) of the cells whose anchor is inside: where a row of anchors crosses the rings, by pairs of crossings."""
    row = lambda f: F.floor(f("n", "n0") / cell - ANCHOR).cast("long")
    s = edges.withColumn("_cy", F.explode(F.sequence(row(F.least), row(F.greatest) + 1))).withColumn("_an", (F.col("_cy") + ANCHOR) * cell)
    s = s.where("(n > _an) <> (n0 > _an)").withColumn("_x", (F.col("e0") - F.col("e")) * (F.col("_an") - F.col("n")) / (F.col("n0") - F.col("n")) + F.col("e"))
    w = Window.partitionBy("poly_id", "_cy").orderBy("_x")
    s = s.select("poly_id", "_cy", "_x", F.row_number().over(w).alias("_k"), F.lead("_x").over(w).alias("_to")).where("_k % 2 = 1")
    first, after = (F.ceil(F.col(c) / cell - ANCHOR).cast("long") for c in ("_x", "_to"))
    s = s.select("poly_id", "_cy", first.alias("_a"), after.alias("_b")).where("_a < _b")
    return s.select("poly_id", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("_cx"), "_cy")


def _edges_by_cell(edges: DataFrame, cell: float, slack: float = 1e-6) -> DataFrame:
    """Each edge once for each cell that it touches (or nearly so)."""
    at = lambda x: F.floor(x / cell).cast("long")
    low, high = F.least("e", "e0"), F.greatest("e", "e0")
    s = edges.withColumn("_cx", F.explode(F.sequence(at(low - slack), at(high + slack))))
    n_at = lambda x: F.when(F.col("e") == F.col("e0"), None).otherwise(F.col("n") + (F.least(F.greatest(x, low), high) - F.col("e")) * (F.col("n0") - F.col("n")) / (F.col("e0") - F.col("e")))
    s = s.withColumns({"_p": F.coalesce(n_at(F.col("_cx") * cell - slack), "n"), "_q": F.coalesce(n_at((F.col("_cx") + 1) * cell + slack), "n0")})
    return s.withColumn("_cy", F.explode(F.sequence(at(F.least("_p", "_q") - slack), at(F.greatest("_p", "_q") + slack)))).drop("_p", "_q")


def polygon_cells(rings: DataFrame, cell: float) -> DataFrame:
    """(poly_id, _cx, _cy, _e, _n, _e0, _n0): the cells whose anchor is inside a polygon, with no edge, and those an edge touches, with that edge.

    The edges are made once and written, as both lists come from them.
    """
    edges = written(ring_edges(rings).select("poly_id", "e", "n", "e0", "n0"))
    parts = _edges_by_cell(edges, cell).select("poly_id", *CELL, *(F.col(c).alias(f"_{c}") for c in ("e", "n", "e0", "n0")))
    return parts.unionByName(_cells_inside(edges, cell), allowMissingColumns=True)


#: Polygons with the same rings that go through a join as one row, at most about.
ALIKE = 1_000
#: Edges of a polygon in a cell whose test is an expression of its own.
WRITTEN_OUT = 6


def alike(rings: DataFrame) -> DataFrame:
    """(poly_id, _shape, _n): for each polygon the first one with exactly its rings, and how many have them."""
    ring = F.sort_array(F.collect_list(F.struct("ring_no", "seq", "e", "n")))
    p = written(rings.groupBy("poly_id").agg(F.sha2(ring.cast("string"), 256).alias("_digest")))
    first = p.groupBy("_digest").agg(F.min("poly_id").alias("_shape"), F.count("*").alias("_n"))
    return written(p.join(grown(first), "_digest").drop("_digest"))


def hit_shapes(points: DataFrame, rings: DataFrame, tags: DataFrame | None, keys: list[str], cell: float = 1024.0, load: int = LOAD, own: str | None = None) -> DataFrame:
    """(keys, the columns of ``tags`` but _shape): a row for each point inside a shape by the even-odd rule over all rings, and each row of ``tags`` (_shape ..) of it.

    A polygon, the one that its shape is named after, goes to grid cells: to those
    whose anchor is inside it, as one row, and to those its edges touch, with these
    edges as one array. A point is inside if its cell's anchor is, once for each
    edge between the two (along a path of a step north and a step east). So an edge
    is copied only to the cells along it, cells inside cost one row, however many
    edges the polygon has, and what a point hits is known where it is joined:
    neither pairs nor edges of pairs are shuffled or sorted. Cells of more than
    ``load`` points are cut into the leaves of a quadtree; an edge goes to those
    leaves that, together with the anchor, it may lie between.

    With ``own``, one of ``keys``, and without ``tags``, a point meets only the
    polygon that it names there.
    """
    p = in_cells(points.select(*keys, *(c for c in ("e", "n") if c not in keys)), cell)
    tree = quadtree(p, cell, load=load)
    if tags is not None:
        rings = rings.join(grown(tags.select(F.col("_shape").alias("poly_id")).distinct()), "poly_id", "left_semi")
    parts = polygon_cells(rings, cell)
    # A row without an edge concerns all of its cell.
    span = {f"_b{k}": F.coalesce(f(f"_{c}", f"_{c}0"), F.lit(v)) for k, (f, c, v) in enumerate(((F.least, "e", "-inf"), (F.least, "n", "-inf"), (F.greatest, "e", "inf"), (F.greatest, "n", "inf")))}
    parts = parts.withColumns({k: v.cast("double") for k, v in span.items()})
    parts = tree.key_shapes(parts, ("_b0", "_b1", "_b2", "_b3"), (ANCHOR, ANCHOR))
    edge = F.when(F.col("_e").isNotNull(), F.struct("_e", "_n", "_e0", "_n0"))
    within = [f(F.when(F.col("_e").isNotNull(), F.col(b))).alias(b) for b, f in zip(span, (F.min, F.min, F.max, F.max), strict=True)]
    parts = parts.groupBy(*KEY, F.col("poly_id").alias("_shape")).agg((F.count_if(F.col("_e").isNull()) % 2 == 1).alias("_in"), F.collect_list(edge).alias("_edges"), *within)
    parts = parts.withColumnRenamed("_shape", own) if tags is None else parts.join(grown(tags), "_shape").drop("_shape")
    e, n = F.col("e"), F.col("n")
    ae, an = ((F.col(c) + ANCHOR) * cell for c in ("_cx", "_cy"))

    def flips(x: Column) -> Column:
        east = (x["_n"] > n) != (x["_n0"] > n)
        at = (x["_e0"] - x["_e"]) * (n - x["_n"]) / F.when(east, x["_n0"] - x["_n"]) + x["_e"]
        east = east & ((e < at) != (ae < at))
        north = (x["_e"] > ae) != (x["_e0"] > ae)
        at = (x["_n0"] - x["_n"]) * (ae - x["_e"]) / F.when(north, x["_e0"] - x["_e"]) + x["_n"]
        north = north & ((an < at) != (n < at))
        return F.coalesce(east, F.lit(False)) != F.coalesce(north, F.lit(False))

    # Whether the box of the edges meets one of the two steps at all.
    slack = cell * 1e-9
    meets = lambda a, b, low, high: (F.least(a, b) <= F.col(high) + slack) & (F.greatest(a, b) >= F.col(low) - slack)
    near = meets(ae, e, "_b0", "_b2") & meets(n, n, "_b1", "_b3") | meets(ae, ae, "_b0", "_b2") & meets(an, n, "_b1", "_b3")
    # The first edges are written out, as Spark compiles these but not a function over an array; few cells have more.
    size = F.size("_edges")
    odd = F.when(size > WRITTEN_OUT, F.size(F.filter(F.slice("_edges", WRITTEN_OUT + 1, size - WRITTEN_OUT), flips)) % 2 == 1).otherwise(False)
    for k in range(WRITTEN_OUT):
        odd = odd != F.when(size > k, flips(F.get("_edges", F.lit(k)))).otherwise(False)
    odd = F.when(near, odd).otherwise(False)
    keyed = tree.key_points(p)
    if tree.quarters is None:  # a constant in the key of whole cells would cost a second shuffle
        keyed, parts = keyed.drop("_leaf", "_part"), parts.drop("_leaf", "_part")
    key = [*(CELL if tree.quarters is None else KEY), *([own] if own else [])]
    hit = dealt(keyed, *key).join(grown(dealt(parts, *key)), key).where(F.col("_in") != odd)
    return hit.select(*keys, *(c for c in (tags.columns if tags is not None else ()) if c != "_shape"))


def once_and_again(points: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Points whose ``keys`` no other one has, and the others, None where there are none."""
    again = written(points.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*(F.col(k).alias(f"_{k}") for k in keys)))
    if again.isEmpty():
        return points, None
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return points.join(counted(again), same, "left_anti"), points.join(counted(again), same, "left_semi")


def points_in_polygons(points: DataFrame, rings: DataFrame, keys: list[str], cell: float = 1024.0, load: int = LOAD, own: str | None = None) -> DataFrame:
    """(keys, poly_id) of points inside by the even-odd rule over all rings, so holes are outside.

    Polygons with the same rings are tested as one (``hit_shapes``) and listed
    after that. Points with the same keys count as one, which is inside where an odd
    number of them are. With ``own`` points (all with other keys) meet only the
    polygon that this key names.
    """
    if own:
        return hit_shapes(points, rings, None, keys, cell, load, own).withColumn("poly_id", F.col(own))
    shapes = alike(rings)
    part = F.pmod(F.xxhash64("poly_id"), F.ceil(F.col("_n") / ALIKE))
    tags = written(shapes.groupBy("_shape", part.alias("_block")).agg(F.collect_list("poly_id").alias("_members")).drop("_block"))
    inside = lambda some: hit_shapes(some, rings, tags, keys, cell, load).select(*keys, F.explode("_members").alias("poly_id"))
    once, again = once_and_again(points, keys)
    if again is None:
        return inside(once)
    odd = inside(again).groupBy(*keys, "poly_id").agg(F.count("*").alias("_f")).where("_f % 2 = 1").drop("_f")
    return inside(once).unionByName(odd)


def in_any_polygon(points: DataFrame, rings: DataFrame, keys: list[str], cell: float = 1024.0) -> DataFrame:
    """The ``keys``, all different, of points inside at least one polygon; polygons with the same rings count once."""
    shapes = alike(rings).select("_shape").distinct()
    return hit_shapes(points, rings, shapes, keys, cell).distinct()


def landcover_rank(kind: Column) -> Column:
    """Paint order of land-cover kinds; null for kind 3, which is not painted."""
    order = {12: 0, 5: 1, 6: 2, 7: 3, 8: 4, 9: 5, 10: 6, 11: 7, 0: 8, 1: 8, 2: 8, 4: 9}
    out = F.lit(None).cast("int")
    for k, rank in order.items():
        out = F.when(kind == k, rank).otherwise(out)
    return out


def rasterise_classes(px: DataFrame, rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind) of pixel centres (e, n) in a polygon; the highest rank wins, then the later polygon.

    Polygons are numbered in this order, so a pixel keeps one number, and of those
    with the same rings only the last is met.
    """
    kinds = rings.select("poly_id", "kind").distinct().withColumn("_rank", landcover_rank(F.col("kind"))).where("_rank is not null")
    kinds = written(numbered(kinds, ["_rank", "poly_id"], "_place"))
    last = alike(rings).join(grown(kinds), "poly_id").groupBy("_shape").agg(F.max("_place").alias("_place"))
    once, again = once_and_again(px, keys)
    top = hit_shapes(once, rings, written(last), keys).groupBy(*keys).agg(F.max("_place").alias("_place"))
    if again is not None:
        of = points_in_polygons(again, rings, keys).join(grown(kinds), "poly_id")
        top = top.unionByName(of.groupBy(*keys).agg(F.max("_place").alias("_place")))
    return top.join(kinds.select("_place", "kind"), "_place").select(*keys, "kind")


def exclude_in_zones(features: DataFrame, zones: DataFrame, keys: list[str], rings: DataFrame | None = None, cell: float = 512.0) -> DataFrame:
    """Drops features (e, n, priority; told apart by ``keys``) in a zone (zone_id) whose ``min_dir`` is at most their priority.

    A zone is a circle (e, n, r) or has ``rings`` (poly_id, the zone_id; ring_no,
    seq, e, n), or both.
    """
    c = zones.where("r is not null")
    boxes = c.select(F.col("e").alias("ze"), F.col("n").alias("zn"), "r", "min_dir", (F.col("e") - F.col("r")).alias("x0"), (F.col("n") - F.col("r")).alias("y0"), (F.col("e") + F.col("r")).alias("x1"), (F.col("n") + F.col("r")).alias("y1"))
    at = features.select(*keys, "priority", *(c for c in ("e", "n") if c not in keys))
    hit = cell_join(at, boxes, cell).where("priority >= min_dir and (e - ze) * (e - ze) + (n - zn) * (n - zn) <= r * r").select(*keys)
    if rings is not None:
        low = zones.select(F.col("zone_id").alias("poly_id"), "min_dir")
        hit = hit.union(points_in_polygons(at, rings, [*keys, "priority"]).join(low, "poly_id").where("priority >= min_dir").select(*keys))
    return features.join(hit.distinct(), keys, "left_anti")


def segment_distance(e: Column, n: Column, e0: Column, n0: Column, e1: Column, n1: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = e1 - e0, n1 - n0
    t = F.coalesce(((e - e0) * dx + (n - n0) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.sqrt(F.pow(e - (e0 + t * dx), F.lit(2)) + F.pow(n - (n0 + t * dy), F.lit(2)))


def segment_cells(segments: DataFrame, reach: Column, cell: float, slack: float = 1e-6) -> DataFrame:
    """Each segment (e0, n0, e1, n1) once for each cell that comes within ``reach`` of it (or nearly so), with the box (x0, y0, x1, y1) of what is near in that column of cells."""
    at = lambda x: F.floor(x / cell).cast("long")
    low, high, wide = F.least("e0", "e1"), F.greatest("e0", "e1"), reach + slack
    s = segments.withColumns({"x0": low - wide, "x1": high + wide}).withColumn("_cx", F.explode(F.sequence(at(F.col("x0")), at(F.col("x1")))))
    n_at = lambda x: F.when(F.col("e0") == F.col("e1"), None).otherwise(F.col("n0") + (F.least(F.greatest(x, low), high) - F.col("e0")) * (F.col("n1") - F.col("n0")) / (F.col("e1") - F.col("e0")))
    p, q = F.coalesce(n_at(F.col("_cx") * cell - wide), "n0"), F.coalesce(n_at((F.col("_cx") + 1) * cell + wide), "n1")
    s = s.withColumns({"y0": F.least(p, q) - wide, "y1": F.greatest(p, q) + wide})
    return s.withColumn("_cy", F.explode(F.sequence(at(F.col("y0")), at(F.col("y1")))))


def near_segments(points: DataFrame, segments: DataFrame, reach: Column, cell: float) -> DataFrame:
    """Pairs of points and segments, with their ``distance``, where it is below ``reach``.

    Segments beyond the points' extent are left out before they go to cells.
    """
    a, b, c, d = points.agg(F.min("e"), F.min("n"), F.max("e"), F.max("n")).first()
    over = lambda k, low, high: (F.least(f"{k}0", f"{k}1") - reach <= F.lit(high).cast("double")) & (F.greatest(f"{k}0", f"{k}1") + reach >= F.lit(low).cast("double"))
    box = ("x0", "y0", "x1", "y1")
    p, s = in_cells(points, cell), segment_cells(segments.where(over("e", a, c) & over("n", b, d)), reach, cell)
    tree = quadtree(p, cell)
    pairs = tree.key_points(p).join(tree.key_shapes(s, box), KEY).drop(*KEY, *box)
    distance = segment_distance(*(F.col(c) for c in ("e", "n", "e0", "n0", "e1", "n1")))
    return pairs.withColumn("distance", distance).where(F.col("distance") < reach)


def clear_corridors(points: DataFrame, segments: DataFrame, key: str, margin: float = 1.0, cell: float = 1024.0) -> DataFrame:
    """Drops points closer than half_width + margin to a segment (e0, n0, e1, n1, half_width)."""
    hit = near_segments(points, segments, F.col("half_width") + margin, cell).select(key).distinct()
    return points.join(hit, key, "left_anti")


def paint_corridors(px: DataFrame, segments: DataFrame, keys: list[str], least: float = 5.5, cell: float = 256.0, side: int = 64) -> DataFrame:
    """(keys) of pixel centres (e, n) within the half width of a corridor at least ``least`` wide to each side.

    Rasters of fewer than 64 pixels a ``side`` are too coarse to paint on: no rows.
    """
    if side < 64:
        return px.select(*keys).limit(0)
    return near_segments(px, segments.where(F.col("half_width") >= least), F.col("half_width"), cell).select(*keys).distinct()


def apply_patches(px: DataFrame, stations: DataFrame, plateaus: DataFrame, protected: DataFrame, keys: list[str], cell: float = 256.0) -> DataFrame:
    """(keys, h) of the pixels (e, n) that corridors or plateaus rewrite.

    A corridor (line_id, seq, e0, n0, h0, e1, n1, h1, reach, half_width) sets the
    height of its nearest segment, interpolated, below ``reach``; corridors are
    weighed by 1 / (max(0, distance - half_width) + 3)^2 and leave pixels inside
    ``protected`` rings alone. Plateaus (rings with a ``level``) overwrite; the
    last polygon wins.
    """
    de, dn = F.col("e1") - F.col("e0"), F.col("n1") - F.col("n0")
    t = F.coalesce(((F.col("e") - F.col("e0")) * de + (F.col("n") - F.col("n0")) * dn) / F.nullif(de * de + dn * dn, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    near = near_segments(px, stations, F.col("reach"), cell).withColumn("_h", F.col("h0") + t * (F.col("h1") - F.col("h0")))
    near = near.groupBy(*keys, "line_id").agg(F.min(F.struct("distance", "seq", "_h", "half_width")).alias("m"))
    w = 1 / F.pow(F.greatest(F.lit(0.0), F.col("m.distance") - F.col("m.half_width")) + 3, F.lit(2))
    laid = near.groupBy(*keys).agg((F.sum(w * F.col("m._h")) / F.sum(w)).alias("_laid"))
    # Both kinds of polygons are met in one pass over the pixels.
    kinds = [rings.select(F.struct(F.lit(k).alias("kind"), F.col("poly_id").alias("id")).alias("poly_id"), "ring_no", "seq", "e", "n") for k, rings in enumerate((protected, plateaus))]
    levels = plateaus.select(F.struct(F.lit(1).alias("kind"), F.col("poly_id").alias("id")).alias("poly_id"), "level").distinct()
    hit = points_in_polygons(px, kinds[0].unionByName(kinds[1]), keys).join(levels, "poly_id", "left")
    plateau = F.when(F.col("poly_id.kind") == 1, F.col("poly_id.id"))
    hit = hit.groupBy(*keys).agg(F.max(F.col("poly_id.kind") == 0).alias("_safe"), F.max_by("level", plateau).alias("_flat"))
    height = F.coalesce(F.col("_flat"), F.when(~F.coalesce("_safe", F.lit(False)), F.col("_laid")))
    return laid.join(hit, keys, "full").select(*keys, height.alias("h")).where("h is not null")


def clip_to_boundary(lines: DataFrame, middle: DataFrame, boundary: DataFrame) -> DataFrame:
    """Lines whose middle vertex (line_id, e, n) lies inside the boundary rings."""
    return lines.join(in_any_polygon(middle, boundary, ["line_id"]), "line_id", "left_semi")


def clip_polygons_to_boundary(rings: DataFrame, boundary: DataFrame, cell: float = 1024.0) -> DataFrame:
    """Polygons whose mean outer vertex (ring 0) lies inside the boundary rings."""
    mean = rings.where("ring_no = 0").groupBy(F.col("poly_id").alias("own")).agg(F.avg("e").alias("e"), F.avg("n").alias("n"))
    inside = in_any_polygon(mean, boundary, ["own"], cell).withColumnRenamed("own", "poly_id")
    return rings.join(inside, "poly_id", "left_semi")


def clip_polygons_to_tiles(rings: DataFrame, size: float) -> DataFrame:
    """Rings cut to each tile they reach: (poly_id, ring_no, ei, ni, seq, e, n).

    Each ring (one row, as long as one polygon) goes through the tile's four half
    planes inside Catalyst. A ring that keeps fewer than three points in a tile is
    dropped there; if it is the outer one (ring 0), so is the whole polygon.
    """
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "e", "n"))), lambda p: F.struct(p["e"].alias("e"), p["n"].alias("n")))
    r = rings.groupBy("poly_id", "ring_no").agg(ring.alias("ring"), *(f(c).alias(f"_{g}{c}") for c in "en" for g, f in (("a", F.min), ("b", F.max))))
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"_a{c}") / size).cast("int"), F.floor(F.col(f"_b{c}") / size).cast("int")))
    r = r.withColumn("ei", span("e")).withColumn("ni", span("n"))
    plane = lambda a, b, c: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.alias("c"))
    planes = F.array(plane(1.0, 0.0, F.col("ei") * -size), plane(-1.0, 0.0, (F.col("ei") + 1) * size), plane(0.0, 1.0, F.col("ni") * -size), plane(0.0, -1.0, (F.col("ni") + 1) * size))

    def cut(acc: Column, half: Column) -> Column:
        side = lambda p: half["a"] * p["e"] + half["b"] * p["n"] + half["c"]

        def corner(p: Column, i: Column) -> Column:
            before = F.get(acc, F.pmod(i - 1, F.size(acc)))
            now, then = side(p), side(before)
            t = then / F.nullif(then - now, F.lit(0.0))
            edge = F.struct(*((before[c] + t * (p[c] - before[c])).alias(c) for c in "en"))
            own, none = F.array(p), F.slice(acc, 1, 0)
            return F.when((now >= 0) & (then >= 0), own).when(now >= 0, F.array(edge, p)).when(then >= 0, F.array(edge)).otherwise(none)

        return F.flatten(F.transform(acc, corner))

    out = r.withColumn("ring", F.aggregate(planes, F.col("ring"), cut)).where("size(ring) >= 3")
    out = out.withColumn("_outer", F.min("ring_no").over(Window.partitionBy("poly_id", "ei", "ni"))).where("_outer = 0")
    return out.select("poly_id", "ring_no", "ei", "ni", F.posexplode("ring").alias("seq", "p")).select("poly_id", "ring_no", "ei", "ni", "seq", "p.e", "p.n")


def min_spacing(points: DataFrame, r: float, rank: list[str]) -> DataFrame:
    """Points (poly_id, e, n) without a point of the same polygon closer than ``r`` that ranks lower by ``rank``."""
    p = written(in_cells(points, r * BLOCK).withColumn("_rank", F.struct(*rank)))
    return without_close(p, p, r, lower=True).select(*points.columns)


#: Side of a cell in which close points are sought, in parts of their distance: a point goes to (1 + 2 / 4)^2 cells, not to nine.
BLOCK = 4


def near_cells(p: DataFrame, r: float) -> DataFrame:
    """Points once for each cell of ``BLOCK`` times ``r`` that comes within ``r`` of them (or nearly so)."""
    at = lambda c, by: F.floor((F.col(c) + by) / (r * BLOCK)).cast("long")
    slack = r * (1 + 1e-9)
    return p.withColumn("_cx", F.explode(F.sequence(at("e", -slack), at("e", slack)))).withColumn("_cy", F.explode(F.sequence(at("n", -slack), at("n", slack))))


def without_close(p: DataFrame, others: DataFrame, r: float, lower: bool = False) -> DataFrame:
    """Points without one of ``others`` of the same polygon closer than ``r`` (that ranks ``lower``); both in cells of ``BLOCK`` times ``r``."""
    own, other = ["poly_id", *CELL, "e", "n", "_rank"], ["_poly", "_x", "_y", "_e", "_n", "_other"]
    o = near_cells(others, r).select(*(F.col(a).alias(b) for a, b in zip(own, other, strict=True)))
    close = "poly_id = _poly and _cx = _x and _cy = _y and (e - _e) * (e - _e) + (n - _n) * (n - _n) < " + repr(r * r) + "D"
    return p.join(grown(o), F.expr(close + " and _other < _rank" * lower), "left_anti")


def maximal_spacing(points: DataFrame, r: float, rank: list[str]) -> DataFrame:
    """Points (poly_id, e, n) no two of which, in a polygon, are closer than ``r``, and to which none of the others could be added.

    They are the points that taking them one by one in the order of ``rank`` (all
    different) would keep. Each round takes the points without a lower neighbour
    among those that are left, and drops these points' neighbours; what is left is
    written. Ranks that are as good as random need a few rounds, about the
    logarithm of the number of points.
    """
    left, taken = written(in_cells(points, r * BLOCK).withColumn("_rank", F.struct(*rank))), []
    while not left.isEmpty():
        won = written(without_close(left, left, r, lower=True))
        taken.append(won)
        left = written(without_close(left, won, r))
    return reduce(DataFrame.unionByName, taken or [left]).select(*points.columns)


def tiles_in_radius(fixes: DataFrame, tiles: DataFrame, radius: float | Column, keys: list[str], most: float | None = None, fineness: int = 8, load: int = LOAD, few: int = SMALL) -> DataFrame:
    """Tiles whose centre (ce, cn) lies within ``radius`` of a fix, with the distance.

    The radius may be an expression over a tile's columns, of at most ``most``
    (say, wider for tiles with polygons). Fixes stand in cells of an eighth
    (``fineness``) of it; a tile goes to the cells that its circle reaches in the
    fixes' extent, and those wholly inside need no test. Up to ``few`` such rows are
    broadcast; more are dealt to tasks with the fixes, crowded cells cut as in
    ``cell_join``.
    """
    most = radius if most is None else most
    cell = most / fineness
    p = in_cells(fixes.select(*keys, *(c for c in ("e", "n") if c not in keys)), cell)
    a, b, c, d = p.agg(F.min("_cx"), F.max("_cx"), F.min("_cy"), F.max("_cy")).first()
    t = tiles.withColumn("_radius", radius if isinstance(radius, Column) else F.lit(radius))
    for at, k, first, last in (("ce", "_cx", a, b), ("cn", "_cy", c, d)):
        first, last = (F.lit(x).cast("long") for x in (first, last))  # null without fixes: no tile is left
        start, stop = (F.floor(x / cell).cast("long") for x in (F.col(at) - F.col("_radius"), F.col(at) + F.col("_radius")))
        t = t.where((start <= last) & (stop >= first)).withColumn(k, F.explode(F.sequence(F.greatest(start, first), F.least(stop, last))))
    # From a tile's centre to the nearest and to the farthest place of a cell.
    low, high = (lambda k: F.col(k) * cell), (lambda k: (F.col(k) + 1) * cell)
    near = lambda c, k: F.greatest(low(k) - F.col(c), F.col(c) - high(k), F.lit(0.0))
    far = lambda c, k: F.greatest(F.abs(F.col(c) - low(k)), F.abs(F.col(c) - high(k)))
    length = lambda f: F.sqrt(F.pow(f("ce", "_cx"), F.lit(2)) + F.pow(f("cn", "_cy"), F.lit(2)))
    slack = cell * 1e-9
    t = t.where(length(near) <= F.col("_radius") + slack).withColumn("_inside", length(far) <= F.col("_radius") - slack)
    t = written(t)
    if t.limit(few + 1).count() <= few:
        pairs = p.join(F.broadcast(t), CELL)
    else:
        tree = quadtree(p, cell, load=load)
        boxes = t.withColumns({"_b0": F.col("ce") - F.col("_radius"), "_b1": F.col("cn") - F.col("_radius"), "_b2": F.col("ce") + F.col("_radius"), "_b3": F.col("cn") + F.col("_radius")})
        key = CELL if tree.quarters is None else KEY  # a constant in the key of whole cells would cost a second shuffle
        shapes = tree.key_shapes(boxes, ("_b0", "_b1", "_b2", "_b3"))
        pairs = dealt(tree.key_points(p), *key).join(grown(dealt(shapes, *key)), key)
    d = F.sqrt(F.pow(F.col("ce") - F.col("e"), F.lit(2)) + F.pow(F.col("cn") - F.col("n"), F.lit(2)))
    return pairs.withColumn("distance", d).where("_inside or distance <= _radius").select(*keys, "ei", "ni", "distance")


#: Metres in which water tiles are wanted: those with polygons, and others.
WATER_RADIUS, STREAM_RADIUS = 50_000.0, 8_000.0


def water_tiles_in_radius(fixes: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Water tiles (ce, cn, polygons) wanted at a fix: lakes are seen from afar, streams are not."""
    radius = F.when(F.col("polygons") > 0, WATER_RADIUS).otherwise(STREAM_RADIUS)
    return tiles_in_radius(fixes, tiles, radius, keys, WATER_RADIUS)


def tiles_in_ring(fixes: DataFrame, radius: int, keys: list[str], lod) -> DataFrame:
    """All tiles within a Chebyshev radius of a fix's tile (ei, ni), with distance and level of detail."""
    d = F.sequence(F.lit(-radius), F.lit(radius))
    ring = fixes.withColumn("_de", F.explode(d)).withColumn("_dn", F.explode(d)).withColumn("distance", F.greatest(F.abs("_de"), F.abs("_dn")))
    return ring.select(*keys, (F.col("ei") + F.col("_de")).alias("ei"), (F.col("ni") + F.col("_dn")).alias("ni"), "distance", lod(F.col("distance")).alias("lod"))


def surface_height_at(points: DataFrame, tris: DataFrame, keys: list[str], tolerance: float, cell: float = 256.0) -> DataFrame:
    """The highest triangle (ax, ay, az .. cz; y is height) under each point (e, n, hint) within ``tolerance`` of its hint.

    Triangles wholly above or below all hints, or without area, go to no cell. A
    point's weights may be down to -1e-4, so a height may be a little beyond the corners.
    """
    least, most = points.agg(F.min("hint"), F.max("hint")).first()
    low, high = (lambda k: F.least(f"a{k}", f"b{k}", f"c{k}")), (lambda k: F.greatest(f"a{k}", f"b{k}", f"c{k}"))
    slack = (high("y") - low("y")) * 1e-3 + 1e-6
    tris = tris.where((low("y") - slack - tolerance <= F.lit(most).cast("double")) & (high("y") + slack + tolerance >= F.lit(least).cast("double")))
    tris = tris.where("abs((bx - ax) * (cz - az) - (cx - ax) * (bz - az)) >= 1e-3")
    near = cell_join(points, tris.withColumns({"x0": low("x"), "x1": high("x"), "y0": low("z"), "y1": high("z")}), cell)
    c = F.col
    near = near.withColumn("_area", (c("bx") - c("ax")) * (c("cz") - c("az")) - (c("cx") - c("ax")) * (c("bz") - c("az"))).where("abs(_area) >= 1e-3")
    near = near.withColumns({"_u": ((c("bx") - c("e")) * (c("cz") - c("n")) - (c("cx") - c("e")) * (c("bz") - c("n"))) / c("_area"), "_v": ((c("cx") - c("e")) * (c("az") - c("n")) - (c("ax") - c("e")) * (c("cz") - c("n"))) / c("_area")}).withColumn("_w", 1 - c("_u") - c("_v"))
    near = near.where("least(_u, _v, _w) >= -1e-4").withColumn("y", c("_u") * c("ay") + c("_v") * c("by") + c("_w") * c("cy"))
    return near.where(F.abs(c("y") - c("hint")) <= tolerance).groupBy(*keys).agg(F.max("y").alias("y"))


def tiles_by_source(sources: DataFrame, size: float) -> DataFrame:
    """Tiles that each source's half-open box (left, bottom, right, top) overlaps."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size).cast("int"), (F.ceil(F.col(b) / size) - 1).cast("int"))
    t = sources.where((F.col("right") > F.col("left")) & (F.col("top") > F.col("bottom")))
    return t.withColumn("ei", F.explode(span("left", "right"))).withColumn("ni", F.explode(span("bottom", "top")))
