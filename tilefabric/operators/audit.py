"""Inventories and coverage audits: which tiles and cells exist, are missing, are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilefabric.functions.grid import chebyshev, snap_cell, tile_of
from tilefabric.tables import written


def grid_tiles(bounds: DataFrame, names=("e0", "n0", "e1", "n1"), out=("ei", "ni"), step: int = 1) -> DataFrame:
    """All (ei, ni) of index ranges, both ends included; none of a range that ends before it begins."""
    bounds = bounds.where((F.col(names[0]) <= F.col(names[2])) & (F.col(names[1]) <= F.col(names[3])))
    g = bounds.select(F.explode(F.sequence(F.col(names[0]), F.col(names[2]), F.lit(step))).alias(out[0]), names[1], names[3])
    g = g.repartition(out[0])  # the bounds are one row: columns go to several tasks before they become cells
    return g.select(out[0], F.explode(F.sequence(F.col(names[1]), F.col(names[3]), F.lit(step))).alias(out[1]))


def extent(tiles: DataFrame) -> DataFrame:
    return tiles.agg(F.min("ei").alias("e0"), F.min("ni").alias("n0"), F.max("ei").alias("e1"), F.max("ni").alias("n1"))


def missing_tiles(present: DataFrame, bounds: DataFrame | None = None, shrink: int = 0) -> DataFrame:
    """Grid places inside ``bounds`` (e0, n0, e1, n1; else the tiles' own extent, ``shrink`` tiles less on each side) without a tile."""
    if bounds is None:
        bounds = extent(present).select((F.col("e0") + shrink).alias("e0"), (F.col("n0") + shrink).alias("n0"), (F.col("e1") - shrink).alias("e1"), (F.col("n1") - shrink).alias("n1"))
    return grid_tiles(bounds).join(present, ["ei", "ni"], "left_anti")


def last_status(probes: DataFrame) -> DataFrame:
    """The last definite status of each cell; 0 (unresolved) never counts. A tie in time goes to the larger status."""
    return probes.where("status <> 0").groupBy("e_km", "n_km").agg(F.max(F.struct("ts", "status")).alias("_m")).select("e_km", "n_km", F.col("_m.status").alias("status"))


def probe_summary(probes: DataFrame) -> DataFrame:
    cells = probes.select("e_km", "n_km").distinct().join(last_status(probes), ["e_km", "n_km"], "left")
    return cells.agg(F.count_if(F.col("status") == 200).alias("present"), F.count_if(F.col("status") == 404).alias("absent"), F.count_if(F.col("status").isNull()).alias("unresolved"))


def audit(cells: DataFrame, have: DataFrame, published: DataFrame | None, reference: DataFrame, converted: DataFrame | None = None) -> DataFrame:
    """(published or reference) within cells, less what is there; all (e_km, n_km).

    Without a probe (``published`` None) the cells that are there stand in for it.
    Where ``converted`` is given, a cell counts as there only once it is converted.
    """
    wanted = (have if published is None else published).distinct().union(reference.distinct())  # here and below, so that repeated cells become one before the sets are joined
    return wanted.intersect(cells.distinct()).subtract((have if converted is None else converted).distinct())


def complete_groups(tiles: DataFrame, present: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """Groups (cells, tiles, sources) all of whose members are present."""
    there = present.select(*key).distinct().withColumn("_there", F.lit(True))
    j = tiles.join(there, key, "left").groupBy(*group).agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("_all"))
    return j.where("_all").select(*group)


def priority_rank(tiles: DataFrame, key: list[str], priority: list, out: str = "rank") -> DataFrame:
    """1, 2, .. for the candidates of each key, in the order in which they are asked for it."""
    return tiles.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*priority)))


def suppress_duplicates(tiles: DataFrame, key: list[str], priority: list) -> DataFrame:
    """The first by priority keeps the id."""
    return priority_rank(tiles, key, priority, "_r").where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New entries override old ones with the same key."""
    return new.unionByName(old.join(new, key, "left_anti"))


def stand_down(filled: DataFrame, surveyed: DataFrame) -> DataFrame:
    """Fill tiles (source, ei, ni) that stay: no surveyed tile there, and no earlier source filled it."""
    return suppress_duplicates(filled.join(surveyed, ["ei", "ni"], "left_anti"), ["ei", "ni"], [F.asc("source")])


def hide(features: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Without the listed ids; id 0 stands for no id and is never hidden."""
    return features.join(ids.where(F.col(key) != 0).select(key).distinct(), key, "left_anti")


def catalog_counts(tiles: DataFrame) -> DataFrame:
    """Tiles a source brings in (source, tiles), tiles of an earlier source not counted again."""
    return suppress_duplicates(tiles, ["ei", "ni"], [F.asc("source")]).groupBy("source").agg(F.count("*").alias("tiles"))


def coverage_mask(tiles: DataFrame, chunks: DataFrame, positions: DataFrame, radius: int, keys: list[str], span: int = 8) -> DataFrame:
    """For each position's tile (ei, ni), the window around it: (keys, ei, ni, covered) by tiles or whole chunks (cei, cni)."""
    d = F.sequence(F.lit(-radius), F.lit(radius))
    grid = positions.withColumn("_a", F.explode(d)).withColumn("_b", F.explode(d)).select(*keys, (F.col("ei") + F.col("_a")).alias("ei"), (F.col("ni") + F.col("_b")).alias("ni"))
    k = F.sequence(F.lit(0), F.lit(span - 1))
    whole = chunks.withColumn("_a", F.explode(k)).withColumn("_b", F.explode(k)).select((F.col("cei") * span + F.col("_a")).alias("ei"), (F.col("cni") * span + F.col("_b")).alias("ni"))
    covered = whole.union(tiles.select("ei", "ni")).distinct().withColumn("_c", F.lit(True))
    return grid.join(covered, ["ei", "ni"], "left").select(*keys, "ei", "ni", F.coalesce("_c", F.lit(False)).alias("covered"))


def tiles_to_cells(tiles: DataFrame, to_source, lattice: int = 3, size: float = 1024.0) -> DataFrame:
    """The 2 km source cells (ei, ni, e_km, n_km) that feed each tile.

    A lattice x lattice of points over the tile goes through ``to_source``, which
    adds ``ue`` and ``un``; each point's cell is snapped to an odd easting and an
    even northing.
    """
    k = F.sequence(F.lit(0), F.lit(lattice - 1))
    at = lambda i, j: (F.col(i) + F.col(j) / float(lattice - 1)) * size
    p = tiles.withColumn("_i", F.explode(k)).withColumn("_j", F.explode(k)).select("ei", "ni", at("ei", "_i").alias("e"), at("ni", "_j").alias("n"))
    e, n = snap_cell(F.floor(F.col("ue") / 1000).cast("int"), F.floor(F.col("un") / 1000).cast("int"))
    return to_source(p).select("ei", "ni", e.alias("e_km"), n.alias("n_km")).distinct()


def numbered(df: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """1, 2, .. in the order of ``order`` over the whole table.

    Rows are sorted in ranges, which are written with each row's range and place
    in it; the ranges' counts, a row each, then give where a range begins. So a
    task sorts one range, and no window sees the table.
    """
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    starts = ranged.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    starts = starts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    placed = ranged.withColumn("_range", part).join(F.broadcast(starts), "_range")
    return placed.withColumn(out, F.col("_start") + F.col("_row") - F.shiftleft("_range", 33) + 1).drop("_range", "_row", "_start")


def nearest_first(requests: DataFrame, ei, ni, groups: list[str] = ()) -> DataFrame:
    """Requests (ei, ni) with their Chebyshev distance to a tile and their place in the queue: by ``groups``, then distance."""
    d = requests.withColumn("distance", chebyshev(F.col("ei") - ei, F.col("ni") - ni))
    return numbered(d, [*groups, "distance", "ei", "ni"])


def limit_missing(missing: DataFrame, n: int) -> DataFrame:
    """The first ``n`` missing tiles by (ei, ni)."""
    return missing.orderBy("ei", "ni").limit(n)


def locality_sort(tiles: DataFrame, files: int | None = None) -> DataFrame:
    """Tiles in ranges of rows, sorted by row and column within each, so that neighbours are worked on together."""
    ranged = tiles.repartitionByRange(files, "ni", "ei") if files else tiles.repartitionByRange("ni", "ei")
    return ranged.sortWithinPartitions("ni", "ei")


def release_sources(deps: DataFrame, done: DataFrame, source: list[str], tile=("ei", "ni")) -> DataFrame:
    """Sources all of whose dependent tiles (``deps``) are done."""
    return complete_groups(deps.select(*source, *tile), done, list(tile), source)


def union_inventory(*inventories: DataFrame) -> DataFrame:
    """The tiles or cells that at least one inventory has (also: tiles of lines and of polygons)."""
    out = inventories[0]
    for other in inventories[1:]:
        out = out.unionByName(other)
    return out.distinct()


def clip_to_candidates(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    return reference.intersect(candidates.select(*reference.columns))


def missing_from(reference: DataFrame, have: DataFrame) -> DataFrame:
    return reference.subtract(have.select(*reference.columns))


def union_points(*parts: DataFrame) -> DataFrame:
    """Point tables one after another: ``part`` numbers them, so that (part, their own order) keeps the order."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out


def extent_tiles(left, bottom, right, top, size: float, slack: float = 1.0) -> tuple:
    """Index range (e0, n0, e1, n1), ends included, of the tiles of an extent; what reaches less than ``slack`` into a tile does not count."""
    low, high = (lambda x: F.floor(x / size).cast("int")), (lambda x: F.floor((x - slack) / size).cast("int"))
    return low(left), low(bottom), high(right), high(top)


def filter_extent(tiles: DataFrame, left, bottom, right, top, size: float, slack: float = 1.0) -> DataFrame:
    """Tiles (ei, ni) of the extent."""
    e0, n0, e1, n1 = extent_tiles(left, bottom, right, top, size, slack)
    return tiles.where(F.col("ei").between(e0, e1) & F.col("ni").between(n0, n1))


def snap_extent(left, bottom, right, top, size: float, slack: float = 1e-3) -> tuple:
    """The extent grown to whole tiles; sources are rejected only against this one, or edge tiles would lose theirs."""
    e0, n0, e1, n1 = extent_tiles(left, bottom, right, top, size, slack)
    return e0 * size, n0 * size, (e1 + 1) * size, (n1 + 1) * size


def lattice_cells(bounds: DataFrame, inclusive: bool = True) -> DataFrame:
    """The 2 km cells (e_km, n_km) of bounds (e0, n0, e1, n1 in km): from the first odd easting and even northing on.

    Products differ on whether cells at the upper bound belong to it: ``inclusive``.
    """
    last = lambda c: F.col(c) if inclusive else F.col(c) - 1
    b = bounds.select((F.col("e0") + F.when(F.pmod("e0", F.lit(2)) == 0, 1).otherwise(0)).alias("e0"), (F.col("n0") + F.pmod("n0", F.lit(2))).alias("n0"), last("e1").alias("e1"), last("n1").alias("n1"))
    return grid_tiles(b, out=("e_km", "n_km"), step=2)


def cells_to_tiles(cells: DataFrame, from_source, lattice: int = 5, size: float = 1024.0) -> DataFrame:
    """The tiles (e_km, n_km, ei, ni) that each 2 km source cell feeds: ``from_source`` adds e and n to ue and un."""
    k = F.sequence(F.lit(0), F.lit(lattice - 1))
    at = lambda c, j: (F.col(c) + F.col(j) / float(lattice - 1) * 2) * 1000.0
    p = cells.withColumn("_i", F.explode(k)).withColumn("_j", F.explode(k)).select("e_km", "n_km", at("e_km", "_i").alias("ue"), at("n_km", "_j").alias("un"))
    return from_source(p).select("e_km", "n_km", tile_of(F.col("e"), size).alias("ei"), tile_of(F.col("n"), size).alias("ni")).distinct()


def complete_tiles(need: DataFrame, cells: DataFrame, region: tuple[int, int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Tiles all of whose needed cells (``need``: ei, ni, e_km, n_km) inside the half-open ``region`` (km) are present, and the others, deferred."""
    l, b, r, t = region
    inside = need.where((F.col("e_km") >= l) & (F.col("e_km") < r) & (F.col("n_km") >= b) & (F.col("n_km") < t))
    whole = complete_groups(inside, cells, ["e_km", "n_km"], ["ei", "ni"])
    return whole, need.select("ei", "ni").distinct().join(whole, ["ei", "ni"], "left_anti")
