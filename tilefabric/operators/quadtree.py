"""Crowded grid cells cut into a quadtree's leaves by counted load, so that no join key holds more than a bounded number of points.

Points stand in square cells (``_cx``, ``_cy``). Cells of at most ``load`` points
stay whole. A crowded one is halved in both directions, and its quarters again,
until each holds at most ``load``; quarters are numbered by their Morton code, so
all levels are prefixes of the finest one, and one count of the finest quarters
gives the counts of all. A finest quarter that is still crowded (say, one place a
million times) is dealt to several parts by a hash. Points are keyed by (cell,
leaf, part); what they are joined with is copied to the leaves that it touches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilefabric.tables import written

LOAD, DEPTH = 20_000, 8
CELL, KEY = ["_cx", "_cy"], ["_cx", "_cy", "_leaf", "_part"]
#: Rows up to which a counted table is broadcast; a key of this share of the rows is one of few and is broadcast too.
SMALL, SHARE = 100_000, 1_000


def morton(x: Column, y: Column, depth: int) -> Column:
    """The bits of two numbers below 2^depth in turns."""
    bit = lambda v, b, to: F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1).cast("long")), to)
    return reduce(Column.bitwiseOR, (bit(v, b, 2 * b + k) for b in range(depth) for k, v in enumerate((x.cast("long"), y.cast("long")))))


@dataclass
class Quadtree:
    """The leaves of the crowded cells; ``quarters`` is None where no cell is crowded."""

    cell: float
    depth: int
    rows: int
    quarters: DataFrame | None  # (_cx, _cy, _code, _n, _leaf, _level, _parts): each finest quarter that holds points

    def code(self, at: tuple[str, str]) -> Column:
        side = 1 << self.depth
        place = lambda c, k: F.least(F.greatest(F.floor((F.col(c) / self.cell - F.col(k)) * side), F.lit(0)), F.lit(side - 1))
        return morton(place(at[0], "_cx"), place(at[1], "_cy"), self.depth)

    def key_points(self, points: DataFrame, at: tuple[str, str] = ("e", "n")) -> DataFrame:
        """Points with ``_leaf`` and ``_part``: 0, 0 in cells that are whole."""
        whole = points.withColumns({"_leaf": F.lit(0).cast("long"), "_part": F.lit(0)})
        if self.quarters is None:
            return whole
        cells = counted(self.quarters.select(*CELL).distinct())
        whole = whole.join(cells, CELL, "left_anti")
        coded = points.join(cells, CELL, "left_semi").withColumn("_code", self.code(at))
        table = self.quarters.select(*CELL, "_code", "_n", "_leaf", "_parts")
        key = [*CELL, "_code"]
        few = F.broadcast(table.where(F.col("_n") * SHARE >= self.rows))
        rest = table.where(F.col("_n") * SHARE < self.rows)
        cut = coded.join(few, key).unionByName(coded.join(few.select(*key), key, "left_anti").join(rest, key))
        part = F.pmod(F.xxhash64(*points.columns), F.col("_parts")).cast("int")
        return whole.unionByName(cut.withColumn("_part", part).drop("_code", "_n", "_parts"))

    def key_shapes(self, shapes: DataFrame, box: tuple[str, str, str, str], inner: tuple[float, float] | None = None) -> DataFrame:
        """Rows in cells with a row for each leaf and part that their ``box`` (x0, y0, x1, y1) touches.

        ``inner`` is a place in each cell, in parts of a cell: where it is given, a leaf
        counts as reaching to it.
        """
        if self.quarters is None:
            return shapes.withColumns({"_leaf": F.lit(0).cast("long"), "_part": F.lit(0)})
        leaves = self.quarters.groupBy(*CELL, "_leaf", "_level").agg(F.min("_code").alias("_code"), F.max("_parts").alias("_parts"))
        wide = F.pow(F.lit(2.0), self.depth - F.col("_level"))  # of a leaf, in finest quarters
        axis = lambda k: reduce(Column.bitwiseOR, (F.shiftleft(F.shiftright("_code", 2 * b + k).bitwiseAND(F.lit(1).cast("long")), b) for b in range(self.depth)))
        low = lambda k: F.floor(axis(k) / wide) * wide / (1 << self.depth)
        bounds = {}
        for k, name in enumerate("xy"):
            a, b = low(k), low(k) + wide / (1 << self.depth)
            if inner:
                a, b = F.least(a, F.lit(inner[k])), F.greatest(b, F.lit(inner[k]))
            bounds |= {f"_{name}0": (F.col(CELL[k]) + a) * self.cell, f"_{name}1": (F.col(CELL[k]) + b) * self.cell}
        leaves = counted(written(leaves.withColumns(bounds).select(*CELL, "_leaf", "_parts", "_x0", "_y0", "_x1", "_y1")))
        slack = self.cell * 1e-9
        touches = (F.col(box[0]) <= F.col("_x1") + slack) & (F.col(box[2]) >= F.col("_x0") - slack) & (F.col(box[1]) <= F.col("_y1") + slack) & (F.col(box[3]) >= F.col("_y0") - slack)
        cells = counted(self.quarters.select(*CELL).distinct())
        whole = shapes.join(cells, CELL, "left_anti").withColumns({"_leaf": F.lit(0).cast("long"), "_part": F.lit(0)})
        cut = shapes.join(leaves, CELL).where(touches).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        return whole.unionByName(cut.select(*shapes.columns, "_leaf", "_part"))


def counted(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """A broadcast hint, if there are at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def quadtree(points: DataFrame, cell: float, at: tuple[str, str] = ("e", "n"), load: int = LOAD, depth: int = DEPTH) -> Quadtree:
    """Counts ``points``, which have their cell in ``_cx`` and ``_cy``; where none is crowded that is all."""
    crowded = points.groupBy(*CELL).agg(F.count("*").alias("_n")).where(F.col("_n") > load)
    crowded = written(crowded)
    rows = crowded.agg(F.sum("_n")).first()[0]
    tree = Quadtree(cell, depth, rows or 0, None)
    if rows is None:
        return tree
    inside = points.select(*CELL, *at).join(counted(crowded.select(*CELL)), CELL, "left_semi")
    fine = inside.groupBy(*CELL, tree.code(at).alias("_code")).agg(F.count("*").alias("_n"))
    level = F.lit(depth)
    for k in range(depth, 0, -1):  # the widest quarter that is not crowded
        prefix = F.shiftright("_code", 2 * (depth - k))
        fine = fine.withColumn(f"_n{k}", F.sum("_n").over(Window.partitionBy(*CELL, prefix)))
        level = F.when(F.col(f"_n{k}") <= load, k).otherwise(level)
    fine = fine.withColumn("_level", level)
    number = F.col("_level").cast("long") * (1 << 2 * depth) + F.expr(f"shiftright(_code, 2 * ({depth} - _level))") + 1
    parts = F.when(F.col("_level") == depth, F.ceil(F.col("_n") / load)).otherwise(1).cast("int")
    tree.quarters = written(fine.select(*CELL, "_code", "_n", number.alias("_leaf"), "_level", parts.alias("_parts")))
    return tree
