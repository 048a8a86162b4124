"""Line features: segments, densify, mitred ribbons, cuts at tile edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilefabric.functions.grid import sag, tile_of

#: By class, the width in metres, the colour (red, green, blue) and the priority.
CLASSES = {
    "motorway": (24.0, (0.55, 0.55, 0.57), 10), "motorway_link": (10.0, (0.55, 0.55, 0.57), 9),
    "trunk": (16.0, (0.62, 0.60, 0.58), 9), "trunk_link": (8.0, (0.62, 0.60, 0.58), 8),
    "primary": (12.0, (0.72, 0.66, 0.58), 8), "primary_link": (6.0, (0.72, 0.66, 0.58), 7),
    "secondary": (9.0, (0.76, 0.72, 0.66), 7), "secondary_link": (5.0, (0.76, 0.72, 0.66), 6),
    "tertiary": (7.0, (0.78, 0.74, 0.70), 6), "tertiary_link": (4.0, (0.78, 0.74, 0.70), 5),
    "unclassified": (5.0, (0.78, 0.76, 0.72), 5), "residential": (5.0, (0.80, 0.78, 0.74), 4),
    "living_street": (4.0, (0.82, 0.80, 0.76), 3), "service": (3.5, (0.74, 0.74, 0.74), 3),
    "railway:rail": (3.0, (0.30, 0.30, 0.30), 8), "railway:light_rail": (2.5, (0.38, 0.38, 0.38), 7),
    "railway:tram": (2.0, (0.42, 0.42, 0.42), 6), "railway:subway": (2.5, (0.28, 0.32, 0.38), 7),
}
TUNNEL = ("yes", "true", "1")


def by_line() -> Window:
    return Window.partitionBy("line_id").orderBy("seq")


def segments(v: DataFrame) -> DataFrame:
    """Consecutive vertex pairs with length and the chainage of their start."""
    w = by_line()
    s = v.withColumns({"e1": F.lead("e").over(w), "n1": F.lead("n").over(w)}).where("e1 is not null")
    s = s.withColumn("length", F.sqrt(F.pow(F.col("e1") - F.col("e"), F.lit(2)) + F.pow(F.col("n1") - F.col("n"), F.lit(2))))
    return s.withColumn("chainage", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def densify(v: DataFrame, most: float) -> DataFrame:
    """Segments longer than ``most`` become equal parts; (line_id, seq, part, e, n), the last vertex included."""
    s = segments(v).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("length") / most).cast("int")))
    s = s.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("t", F.col("part") / F.col("parts"))
    s = s.select("line_id", "seq", "part", (F.col("e") + F.col("t") * (F.col("e1") - F.col("e"))).alias("e"), (F.col("n") + F.col("t") * (F.col("n1") - F.col("n"))).alias("n"))
    last = v.withColumn("_l", F.lead("seq").over(by_line())).where("_l is null").select("line_id", "seq", F.lit(0).alias("part"), "e", "n")
    return s.unionByName(last)


def ribbon(v: DataFrame, half: float | Column, cap: float = 2.5, line=("line_id",), keep=()) -> DataFrame:
    """Left and right edge points of a strip of half width ``half`` (a number or a column), with mitred joins capped at ``cap`` half widths.

    ``line`` names the columns that tell lines apart; the columns ``keep`` stay.
    """
    w = Window.partitionBy(*line).orderBy("seq")
    d = v.withColumns({"de": F.lead("e").over(w) - F.col("e"), "dn": F.lead("n").over(w) - F.col("n")})
    d = d.withColumn("_l", F.sqrt(F.col("de") * F.col("de") + F.col("dn") * F.col("dn"))).withColumns({"t1e": F.col("de") / F.nullif("_l", F.lit(0.0)), "t1n": F.col("dn") / F.nullif("_l", F.lit(0.0))})
    d = d.withColumns({"t0e": F.lag("t1e").over(w), "t0n": F.lag("t1n").over(w)})
    d = d.withColumns({"ae": F.coalesce("t0e", "t1e"), "an": F.coalesce("t0n", "t1n"), "be": F.coalesce("t1e", "t0e"), "bn": F.coalesce("t1n", "t0n")})
    d = d.withColumn("k", 1 + F.col("ae") * F.col("be") + F.col("an") * F.col("bn")).withColumn("sharp", F.col("k") < 1e-4)
    d = d.withColumns({"oe": F.when(F.col("sharp"), -F.col("an") * half).otherwise((-F.col("an") - F.col("bn")) * half / F.when(~F.col("sharp"), F.col("k"))), "on": F.when(F.col("sharp"), F.col("ae") * half).otherwise((F.col("ae") + F.col("be")) * half / F.when(~F.col("sharp"), F.col("k")))})
    d = d.withColumn("_m", F.sqrt(F.col("oe") * F.col("oe") + F.col("on") * F.col("on"))).withColumn("_s", F.when(F.col("_m") > cap * half, cap * half / F.col("_m")).otherwise(1.0))
    o = lambda sign, a, b: F.col(a) + sign * F.col(b) * F.col("_s")
    return d.select(*line, "seq", *keep, o(1, "e", "oe").alias("left_e"), o(1, "n", "on").alias("left_n"), o(-1, "e", "oe").alias("right_e"), o(-1, "n", "on").alias("right_n"))


def split_at_tiles(v: DataFrame, size: float) -> DataFrame:
    """Segments cut at tile edges: (line_id, seq, part, ei, ni, e0, n0, e1, n1); both sides get the cut point."""
    s = segments(v)

    def cuts(a: str, b: str):
        low, high = F.least(a, b), F.greatest(a, b)
        first, last = F.floor(low / size).cast("long") + 1, F.ceil(high / size).cast("long") - 1
        lines = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
        return F.transform(lines, lambda g: (g * size - F.col(a)) / (F.col(b) - F.col(a)))

    t = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.when(F.col("e") != F.col("e1"), cuts("e", "e1")).otherwise(F.array().cast("array<double>")), F.when(F.col("n") != F.col("n1"), cuts("n", "n1")).otherwise(F.array().cast("array<double>")))))
    s = s.withColumn("t", t).withColumn("part", F.explode(F.sequence(F.lit(0), F.size("t") - 2)))
    s = s.withColumns({"t0": F.get("t", F.col("part")), "t1": F.get("t", F.col("part") + 1)})
    at = lambda x, x1, k: F.col(x) + F.col(k) * (F.col(x1) - F.col(x))
    s = s.withColumns({"a": at("e", "e1", "t0"), "b": at("n", "n1", "t0"), "c": at("e", "e1", "t1"), "d": at("n", "n1", "t1")})
    return s.select("line_id", "seq", "part", tile_of((F.col("a") + F.col("c")) / 2, size).alias("ei"), tile_of((F.col("b") + F.col("d")) / 2, size).alias("ni"), F.col("a").alias("e0"), F.col("b").alias("n0"), F.col("c").alias("e1"), F.col("d").alias("n1"))


def road_class(tags: Column) -> Column:
    """Class of a way's tag map: its highway, else ``railway:`` and its railway unless that is in a tunnel; null for other ways."""
    road, rail = tags["highway"], F.concat(F.lit("railway:"), tags["railway"])
    known = lambda c: c.isin(*CLASSES)
    open_air = ~F.coalesce(tags["tunnel"].isin(*TUNNEL), F.lit(False))
    return F.when(known(road), road).when(known(rail) & open_air, rail)


def classify_roads(v: DataFrame) -> DataFrame:
    """Adds width, colour (red, green, blue) and priority by class; unknown classes and railways in a ``tunnel`` (if there is such a column) are dropped."""
    rows = [(k, w, *c, p) for k, (w, c, p) in CLASSES.items()]
    known = v.sparkSession.createDataFrame(rows, "cls string, width double, red double, green double, blue double, priority int")
    if "tunnel" in v.columns:
        v = v.where(~(F.col("cls").startswith("railway:") & F.coalesce(F.col("tunnel").isin(*TUNNEL), F.lit(False))))
    return v.join(F.broadcast(known), "cls")  # a fixed list


def middle_vertex(v: DataFrame) -> DataFrame:
    """Vertex number n div 2 of each line."""
    return v.withColumn("_n", F.count("*").over(Window.partitionBy("line_id"))).where("seq = floor(_n / 2)").drop("_n")


def drape(v: DataFrame, heights: DataFrame, keys: list[str], tile: list[str], offset: float, centre: tuple[str, str] | None = None) -> DataFrame:
    """Sampled height plus offset, as ``y``; vertices without one take their tile's mean, those of tiles without any are ``pending``.

    On a round earth, ``centre`` names columns with the tile's centre: a vertex
    sinks below the plane that touches there.
    """
    j = v.join(heights, keys, "left")
    y = F.coalesce(F.col("h"), F.avg("h").over(Window.partitionBy(*tile))) + offset
    if centre:
        y = y - sag(F.col("e") - F.col(centre[0]), F.col("n") - F.col(centre[1]))
    return j.withColumn("y", y).withColumn("pending", F.col("y").isNull())


def drape_summary(v: DataFrame, heights: DataFrame, keys: list[str], tile: list[str]) -> DataFrame:
    return v.join(heights, keys, "left").groupBy(*tile).agg(F.count("h").alias("resolved"), F.avg("h").alias("mean_h"), F.bool_and(F.col("h").isNotNull()).alias("complete"))


def tile_pieces(v: DataFrame, size: float, key: str = "line_id") -> DataFrame:
    """Lines cut at tile edges and put together again within each tile: vertices (line_id, piece, seq, ei, ni, e, n).

    A piece is a run of parts of one line in one tile; ``piece`` numbers the runs
    along the line, ``seq`` the vertices of a run.
    """
    s = split_at_tiles(v, size)
    w = Window.partitionBy(key).orderBy("seq", "part")
    new = F.coalesce((F.lag("ei").over(w) != F.col("ei")) | (F.lag("ni").over(w) != F.col("ni")), F.lit(True)).cast("int")
    s = s.withColumn("_new", new).withColumn("piece", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(key, "piece").orderBy("seq", "part")
    s = s.withColumns({"_k": F.row_number().over(own), "_last": F.lead("seq").over(own).isNull()})
    ends = F.array(F.struct(F.col("_k").alias("seq"), F.col("e0").alias("e"), F.col("n0").alias("n")), F.struct((F.col("_k") + 1).alias("seq"), F.col("e1").alias("e"), F.col("n1").alias("n")))
    s = s.select(key, "piece", "ei", "ni", F.explode(F.when(F.col("_last"), ends).otherwise(F.slice(ends, 1, 1))).alias("p"))
    return s.select(key, "piece", "p.seq", "ei", "ni", "p.e", "p.n")
