"""Which tiles a moving position needs: state per track, as a stream and as its batch twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilefabric.functions.grid import RINGS, chebyshev, chunk_distance, chunk_resolution, effective_lod, lod_for_distance, mesh_vertices, ortho_pixels
from tilefabric.streaming import tracks
from tilefabric.tables import dealt, grown

TRACK = ["track_id", "part"]
#: Seconds without a fix after which a track ends.
IDLE = 86_400.0


def moves(fixes: DataFrame, idle: float | None = None) -> DataFrame:
    """The fixes (track_id, fix_id, ts, te, tn) that are in another tile than the one before, numbered as ``k``.

    A gap of more than ``idle`` seconds ends a track: what follows is its next ``part``, which starts anew.
    """
    track = Window.partitionBy("track_id").orderBy("ts", "fix_id")
    f = fixes
    if idle is None:
        f = f.withColumn("part", F.lit(0).cast("long"))
    else:
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        f = f.withColumn("_gap", F.coalesce(at - F.lag(at).over(track) > int(idle * 1e6), F.lit(False)).cast("long"))
        f = f.withColumn("part", F.sum("_gap").over(track.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
    part = Window.partitionBy(*TRACK).orderBy("ts", "fix_id")
    f = f.withColumns({"_pe": F.lag("te").over(part), "_pn": F.lag("tn").over(part)})
    f = f.where("_pe is null or _pe <> te or _pn <> tn").drop("_pe", "_pn")
    return f.withColumn("k", F.row_number().over(part))


def stays(f: DataFrame, reach: int) -> DataFrame:
    """(track, part, ei, ni, from_k, to_k): runs of moves during which a tile is within ``reach``; ``to_k`` is the first move after.

    Only tiles that come into reach or leave it with a move become rows: two
    strips of the square, so their number grows with the reach, not its square.
    """
    w = Window.partitionBy(*TRACK).orderBy("k")
    steps = f.select(*TRACK, "k", "te", "tn", F.lag("te").over(w).alias("pe"), F.lag("tn").over(w).alias("pn"))
    ends = strips(steps, reach).withColumn("enters", F.lit(True))
    ends = ends.unionByName(strips(backwards(steps), reach).withColumn("enters", F.lit(False)))
    tile = Window.partitionBy(*TRACK, "ei", "ni").orderBy("k")
    ends = ends.withColumn("to_k", F.lead("k").over(tile)).where("enters")
    return ends.select(*TRACK, "ei", "ni", F.col("k").alias("from_k"), "to_k")


def backwards(steps: DataFrame, *keep: str) -> DataFrame:
    """Moves from (te, tn) to (pe, pn), without first ones; the columns ``keep`` stay."""
    swapped = (F.col(a).alias(b) for a, b in (("pe", "te"), ("pn", "tn"), ("te", "pe"), ("tn", "pn")))
    return steps.where("pe is not null").select(*TRACK, "k", *keep, *swapped)


def strips(steps: DataFrame, reach: int, *keep: str) -> DataFrame:
    """(track, part, k, keep, ei, ni): the tiles within ``reach`` of (te, tn) that are not within it of (pe, pn); all, where that is null."""
    none = F.array().cast("array<int>")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    e, n, pe, pn = (F.col(c) for c in ("te", "tn", "pe", "pn"))
    r = F.lit(reach)
    rows = steps.withColumn("ei", F.explode(F.sequence(e - r, e + r)))
    inside = F.col("pe").isNotNull() & (F.abs(F.col("ei") - pe) <= r)
    below, above = span(n - r, F.least(n + r, pn - r - 1)), span(F.greatest(n - r, pn + r + 1), n + r)
    rows = rows.withColumn("ni", F.explode(F.when(inside, F.concat(below, above)).otherwise(F.sequence(n - r, n + r))))
    return rows.select(*TRACK, "k", *keep, "ei", "ni")


def residency_batch(fixes: DataFrame, radius: int, margin: int, idle: float | None = None) -> DataFrame:
    """Load and unload events over whole tracks (track_id, fix_id, ts, ei, ni as te, tn).

    A tile is loaded when its Chebyshev distance is at most ``radius`` and goes
    only when it is more than ``radius + margin``: between the two it keeps its
    state. It is loaded from the first stay within the radius that begins in a
    stay within the wider one, until that one ends. With ``idle``, tracks end
    (see ``moves``), and what they hold then goes as ``expire``, without a fix.
    """
    f = moves(fixes, idle)
    tile = [*TRACK, "ei", "ni"]
    outer, inner = stays(f, radius + margin).withColumnsRenamed({"from_k": "a", "to_k": "b"}), stays(f, radius)
    held = outer.join(grown(inner), tile).where("from_k >= a and (b is null or from_k < b)").groupBy(*tile, "a", "b").agg(F.min("from_k").alias("k"))
    end = F.when(F.col("b").isNotNull(), F.lit("unload")).otherwise("expire")
    found = F.array(F.struct(F.col("k").alias("k"), F.lit("load").alias("action")), F.struct(F.col("b").alias("k"), end.alias("action")))
    events = held.select(*tile, F.explode(found).alias("x")).select(*tile, "x.k", "x.action")
    if idle is None:
        events = events.where("action <> 'expire'")
    return events.join(grown(f.select(*TRACK, "k", "fix_id")), [*TRACK, "k"], "left").select("track_id", "fix_id", "ei", "ni", "action")


def residency_stream(fixes: DataFrame, radius: int, margin: int, late: str = "10 minutes", idle: float = IDLE) -> DataFrame:
    """The same events from a stream of (track_id, fix_id, ts, te, tn), in order of event time."""
    p = tracks.Residency(int(idle * 1000), radius, margin)
    return tracks.run(fixes, ["track_id"], p, p.schema, late)


def lod_changes_batch(fixes: DataFrame, radius: int) -> DataFrame:
    """Tiles whose level of detail differs from the one they had at the fix before, and whether their texture's size does too.

    Fixes are (track_id, fix_id, ts, te, tn). A tile that was out of the radius at
    the fix before has no level to change.
    """
    f = moves(fixes)
    w = Window.partitionBy(*TRACK).orderBy("k")
    steps = f.withColumns({"pe": F.lag("te").over(w), "pn": F.lag("tn").over(w)}).where("pe is not null").select(*TRACK, "fix_id", "k", "te", "tn", "pe", "pn")
    reaches = [r for r, _ in next(rings for most, rings in RINGS.items() if most is None or radius <= most)[:-1]]
    now, then = (chebyshev(F.col("ei") - F.col(e), F.col("ni") - F.col(n)) for e, n in (("te", "tn"), ("pe", "pn")))
    # Only tiles that cross the border of a ring change: strips along it, not the whole square. One that crosses several counts at the narrowest.
    own = F.struct("fix_id", "te", "tn", "pe", "pn")
    crossed = []
    for k, r in enumerate(reaches):
        both = strips(steps.withColumn("own", own), r, "own").unionByName(strips(backwards(steps.withColumn("own", own), "own"), r, "own"))
        both = both.select("track_id", "ei", "ni", "own.*")
        crossed.append(both.where(reduce(Column.__and__, ((now <= q) == (then <= q) for q in reaches[:k]), F.lit(True))))
    out = reduce(DataFrame.unionByName, crossed).where((now <= radius) & (then <= radius)).withColumns({"new_lod": lod_for_distance(now, radius), "old_lod": lod_for_distance(then, radius)})
    texture = ortho_pixels(F.col("new_lod")) != ortho_pixels(F.col("old_lod"))
    return out.where("old_lod <> new_lod").select("track_id", "fix_id", "ei", "ni", "old_lod", "new_lod", texture.alias("texture"))


def lod_changes_stream(fixes: DataFrame, radius: int, late: str = "10 minutes", idle: float = IDLE) -> DataFrame:
    """The same changes from a stream; a track's state is its last tile, from which every level follows."""
    p = tracks.Levels(int(idle * 1000), radius)
    return tracks.run(fixes, ["track_id"], p, p.schema, late)


def coverage_generation_batch(fixes: DataFrame) -> DataFrame:
    """(track_id, fix_id, generation): a number that grows only when the covered window, so the tile (te, tn), changes."""
    w = Window.partitionBy("track_id").orderBy("ts", "fix_id")
    moved = F.coalesce((F.lag("te").over(w) != F.col("te")) | (F.lag("tn").over(w) != F.col("tn")), F.lit(True))
    f = fixes.withColumn("_c", moved.cast("long"))
    return f.select("track_id", "fix_id", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("generation"))


def coverage_generation_stream(fixes: DataFrame, late: str = "10 minutes", idle: float = IDLE) -> DataFrame:
    """The same numbers from a stream; the state is the last tile and the number, which starts again after ``idle`` seconds."""
    p = tracks.Generation(int(idle * 1000))
    return tracks.run(fixes, ["track_id"], p, p.schema, late)


def chunk_distances(fixes: DataFrame, far: int, span: int = 8) -> DataFrame:
    """For each move of a track, the chunks whose nearest tile is at most ``far`` tiles away: (track_id, fix_id, k, cei, cni, d)."""
    f = moves(fixes)
    reach = lambda c: F.sequence(F.floor((F.col(c) - far) / span).cast("int"), F.floor((F.col(c) + far) / span).cast("int"))
    f = f.withColumn("cei", F.explode(reach("te"))).withColumn("cni", F.explode(reach("tn")))
    near, _ = chunk_distance(*(F.col(c) for c in ("te", "tn", "cei", "cni")), span)
    return f.select("track_id", "fix_id", "k", "cei", "cni", near.alias("d")).where(F.col("d") <= far)


def chunk_resolution_batch(fixes: DataFrame, far: int, span: int = 8) -> DataFrame:
    """Chunks that are asked for, or asked for anew in another resolution, over whole tracks.

    A chunk gets coarser only once the distance is clear of the border; out
    of reach it is forgotten. A resolution can change only where the distance
    comes into another band, so only such moves become rows: bands 0, 2 and 4
    stand for a resolution each, and in 1 and 3, just past a border, the one
    before counts. The one before band 1 is never of band 1, nor that before 3 of 3.
    """
    f = moves(dealt(fixes, "track_id"))
    last = Window.partitionBy(*TRACK).orderBy("k")
    f = f.withColumns({"pe": F.lag("te").over(last), "pn": F.lag("tn").over(last)})
    reach = lambda c: F.sequence(F.floor((F.col(c) - far) / span).cast("int"), F.floor((F.col(c) + far) / span).cast("int"))
    # The distance along each axis is a column of its own, and a band is looked up, lest the generated code gets too long to be compiled.
    along = lambda tile, chunk: F.greatest(F.col(chunk) * span - F.col(tile), F.col(tile) - F.col(chunk) * span - span + 1)
    f = f.withColumn("cei", F.explode(reach("te"))).withColumns({"_d": along("te", "cei"), "_was": along("pe", "cei")})
    f = f.withColumn("cni", F.explode(reach("tn")))
    d, was = F.greatest("_d", along("tn", "cni"), F.lit(0)), F.greatest("_was", along("pn", "cni"), F.lit(0))
    borders = (32, 36, 64, 68)
    band = lambda x: F.get(F.lit([sum(i > border for border in borders) for i in range(borders[-1] + 2)]), F.least(x, F.lit(borders[-1] + 1)))
    enters = F.col("pe").isNull() | (was > far)
    rows = f.where((d <= far) & (enters | (band(d) != band(was))))
    rows = rows.select("track_id", "fix_id", "k", "cei", "cni", band(d).alias("band"), F.when(enters, chunk_resolution(d, F.lit(None).cast("int"))).alias("first"))
    w = Window.partitionBy("track_id", "cei", "cni").orderBy("k")
    own = F.when(F.col("band") == 0, 129).when(F.col("band") == 2, 65).when(F.col("band") == 4, 33).when(F.col("band") == 1, F.when(F.lag("band").over(w) == 0, 129).otherwise(65))
    rows = rows.withColumn("_res", F.coalesce("first", own))
    rows = rows.withColumn("new_res", F.coalesce("_res", F.when(F.lag("_res").over(w) == 65, 65).otherwise(33)))
    rows = rows.withColumn("old_res", F.when(F.col("first").isNull(), F.lag("new_res").over(w)))
    return rows.where("old_res is null or old_res <> new_res").select("track_id", "fix_id", "cei", "cni", "old_res", "new_res")


def chunk_resolution_stream(fixes: DataFrame, far: int, span: int = 8, late: str = "10 minutes", idle: float = IDLE) -> DataFrame:
    """The same from a stream; a track's state is its last tile and the resolution of each chunk in reach."""
    p = tracks.Resolutions(int(idle * 1000), far, span)
    return tracks.run(fixes, ["track_id"], p, p.schema, late)


def handoff_batch(events: DataFrame, radius: int, margin: int, far: int, span: int = 8) -> DataFrame:
    """Loads and unloads (track_id, event_id, kind, a, b, action) of tiles and chunks over whole tracks.

    Events (track_id, event_id, ts, kind, a, b) are a ``fix`` at tile (a, b), or
    that a ``tile`` or ``chunk`` is there. A group is one track.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, at, tiles, chunks, out = pdf.sort_values(["ts", "event_id"]), None, {}, {}, []
        for event, kind, a, b in zip(rows["event_id"], rows["kind"], rows["a"], rows["b"], strict=True):
            more, at = tracks.handed(int(rows["track_id"].iloc[0]), int(event), kind, (int(a), int(b)), at, tiles, chunks, radius, margin, far, span)
            out += more
        return pd.DataFrame(out, columns=tracks.names(tracks.Handoff.schema))

    return events.groupBy("track_id").applyInPandas(run, tracks.Handoff.schema)


def handoff_stream(events: DataFrame, radius: int, margin: int, far: int, span: int = 8, late: str = "10 minutes", idle: float = IDLE) -> DataFrame:
    """The same from a stream; tiles and chunks are in one track's state, as each waits for the other."""
    p = tracks.Handoff(int(idle * 1000), radius, margin, far, span)
    return tracks.run(events, ["track_id"], p, p.schema, late)


def drain(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Works off the source files (Parquet) that have come since the last call, and publishes their results.

    Every batch goes to a folder of its own, ``out/data/batch=N``, replaced whole
    if it runs again; then its files are listed in ``out/released``: they are done
    and can go. The checkpoint tells which files were seen.
    """

    def batch(df: DataFrame, number: int) -> None:
        process(df.drop("_file")).write.mode("overwrite").parquet(f"{out}/data/batch={number}")
        df.select(F.col("_file").alias("file")).distinct().write.mode("overwrite").parquet(f"{out}/released/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source).withColumn("_file", F.col("_metadata.file_path"))
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def probe_status_stream(probes: DataFrame) -> DataFrame:
    """The last definite status per cell, in update mode."""
    last = probes.where("status <> 0").groupBy("e_km", "n_km").agg(F.max(F.struct("ts", "status")).alias("m"))
    return last.select("e_km", "n_km", F.col("m.status").alias("status"))


def tile_demand(fixes: DataFrame, radius: int, px: int = 1024) -> DataFrame:
    """Over a whole track (track_id, fix_id, ts, te, tn): each tile within ``radius`` once, at its finest level, with that level's vertices and the fixes that need it.

    The fixes are counted by a tile's stays, and its finest level is that of the
    narrowest ring that it ever enters, so only strips become rows.
    """
    track = Window.partitionBy("track_id").orderBy("ts", "fix_id")
    all_ = dealt(fixes, "track_id").withColumn("_at", F.row_number().over(track)).withColumn("_of", F.count("*").over(Window.partitionBy("track_id")))
    ends = all_.groupBy("track_id").agg((F.max("_of") + 1).alias("_end"))
    f = moves(all_).withColumn("k", F.col("_at"))  # a move's number is that of its fix
    need = stays(f, radius).join(ends, "track_id")
    need = need.select("track_id", "ei", "ni", (F.coalesce("to_k", "_end") - F.col("from_k")).alias("fixes"), F.lit(None).cast("int").alias("lod"))
    w = Window.partitionBy(*TRACK).orderBy("k")
    steps = f.withColumns({"pe": F.lag("te").over(w), "pn": F.lag("tn").over(w)})
    rings = next(r for most, r in RINGS.items() if most is None or radius <= most)
    entered = [strips(steps, radius if r is None else min(r, radius)).select("track_id", "ei", "ni", F.lit(None).cast("long").alias("fixes"), F.lit(lod).alias("lod")) for r, lod in rings]
    # A tile that is needed enters a ring, so both kinds of rows meet in one grouping.
    t = reduce(DataFrame.unionByName, [need, *entered]).groupBy("track_id", "ei", "ni").agg(F.min("lod").alias("lod"), F.sum("fixes").alias("fixes"))
    return t.withColumn("vertices", mesh_vertices(effective_lod(F.col("lod"), px), px))


def chunk_demand(fixes: DataFrame, far: int, span: int = 8) -> DataFrame:
    """Over a whole track: each chunk in reach once, with its nearest distance and the resolution that asks for."""
    d = chunk_distances(fixes, far, span).groupBy("track_id", "cei", "cni").agg(F.min("d").alias("distance"))
    return d.withColumn("res", chunk_resolution(F.col("distance"), F.lit(None).cast("int")))
