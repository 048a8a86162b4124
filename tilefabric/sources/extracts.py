"""Road and water tiles straight from a map extract: tags, boundary, projection and bake in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefabric.functions import geodesy
from tilefabric.operators import bakes, spatial
from tilefabric.sources import vectors
from tilefabric.tables import written


def boundary_rings(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The rings of .poly files as one polygon (poly_id, ring_no, seq, lon, lat); holes count out by the even-odd rule."""
    if path is None:
        return None
    rings = vectors.read_boundary_poly(spark, path)
    return written(rings.select(F.lit(0).alias("poly_id"), F.xxhash64("path", "ring_no").alias("ring_no"), "seq", "lon", "lat"))


def projected_areas(areas: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """Polygons (poly_id, ring_no, seq, e, n) from rings (area, ring_no, seq, lat, lon); those whose mean outer vertex is outside the boundary left out.

    Rings of fewer than three vertices go; without its outer ring, so does a polygon.
    """
    r = areas.withColumnRenamed("area", "poly_id")
    sizes = r.groupBy("poly_id", "ring_no").agg(F.count("*").alias("_k")).where("_k >= 3").drop("_k")
    whole = sizes.where("ring_no = 0").select("poly_id")
    r = r.join(sizes, ["poly_id", "ring_no"], "left_semi").join(whole, "poly_id", "left_semi")
    if boundary is not None:
        flat = r.select("poly_id", "ring_no", "seq", F.col("lon").alias("e"), F.col("lat").alias("n"))
        inside = spatial.clip_polygons_to_boundary(flat, degrees(boundary), bakes.DEGREES)
        r = r.join(inside.select("poly_id").distinct(), "poly_id", "left_semi")
    return geodesy.settled(geodesy.wgs84_to_lv95(r), "e", "n").drop("lat", "lon")


def degrees(boundary: DataFrame) -> DataFrame:
    return boundary.select("poly_id", "ring_no", "seq", F.col("lon").alias("e"), F.col("lat").alias("n"))


def extract_tiles(spark: SparkSession, extract: str, height: DataFrame, px: int, boundary: str | None = None, most: float = bakes.DENSE, size: float = bakes.VECTOR_TILE) -> dict[str, DataFrame]:
    """``road_vertices``, ``roads`` (the manifest), ``lakes``, ``streams`` and ``water`` (the manifest) of a map extract in XML.

    Roads, rails, rivers and canals by their tags, areas by theirs; lines whose
    middle vertex and areas whose mean outer vertex lie outside the ``boundary``
    (.poly files) are left out; everything is projected and baked on ``height``.
    """
    roads, water, areas = vectors.read_osm(spark, extract)
    rings = boundary_rings(spark, boundary)
    project = lambda v: written(bakes.projected_lines(v, rings))
    vertices, road_manifest = bakes.road_tiles(project(roads), height, px, most, size)
    lakes, streams, water_manifest = bakes.water_tiles(project(water), written(projected_areas(areas, rings)), height, px, size)
    return {"road_vertices": vertices, "roads": road_manifest, "lakes": lakes, "streams": streams, "water": water_manifest}
