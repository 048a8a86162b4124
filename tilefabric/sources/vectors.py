"""Readers of vector files: land-cover polygons, building models, map extracts, boundaries; and what is already done."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefabric.operators import features, lines

from .tiles import _files

LANDCOVER = "path string, tile_e double, tile_n double, poly_id int, kind int, density float, height float, ring_no int, seq int, dx float, dz float"


def _landcover(content: bytes) -> tuple[float, float, list]:
    """Tile corner and (poly_id, kind, density, height, ring_no, points) of one file; struct.error if it is cut short."""
    _, version, count, _, e, n = struct.unpack_from("<4sIIIdd", content)
    at, rings = 32, []
    if content[:4] != b"FOR1" or version != 1:
        raise struct.error("not a land-cover file")
    for poly in range(count):
        kind, density, height, parts = struct.unpack_from("<B3xffI", content, at)
        at += 16
        own = []
        for part in range(parts):
            (points,) = struct.unpack_from("<I", content, at)
            if len(content) < at + 4 + 8 * points:
                raise struct.error("cut short")
            own.append((poly, kind, density, height if height > 1 else 20.0, part, np.frombuffer(content, "<f4", 2 * points, at + 4).reshape(-1, 2)))
            at += 4 + 8 * points
        if own and (len(own[0][5]) >= 3 or kind == 3 and len(own[-1][5]) >= 2):
            rings += own[-1:] if kind == 3 else own  # a corridor (kind 3) is one line
    return e, n, rings


def read_landcover_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Ring vertices of FOR1 files; a file with a bad header or cut short is left out whole.

    Heights up to 1 become 20; polygons of fewer than three outer points and
    corridors of fewer than two are dropped.
    """
    files = _files(spark, path, "*.for").select("path", "content")

    def decode(batches):
        for pdf in batches:
            for path, content in pdf.itertuples(index=False):
                try:
                    e, n, rings = _landcover(content)
                except struct.error:
                    continue
                for poly, kind, density, height, ring, xz in rings:
                    yield pd.DataFrame({"path": path, "tile_e": e, "tile_n": n, "poly_id": poly, "kind": kind, "density": density, "height": height, "ring_no": ring, "seq": np.arange(len(xz), dtype=np.int32), "dx": xz[:, 0], "dz": xz[:, 1]})

    return files.mapInPandas(decode, LANDCOVER)


def parse_coords(text: Column) -> Column:
    """Points of a text of triples; empty for fewer than nine numbers or a number that is not a multiple of three."""
    n = F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda t: t.try_cast("double"))
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 3).cast("int") - 1), lambda k: F.struct(*(F.get(n, k * 3 + i).alias(c) for i, c in enumerate("xyz"))))
    return F.when((F.size(n) >= 9) & (F.size(n) % 3 == 0), points)


_RING = "struct<`gml:LinearRing`: struct<`gml:posList`: string, `gml:pos`: array<string>>>"
_POLYGON = f"struct<`gml:Polygon`: struct<`gml:exterior`: {_RING}, `gml:interior`: array<{_RING}>>>"
_FACE = f"struct<`bldg:lod2MultiSurface`: struct<`gml:MultiSurface`: struct<`gml:surfaceMember`: array<{_POLYGON}>>>>"
#: Surfaces by their element; those not listed here are not read.
SURFACES = {"WallSurface": "wall", "RoofSurface": "roof", "GroundSurface": "ground", "ClosureSurface": "other", "OuterFloorSurface": "other", "OuterCeilingSurface": "other"}
_BOUNDED = "array<struct<" + ", ".join(f"`bldg:{k}`: {_FACE}" for k in SURFACES) + ">>"
_PART = f"array<struct<`bldg:BuildingPart`: struct<`bldg:boundedBy`: {_BOUNDED}>>>"
_PARTS = f"array<struct<`bldg:BuildingPart`: struct<`bldg:boundedBy`: {_BOUNDED}, `bldg:consistsOfBuildingPart`: {_PART}>>>"
CITYGML = f"`_gml:id` string, `bldg:boundedBy` {_BOUNDED}, `bldg:consistsOfBuildingPart` {_PARTS}"


def read_citygml(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of buildings' faces (building_id, surface, poly_no, ring_no, seq, x, y, z); ring 0 is outer.

    Faces of building parts, and of the parts' own parts, are included. Rings are
    given as ``posList`` or as ``pos`` after ``pos``.
    """
    b = spark.read.format("xml").option("rowTag", "bldg:Building").schema(CITYGML).load(path)
    none = F.array().cast(_BOUNDED)
    faces = lambda p: F.coalesce(p["bldg:BuildingPart"]["bldg:boundedBy"], none)
    parts = F.coalesce("bldg:consistsOfBuildingPart", F.array().cast(_PARTS))
    inner = F.flatten(F.transform(parts, lambda p: F.coalesce(p["bldg:BuildingPart"]["bldg:consistsOfBuildingPart"], F.array().cast(_PART))))
    b = b.select(F.col("_gml:id").alias("building_id"), F.concat(F.coalesce("bldg:boundedBy", none), F.flatten(F.transform(parts, faces)), F.flatten(F.transform(inner, faces))).alias("s"))
    b = b.select("building_id", F.explode("s").alias("s")).select("building_id", F.explode(F.array(*(F.struct(F.lit(k).alias("surface"), F.col("s")[f"bldg:{t}"].alias("f")) for t, k in SURFACES.items()))).alias("k"))
    b = b.select("building_id", "k.surface", F.explode(F.col("k.f")["bldg:lod2MultiSurface"]["gml:MultiSurface"]["gml:surfaceMember"]).alias("m")).select("building_id", "surface", F.col("m")["gml:Polygon"].alias("p"))
    b = b.withColumn("poly_no", F.monotonically_increasing_id())  # only tells faces apart
    text = lambda r: F.coalesce(r["gml:LinearRing"]["gml:posList"], F.array_join(r["gml:LinearRing"]["gml:pos"], " "))
    rings = F.concat(F.array(text(F.col("p")["gml:exterior"])), F.transform(F.coalesce(F.col("p")["gml:interior"], F.array().cast(f"array<{_RING}>")), text))
    b = b.select("building_id", "surface", "poly_no", F.posexplode(rings).alias("ring_no", "text"))
    return b.select("building_id", "surface", "poly_no", "ring_no", F.posexplode(parse_coords(F.col("text"))).alias("seq", "v")).select("building_id", "surface", "poly_no", "ring_no", "seq", "v.x", "v.y", "v.z")


def read_osm_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, lat, lon) of a map extract in XML; nodes without a place are dropped."""
    n = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lat double, _lon double").load(path)
    return n.select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).dropna()


def read_osm_ways(spark: SparkSession, path: str) -> DataFrame:
    """(way_id, tags, refs) of a map extract in XML."""
    w = spark.read.format("xml").option("rowTag", "way").schema("_id long, nd array<struct<_ref: long>>, tag array<struct<_k: string, _v: string>>").load(path)
    tags = F.map_from_entries(F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")))
    return w.select(F.col("_id").alias("way_id"), tags.alias("tags"), F.transform("nd", lambda r: r["_ref"]).alias("refs"))


def assemble_ways(ways: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(way_id, seq, lat, lon): the ways' nodes in order; unknown nodes are left out, then ways of fewer than ``least`` points."""
    p = ways.select("way_id", F.posexplode("refs").alias("seq", "node_id")).join(nodes, "node_id")
    enough = p.groupBy("way_id").count().where(F.col("count") >= least).select("way_id")
    return p.join(enough, "way_id", "left_semi").select("way_id", "seq", "lat", "lon")


def read_osm_relations(spark: SparkSession, path: str) -> DataFrame:
    """(relation_id, tags, seq, way_id, role) of the ways of a map extract's relations."""
    r = spark.read.format("xml").option("rowTag", "relation").schema("_id long, member array<struct<_type: string, _ref: long, _role: string>>, tag array<struct<_k: string, _v: string>>").load(path)
    tags = F.map_from_entries(F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")))
    m = r.select(F.col("_id").alias("relation_id"), tags.alias("tags"), F.posexplode("member").alias("seq", "m")).where("m._type = 'way'")
    return m.select("relation_id", "tags", "seq", F.col("m._ref").alias("way_id"), F.coalesce("m._role", F.lit("")).alias("role"))


def _closed(ways: list[list[tuple]]) -> list[list[tuple]]:
    """Rings of at least three points, from ways put end to end; what does not close is left out."""
    rings, left = [], [list(w) for w in ways if len(w) > 1]
    while left:
        ring = left.pop()
        while ring[0] != ring[-1]:
            k = next((k for k, w in enumerate(left) if ring[-1] in (w[0], w[-1])), None)
            if k is None:
                break
            w = left.pop(k)
            ring += w[1:] if w[0] == ring[-1] else w[-2::-1]
        if ring[0] == ring[-1] and len(ring) > 3:
            rings.append(ring[:-1])
    return rings


def _within(x: float, y: float, ring: list[tuple]) -> bool:
    inside = False
    for (x1, y1), (x0, y0) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if (y1 > y) != (y0 > y) and x < (x0 - x1) * (y - y1) / (y0 - y1) + x1:
            inside = not inside
    return inside


def osm_areas(ways: DataFrame, relations: DataFrame, nodes: DataFrame, wanted: Column) -> DataFrame:
    """Rings (area, ring_no, seq, lat, lon) of closed ways and of multipolygon relations whose tags are ``wanted``.

    ``area`` is ``w`` or ``r``, the id, and the number of the outer ring; an inner
    ring (from 1 on) belongs to the outer one that holds its first point. A group
    is one relation, so its size is that of an area.
    """
    closed = ways.where(wanted & (F.size("refs") > 3) & (F.get("refs", F.lit(0)) == F.element_at("refs", -1)))
    single = closed.select(F.concat(F.lit("w"), F.col("way_id")).alias("area"), F.lit(0).alias("part"), F.lit("outer").alias("role"), F.posexplode("refs").alias("seq", "node_id"))
    member = relations.where(wanted & (F.element_at("tags", "type") == "multipolygon")).drop("tags").join(ways.select("way_id", "refs"), "way_id")
    many = member.select(F.concat(F.lit("r"), F.col("relation_id")).alias("area"), F.col("seq").alias("part"), "role", F.posexplode("refs").alias("seq", "node_id"))
    points = single.unionByName(many).join(nodes, "node_id")

    def rings(pdf: pd.DataFrame) -> pd.DataFrame:
        ways_of: dict[bool, list] = {True: [], False: []}
        for (_, role), w in pdf.sort_values(["part", "seq"]).groupby(["part", "role"], sort=True):
            ways_of[role != "inner"].append(list(zip(w["lon"], w["lat"], strict=True)))
        outer, out = _closed(ways_of[True]), []
        holes: dict[int, list] = {k: [] for k in range(len(outer))}
        for hole in _closed(ways_of[False]):
            k = next((k for k, ring in enumerate(outer) if _within(*hole[0], ring)), None)
            if k is not None:
                holes[k].append(hole)
        for k, ring in enumerate(outer):
            for no, r in enumerate([ring, *holes[k]]):
                out += [(f"{pdf['area'].iloc[0]}_{k}", no, seq, lat, lon) for seq, (lon, lat) in enumerate(r)]
        return pd.DataFrame(out, columns=["area", "ring_no", "seq", "lat", "lon"])

    return points.groupBy("area").applyInPandas(rings, "area string, ring_no int, seq int, lat double, lon double")


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a map extract in XML: roads and rails (line_id, cls, seq, lat, lon), water lines alike, and water areas (see ``osm_areas``)."""
    nodes, ways = read_osm_nodes(spark, path), read_osm_ways(spark, path)
    kind = lines.road_class(F.col("tags"))
    water = F.when(F.coalesce(F.col("tags")["area"] != "yes", F.lit(True)) & F.col("tags")["waterway"].isin("river", "canal"), F.col("tags")["waterway"])
    area = F.coalesce(features.classify_water(F.col("tags")) == "polygon", F.lit(False))

    def assembled(cls: Column) -> DataFrame:
        known = ways.select("way_id", "refs", cls.alias("cls")).where("cls is not null")
        v = assemble_ways(known, nodes).join(known.select("way_id", "cls"), "way_id")
        return v.select(F.col("way_id").alias("line_id"), "cls", "seq", "lat", "lon")

    return assembled(kind), assembled(F.when(kind.isNull(), water)), osm_areas(ways, read_osm_relations(spark, path), nodes, area)


def read_boundary_poly(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of .poly files (path, ring_no, name, hole, seq, lon, lat); a ring's name with ``!`` in front marks a hole."""
    block = r"(?m)^[ \t]*(!?[^\s]+)[ \t]*\r?\n((?:[ \t]*[-+.\dEe]+[ \t]+[-+.\dEe]+[ \t]*\r?\n)+)[ \t]*END"
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), *(F.regexp_extract_all("value", F.lit(block), F.lit(k)).alias(c) for k, c in ((1, "names"), (2, "bodies"))))
    t = t.select("path", F.posexplode(F.arrays_zip("names", "bodies")).alias("ring_no", "r"))
    t = t.select("path", "ring_no", F.regexp_replace("r.names", "^!", "").alias("name"), F.col("r.names").startswith("!").alias("hole"), F.posexplode(F.split(F.trim(F.regexp_replace("r.bodies", r"\r", "")), r"\n")).alias("seq", "line")).where(F.trim("line") != "")
    number = lambda k: F.get(F.split(F.trim("line"), r"\s+"), F.lit(k)).try_cast("double")
    return t.select("path", "ring_no", "name", "hole", "seq", number(0).alias("lon"), number(1).alias("lat"))


def read_rgb_tiles(spark: SparkSession, path: str, size: int = 1024) -> DataFrame:
    """Pixels (path, ei, ni, prow, pcol, r, g, b) of image files, row 0 on top, as Spark's image source decodes them.

    The tile comes from a name like ``ortho_E_N.jpg``; null for other names.
    """
    place = lambda k: F.floor(F.regexp_extract("path", r"_(-?\d+)_(-?\d+)\.\w+$", k).try_cast("long") / size).cast("int")
    images = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").where("nChannels >= 3")

    def decode(batches):
        for pdf in batches:
            for path, height, width, channels, data in pdf.itertuples(index=False):
                row, col = np.divmod(np.arange(height * width, dtype=np.int32), width)
                bgr = np.frombuffer(data, np.uint8).reshape(-1, channels).astype(np.int32)
                yield pd.DataFrame({"path": path, "prow": row, "pcol": col, "r": bgr[:, 2], "g": bgr[:, 1], "b": bgr[:, 0]})

    px = images.mapInPandas(decode, "path string, prow int, pcol int, r int, g int, b int")
    return px.select("path", place(1).alias("ei"), place(2).alias("ni"), "prow", "pcol", "r", "g", "b")


def resume(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work whose output is not there yet."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def stale_inputs(spark: SparkSession, source: str, output: str) -> DataFrame:
    """(stem, path) of source files whose output is missing or older; contents are not read."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    files = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select(stem.alias("stem"), "path", F.col("modificationTime").alias("at"))
    made = files(output).groupBy("stem").agg(F.max("at").alias("made"))
    return files(source).join(made, "stem", "left").where("made is null or made < at").select("stem", "path")
