"""Readers and writers of tile files: binary files are decoded in tasks, batch by batch."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"tile_(-?\d+)_(-?\d+)\.raw$"
PIXELS = "path string, ei int, ni int, prow int, pcol int, h float"


#: Tiles that a reader can be asked for by name.
NAMED = 5_000


def _files(spark: SparkSession, path: str, glob: str, tiles: list[tuple[int, int]] | None = None, name: str = "", size: int = 1024) -> DataFrame:
    """Files below ``path``; where ``tiles`` are given, the listing keeps only theirs, so no other file is opened."""
    if tiles is not None:
        if len(tiles) > NAMED:
            raise ValueError(f"{len(tiles)} tiles by name; read all and join instead of naming more than {NAMED}")
        glob = "{" + ",".join(name % (e * size, n * size) for e, n in tiles) + ("}" if tiles else "no tile}")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def read_height_tiles(spark: SparkSession, path: str, px: int, size: int = 1024, tiles: list[tuple[int, int]] | None = None) -> DataFrame:
    """Pixels of headerless float32 tiles; files of another size are left out. E and N come from the name; only ``tiles`` (ei, ni), if given."""
    files = _files(spark, path, "*.raw", tiles, "tile_%d_%d.raw", size).where(F.col("length") == px * px * 4)
    place = lambda k: F.floor(F.regexp_extract("path", NAME, k).cast("long") / size).cast("int")
    files = files.where(F.col("path").rlike(NAME)).select("path", place(1).alias("ei"), place(2).alias("ni"), "content")

    def decode(batches):
        row, col = np.divmod(np.arange(px * px, dtype=np.int32), px)
        for pdf in batches:
            for path, ei, ni, content in pdf.itertuples(index=False):
                yield pd.DataFrame({"path": path, "ei": ei, "ni": ni, "prow": row, "pcol": col, "h": np.frombuffer(content, "<f4")})

    return files.mapInPandas(decode, PIXELS)


def read_heightmap_v2(spark: SparkSession, path: str, tiles: list[tuple[int, int]] | None = None, size: int = 1024) -> DataFrame:
    """Pixels of tiles with a header of two uint32, width and height; files of another length are left out. Only ``tiles`` (ei, ni), if given."""
    files = _files(spark, path, "*.raw", tiles, "tile_%d_%d.raw", size).select("path", "content")

    def decode(batches):
        for pdf in batches:
            for path, content in pdf.itertuples(index=False):
                w, h = struct.unpack_from("<II", content) if len(content) >= 8 else (0, 0)
                if w * h and len(content) == 8 + 4 * w * h:
                    row, col = np.divmod(np.arange(w * h, dtype=np.int32), w)
                    yield pd.DataFrame({"path": path, "prow": row.astype(np.int32), "pcol": col.astype(np.int32), "h": np.frombuffer(content, "<f4", offset=8)})

    return files.mapInPandas(decode, "path string, prow int, pcol int, h float")


TREES = "path string, tile_e double, tile_n double, idx int, dx float, dz float, ground_z float, height_m float, yaw_rad float, crown_radius_m float"


def read_tree_points(spark: SparkSession, path: str, tiles: list[tuple[int, int]] | None = None, size: int = 1024) -> DataFrame:
    """Records of VEG1 files; a bad magic, version or length leaves the file out. Only ``tiles`` (ei, ni), if given."""
    files = _files(spark, path, "*.veg", tiles, "vegetation_%d_%d.veg", size).select("path", "content")

    def decode(batches):
        names = ["dx", "dz", "ground_z", "height_m", "yaw_rad", "crown_radius_m"]
        for pdf in batches:
            for path, content in pdf.itertuples(index=False):
                if len(content) < 32 or content[:4] != b"VEG1":
                    continue
                version, count, _, e, n = struct.unpack_from("<IIIdd", content, 4)
                if version != 1 or len(content) < 32 + 24 * count:
                    continue
                rows = np.frombuffer(content, "<f4", 6 * count, 32).reshape(-1, 6)
                yield pd.DataFrame(rows, columns=names).assign(path=path, tile_e=e, tile_n=n, idx=np.arange(count, dtype=np.int32))[["path", "tile_e", "tile_n", "idx", *names]]

    return files.mapInPandas(decode, TREES)


def read_xyz(spark: SparkSession, path: str, step: float = 1.0) -> DataFrame:
    """Points (path, x, y, z, col, row) of text grids of ``x y z``: the cell of ``step`` metres from each file's north-west point.

    Lines that hold no three numbers are skipped; a point's cell is the nearest.
    """
    part = lambda k: F.get(F.split(F.trim("value"), r"[\s,;]+"), F.lit(k)).try_cast("double")
    p = spark.read.text(path).select(F.input_file_name().alias("path"), part(0).alias("x"), part(1).alias("y"), part(2).alias("z")).dropna()
    corner = p.groupBy("path").agg(F.min("x").alias("_x"), F.max("y").alias("_y"))
    cell = lambda d: F.floor(d / step + 0.5).cast("int")
    return p.join(corner, "path").select("path", "x", "y", "z", cell(F.col("x") - F.col("_x")).alias("col"), cell(F.col("_y") - F.col("y")).alias("row"))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (e_km, n_km, status) of ``e n [status]`` lines; comments and bad rows are skipped."""
    line = F.regexp_replace("value", "#.*", "")
    part = lambda k: F.regexp_extract(line, r"^\s*(-?\d+)\s+(-?\d+)(?:\s+(\d+))?\s*$", k)
    t = spark.read.text(path).select(part(1).alias("e"), part(2).alias("n"), part(3).alias("s"))
    return t.where("e <> ''").select(F.col("e").cast("int").alias("e_km"), F.col("n").cast("int").alias("n_km"), F.expr("try_cast(nullif(s, '') as int)").alias("status")).distinct()


def write_cells(cells: DataFrame, path: str) -> None:
    """Writes distinct (e_km, n_km, status) as sorted ``e n [status]`` lines, in as many files as there are ranges."""
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("e_km", "n_km", "status")))
    rows = cells.where("e_km is not null and n_km is not null").select("e_km", "n_km", "status").distinct()
    rows.orderBy("e_km", "n_km", "status").select(line.alias("value")).write.text(path)


def filter_crs(manifests: DataFrame, epsg: int = 2056, text: str = "crs") -> DataFrame:
    """Sources whose ``text`` declares another EPSG code go; those that declare none stay."""
    code = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)epsg\D{0,3}(\d+)", 1)
    return manifests.where((code == "") | code.try_cast("int").eqNullSafe(epsg))


def read_tile_index(spark: SparkSession, path: str) -> DataFrame:
    """(e, n, kind) of ``E N f|v`` lines; others are skipped."""
    part = lambda k: F.regexp_extract("value", r"^\s*(-?\d+)\s+(-?\d+)\s+([fv])\s*$", k)
    return spark.read.text(path).select(part(1).alias("e"), part(2).alias("n"), part(3).alias("kind")).where("kind <> ''").withColumns({"e": F.col("e").cast("int"), "n": F.col("n").cast("int")})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per tile of a JSON manifest; missing header keys get defaults."""
    schema = "conversion_origin_e double, conversion_origin_n double, tile_size_m double, elevation_baked boolean, tiles map<string, struct<file: string, tile_e: int, tile_n: int, center_e: double, center_n: double>>"
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m")).select("m.*")
    head = [F.coalesce("conversion_origin_e", F.lit(0.0)).alias("origin_e"), F.coalesce("conversion_origin_n", F.lit(0.0)).alias("origin_n"), F.coalesce("tile_size_m", F.lit(1024.0)).alias("tile_size_m"), F.coalesce("elevation_baked", F.lit(False)).alias("elevation_baked")]
    return m.select(*head, F.explode("tiles").alias("tile_id", "t")).select("origin_e", "origin_n", "tile_size_m", "elevation_baked", "tile_id", "t.*")


#: By product: the pattern of its files' names, and whether they name tiles (in metres) or source cells (in km).
PRODUCTS = {"height": (NAME, "tile"), "ortho": (r"ortho_(-?\d+)_(-?\d+)\.jpg$", "tile"), "vegetation": (r"vegetation_(-?\d+)_(-?\d+)\.(?:veg|bin)$", "tile"), "buildings": (r"buildings_(-?\d+)_(-?\d+)\.glb$", "cell"), "archive": (r"_32_(\d+)_(\d+)_2_bw\.zip$", "cell")}


def inventory(spark: SparkSession, path: str, size: int = 1024, product: str = "height") -> DataFrame:
    """Tiles (ei, ni) or cells (e_km, n_km) there by file name; tiles that are not on the grid are ignored. File contents are not read."""
    pattern, kind = PRODUCTS[product]
    part = lambda k: F.regexp_extract("path", pattern, k).cast("long")
    t = _files(spark, path, "*").where(F.col("path").rlike(pattern)).select(part(1).alias("e"), part(2).alias("n"))
    if kind == "cell":
        return t.select(F.col("e").cast("int").alias("e_km"), F.col("n").cast("int").alias("n_km")).distinct()
    return t.where((F.col("e") % size == 0) & (F.col("n") % size == 0)).select((F.col("e") / size).cast("int").alias("ei"), (F.col("n") / size).cast("int").alias("ni")).distinct()
