"""Tile, pixel, cell and detail-level arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 1024.0
#: By load radius, the rings (distance, level of detail); the last level is that of everything farther.
RINGS = {4: ((1, 0), (2, 1), (None, 2)), 15: ((1, 0), (2, 1), (4, 2), (None, 3)), 50: ((1, 0), (2, 1), (4, 2), (8, 3), (12, 4), (None, 6)), None: ((1, 0), (2, 1), (4, 2), (8, 3), (16, 4), (30, 6), (None, 8))}


def tile_of(x: Column, size: float = TILE) -> Column:
    """Index of the tile along one axis; floors, so negatives are right."""
    return F.floor(x / size).cast("int")


def tile_key(ei: Column, ni: Column) -> Column:
    """Two ints packed into one long."""
    return F.shiftleft(ei.cast("long"), 32).bitwiseOR(ni.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def tile_unkey(key: Column) -> tuple[Column, Column]:
    """The two ints of a packed key."""
    low = key.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(key, 32).cast("int"), F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def bbox_overlaps(l1, b1, r1, t1, l2, b2, r2, t2) -> Column:
    """Whether two half-open boxes (left, bottom, right, top) overlap."""
    return (r1 > l2) & (l1 < r2) & (t1 > b2) & (b1 < t2)


def snap_cell(e_km: Column, n_km: Column) -> tuple[Column, Column]:
    """Down to an odd easting and an even northing."""
    return e_km - F.when(F.pmod(e_km, F.lit(2)) == 0, 1).otherwise(0), n_km - F.pmod(n_km, F.lit(2))


def chebyshev(de: Column, dn: Column) -> Column:
    return F.greatest(F.abs(de), F.abs(dn))


def chunk_of(index: Column, span: int = 8) -> Column:
    return F.floor(index / span).cast("int")


def lod_for_distance(d: Column, load_radius: int) -> Column:
    """Level of detail at a distance in tiles."""
    rings = next(r for most, r in RINGS.items() if most is None or load_radius <= most)
    out = F.lit(rings[-1][1])
    for radius, lod in reversed(rings[:-1]):
        out = F.when(d <= radius, lod).otherwise(out)
    return out


def effective_lod(lod: Column, px: int, size: float = TILE) -> Column:
    """Fewer levels where pixels are coarser than a metre."""
    return F.greatest(F.lit(0), lod - F.round(F.log2(F.greatest(F.lit(size / (px - 1)), F.lit(1.0)))).cast("int"))


def mesh_vertices(lod: Column, px: int) -> Column:
    side = F.floor(F.lit(px - 1) / F.least(F.pow(F.lit(2.0), lod), F.lit(float(px - 1)))) + 1
    return (side * side).cast("long")


def ortho_pixels(lod: Column) -> Column:
    return F.when(lod >= 7, 64).when(lod >= 5, 256).otherwise(1024)


def ortho_mip(lod: Column) -> Column:
    """Which level of the colour pyramid a level of detail reads: the smallest from 7 on, else the full one."""
    return F.when(lod >= 7, 2).otherwise(0)


def chunk_resolution(d: Column, current: Column, slack: int = 4) -> Column:
    """Samples of a chunk by distance; it gets coarser only once the distance is ``slack`` tiles past the border, and finer at once."""
    wait = lambda held: F.when(current == held, slack).otherwise(0)
    return F.when(d <= 32 + wait(129), 129).when(d <= 64 + wait(65), 65).otherwise(33)


def pixel_place(e: Column, n: Column, px: int, size: float = TILE) -> tuple[Column, Column]:
    """Fractional (column, row) in a tile; column 0 is the east edge, row 0 the south edge."""
    lx, ly = e - F.floor(e / size) * size, n - F.floor(n / size) * size
    return (1 - lx / size) * (px - 1), ly / size * (px - 1)


def flip_axes(index: Column, px: int) -> Column:
    return px - 1 - index


def hash32(a: Column, b: Column) -> Column:
    """A uint32 mix of two ints, in a long; the product is split so that it stays below 2^63."""

    def times(x: Column, c: int) -> Column:
        high = (F.shiftright(x, 16) * c).bitwiseAND(F.lit(0xFFFF))
        return (high * 65536 + x.bitwiseAND(F.lit(0xFFFF)) * c).bitwiseAND(F.lit(0xFFFFFFFF))

    h = times(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 2_654_435_761).bitwiseXOR(times(b.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 2_246_822_519))
    return times(h.bitwiseXOR(F.shiftright(h, 15)), 3_266_489_917)


def grid_to_flat(e: Column, n: Column, origin_e: float, origin_n: float) -> tuple[Column, Column]:
    """Flat world with +x to the west and +z to the north."""
    return origin_e - e, n - origin_n


def flat_to_grid(x: Column, z: Column, origin_e: float, origin_n: float) -> tuple[Column, Column]:
    return origin_e - x, z + origin_n


def sag(dx: Column, dz: Column) -> Column:
    """How far the round earth falls below a plane at this offset."""
    return (dx * dx + dz * dz) / (2 * 6_371_000.0)


def crs_of_epsg(code: Column) -> Column:
    """LV95, or UTM with zone and hemisphere; null for other codes."""
    utm = lambda base, side: F.concat(F.lit("UTM"), (code - base).cast("string"), F.lit(side))
    return F.when(code == 2056, "LV95").when(code.between(32601, 32660), utm(32600, "N")).when(code.between(32701, 32760), utm(32700, "S")).when(code.between(25828, 25838), utm(25800, "N"))


def parse_epsg(text: Column) -> Column:
    """The number of ``EPSG:n`` or of a bare ``n``; null for other texts."""
    return F.regexp_extract(F.upper(F.trim(text)), r"^(?:EPSG:)?(\d{1,9})$", 1).try_cast("int")


def chunk_distance(ei: Column, ni: Column, cei: Column, cni: Column, span: int = 8) -> tuple[Column, Column]:
    """Chebyshev distance from a tile to the nearest and to the farthest tile of a chunk."""
    lo, hi = lambda c: c * span, lambda c: c * span + span - 1
    near = lambda t, c: F.greatest(lo(c) - t, t - hi(c), F.lit(0))
    far = lambda t, c: F.greatest(F.abs(t - lo(c)), F.abs(t - hi(c)))
    return F.greatest(near(ei, cei), near(ni, cni)), F.greatest(far(ei, cei), far(ni, cni))


def unpremultiply(value: Column, alpha: Column) -> Column:
    """A colour value before it was multiplied by a partial alpha."""
    return F.when((alpha > 0) & (alpha < 255), F.least(F.lit(255), F.floor(value * 255.0 / alpha + 0.5))).otherwise(value).cast("int")


def tile_file_name(ei: Column, ni: Column, size: int = 1024) -> Column:
    return F.format_string("tile_%d_%d.raw", ei.cast("long") * size, ni.cast("long") * size)


def parse_tile_name(name: Column) -> tuple[Column, Column]:
    part = lambda k: F.regexp_extract(name, r"tile_(-?\d+)_(-?\d+)", k).try_cast("long")
    return part(1), part(2)


def parse_cell_name(name: Column) -> tuple[Column, Column]:
    """(e_km, n_km) of a source cell's file name, as in ``.._32_495_5288_2_bw.zip``."""
    part = lambda k: F.regexp_extract(name, r"_32_(\d+)_(\d+)_2_bw", k).try_cast("int")
    return part(1), part(2)


def parse_lod_tile_id(stem: Column) -> Column:
    """Parts 3 and 4 of a name of five or more parts that starts with ``lod``; else the name itself."""
    parts = F.split(stem, "_")
    return F.when((F.size(parts) >= 5) & F.lower(stem).startswith("lod"), F.concat_ws("_", F.get(parts, F.lit(2)), F.get(parts, F.lit(3)))).otherwise(stem)


def source_url(base: str, pattern: str, e_km: Column, n_km: Column) -> Column:
    """Where a source cell's archive is; ``pattern`` has two %d."""
    return F.format_string(f"{base}/{pattern}.zip", e_km, n_km)
