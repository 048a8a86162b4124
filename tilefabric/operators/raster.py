"""Height and colour rasters as long pixel tables: lookup, mosaic, gap filling, pyramids, quality.

A pixel table has (ei, ni, prow, pcol, h); 0 is no data at rest and null inside.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilefabric.functions.grid import TILE, pixel_place, tile_of, unpremultiply

TILE_KEY = ["ei", "ni"]
PIXEL = ["ei", "ni", "prow", "pcol"]


def packed(height: DataFrame, px: int, by=("ei", "ni")) -> DataFrame:
    """(ei, ni, tile), or other columns ``by`` that name a tile: each tile's heights as one array, row by row; null where a pixel has no row.

    A pixel has one value (a mosaic's, not several sources'). This is the form to
    keep rasters in that are sampled often; what samples takes either form.
    """
    h = height.select(*by, (F.col("prow") * px + F.col("pcol")).alias("i"), F.col("h").cast("double").alias("h"))
    t = h.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("p"))
    none = lambda n: F.array_repeat(F.lit(None).cast("double"), n.cast("int"))
    after = F.concat(F.transform(F.slice("p", 2, px * px), lambda x: x["i"]), F.array(F.lit(px * px)))
    holed = F.transform(F.arrays_zip(F.col("p").alias("p"), after.alias("next")), lambda z: F.concat(F.array(z["p"]["h"]), none(z["next"] - z["p"]["i"] - 1)))
    holed = F.concat(none(F.col("p")[0]["i"]), F.flatten(holed))
    whole = F.transform("p", lambda x: x["h"])
    return t.select(*by, F.when(F.size("p") == px * px, whole).otherwise(holed).alias("tile"))


def placed(points: DataFrame, px: int, mode: str, size: float) -> tuple[DataFrame, Callable[[str], Column]]:
    """``points`` with their tile (ei, ni) and place in it, and what to read from an array of heights there, by its column."""
    p = points.withColumns({"ei": tile_of(F.col("e"), size), "ni": tile_of(F.col("n"), size)})
    if mode == "nearest":
        step = size / px
        lx, ly = F.col("e") - F.col("ei") * size, F.col("n") - F.col("ni") * size
        p = p.withColumns({"_c": px - 1 - F.least(F.floor(lx / step), F.lit(px - 1)).cast("int"), "_r": F.least(F.floor(ly / step), F.lit(px - 1)).cast("int")})

        def read(tile: str) -> Column:
            h = F.get(tile, F.col("_r") * px + F.col("_c"))
            return F.when(h != 0, h)

        return p, read
    col, row = pixel_place(F.col("e"), F.col("n"), px, size)
    p = p.withColumns({"_c": col, "_r": row}).withColumns({"_c0": F.floor("_c").cast("int"), "_r0": F.floor("_r").cast("int")})
    p = p.withColumns({"_fc": F.col("_c") - F.col("_c0"), "_fr": F.col("_r") - F.col("_r0")})

    def read(tile: str) -> Column:
        at = lambda dc, dr: F.get(tile, F.least(F.col("_r0") + dr, F.lit(px - 1)) * px + F.least(F.col("_c0") + dc, F.lit(px - 1)))
        share = lambda dc, dr: (F.col("_fc") if dc else 1 - F.col("_fc")) * (F.col("_fr") if dr else 1 - F.col("_fr"))
        corners = [(c, r) for r in (0, 1) for c in (0, 1)]
        h = sum((at(*k) * share(*k) for k in corners[1:]), at(0, 0) * share(0, 0))
        return F.when(F.greatest(*(F.abs(at(*k)) for k in corners)) > 0, h) if mode == "zero_aware" else h

    return p, read


def _tiles(height: DataFrame, px: int) -> DataFrame:
    return height if "tile" in height.columns else packed(height, px)


def sample_height(points: DataFrame, height: DataFrame, keys: list[str], px: int, mode: str = "bilinear", size: float = TILE) -> DataFrame:
    """Height at points (e, n), as column ``h``; null where a tile or one of the pixels is absent.

    ``bilinear`` weighs the four corners; ``zero_aware`` gives null if all four
    are 0; ``nearest`` truncates to a pixel and gives null for 0. ``height`` is a
    pixel table or ``packed``; one join by tile, then reads from the tile's array.
    """
    p, read = placed(points, px, mode, size)
    return p.join(_tiles(height, px), TILE_KEY, "left").select(*keys, read("tile").alias("h"))


def sample_height_any(points: DataFrame, fine: DataFrame, coarse: DataFrame, keys: list[str], px: int, size: float = TILE) -> DataFrame:
    """From the finer raster where it has the tile, else from the coarser; both joins are by tile, so points move once."""
    p, read = placed(points, px, "bilinear", size)
    both = p.join(_tiles(fine, px).withColumnRenamed("tile", "_fine"), TILE_KEY, "left").join(_tiles(coarse, px).withColumnRenamed("tile", "_coarse"), TILE_KEY, "left")
    return both.select(*keys, F.when(F.col("_fine").isNotNull(), read("_fine")).otherwise(read("_coarse")).alias("h"))


def valid(h: Column) -> Column:
    return F.when(h != 0, h)


def mosaic(px: DataFrame, rule: str, priority: str = "source", quality: str | None = None) -> DataFrame:
    """One height a pixel from several sources: ``first`` or ``last`` with data, or ``best`` quality (earlier wins ties)."""
    value = F.col("h")
    p = px.where("h <> 0")
    if rule == "best":
        chosen = F.max_by(value, F.struct(F.col(quality), -F.col(priority)))
    else:
        chosen = F.min_by(value, F.col(priority)) if rule == "first" else F.max_by(value, F.col(priority))
    return p.groupBy(*PIXEL).agg(chosen.alias("h"))


def mosaic_rgb(px: DataFrame, priority: str = "source") -> DataFrame:
    """One colour a pixel: that of the greatest coverage ``q`` (0..255), the earlier source on ties.

    A colour of partial coverage was darkened by it and is restored first; pixels
    without coverage anywhere go.
    """
    colour = F.struct(*(unpremultiply(F.col(c), F.col("q")).alias(c) for c in "rgb"), F.col("q").cast("int").alias("q"))
    best = px.where("q > 0").groupBy(*PIXEL).agg(F.max_by(colour, F.struct("q", -F.col(priority))).alias("o"))
    return best.select(*PIXEL, "o.r", "o.g", "o.b", "o.q")


def first_source_wins(px: DataFrame, priority: str = "source") -> DataFrame:
    """The first source that has a tile at all supplies the whole tile; tiles without data go."""
    tile = px.groupBy(*TILE_KEY, priority).agg(F.max(F.abs("h")).alias("_m")).groupBy(*TILE_KEY).agg(F.min_by(F.struct(priority, "_m"), priority).alias("_s"))
    return px.join(tile.where("_s._m > 0").select(*TILE_KEY, F.col(f"_s.{priority}").alias(priority)), [*TILE_KEY, priority])


def valid_fraction(px: DataFrame, by=("ei", "ni")) -> DataFrame:
    return px.groupBy(*by).agg(F.avg(F.when(F.col("h") != 0, 1.0).otherwise(0.0)).alias("fraction"))


def fill_gaps_idw(px: DataFrame, max_dist: int | None = None, bands=("h",), known: Column | None = None) -> DataFrame:
    """No data from the nearest valid sample on each side, in the row and in the column, weighted by inverse distance.

    All ``bands`` are filled together; ``known`` tells pixels with data, by default those whose height is valid.
    """
    known = valid(F.col("h")).isNotNull() if known is None else known
    out = px.withColumn("v", F.when(known, F.struct(*bands)))
    for along, across in (("pcol", "prow"), ("prow", "pcol")):
        w = Window.partitionBy(*TILE_KEY, across).orderBy(along)
        seen = F.when(F.col("v").isNotNull(), F.struct("v", along))
        for name, side in (("back", F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, -1))), ("fore", F.first(seen, True).over(w.rowsBetween(1, Window.unboundedFollowing)))):
            near = side if max_dist is None else F.when(F.abs(F.col(along) - side[along]) <= max_dist, side)
            out = out.withColumn(f"_{along}_{name}", near).withColumn(f"_{along}_{name}_d", F.abs(F.col(along) - F.col(f"_{along}_{name}")[along]).cast("double"))
    sides = ["_pcol_back", "_pcol_fore", "_prow_back", "_prow_fore"]
    top = lambda b: sum((F.coalesce(F.col(s)["v"][b] / F.col(f"{s}_d"), F.lit(0.0)) for s in sides), F.lit(0.0))
    low = sum((F.coalesce(1 / F.col(f"{s}_d"), F.lit(0.0)) for s in sides), F.lit(0.0))
    return out.select(*PIXEL, *(F.coalesce(F.col("v")[b], F.when(low > 0, top(b) / low)).alias(b) for b in bands))


def fill_gaps_sweep(px: DataFrame) -> DataFrame:
    """Carries valid samples along rows both ways, then along columns both ways, each seeing the result before."""
    out = px.withColumn("h", valid(F.col("h")))
    for across, along in (("prow", "pcol"), ("pcol", "prow")):
        for order in (F.asc(along), F.desc(along)):
            w = Window.partitionBy(*TILE_KEY, across).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
            out = out.withColumn("h", F.last("h", True).over(w))
    return out.select(*PIXEL, "h")


def slope_normals(px: DataFrame, step: float) -> DataFrame:
    """Unit normal from central differences, clamped at the edges."""
    out = px
    for axis, across in (("pcol", "prow"), ("prow", "pcol")):
        w = Window.partitionBy(*TILE_KEY, across).orderBy(axis)
        out = out.withColumn(f"_d{axis}", F.coalesce(F.lead("h").over(w), F.col("h")) - F.coalesce(F.lag("h").over(w), F.col("h")))
    length = F.sqrt(F.col("_dpcol") * F.col("_dpcol") + F.col("_dprow") * F.col("_dprow") + (2 * step) ** 2)
    return out.select(*PIXEL, (-F.col("_dpcol") / length).alias("nx"), (F.lit(2 * step) / length).alias("ny"), (-F.col("_dprow") / length).alias("nz"))


def mip_pyramid(px: DataFrame, factor: int, values=("h",)) -> DataFrame:
    """Box means over factor x factor pixels."""
    shrunk = px.withColumns({"prow": F.floor(F.col("prow") / factor).cast("int"), "pcol": F.floor(F.col("pcol") / factor).cast("int")})
    return shrunk.groupBy(*PIXEL).agg(*(F.avg(v).alias(v) for v in values))


def window_means(px: DataFrame, size: int, windows: Callable[[int, int], pd.DataFrame], names: dict[str, str]) -> DataFrame:
    """Means of the heights in windows of each tile: (names, h), from the tile's summed areas.

    ``windows(ei, ni)`` gives a tile's windows: first and last row and column, both
    included (r0, r1, c0, c1), and the columns of ``names`` (name: type). A group is
    one tile, so its size is that of a tile; whatever the windows' size, a mean is
    four reads of the sums and four of the counts. A window without any pixel has no
    row, one whose pixels are all null (or not finite) a null mean. A window of one
    pixel gives that pixel as it is. Pixels without a tile or a place in it go.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["prow"].to_numpy() + 1, pdf["pcol"].to_numpy() + 1
        value = pdf["h"].to_numpy(float, na_value=np.nan)
        known = np.isfinite(value)
        own = np.zeros((3, size + 1, size + 1))  # heights, pixels with a height, pixels
        for layer, weight in zip(own, (np.where(known, value, 0.0), known, np.ones(len(pdf))), strict=True):
            np.add.at(layer, at, weight)
        summed = own.cumsum(1).cumsum(2)
        w = windows(*key)
        r0, r1, c0, c1 = (w[c].to_numpy() for c in ("r0", "r1", "c0", "c1"))
        total, n, there = summed[:, r1 + 1, c1 + 1] - summed[:, r0, c1 + 1] - summed[:, r1 + 1, c0] + summed[:, r0, c0]
        total = np.where((r0 == r1) & (c0 == c1), own[0, r1 + 1, c1 + 1], total)
        mean = np.full(len(w), np.nan)
        np.divide(total, n, out=mean, where=n > 0.5)
        out = w[list(names)].assign(h=pd.Series(mean, dtype="Float64").mask(np.isnan(mean)))
        return out[there > 0.5]

    rows = px.select(*PIXEL, F.col("h").cast("double").alias("h")).dropna(subset=PIXEL)
    return rows.groupBy(*TILE_KEY).applyInPandas(run, ", ".join(f"{c} {t}" for c, t in {**names, "h": "double"}.items()))


def lod_downsample(px: DataFrame, size: int, stride: int) -> DataFrame:
    """Samples every ``stride`` pixels: border samples as they are, inner ones the mean of a centred window."""
    half, last = stride // 2, size - 1

    def windows(ei: int, ni: int) -> pd.DataFrame:
        row, col = (k.ravel() for k in np.meshgrid(*(np.arange(0, size, stride),) * 2, indexing="ij"))
        reach = np.where((row == 0) | (row == last) | (col == 0) | (col == last), 0, half)
        w = {"ei": ei, "ni": ni, "prow": row, "pcol": col}
        for a, at in (("r", row), ("c", col)):
            w |= {f"{a}0": np.maximum(at - reach, 0), f"{a}1": np.minimum(at + reach, last)}
        return pd.DataFrame(w)

    return window_means(px, size, windows, {"ei": "int", "ni": "int", "prow": "int", "pcol": "int"})


def fill_from_coarser(fine: DataFrame, coarse: DataFrame, px: int, coarse_px: int) -> DataFrame:
    """No data of the finer raster from the coarser, bilinear over its non-zero neighbours only; 0 where all of those have no weight.

    The coarser raster is joined as one array a tile. The four neighbours are added
    row by row, always in this order: a mean that is halfway between two rounded
    values comes out the same each time.
    """
    k = (coarse_px - 1) / (px - 1)
    inside = coarse.where(F.col("prow").between(0, coarse_px - 1) & F.col("pcol").between(0, coarse_px - 1))
    near = fine.join(packed(inside, coarse_px).withColumnRenamed("tile", "_coarse"), TILE_KEY, "left")
    near = near.withColumns({"_x": F.col("pcol") * k, "_y": F.col("prow") * k})
    at = lambda c, d: F.least(F.floor(c).cast("int") + d, F.lit(coarse_px - 1))
    share = lambda c, d: F.col(c) % 1 if d else 1 - F.col(c) % 1
    total = weight = F.lit(0.0)
    for dr, dc in ((0, 0), (0, 1), (1, 0), (1, 1)):
        h = F.when((F.col("pcol") >= 0) & (F.col("prow") >= 0), F.get("_coarse", at("_y", dr) * coarse_px + at("_x", dc)))
        w = share("_x", dc) * share("_y", dr)
        total, weight = (s + F.when(h != 0, x).otherwise(0.0) for s, x in ((total, h * w), (weight, w)))
    filled = F.coalesce(total / F.nullif(weight, F.lit(0.0)), F.lit(0.0))
    return near.select(*PIXEL, F.when(F.col("h") != 0, F.col("h")).otherwise(F.when(F.col("h") == 0, filled).otherwise(0.0)).alias("h"))


def no_data_weight(r: Column, g: Column, b: Column) -> Column:
    """1 where near white or near black, 0 where not, with ramps 200..250 and 14..6 between."""
    low, high = F.least(r, g, b), F.greatest(r, g, b)
    ramp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return F.greatest(ramp((low - 200) / 50.0), ramp((14 - high) / 8.0))


def mean_color(rgb: DataFrame, by=("ei", "ni")) -> DataFrame:
    """Mean colour of the real pixels, and whether at least a tenth are real."""
    real = no_data_weight(F.col("r"), F.col("g"), F.col("b")) < 1
    return rgb.groupBy(*by).agg(*(F.avg(F.when(real, F.col(c))).alias(c) for c in "rgb"), F.count_if(real).alias("valid"), (F.count_if(real) * 10 >= F.count("*")).alias("kept"))


def fill_gaps_neighbours(px: DataFrame, tile=("ei", "ni"), at=("prow", "pcol")) -> DataFrame:
    """Missing pixels become the mean of the valid ones among their eight neighbours, again and again until a pass fills nothing.

    What is left is 0. A group is one tile (or chunk), so its size is that of a
    tile; all its passes run in one task without another shuffle.
    """

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = (pdf[c].to_numpy() for c in at)
        shape = int(row.max()) + 3, int(col.max()) + 3
        h, known, there = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        value = pdf["h"].to_numpy(float, na_value=0.0)
        h[row + 1, col + 1], known[row + 1, col + 1], there[row + 1, col + 1] = value, value != 0, True
        around = [(slice(1 + r, shape[0] - 1 + r), slice(1 + c, shape[1] - 1 + c)) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]
        inner = slice(1, -1), slice(1, -1)
        while True:
            near = sum(known[k].astype(int) for k in around)
            new = there[inner] & ~known[inner] & (near > 0)
            if not new.any():
                break
            total = sum(h[k] for k in around)
            h[inner][new] = total[new] / near[new]
            known[inner][new] = True
        return pdf.assign(h=h[row + 1, col + 1])

    rows = px.select(*tile, *at, F.col("h").cast("double").alias("h"))
    return rows.groupBy(*tile).applyInPandas(fill, rows.schema)


def merge_rgb(px: DataFrame, priority: str = "source") -> DataFrame:
    """Sources in priority order; each lower one blends into what is no data in the result so far."""
    stack = F.array_sort(F.collect_list(F.struct(priority, "r", "g", "b")))
    merged = px.groupBy(*PIXEL).agg(stack.alias("s"))

    def blend(acc: Column, low: Column) -> Column:
        w = no_data_weight(acc["r"], acc["g"], acc["b"])
        return F.struct(*(F.floor(acc[c] * (1 - w) + low[c] * w + 0.5).cast("int").alias(c) for c in "rgb"))

    first = F.struct(*(F.col("s")[0][c].cast("int").alias(c) for c in "rgb"))
    out = merged.withColumn("o", F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), first, blend))
    return out.select(*PIXEL, "o.r", "o.g", "o.b")


def chunk_composite(px: DataFrame, size: int, res: int, tiles: int = 8) -> DataFrame:
    """Chunks of tiles x tiles as res x res samples: the mean of the non-zero pixels in a window around each sample.

    A sample lies in one tile (the last one at the far edges); its window stays in
    it. Samples without data are filled from their neighbours, then 0.
    """
    half = min(8, size // (res - 1) // 2)
    k = np.arange(res)
    place = k / float(res - 1) * tiles
    t = np.minimum(np.floor(place), tiles - 1).astype(int)
    centre = np.floor((place - t) * (size - 1) + 0.5).astype(int)

    def windows(ei: int, ni: int) -> pd.DataFrame:
        """The samples in this tile; columns run against the tiles."""
        cy, cx = (i.ravel() for i in np.meshgrid(k[t == ni % tiles], k[tiles - 1 - t == ei % tiles], indexing="ij"))
        w = {"cei": ei // tiles, "cni": ni // tiles, "cx": cx, "cy": cy}
        for a, at in (("r", centre[cy]), ("c", centre[cx])):
            w |= {f"{a}0": np.maximum(at - half, 0), f"{a}1": np.minimum(at + half, size - 1)}
        return pd.DataFrame(w)

    found = window_means(px.where("h <> 0"), size, windows, {"cei": "int", "cni": "int", "cx": "int", "cy": "int"})
    each = F.sequence(F.lit(0), F.lit(res - 1))
    lattice = px.select(F.floor(F.col("ei") / tiles).cast("int").alias("cei"), F.floor(F.col("ni") / tiles).cast("int").alias("cni")).distinct()
    lattice = lattice.withColumn("cx", F.explode(each)).withColumn("cy", F.explode(each))
    return fill_gaps_neighbours(lattice.join(found, lattice.columns, "left"), ("cei", "cni"), ("cy", "cx"))


def pixel_centres(px: DataFrame, size: int, tile: float = TILE) -> DataFrame:
    """Adds e, n of pixel centres; column 0 is at the east edge, row 0 at the south edge."""
    step = tile / size
    return px.withColumns({"e": (F.col("ei") + 1) * tile - (F.col("pcol") + 0.5) * step, "n": F.col("ni") * tile + (F.col("prow") + 0.5) * step})


def pixel_nodes(px: DataFrame, size: int, tile: float = TILE) -> DataFrame:
    """Adds e, n of pixels as nodes of a lattice that reaches the tile's edges."""
    step = tile / (size - 1)
    return px.withColumns({"e": (F.col("ei") + 1) * tile - F.col("pcol") * step, "n": F.col("ni") * tile + F.col("prow") * step})


def reproject_raster(target: DataFrame, height: DataFrame, to_source, keys: list[str], px: int) -> DataFrame:
    """Heights (keys, h) at target pixels (ue, un): ``to_source`` adds e, n in the raster's system; null outside it."""
    return sample_height(to_source(target), height, keys, px)


def fill_rgb_nearest(rgb: DataFrame) -> DataFrame:
    """No data of colour tiles from the nearest real pixel by city-block distance, fading to the tile's mean colour.

    The fade ends max(2, side / 32) pixels away. A group is one tile, so its size
    is that of a tile. Tiles without any real pixel stay as they are.
    """
    kept = no_data_weight(F.col("r"), F.col("g"), F.col("b")) <= 0.5

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["prow", "pcol"], ignore_index=True)
        rows, cols = int(pdf["prow"].max()) + 1, int(pdf["pcol"].max()) + 1
        place = pdf["prow"].to_numpy() * cols + pdf["pcol"].to_numpy()
        real = np.zeros(rows * cols, bool)
        real[place] = pdf["_real"]
        colour = np.zeros((rows * cols, 3))
        colour[place] = pdf[["r", "g", "b"]]
        if real.any() and not real.all():
            far, x = rows + cols, np.arange(cols)
            dist, src = np.full((rows, cols), far), np.zeros((rows, cols), np.int64)
            for y, line in enumerate(real.reshape(rows, cols)):
                at = np.flatnonzero(line)
                if len(at):  # the nearest real column of the row, left or right
                    k = np.searchsorted(at, x)
                    left, right = at[np.maximum(k - 1, 0)], at[np.minimum(k, len(at) - 1)]
                    near = np.where(np.abs(x - left) <= np.abs(right - x), left, right)
                    dist[y], src[y] = np.abs(x - near), y * cols + near
            for order in (range(1, rows), range(rows - 2, -1, -1)):
                for y in order:
                    z = y - 1 if order.step == 1 else y + 1
                    closer = dist[z] + 1 < dist[y]
                    dist[y], src[y] = np.where(closer, dist[z] + 1, dist[y]), np.where(closer, src[z], src[y])
            t = np.minimum(1.0, dist.ravel() / max(2, min(rows, cols) // 32))[:, None]
            blend = np.floor(colour[src.ravel()] * (1 - t) + colour[real].mean(axis=0) * t + 0.5)
            colour = np.where(real[:, None], colour, blend)
        out = pdf[PIXEL].copy()
        out[["r", "g", "b"]] = colour[place].astype("int32")
        return out

    tiles = rgb.select(*PIXEL, *(F.col(c).cast("int").alias(c) for c in "rgb"), kept.alias("_real")).groupBy(*TILE_KEY)
    return tiles.applyInPandas(fill, "ei int, ni int, prow int, pcol int, r int, g int, b int")
