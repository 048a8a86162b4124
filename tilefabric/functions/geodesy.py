"""Map projections as staged columns: each function takes and returns a DataFrame.

Intermediates are columns of their own stage, so expressions stay small.
Published formulas: Swiss oblique Mercator on the Bessel ellipsoid, three-parameter
datum shift, and the Krueger series for UTM. Angles are degrees at the interface.
"""

from __future__ import annotations

from math import asin, cos, log, pi, radians, sin, sqrt, tan

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WGS84, BESSEL = (6378137.0, 1 / 298.257223563), (6377397.155, 1 / 299.1528128)
SHIFT = (674.374, 15.056, 405.346)
PHI0, LAM0 = radians(46 + 57 / 60 + 8.66 / 3600), radians(7 + 26 / 60 + 22.5 / 3600)
_E2 = BESSEL[1] * (2 - BESSEL[1])
_E = sqrt(_E2)
ALPHA = sqrt(1 + _E2 / (1 - _E2) * cos(PHI0) ** 4)
B0 = asin(sin(PHI0) / ALPHA)
K = log(tan(pi / 4 + B0 / 2)) - ALPHA * log(tan(pi / 4 + PHI0 / 2)) + ALPHA * _E / 2 * log((1 + _E * sin(PHI0)) / (1 - _E * sin(PHI0)))
R = BESSEL[0] * sqrt(1 - _E2) / (1 - _E2 * sin(PHI0) ** 2)


def staged(df: DataFrame, **columns: str) -> DataFrame:
    """Adds SQL expressions one after another."""
    for name, text in columns.items():
        df = df.withColumn(name, F.expr(text))
    return df


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``columns`` behind a one-row explode, which filters of later joins do not pass.

    Else Catalyst writes the whole projection into each filter it pushes down.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("_s")).select(*rest, *(F.col(f"_s.{c}").alias(c) for c in columns))


def geodetic_to_ecef(df: DataFrame, lat: str, lon: str, h: str, ell=WGS84, out=("x", "y", "z")) -> DataFrame:
    a, f = ell
    e2 = f * (2 - f)
    df = staged(df, _p=f"radians({lat})", _l=f"radians({lon})", _n=f"{a!r}D / sqrt(1 - {e2!r}D * sin(_p) * sin(_p))")
    return staged(df, **{out[0]: f"(_n + {h}) * cos(_p) * cos(_l)", out[1]: f"(_n + {h}) * cos(_p) * sin(_l)", out[2]: f"(_n * {1 - e2!r}D + {h}) * sin(_p)"}).drop("_p", "_l", "_n")


def ecef_to_geodetic(df: DataFrame, x="x", y="y", z="z", ell=WGS84, out=("lat", "lon", "h"), steps: int = 4) -> DataFrame:
    """Latitude, longitude and height; the earth's centre gives (0, 0, -a)."""
    a, f = ell
    e2 = f * (2 - f)
    df = staged(df, _r=f"sqrt({x} * {x} + {y} * {y})", _p=f"atan2({z}, _r * {1 - e2!r}D)")
    for _ in range(steps):
        df = staged(df, _n=f"{a!r}D / sqrt(1 - {e2!r}D * sin(_p) * sin(_p))", _h="_r / cos(_p) - _n", _q=f"atan2({z}, _r * (1 - coalesce(try_divide({e2!r}D * _n, _n + _h), 0D)))").withColumn("_p", F.col("_q"))
    return staged(df, **{out[0]: "degrees(_p)", out[1]: f"degrees(atan2({y}, {x}))", out[2]: "_h"}).drop("_r", "_p", "_n", "_h", "_q")


def wgs84_to_ch1903plus(df: DataFrame, lat="lat", lon="lon", out=("ch_lat", "ch_lon")) -> DataFrame:
    """Datum shift to the Bessel ellipsoid; the ellipsoidal height is taken as 0."""
    df = geodetic_to_ecef(df, lat, lon, "0D", WGS84, ("_x", "_y", "_z"))
    df = staged(df, _x=f"_x - {SHIFT[0]}D", _y=f"_y - {SHIFT[1]}D", _z=f"_z - {SHIFT[2]}D")
    return ecef_to_geodetic(df, "_x", "_y", "_z", BESSEL, (*out, "_hh")).drop("_x", "_y", "_z", "_hh")


def ch1903plus_to_wgs84(df: DataFrame, lat="ch_lat", lon="ch_lon", out=("lat", "lon")) -> DataFrame:
    df = geodetic_to_ecef(df, lat, lon, "0D", BESSEL, ("_x", "_y", "_z"))
    df = staged(df, _x=f"_x + {SHIFT[0]}D", _y=f"_y + {SHIFT[1]}D", _z=f"_z + {SHIFT[2]}D")
    return ecef_to_geodetic(df, "_x", "_y", "_z", WGS84, (*out, "_hh")).drop("_x", "_y", "_z", "_hh")


def ch1903plus_to_lv95(df: DataFrame, lat="ch_lat", lon="ch_lon", e="e", n="n") -> DataFrame:
    """Swiss oblique Mercator."""
    sphere = f"{ALPHA!r}D * ln(tan({pi / 4!r}D + _f / 2)) - {ALPHA * _E / 2!r}D * ln((1 + {_E!r}D * sin(_f)) / (1 - {_E!r}D * sin(_f))) + {K!r}D"
    df = staged(df, _f=f"radians({lat})", _s=sphere, _b=f"2 * (atan(exp(_s)) - {pi / 4!r}D)", _d=f"{ALPHA!r}D * (radians({lon}) - {LAM0!r}D)")
    df = staged(df, _lb=f"atan2(sin(_d), {sin(B0)!r}D * tan(_b) + {cos(B0)!r}D * cos(_d))", _bb=f"asin({cos(B0)!r}D * sin(_b) - {sin(B0)!r}D * cos(_b) * cos(_d))")
    df = staged(df, **{e: f"{R!r}D * _lb + 2600000D", n: f"{R / 2!r}D * ln((1 + sin(_bb)) / (1 - sin(_bb))) + 1200000D"})
    return df.drop("_f", "_s", "_b", "_d", "_lb", "_bb")


def lv95_to_ch1903plus(df: DataFrame, e="e", n="n", out=("ch_lat", "ch_lon"), steps: int = 5) -> DataFrame:
    df = staged(df, _lb=f"({e} - 2600000D) / {R!r}D", _bb=f"2 * (atan(exp(({n} - 1200000D) / {R!r}D)) - {pi / 4!r}D)")
    df = staged(df, _b=f"asin({cos(B0)!r}D * sin(_bb) + {sin(B0)!r}D * cos(_bb) * cos(_lb))", _l=f"atan2(sin(_lb), {cos(B0)!r}D * cos(_lb) - {sin(B0)!r}D * tan(_bb))", _f="_b")
    df = staged(df, _s0=f"(ln(tan({pi / 4!r}D + _b / 2)) - {K!r}D) / {ALPHA!r}D")
    for _ in range(steps):
        df = staged(df, _s=f"_s0 + {_E!r}D * ln(tan({pi / 4!r}D + asin({_E!r}D * sin(_f)) / 2))", _f=f"2 * atan(exp(_s)) - {pi / 2!r}D")
    df = staged(df, **{out[0]: "degrees(_f)", out[1]: f"degrees({LAM0!r}D + _l / {ALPHA!r}D)"})
    return df.drop("_lb", "_bb", "_b", "_l", "_f", "_s0", "_s")


def wgs84_to_lv95(df: DataFrame, lat="lat", lon="lon", e="e", n="n") -> DataFrame:
    """Adds LV95 coordinates; the ellipsoidal height is taken as 0."""
    return ch1903plus_to_lv95(wgs84_to_ch1903plus(df, lat, lon, ("_la", "_lo")), "_la", "_lo", e, n).drop("_la", "_lo")


def lv95_to_wgs84(df: DataFrame, e="e", n="n", lat="lat", lon="lon") -> DataFrame:
    return ch1903plus_to_wgs84(lv95_to_ch1903plus(df, e, n, ("_la", "_lo")), "_la", "_lo", (lat, lon)).drop("_la", "_lo")


def _krueger() -> tuple[float, float, tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    a, f = WGS84
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    return n, radius, alpha, beta, delta


def wgs84_to_utm(df: DataFrame, zone: int = 32, lat="lat", lon="lon", e="ue", n="un") -> DataFrame:
    third, radius, alpha, _, _ = _krueger()
    c = 2 * sqrt(third) / (1 + third)
    df = staged(df, _f=f"radians({lat})", _l=f"radians({lon} - {6 * zone - 183}D)", _t=f"sinh(atanh(sin(_f)) - {c!r}D * atanh({c!r}D * sin(_f)))", _xi="atan2(_t, cos(_l))", _eta="atanh(sin(_l) / sqrt(1 + _t * _t))")
    east = " + ".join(f"{a!r}D * cos({2 * j}D * _xi) * sinh({2 * j}D * _eta)" for j, a in enumerate(alpha, 1))
    north = " + ".join(f"{a!r}D * sin({2 * j}D * _xi) * cosh({2 * j}D * _eta)" for j, a in enumerate(alpha, 1))
    k = 0.9996 * radius
    return staged(df, **{e: f"500000D + {k!r}D * (_eta + {east})", n: f"{k!r}D * (_xi + {north}) + if({lat} < 0, 10000000D, 0D)"}).drop("_f", "_l", "_t", "_xi", "_eta")


def utm_to_wgs84(df: DataFrame, zone: int = 32, e="ue", n="un", lat="lat", lon="lon", south: bool = False) -> DataFrame:
    _, radius, _, beta, delta = _krueger()
    k = 0.9996 * radius
    df = staged(df, _x=f"({n} - {10_000_000.0 if south else 0.0}D) / {k!r}D", _y=f"({e} - 500000D) / {k!r}D")
    xi = " - ".join(["_x", *(f"{b!r}D * sin({2 * j}D * _x) * cosh({2 * j}D * _y)" for j, b in enumerate(beta, 1))])
    eta = " - ".join(["_y", *(f"{b!r}D * cos({2 * j}D * _x) * sinh({2 * j}D * _y)" for j, b in enumerate(beta, 1))])
    df = staged(df, _xi=xi, _eta=eta, _c="asin(sin(_xi) / cosh(_eta))")
    phi = " + ".join(["_c", *(f"{d!r}D * sin({2 * j}D * _c)" for j, d in enumerate(delta, 1))])
    return staged(df, **{lat: f"degrees({phi})", lon: f"{6 * zone - 183}D + degrees(atan2(sinh(_eta), cos(_xi)))"}).drop("_x", "_y", "_xi", "_eta", "_c")


def utm32_to_lv95(df: DataFrame, ue="ue", un="un", e="e", n="n") -> DataFrame:
    ll = settled(utm_to_wgs84(df, 32, ue, un, "_ga", "_go"), "_ga", "_go")
    return settled(wgs84_to_lv95(ll, "_ga", "_go", e, n).drop("_ga", "_go"), e, n)


def lv95_to_utm32(df: DataFrame, e="e", n="n", ue="ue", un="un") -> DataFrame:
    ll = settled(lv95_to_wgs84(df, e, n, "_ga", "_go"), "_ga", "_go")
    return settled(wgs84_to_utm(ll, 32, "_ga", "_go", ue, un).drop("_ga", "_go"), ue, un)


def utm_zone(lon):
    """Zone of a longitude column, 1..60."""
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6).cast("int") + 1))


def convergence(df: DataFrame, lat="lat", lon="lon", out="convergence", to_grid=wgs84_to_lv95, step: float = 1e-4) -> DataFrame:
    """Adds the bearing of true north from grid north in degrees, from a short step to the north.

    ``to_grid(df, lat, lon, e, n)`` adds coordinates of those names.
    """
    for k, sign in enumerate("-+"):
        df = to_grid(df.withColumn("_at", F.expr(f"{lat} {sign} {step!r}D")), "_at", lon, f"_e{k}", f"_n{k}")
        df = settled(df, f"_e{k}", f"_n{k}")
    return staged(df, **{out: "degrees(atan2(_e1 - _e0, _n1 - _n0))"}).drop("_at", "_e0", "_n0", "_e1", "_n1")


def grid_to_ecef(df: DataFrame, e="e", n="n", h="h", out=("x", "y", "z")) -> DataFrame:
    """Geocentric position of a grid point at a height, which counts as ellipsoidal."""
    ll = settled(lv95_to_wgs84(df, e, n, "_ga", "_go"), "_ga", "_go")
    return geodetic_to_ecef(ll, "_ga", "_go", h, WGS84, out).drop("_ga", "_go")


def ecef_to_grid(df: DataFrame, x="x", y="y", z="z", e="e", n="n", h="h") -> DataFrame:
    """The grid point under a geocentric position, and its height (the world height)."""
    ll = settled(ecef_to_geodetic(df, x, y, z, WGS84, ("_ga", "_go", h)), "_ga", "_go", h)
    return wgs84_to_lv95(ll, "_ga", "_go", e, n).drop("_ga", "_go")


def wun_axes(df: DataFrame, e="e", n="n", out=("west", "up", "north")) -> DataFrame:
    """Unit vectors (arrays x, y, z) to the west, up and to the north at a grid point."""
    df = settled(lv95_to_wgs84(df, e, n, "_ga", "_go"), "_ga", "_go")
    df = staged(df, _sl="sin(radians(_ga))", _cl="cos(radians(_ga))", _so="sin(radians(_go))", _co="cos(radians(_go))")
    return staged(df, **{out[0]: "array(_so, -_co, 0D)", out[1]: "array(_cl * _co, _cl * _so, _sl)", out[2]: "array(-_sl * _co, -_sl * _so, _cl)"}).drop("_ga", "_go", "_sl", "_cl", "_so", "_co")


def grid_scale_at(df: DataFrame, e="e", n="n", out=("xx", "xz", "zx", "zz"), step: float = 100.0) -> DataFrame:
    """What a metre of grid is in true metres west and north: columns (xx, xz) of a step west and (zx, zz) of a step north.

    Numerical, over ``step`` metres; the part along the vertical is left out.
    """
    df = df.withColumns({"_zero": F.lit(0.0), "_e1": F.expr(f"{e} + {step!r}D"), "_n1": F.expr(f"{n} + {step!r}D")})
    for k, (a, b) in enumerate(((e, n), ("_e1", n), (e, "_n1"))):
        df = settled(grid_to_ecef(df, a, b, "_zero", (f"_x{k}", f"_y{k}", f"_z{k}")), f"_x{k}", f"_y{k}", f"_z{k}")
    df = settled(wun_axes(df, e, n, ("_w", "_u", "_v")), "_w", "_v").drop("_u")
    along = lambda k, axis, sign: sign + "(" + " + ".join(f"(_{c}{k} - _{c}0) * {axis}[{i}]" for i, c in enumerate("xyz")) + f") / {step!r}D"
    df = staged(df, **{out[0]: along(1, "_w", "-"), out[1]: along(1, "_v", "-"), out[2]: along(2, "_w", ""), out[3]: along(2, "_v", "")})
    return df.drop("_zero", "_e1", "_n1", "_w", "_v", *(f"_{c}{k}" for c in "xyz" for k in range(3)))


def wgs84_to_world(df: DataFrame, lat="lat", lon="lon", h="h", mode="flat", origin=(2_600_000.0, 1_200_000.0), out=("x", "y", "z")) -> DataFrame:
    """World position: ``flat`` with x to the west of the origin, y up and z to the north, or ``ecef``."""
    df = settled(wgs84_to_lv95(df, lat, lon, "_we", "_wn"), "_we", "_wn")
    if mode == "ecef":
        return grid_to_ecef(df, "_we", "_wn", h, out).drop("_we", "_wn")
    return staged(df, **{out[0]: f"{origin[0]!r}D - _we", out[1]: h, out[2]: f"_wn - {origin[1]!r}D"}).drop("_we", "_wn")


def world_to_wgs84(df: DataFrame, x="x", y="y", z="z", mode="flat", origin=(2_600_000.0, 1_200_000.0), out=("lat", "lon", "h")) -> DataFrame:
    """The inverse; the height is that above the ellipsoid in both modes."""
    if mode == "ecef":
        df = settled(ecef_to_grid(df, x, y, z, "_we", "_wn", out[2]), "_we", "_wn", out[2])
    else:
        df = staged(df, _we=f"{origin[0]!r}D - {x}", _wn=f"{z} + {origin[1]!r}D", **{out[2]: y})
    return lv95_to_wgs84(df, "_we", "_wn", out[0], out[1]).drop("_we", "_wn")


def transform_bbox(boxes: DataFrame, keys: list[str], to, box=("left", "bottom", "right", "top"), densify: int = 21, pad: float = 0.0) -> DataFrame:
    """The boxes (keys, left, bottom, right, top) around the reprojected outlines of ``boxes``, ``pad`` wider on each side.

    ``densify`` points divide each edge; ``to`` adds te and tn to columns fe and fn.
    """
    l, b, r, t = (F.col(c) for c in box)
    k = F.col("_k") / float(densify + 1)
    edges = F.array(*(F.struct(x.alias("fe"), y.alias("fn")) for x, y in ((l + (r - l) * k, b), (l + (r - l) * k, t), (l, b + (t - b) * k), (r, b + (t - b) * k))))
    p = boxes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(densify + 1)))).select(*keys, F.explode(edges).alias("p")).select(*keys, "p.fe", "p.fn")
    out = to(p).groupBy(*keys).agg(F.min("te").alias("_l"), F.min("tn").alias("_b"), F.max("te").alias("_r"), F.max("tn").alias("_t"))
    return out.select(*keys, (F.col("_l") - pad).alias(box[0]), (F.col("_b") - pad).alias(box[1]), (F.col("_r") + pad).alias(box[2]), (F.col("_t") + pad).alias(box[3]))
