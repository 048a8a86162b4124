"""Queries of the projections' single steps and of the world frame, with SQL twins built stage by stage."""

from __future__ import annotations

from math import cos, pi, sin, sqrt

from pyspark.sql import functions as F

from tilefabric.functions import geodesy

from .queries import PX, QUERIES, _number, query, rounded  # noqa: F401

N = _number


def stages(rows: str, **columns: str) -> str:
    """``rows`` with SQL expressions added one after another."""
    for name, text in columns.items():
        rows = f"(SELECT *, {text} AS {name} FROM {rows})"
    return rows


def ecef_sql(rows: str, lat: str, lon: str, h: str, ell, x: str, y: str, z: str) -> str:
    a, f = ell
    e2 = f * (2 - f)
    v = f"({N(a)} / sqrt(1 - {N(e2)} * sin(radians({lat})) * sin(radians({lat}))))"
    return stages(rows, **{x: f"({v} + {h}) * cos(radians({lat})) * cos(radians({lon}))", y: f"({v} + {h}) * cos(radians({lat})) * sin(radians({lon}))", z: f"({v} * {N(1 - e2)} + {h}) * sin(radians({lat}))"})


def geodetic_sql(rows: str, x: str, y: str, z: str, ell, lat: str, lon: str, h: str, tag: str) -> str:
    a, f = ell
    e2 = f * (2 - f)
    rows = stages(rows, **{f"r{tag}": f"sqrt({x} * {x} + {y} * {y})", f"p{tag}0": f"atan2({z}, r{tag} * {N(1 - e2)})"})
    for k in range(4):
        v = f"({N(a)} / sqrt(1 - {N(e2)} * sin(p{tag}{k}) * sin(p{tag}{k})))"
        rows = stages(rows, **{f"v{tag}{k}": v, f"p{tag}{k + 1}": f"atan2({z}, r{tag} * (1 - {N(e2)} * v{tag}{k} / (r{tag} / cos(p{tag}{k}))))"})
    return stages(rows, **{lat: f"degrees(p{tag}4)", lon: f"degrees(atan2({y}, {x}))", h: f"r{tag} / cos(p{tag}3) - v{tag}3"})


def shift_sql(rows: str, lat: str, lon: str, out: tuple[str, str], tag: str, back: bool = False) -> str:
    """WGS84 to the Bessel ellipsoid, or back."""
    one, other = (geodesy.BESSEL, geodesy.WGS84) if back else (geodesy.WGS84, geodesy.BESSEL)
    rows = ecef_sql(rows, lat, lon, "0e0", one, f"x{tag}", f"y{tag}", f"z{tag}")
    moved = {f"{c}s{tag}": f"{c}{tag} {'+' if back else '-'} {d}e0" for c, d in zip("xyz", geodesy.SHIFT, strict=True)}
    return geodetic_sql(stages(rows, **moved), f"xs{tag}", f"ys{tag}", f"zs{tag}", other, *out, f"h{tag}", tag)


def mercator_sql(rows: str, lat: str, lon: str, e: str, n: str, tag: str) -> str:
    g = geodesy
    sphere = f"{N(g.ALPHA)} * ln(tan({N(pi / 4)} + radians({lat}) / 2)) - {N(g.ALPHA * g._E / 2)} * ln((1 + {N(g._E)} * sin(radians({lat}))) / (1 - {N(g._E)} * sin(radians({lat})))) + {N(g.K)}"
    rows = stages(rows, **{f"b{tag}": f"2 * (atan(exp({sphere})) - {N(pi / 4)})", f"d{tag}": f"{N(g.ALPHA)} * (radians({lon}) - {N(g.LAM0)})"})
    rows = stages(rows, **{f"m{tag}": f"atan2(sin(d{tag}), {N(sin(g.B0))} * tan(b{tag}) + {N(cos(g.B0))} * cos(d{tag}))", f"q{tag}": f"asin({N(cos(g.B0))} * sin(b{tag}) - {N(sin(g.B0))} * cos(b{tag}) * cos(d{tag}))"})
    return stages(rows, **{e: f"{N(g.R)} * m{tag} + 2600000", n: f"{N(g.R / 2)} * ln((1 + sin(q{tag})) / (1 - sin(q{tag}))) + 1200000"})


def inverse_sql(rows: str, e: str, n: str, lat: str, lon: str, tag: str) -> str:
    g = geodesy
    rows = stages(rows, **{f"m{tag}": f"({e} - 2600000) / {N(g.R)}", f"q{tag}": f"2 * (atan(exp(({n} - 1200000) / {N(g.R)})) - {N(pi / 4)})"})
    rows = stages(rows, **{f"f{tag}0": f"asin({N(cos(g.B0))} * sin(q{tag}) + {N(sin(g.B0))} * cos(q{tag}) * cos(m{tag}))", f"l{tag}": f"atan2(sin(m{tag}), {N(cos(g.B0))} * cos(m{tag}) - {N(sin(g.B0))} * tan(q{tag}))"})
    rows = stages(rows, **{f"s{tag}": f"(ln(tan({N(pi / 4)} + f{tag}0 / 2)) - {N(g.K)}) / {N(g.ALPHA)}"})
    for k in range(5):
        rows = stages(rows, **{f"f{tag}{k + 1}": f"2 * atan(exp(s{tag} + {N(g._E)} * ln(tan({N(pi / 4)} + asin({N(g._E)} * sin(f{tag}{k})) / 2)))) - {N(pi / 2)}"})
    return stages(rows, **{lat: f"degrees(f{tag}5)", lon: f"degrees({N(g.LAM0)} + l{tag} / {N(g.ALPHA)})"})


def to_lv95(rows: str, lat: str, lon: str, e: str, n: str, tag: str) -> str:
    return mercator_sql(shift_sql(rows, lat, lon, (f"la{tag}", f"lo{tag}"), tag), f"la{tag}", f"lo{tag}", e, n, f"g{tag}")


def from_lv95(rows: str, e: str, n: str, lat: str, lon: str, tag: str) -> str:
    return shift_sql(inverse_sql(rows, e, n, f"la{tag}", f"lo{tag}", f"i{tag}"), f"la{tag}", f"lo{tag}", (lat, lon), tag, True)


def to_utm(rows: str, lat: str, lon: str, e: str, n: str, tag: str, zone: int = 32) -> str:
    third, radius, alpha, _, _ = geodesy._krueger()
    c, k = 2 * sqrt(third) / (1 + third), 0.9996 * radius
    rows = stages(rows, **{f"t{tag}": f"sinh(atanh(sin(radians({lat}))) - {N(c)} * atanh({N(c)} * sin(radians({lat}))))", f"xi{tag}": f"atan2(t{tag}, cos(radians({lon} - {6 * zone - 183})))", f"et{tag}": f"atanh(sin(radians({lon} - {6 * zone - 183})) / sqrt(1 + t{tag} * t{tag}))"})
    east = "".join(f" + {N(a)} * cos({2 * j} * xi{tag}) * sinh({2 * j} * et{tag})" for j, a in enumerate(alpha, 1))
    north = "".join(f" + {N(a)} * sin({2 * j} * xi{tag}) * cosh({2 * j} * et{tag})" for j, a in enumerate(alpha, 1))
    return stages(rows, **{e: f"500000 + {N(k)} * (et{tag}{east})", n: f"{N(k)} * (xi{tag}{north}) + CASE WHEN {lat} < 0 THEN 10000000 ELSE 0 END"})


LATLON = "(SELECT fix_id, 45.9e0 + (fix_id % 1000) / 500e0 AS lat, 6e0 + (track_id % 100) / 25e0 AS lon, 300e0 + fix_id % 700 AS h FROM fx_fix)"


def _latlon(fix):
    return fix.select("fix_id", (45.9 + (F.col("fix_id") % 1000) / 500).alias("lat"), (6.0 + (F.col("track_id") % 100) / 25).alias("lon"), (300.0 + F.col("fix_id") % 700).alias("h"))


@query("SELECT fix_id, round(a, 9) AS ch_lat, round(o, 9) AS ch_lon, round(e, 3) AS e, round(n, 3) AS n, round(a2, 9) AS back_lat, round(o2, 9) AS back_lon, round(la, 8) AS lat, round(lo, 8) AS lon FROM "
       + shift_sql(inverse_sql(mercator_sql(shift_sql(LATLON, "lat", "lon", ("a", "o"), "k"), "a", "o", "e", "n", "u"), "e", "n", "a2", "o2", "w"), "a2", "o2", ("la", "lo"), "j", True), "fx_fix")
def ch1903plus_steps(fix):
    """The datum shift and the projection by themselves, and back."""
    df = geodesy.settled(geodesy.wgs84_to_ch1903plus(_latlon(fix)), "ch_lat", "ch_lon")
    df = geodesy.settled(geodesy.ch1903plus_to_lv95(df), "e", "n")
    df = geodesy.settled(geodesy.lv95_to_ch1903plus(df, out=("back_lat", "back_lon")), "back_lat", "back_lon")
    df = geodesy.ch1903plus_to_wgs84(df, "back_lat", "back_lon", ("la", "lo"))
    df = df.select("fix_id", "ch_lat", "ch_lon", "e", "n", "back_lat", "back_lon", F.col("la").alias("lat"), F.col("lo").alias("lon"))
    return rounded(rounded(rounded(df, 9, "ch_lat", "ch_lon", "back_lat", "back_lon"), 3, "e", "n"), 8, "lat", "lon")


@query("SELECT fix_id, round(degrees(atan2(e1 - e0, n1 - n0)), 5) AS lv95, round(degrees(atan2(ue1 - ue0, un1 - un0)), 5) AS utm32 FROM "
       + to_utm(to_utm(to_lv95(to_lv95(stages(LATLON, south="lat - 0.0001e0", north="lat + 0.0001e0"), "south", "lon", "e0", "n0", "a"), "north", "lon", "e1", "n1", "b"), "south", "lon", "ue0", "un0", "c"), "north", "lon", "ue1", "un1", "d"), "fx_fix")
def convergence(fix):
    df = geodesy.settled(geodesy.convergence(_latlon(fix), out="lv95"), "lv95")
    df = geodesy.convergence(df, out="utm32", to_grid=lambda d, lat, lon, e, n: geodesy.wgs84_to_utm(d, 32, lat, lon, e, n))
    return rounded(df.select("fix_id", "lv95", "utm32"), 5, "lv95", "utm32")


@query("SELECT fix_id, round(ue, 3) AS ue, round(un, 3) AS un, round(south_un, 3) AS south_un, CAST(least(60, greatest(1, floor((lon * 50 - 400 + 180) / 6) + 1)) AS INTEGER) AS zone FROM "
       + to_utm(to_utm(stages(LATLON, south="-lat"), "lat", "lon", "ue", "un", "a"), "south", "lon", "x", "south_un", "b"), "fx_fix")
def utm_forward(fix):
    """Forward Krueger series on both hemispheres, and the zone of longitudes far beyond it."""
    df = geodesy.settled(geodesy.wgs84_to_utm(_latlon(fix)), "ue", "un")
    df = geodesy.wgs84_to_utm(df.withColumn("south", -F.col("lat")), 32, "south", "lon", "x", "south_un")
    return rounded(df.select("fix_id", "ue", "un", "south_un", geodesy.utm_zone(F.col("lon") * 50 - 400).alias("zone")), 3, "ue", "un", "south_un")


GRID = "(SELECT fix_id, e, n, 300e0 + fix_id % 700 AS h FROM fx_fix)"


def _grid(fix):
    return fix.select("fix_id", "e", "n", (300.0 + F.col("fix_id") % 700).alias("h"))


@query("SELECT fix_id, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(e2, 3) AS e2, round(n2, 3) AS n2, round(h2, 3) AS h2 FROM "
       + to_lv95(geodetic_sql(ecef_sql(from_lv95(GRID, "e", "n", "lat", "lon", "a"), "lat", "lon", "h", geodesy.WGS84, "x", "y", "z"), "x", "y", "z", geodesy.WGS84, "lat2", "lon2", "h2", "b"), "lat2", "lon2", "e2", "n2", "c"), "fx_fix")
def frame_ecef(fix):
    """Grid points in the geocentric frame, and the grid and world height of those positions."""
    df = geodesy.settled(geodesy.grid_to_ecef(_grid(fix)), "x", "y", "z")
    df = geodesy.ecef_to_grid(df, e="e2", n="n2", h="h2")
    return rounded(df.select("fix_id", "x", "y", "z", "e2", "n2", "h2"), 3, "x", "y", "z", "e2", "n2", "h2")


AXES = {"wx": "sin(radians(lon))", "wy": "-cos(radians(lon))", "ux": "cos(radians(lat)) * cos(radians(lon))", "uy": "cos(radians(lat)) * sin(radians(lon))", "uz": "sin(radians(lat))", "nx": "-sin(radians(lat)) * cos(radians(lon))", "ny": "-sin(radians(lat)) * sin(radians(lon))", "nz": "cos(radians(lat))"}


@query("SELECT fix_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in AXES) + " FROM " + stages(from_lv95(GRID, "e", "n", "lat", "lon", "a"), **AXES), "fx_fix")
def wun_axes(fix):
    df = geodesy.wun_axes(_grid(fix))
    at = {"w": "west", "u": "up", "n": "north"}
    return df.select("fix_id", *(F.round(F.col(at[c[0]])["xyz".index(c[1])], 9).alias(c) for c in AXES))


def _scale_sql() -> str:
    rows = stages("(SELECT fix_id, e, n, e + 100 AS e1, n + 100 AS n1 FROM fx_fix)", nought="0e0")
    for k, (a, b) in enumerate((("e", "n"), ("e1", "n"), ("e", "n1"))):
        rows = ecef_sql(from_lv95(rows, a, b, f"lat{k}", f"lon{k}", f"k{k}"), f"lat{k}", f"lon{k}", "nought", geodesy.WGS84, f"x{k}", f"y{k}", f"z{k}")
    rows = stages(rows, **{c: text.replace("(lat)", "(lat0)").replace("(lon)", "(lon0)") for c, text in AXES.items() if c[0] != "u"})
    west, north = (lambda k: f"((x{k} - x0) * wx + (y{k} - y0) * wy) / 100"), (lambda k: f"((x{k} - x0) * nx + (y{k} - y0) * ny + (z{k} - z0) * nz) / 100")
    return f"SELECT fix_id, round(-{west(1)}, 6) + 0e0 AS xx, round(-{north(1)}, 5) + 0e0 AS xz, round({west(2)}, 5) + 0e0 AS zx, round({north(2)}, 6) + 0e0 AS zz FROM {rows}"


@query(_scale_sql(), "fx_fix")
def grid_scale(fix):
    s = geodesy.grid_scale_at(_grid(fix)).select("fix_id", "xx", "xz", "zx", "zz")
    s = rounded(rounded(s, 6, "xx", "zz"), 5, "xz", "zx")
    return s.withColumns({c: F.col(c) + 0.0 for c in ("xx", "xz", "zx", "zz")})


@query("SELECT fix_id, round(2600000 - e, 3) AS x, h AS y, round(n - 1200000, 3) AS z, round(lat2, 8) AS lat2, round(lon2, 8) AS lon2, h AS h2, round(x3, 3) AS x3, round(y3, 3) AS y3, round(z3, 3) AS z3 FROM "
       + ecef_sql(from_lv95(to_lv95(LATLON, "lat", "lon", "e", "n", "a"), "e", "n", "lat2", "lon2", "b"), "lat2", "lon2", "h", geodesy.WGS84, "x3", "y3", "z3"), "fx_fix")
def world_positions(fix):
    """Geodetic positions in the flat world and back, and in the geocentric one."""
    df = geodesy.settled(geodesy.wgs84_to_world(_latlon(fix)), "x", "y", "z")
    df = geodesy.settled(geodesy.world_to_wgs84(df, out=("lat2", "lon2", "h2")), "lat2", "lon2", "h2")
    df = geodesy.wgs84_to_world(df, mode="ecef", out=("x3", "y3", "z3"))
    out = df.select("fix_id", "x", "y", "z", "lat2", "lon2", "h2", "x3", "y3", "z3")
    return rounded(rounded(out, 3, "x", "z", "x3", "y3", "z3"), 8, "lat2", "lon2")


OUTLINE = """(SELECT ei, ni, CASE side WHEN 0 THEN (ei + k / 22e0) * 1024e0 WHEN 1 THEN (ei + k / 22e0) * 1024e0 WHEN 2 THEN ei * 1024e0 ELSE (ei + 1) * 1024e0 END AS e,
CASE side WHEN 0 THEN ni * 1024e0 WHEN 1 THEN (ni + 1) * 1024e0 ELSE (ni + k / 22e0) * 1024e0 END AS n FROM (SELECT DISTINCT ei, ni FROM fx_height_px), range(0, 23) r(k), range(0, 4) s(side))"""


@query("SELECT ei, ni, round(min(ue) - 200, 2) AS \"left\", round(min(un) - 200, 2) AS bottom, round(max(ue) + 200, 2) AS \"right\", round(max(un) + 200, 2) AS top FROM "
       + to_utm(from_lv95(OUTLINE, "e", "n", "lat", "lon", "a"), "lat", "lon", "ue", "un", "b") + " GROUP BY ALL", "fx_height_px")
def transform_bbox(px):
    """The box of each tile's outline in UTM 32, 200 metres wider."""
    t = px.select("ei", "ni").distinct()
    boxes = t.select("ei", "ni", (F.col("ei") * 1024.0).alias("left"), (F.col("ni") * 1024.0).alias("bottom"), ((F.col("ei") + 1) * 1024.0).alias("right"), ((F.col("ni") + 1) * 1024.0).alias("top"))
    out = geodesy.transform_bbox(boxes, ["ei", "ni"], lambda p: geodesy.lv95_to_utm32(p, "fe", "fn", "te", "tn"), pad=200.0)
    return rounded(out, 2, "left", "bottom", "right", "top")
