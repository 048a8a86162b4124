"""Geodata views derived from the relational test tables by plain SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "supplier")

FIXTURES = {
    "fx_fix": """
select user_id as track_id, event_id as fix_id, ts,
       2600000e0 + user_id * 100e0 + value * 10e0 as e,
       1200000e0 + (event_id * 37 % 16384) + value as n
from events
""",
    "fx_height_px": """
select s.source, cast(2539 + t.tile % 8 as int) as ei, cast(1171 + floor(t.tile / 8e0) as int) as ni,
       t.prow, t.pcol,
       case when s.source = 0 then (case when t.ck % 7 = 0 then 0e0 else 300e0 + t.tp / 1000e0 end)
            else (case when t.ck % 5 = 0 then 0e0 else 310e0 + t.tp / 1000e0 end) end as h
from (select cast(floor(o_orderkey / 256e0) as int) as tile,
             cast(floor((o_orderkey % 256) / 16e0) as int) as prow,
             cast(o_orderkey % 16 as int) as pcol, o_custkey as ck, o_totalprice as tp
      from orders) t
cross join (select 0 as source union all select 1 as source) s
""",
    "fx_tile_present": """
select distinct cast(o_custkey as int) as ei, cast(o_orderkey % 31 as int) as ni
from orders
""",
    "fx_line_vertex": """
select f.user_id as line_id, f.seq, f.e, f.n,
       case f.user_id % 4 when 0 then 'primary' when 1 then 'residential' when 2 then 'railway:rail' else 'track' end as cls
from (select user_id, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as seq,
             2600137e0 + user_id * 100e0 + value * 10e0 as e,
             1200061e0 + (event_id * 37 % 16384) + value as n
      from events) f
""",
    "fx_ring_vertex": """
select p.c_custkey as poly_id, v.ring_no, v.seq, p.c_custkey % 13 as kind,
       2600000e0 + p.c_custkey * 10e0 + v.dx * (0.125e0 + (p.c_custkey % 5) * 0.0625e0) as e,
       1200000e0 + (p.c_custkey * 7 % 33) * 500e0 + v.dy * (0.125e0 + (p.c_custkey % 5) * 0.0625e0) as n
from customer p cross join (
  select 0 as ring_no, 0 as seq, 2000e0 as dx, 0e0 as dy union all
  select 0, 1, 1000e0, 1700e0 union all select 0, 2, -1000e0, 1700e0 union all
  select 0, 3, -2000e0, 0e0 union all select 0, 4, -1000e0, -1700e0 union all
  select 0, 5, 1000e0, -1700e0 union all
  select 1, 0, 500e0, 500e0 union all select 1, 1, -500e0, 500e0 union all
  select 1, 2, -500e0, -500e0 union all select 1, 3, 500e0, -500e0) v
""",
    "fx_probe": """
select l_shipdate as ts,
       389 + 2 * (l_partkey % 40) as e_km, 5262 + 2 * (l_suppkey % 30) as n_km,
       case when l_quantity % 10 = 0 then 0 when l_returnflag = 'R' then 404 else 200 end as status
from lineitem
""",
    "fx_zone": """
select s_suppkey as zone_id, s_suppkey % 3 as min_dir,
       2600000e0 + s_suppkey * 150e0 as e, 1200000e0 + (s_suppkey % 16) * 1000e0 as n, 300e0 + s_nationkey * 10e0 as r
from supplier
""",
    "fx_box": """
select p_partkey as building_id, 2600000e0 + p_partkey * 7.5e0 as x0, 1200000e0 + (p_partkey * 29 % 16000) as y0,
       400e0 + p_size as z0, p_size * 0.5e0 as w, p_size * 0.25e0 as d, 3e0 + p_size as hgt
from part
""",
}

#: Where ``CROWDED`` puts what ``FIXTURES`` puts farther east with each key.
_PLACES = {
    "2600000e0 + user_id * 100e0": "2600000e0 + (user_id % 50) * 400e0",
    "2600137e0 + user_id * 100e0": "2600000e0 + (user_id % 50) * 400e0",
    "1200061e0": "1200000e0",
    "p.c_custkey * 10e0": "(p.c_custkey % 40) * 500e0",
    "s_suppkey * 150e0": "(s_suppkey % 20) * 1000e0",
}


def _crowded(text: str) -> str:
    for wide, narrow in _PLACES.items():
        text = text.replace(wide, narrow)
    return text


#: The same views in an area that stays 20 km wide, so that all of a larger table still meets, and meets more.
CROWDED = {name: _crowded(text) for name, text in FIXTURES.items()}


def view(spark: SparkSession, sf_dir: str, name: str, fixtures: dict[str, str] = FIXTURES) -> DataFrame:
    """A fixture as a DataFrame; only the columns it names are read."""
    text = fixtures[name]
    for t in TABLES:
        text = text.replace(f"from {t}", f"from parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)


def with_views(sql: str, fixtures: dict[str, str] = FIXTURES) -> str:
    """The query with the fixtures that it names as common table expressions."""
    used = [n for n in fixtures if n in sql]
    return "WITH " + ",\n".join([*(f"{n} AS ({fixtures[n].strip()})" for n in used), "q AS (" + sql.strip() + ")"]) + "\nSELECT * FROM q"
