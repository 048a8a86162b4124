"""Embedding near-dedup by lattice hashing.

Vectors are compared within a label. Equal vectors are one class. In each of
several tables a class representative's unit vector is projected to ``k`` times
eight dimensions (orthonormal random directions), scaled, and each eight are
decoded to the nearest point of the lattice E8; the ``k`` points together are its
home cell. It also probes the cells that are nearest after it: those that differ
in the cheapest of the 240 neighbours of the points. Two vectors meet in a cell
if it is home to one of them and home to, or probed by, the other; cosines in
double precision decide. No pair below the threshold is linked.

``level`` picks ``k`` (2 to 4), the cells' size, the probes and the tables by the number of
vectors that are compared with each other, so that an unrelated vector is met
about as often however many there are: cells shrink as the data grow, and tables
make up for what finer cells miss. Tests find more than 0.999 of the pairs at
10,000 and 40,000 vectors, and more than 0.998 of pairs at cosine 0.981 at the
finer levels of 10^6 and 10^10.

A pair that meets in several cells counts once: in the first table where it
meets, and there in the cell of the smaller id. Cells yield a count for each
vector and the edges of a spanning forest, never all pairs; a crowded cell is
cut into blocks of rows whose pairs go to different tasks.

Defined cases: null label, null, empty or zero vectors, and vectors with null or
non-finite components link with nothing and are their own component; vectors of
different length never link; repeated rows (equal vec_id too) count as vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilefabric.tables import written

from .shared import components, heavy_join, small, spread

THRESHOLD, SEED = 0.98, 8
#: Vectors from which cells of two blocks shrink, and the finest and coarsest size of a cell.
MANY, FINE, COARSE = 10_000, 0.2, 0.26
#: Rows of a cell that one task compares with as many others.
CROWD = 2_048
STEP = 512
#: Bytes of codes of pairs that are looked at together.
PAIRS = 16 << 20
#: What names a block of a cell; rows that go to one bucket of blocks, on average at most.
BLOCK, BUCKET = ["t", "label", "len", "cell", "x", "y"], 2_048
#: Mixes the keys of several lattice points into one.
MIX = np.int64(-7_046_029_254_386_353_131)

NEIGHBOURS = np.array(
    [[a if k == i else b if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2)]
    + [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with even sum (lattice D8): where the sum is odd, the worst coordinate rounds the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 shifted by one half."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cell_keys(points: np.ndarray) -> np.ndarray:
    """A long for each lattice point: its doubled coordinates, a byte each (a clash only costs a comparison)."""
    return np.ascontiguousarray(np.rint(2 * points).astype(np.int8)).view(np.int64)[..., 0]


@dataclass(frozen=True)
class Level:
    blocks: int
    scale: float
    probes: int
    tables: int


def level(n: int) -> Level:
    """How to hash ``n`` vectors that are compared with each other."""
    k, from_n = 2, float(MANY)
    while (scale := min(COARSE, COARSE * (from_n / n) ** (1 / (8 * k)))) < FINE and k < 4:
        from_n, k = from_n * (COARSE / FINE) ** (8 * k), k + 1
    fine = scale < 0.235
    return Level(k, scale, 8 << (k - 1), {2: 3 + fine, 3: 4 + 2 * fine, 4: 7}[k])


def directions(size: int, table: int, blocks: int) -> np.ndarray:
    g = np.random.default_rng([SEED, size, table]).normal(size=(size, max(size, 8 * blocks)))
    return np.linalg.qr(g)[0][:, : 8 * blocks] * np.sqrt(size / 64) if size >= 8 * blocks else g[:, : 8 * blocks] / 8


def units(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(vectors: list, at: Level) -> np.ndarray:
    """(rows, tables, 1 + probes) cell keys: home, then the probes."""
    u, per = units(vectors), 1 + at.probes
    out = np.empty((len(vectors), at.tables, per), np.int64)
    for t in range(at.tables):
        turn = directions(u.shape[1], t, at.blocks)
        for k in range(at.blocks):
            x = u @ turn[:, 8 * k : 8 * k + 8] / at.scale
            home = decode(x)
            gain = (x - home) @ NEIGHBOURS.T
            near = np.argsort(-gain, axis=1, kind="stable")[:, :16]
            key = cell_keys(np.concatenate([home[:, None], home[:, None] + NEIGHBOURS[near]], axis=1))
            cost = np.concatenate([np.zeros((len(u), 1)), 2 - 2 * np.take_along_axis(gain, near, axis=1)], axis=1)
            if k:  # the cheapest of all ways to combine this block's points with the blocks before it
                key = (keys[:, :, None] * MIX + key[:, None, :]).reshape(len(u), -1)
                cost = (costs[:, :, None] + cost[:, None, :]).reshape(len(u), -1)
                best = np.argsort(cost, axis=1, kind="stable")[:, : 4 * per]
                key, cost = np.take_along_axis(key, best, axis=1), np.take_along_axis(cost, best, axis=1)
            keys, costs = key, cost
        out[:, t] = keys[:, :per]
    return out


def meets_first(table: int, a: np.ndarray, b: np.ndarray, ida: np.ndarray, idb: np.ndarray) -> np.ndarray:
    """Which pairs (a at home, b there too or probing) count here: not met in an earlier table, nor in the smaller id's cell."""
    ok = np.ones(len(a), bool)
    for t in range(table):
        ok &= ~((b[:, t] == a[:, t, :1]).any(axis=1) | (a[:, t] == b[:, t, :1]).any(axis=1))
    same = a[:, table, 0] == b[:, table, 0]
    other = (a[:, table, 1:] == b[:, table, :1]).any(axis=1)  # they meet at b's home as well
    return ok & np.where(same | other, ida < idb, True)


def compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links within the cell blocks of one bucket: (cid, n, root), n counts members of the classes linked with cid's."""
    ids, size, side = pdf["cid"].to_numpy(), pdf["members"].to_numpy(), pdf["side"].to_numpy()
    n, parent = np.zeros(len(pdf), np.int64), np.arange(len(pdf))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (table, *_), rows in pdf.groupby(BLOCK, sort=False, dropna=False).indices.items():
        home, asks = rows[side[rows] < 2], rows[side[rows] != 1]
        if len(home) == 0 or len(rows) < 2:
            continue
        other = units(pdf["vec"].iloc[asks].tolist())
        place = np.zeros(len(pdf), np.int64)
        place[rows] = np.arange(len(rows))
        code = np.stack(pdf["codes"].iloc[rows].to_numpy()).reshape(len(rows), pdf["tables"].iloc[rows[0]], -1)
        most = max(1, PAIRS // code[0].nbytes)
        for at in range(0, len(home), STEP):
            h = home[at : at + STEP]
            i, j = np.nonzero(units(pdf["vec"].iloc[h].tolist()) @ other.T >= THRESHOLD)
            i, j = h[i], asks[j]
            keep = ids[i] != ids[j]
            i, j = i[keep], j[keep]
            keep = np.concatenate([meets_first(table, code[place[i[a : a + most]]], code[place[j[a : a + most]]], ids[i[a : a + most]], ids[j[a : a + most]]) for a in range(0, len(i), most)] or [np.zeros(0, bool)])
            i, j = i[keep], j[keep]
            np.add.at(n, i, size[j])
            np.add.at(n, j, size[i])
            for p, q in zip(i.tolist(), j.tolist()):
                p, q = find(p), find(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    root = np.array([find(i) for i in range(len(pdf))])
    on = (n > 0) | (root != np.arange(len(pdf)))
    return pd.DataFrame({"cid": ids[on], "n": n[on], "root": ids[root[on]]})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    rows = written(vectors.select("vec_id", "label", F.when(F.coalesce(usable, F.lit(False)), F.col("embedding")).alias("vec")))
    good = rows.where("vec is not null")
    groups = written(good.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("members")).withColumn("cid", F.monotonically_increasing_id()))
    sets = groups.groupBy("label", F.size("vec").alias("len")).agg(F.count("*").alias("peers"))
    groups_sized = groups.withColumn("len", F.size("vec")).join(small(written(sets)), ["label", "len"])
    count = groups.count()

    def encode(batches):
        for pdf in batches:
            for (_, peers), part in pdf.groupby(["len", "peers"]):
                at = level(peers)
                for a in range(0, len(part), 1_024):
                    p = part.iloc[a : a + 1_024]
                    yield p.drop(columns=["len", "peers"]).assign(tables=at.tables, codes=list(codes(p["vec"].tolist(), at).reshape(len(p), -1)))

    classes = groups_sized.select("cid", "label", "vec", "members", "len", "peers")
    schema = classes.drop("len", "peers").schema.add("tables", T.IntegerType()).add("codes", T.ArrayType(T.LongType()))
    coded = written(spread(classes, count, 20_000).mapInPandas(encode, schema))
    per = (F.size("codes") / F.col("tables")).cast("int")
    at = coded.select("cid", "label", F.size("vec").alias("len"), per.alias("per"), F.posexplode("codes").alias("k", "cell"))
    at = at.select("cid", F.floor(F.col("k") / F.col("per")).cast("int").alias("t"), "label", "len", "cell", (F.col("k") % F.col("per") == 0).alias("is_home"))
    cell = ["t", "label", "len", "cell"]
    cells = at.groupBy(*cell).agg(F.count_if("is_home").alias("homes"), F.count("*").alias("all")).where("homes > 0 and all > 1")
    cells = cells.select(*cell, F.ceil(F.col("homes") / CROWD).cast("int").alias("hb"), F.ceil(F.col("all") / CROWD).cast("int").alias("qb"))
    at = at.join(cells, cell).withColumn("own_x", F.pmod(F.xxhash64("cid"), "hb").cast("int")).withColumn("own_y", F.pmod(F.xxhash64("cid", "t"), "qb").cast("int"))

    def place(x, y, side):
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(side).alias("side"))

    whole = (F.col("hb") == 1) & (F.col("qb") == 1)
    as_home = F.when(F.col("is_home"), F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda y: place(F.col("own_x"), y, 1))).otherwise(F.array().cast("array<struct<x:int,y:int,side:int>>"))
    as_asking = F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda x: place(x, F.col("own_y"), 2))
    places = F.when(whole, F.array(place(F.lit(0), F.lit(0), 0)).cast("array<struct<x:int,y:int,side:int>>")).otherwise(F.concat(as_home, as_asking))
    at = at.withColumn("p", F.explode(places)).select(*cell, "p.x", "p.y", F.when(F.col("is_home") | ~whole, F.col("p.side")).otherwise(2).alias("side"), "cid")
    at = written(at)  # ids only; vectors go to those cells alone in which there is someone to meet
    buckets = max(1, at.count() // BUCKET)
    at = at.withColumn("bucket", F.pmod(F.xxhash64(*BLOCK), F.lit(buckets))).join(coded.select("cid", "vec", "members", "tables", "codes"), "cid")
    met = at.groupBy("bucket").applyInPandas(compare, "cid long, n long, root long")
    met = written(met)
    links = met.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = components(met.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    groups = groups.join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    first = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = groups.join(first, "root").select("label", "vec", F.col("members").alias("n"), (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), "component_id")
    out = heavy_join(good, groups, ["label", "vec"], good.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
