"""Helpers that several training-data operators need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilefabric.tables import written

#: Rows up to which a table counts as small enough to broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, if the (already written) table has at most ``limit`` rows; else Spark picks the join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame, rows: int, per_task: int, *cols: str) -> DataFrame:
    """``df`` in enough partitions for ``per_task`` rows in each, and at least the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // per_task)), *cols)


def with_text_id(docs: DataFrame, *columns: Column) -> DataFrame:
    """doc_id as text and ``columns``: pandas would hold integer ids as doubles where some are null."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), *columns)


def with_own_id(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` with doc_id in the type it has in ``docs``."""
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until ``df`` has no such column, so that working columns never replace its own."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of consecutive rows of at most ``most`` bytes together, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


def int_div(a: Column, b: Column) -> Column:
    """Quotient of non-negative longs, rounded down."""
    return ((a - a % b) / b).cast("long")


def heavy_join(df: DataFrame, table: DataFrame, keys: list[str], rows: int, share: int = 1_000) -> DataFrame:
    """``df`` (of at most ``rows`` rows) joined with ``table``, which has a row for each key and in ``n`` how many rows of ``df`` have it.

    Keys that hold at least one in ``share`` of the rows, so ``share`` keys at most, are
    broadcast; only the others are shuffled, so no task gets a hot key.
    """
    hot = F.broadcast(table.where(F.col("n") * share >= rows))
    rare = df.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col("n") * share < rows), keys)
    return df.join(hot, keys).unionByName(rare)


def without(docs: DataFrame, sha: str, lost: DataFrame) -> DataFrame:
    """``docs`` less the rows that ``lost`` (id, sha, spare) names by doc_id and by the digest in column ``sha``.

    All rows of a name go, or, where ``spare`` is true, all but one: that of the
    largest hash over its columns (maps aside). Few names are broadcast; many are
    joined in one shuffle of ``docs``. Both ``docs`` branches read that one.
    """
    i, h, spare, row = unused(docs, "_id", "_sha", "_spare", "_row")
    names = small(written(lost.select(F.col("id").alias(i), F.col("sha").alias(h), F.col("spare").alias(spare))))
    marked = docs.join(names, docs["doc_id"].eqNullSafe(F.col(i)) & (docs[sha] == F.col(h)), "left")
    stay = marked.where(F.col(spare).isNull()).select(docs["*"])
    tied = marked.where(F.col(spare)).select(i, h, F.struct(docs["*"]).alias(row))
    one = tied.groupBy(i, h).agg(F.max_by(row, F.xxhash64(*(F.col(row)[c] for c in hashable(docs)))).alias(row))
    return stay.unionByName(one.select(f"{row}.*"))


def hashable(df: DataFrame) -> list[str]:
    """The columns that Spark can hash: all but those that hold maps."""
    return [f.name for f in df.schema if "MapType" not in str(f.dataType)]


#: Copies that one row of an explode makes at most.
COPIES = 1 << 12


def running_start(df: DataFrame, keys: list[str], weight: Column, order: list[str], out: str, rows: int, per_bucket: int = 5_000) -> DataFrame:
    """Sum of ``weight`` over the rows before this one within ``keys``, as column ``out``; ``df`` has no columns but ``keys`` and ``order``.

    A key may hold any share of the rows, and so may copies of one row: equal
    rows are counted first and are one row of the sums. Those go to hashed
    buckets of at most about ``per_bucket``, so a window sees one bucket, or one
    row a bucket for the buckets' own starts. The order within a key is by
    bucket, then ``order``; equal rows get their places in any order, and many of
    them become rows again in several tasks. ``keys`` hold no nulls.
    """
    n = max(1, -(-rows // per_bucket))
    same = df.groupBy(*keys, *order).agg(F.count("*").alias("_m"))
    same = same.withColumn("_w", weight).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    cell, all_ = [*keys, "_b"], F.col("_w") * F.col("_m")
    starts = same.groupBy(*cell).agg(F.sum(all_).alias("_s"))
    starts = starts.withColumn("_s", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_s"))
    within = F.sum(all_).over(Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - all_
    same = written(same.withColumn("_in", within).join(starts, cell).select(*keys, *order, "_m", "_w", (F.col("_s") + F.col("_in")).alias(out)))
    zero, last = F.lit(0).cast("long"), F.col("_m") - 1
    few = same.where(F.col("_m") <= COPIES).withColumn("_k", F.explode(F.sequence(zero, last)))
    many = same.where(F.col("_m") > COPIES).withColumn("_c", F.explode(F.sequence(zero, last, F.lit(COPIES).cast("long"))))
    many = spread(many, rows // COPIES, 100).withColumn("_k", F.explode(F.sequence("_c", F.least(F.col("_c") + COPIES - 1, last)))).drop("_c")
    return few.unionByName(many).withColumn(out, F.col(out) + F.col("_w") * F.col("_k")).drop("_m", "_w", "_k")


def with_number(df: DataFrame, rid: str, out: str) -> DataFrame:
    """Dense numbers 0..n-1 from ``rid``, a written column of ``monotonically_increasing_id``.

    Such an id holds the partition and the row's place in it, so the partitions'
    counts (a row each, broadcast if few) give the numbers without moving rows.
    """
    part = F.shiftright(rid, 33)
    starts = written(df.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")))
    starts = starts.withColumn("_s", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_s")
    return df.withColumn("_p", part).join(small(starts), "_p").withColumn(out, F.col("_s") + (F.col(rid) - F.shiftleft("_p", 33))).drop("_p", "_s")


def feistel(x: Column, n: Column, key: Column, rounds: int = 4, walks: int = 64) -> Column:
    """Keyed permutation of 0..n-1, applied to ``x``.

    A Feistel network over Z_a x Z_b with a*b >= n and a*b - n < sqrt(n) + 1;
    results from n on walk their cycle until they fall below n. A step leaves
    the range with probability under 1/sqrt(n), so ``walks`` steps suffice: the
    chance that more are needed is below 1e-30 for n >= 12, and for smaller n a
    cycle has fewer than 64 points out of range.
    """
    n = F.greatest(n, F.lit(1).cast("long"))
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def turn(s: Column, r: Column) -> Column:
        hi = F.when(r % 2 == 0, (s["hi"] + F.pmod(F.xxhash64(s["lo"], key, r), a)) % a).otherwise(s["hi"])
        lo = F.when(r % 2 == 1, (s["lo"] + F.pmod(F.xxhash64(s["hi"], key, r), b)) % b).otherwise(s["lo"])
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    def once(v: Column) -> Column:
        halves = F.struct(int_div(v, b).alias("hi"), (v % b).alias("lo"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), halves, turn, lambda s: s["hi"] * b + s["lo"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), once(x), lambda v, _: F.when(v < n, v).otherwise(once(v)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, root) for each node of an edge, root the smallest node.

    Alternates two star steps: every larger neighbour of a node moves to the
    node's smallest neighbour, then every node and its smaller neighbours do.
    The edges shrink to stars in a logarithmic number of rounds; each round's
    edges are written to the shared folder. The rows of a node with very many edges
    are left to Spark's skew join. Self-loops and nulls are dropped.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e, seen = written(e), None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo").distinct())
        seen = mark
        both = e.select(F.col("hi").alias("v"), F.col("lo").alias("u")).union(e.select("lo", "hi"))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = written(moved.union(low).distinct())
