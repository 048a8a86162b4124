"""Hard-negative mining by Fagin's threshold algorithm.

Components become integers, floor(256 * x); a row's score is its integer inner
product with the anchor. Rows are dealt to blocks of a bounded size, those of a
large label to blocks of their own, those of small labels to shared ones. In a
block every dimension has its sorted list of the block's rows. An anchor reads
the lists from the end that its component's sign asks for, the rows it comes
across are scored from their whole vectors, and it stops once the threshold (the
score of a row as good as the last entry read in every list) is strictly below
the k-th score of each of its windows; while a window has fewer than k rows, its
lower end stands in for that score. So a block's answer is exact, ties included,
and the blocks' answers are merged by a ranked window.

The first pass seeks an anchor's positives, in the blocks of its label alone; the
second seeks negatives for the windows that those positives open, in all blocks.
Anchors are a stated query set: they are dealt to parts, and a task gets one
block and one part.

Defined cases: rows with a null label or vector, or with a null or non-finite
component, take no part; vectors of different length never meet; empty and zero
vectors score 0; a positive of negative score opens an empty window; repeated
rows count one by one, and a row is only not its own partner; a null vec_id comes
after all others in ties and is never an anchor; scores beyond the range of a
long are the nearest long; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilefabric.tables import written

from .shared import heavy_join, small

SCALE, TOP, LOW, HIGH = 256, 5, 80, 100
#: Rows of a block, anchors of a part, and entries that are first read from each list (twice as many each time).
BLOCK, PART, FIRST = 8_192, 4_096, 16
KEY = ["len", "own", "home", "sub", "part"]
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "anchor long, anchor_id long, w int, rid long, id long, no_id boolean, score long"


class Lists:
    """A block's integer vectors with each dimension's rows in ascending order."""

    def __init__(self, vectors: list):
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * np.array(vectors, np.float64).reshape(len(vectors), -1))
        self.x = np.clip(x, -np.finfo(float).max, np.finfo(float).max)
        self.order = np.argsort(self.x, axis=0, kind="stable").T
        self.size = np.abs(self.x).max(initial=0.0)
        self.kinds: dict[type, np.ndarray] = {}

    def kind(self, anchor: np.ndarray) -> type:
        """The narrowest type in which inner products with ``anchor`` are exact."""
        most = float(np.abs(anchor).sum()) * self.size
        return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object

    def of(self, kind: type) -> np.ndarray:
        if kind not in self.kinds:
            self.kinds[kind] = np.vectorize(int, otypes=[object])(self.x) if kind is object and self.x.size else self.x.astype(kind)
        return self.kinds[kind]


def in_long(score) -> int:
    return int(min(max(int(score), LEAST), MOST))


def scan(lists: Lists, anchor: np.ndarray, fits: np.ndarray, windows: list[tuple[int, int]], top: int, first: int = FIRST) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (lowest, highest score) the rows, among those that ``fits`` marks, which hold its ``top`` best scores, ties of the last one included, and their scores."""
    kind, n = lists.kind(anchor), len(fits)
    x = lists.of(kind)
    a = x[:0].dtype.type(0) + anchor.astype(kind) if kind is not object else np.array([int(c) for c in anchor], object)
    used = np.flatnonzero(anchor)
    # Ascending lists are read from their end where the anchor's component is positive.
    ways = [(lists.order[d], anchor[d] > 0) for d in used]
    seen, scores, depth, step = np.zeros(n, bool), np.full(n, LEAST, np.int64), 0, first
    while True:
        to = min(n, depth + step) if len(used) else n
        hit = np.zeros(n, bool)
        for order, from_end in ways:
            hit[order[n - to : n - depth] if from_end else order[depth:to]] = True
        if to == n:
            hit[:] = True
        new = np.flatnonzero(hit & ~seen & fits)
        seen |= hit
        got = x[new] @ a if len(used) else np.zeros(len(new))
        scores[new] = [in_long(s) for s in got] if kind is object else got.astype(np.int64)
        depth, step = to, 2 * step
        known = np.flatnonzero(seen & fits)
        held = scores[known]
        if depth < n and not seen.all():
            ends = [x[order[n - to] if from_end else order[to - 1], d] * a[k] for (order, from_end), d, k in zip(ways, used, used, strict=True)]
            threshold = in_long(sum(ends) if kind is object else float(np.sum(np.array(ends, np.float64))))
        else:
            threshold = None  # every row has been seen
        out, done = [], True
        for low, high in windows:
            inside = (held >= low) & (held <= high)
            s = held[inside]
            kth = np.partition(s, len(s) - top)[len(s) - top] if len(s) >= top else low
            done = done and (threshold is None or threshold < kth)
            out.append((known[inside][s >= kth], s[s >= kth]))
        if done:
            return out


def best(ids: np.ndarray, no_id: np.ndarray, rows: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``top`` by score, then by id, null last."""
    at = np.lexsort((ids[rows], no_id[rows], ~scores))[:top]  # ~s is -s - 1 and cannot overflow
    return rows[at], scores[at]


def searcher(same: bool, top: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The search of one block by the anchors of one part: rows of the anchor's label, or of others within its windows."""

    def search(block: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c.split()[0]: [] for c in FOUND.split(", ")}
        if len(block) and len(anchors):
            lists, labels, rids, ids, no_id = Lists(block["vec"].tolist()), *(block[c].to_numpy() for c in ("label", "rid", "id", "no_id"))
            asked = Lists(anchors["vec"].tolist()).x
            for k, (anchor, anchor_id, label, windows) in enumerate(zip(*(anchors[c] for c in ("rid", "id", "label", "windows")), strict=True)):
                fits = (labels == label) & (rids != anchor) if same else labels != label
                bounds = [(int(low), int(high)) for low, high in windows]
                for w, (rows, scores) in enumerate(scan(lists, asked[k], fits, bounds, top)):
                    rows, scores = best(ids, no_id, rows, scores, top)
                    for name, values in zip(out, ([anchor] * len(rows), [anchor_id] * len(rows), [w] * len(rows), rids[rows], ids[rows], no_id[rows], scores), strict=True):
                        out[name].extend(values)
        return pd.DataFrame(out)

    return search


def merged(found: DataFrame, top: int) -> DataFrame:
    """The blocks' answers as one: ``place`` from 1 in each window of each anchor."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "no_id", "id", "rid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).withColumn("vec_id", F.when(~F.col("no_id"), F.col("id")))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, top: int = TOP, low: int = LOW, high: int = HIGH, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` (vec_id, embedding).

    ``is_anchor`` and ``label`` are expressions over the rows. Negatives of a
    positive score between ``low`` and ``high`` per cent of it.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec_id = F.col("vec_id").cast("long")
    rows = vectors.select(F.coalesce(vec_id, F.lit(0)).alias("id"), vec_id.isNull().alias("no_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    rows = written(rows.withColumn("len", F.size("vec")).withColumn("rid", F.monotonically_increasing_id()))
    sizes = written(rows.groupBy("len", "label").agg(F.count("*").alias("n")))
    own = F.col("n") * 2 >= block
    total, few = sizes.agg(F.sum("n"), F.sum(F.when(~own, F.col("n")))).first()
    home = F.when(own, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(max(1, -(-(few or 0) // block)))))
    homes = sizes.select("len", "label", "n", own.alias("own"), home.alias("home"), F.when(own, F.ceil(F.col("n") / block)).otherwise(1).cast("int").alias("subs"))
    placed = written(heavy_join(rows, homes, ["len", "label"], total or 0).drop("n"))
    anchors = placed.where("asks").withColumn("part", F.lit(0))
    parts = max(1, -(-anchors.count() // part))
    anchors = written(anchors.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int")))
    rows = placed.select("rid", "id", "no_id", "label", "vec", "len", "own", "home", F.pmod(F.xxhash64("rid"), "subs").cast("int").alias("sub"))
    blocks = small(written(rows.select("len", "own", "home", "sub").distinct()))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def ask(asks: DataFrame, same: bool) -> DataFrame:
        asks = asks.select(*KEY, "rid", "id", "label", "vec", "windows")
        return rows.groupBy(*KEY).cogroup(asks.groupBy(*KEY)).applyInPandas(searcher(same, top), FOUND)

    everything = F.array(F.array(F.lit(int(LEAST)), F.lit(int(MOST))))
    first = anchors.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).withColumn("windows", everything)
    positives = written(merged(ask(first, True), top).select("anchor", F.col("place").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # In hundredths: low * positive <= 100 * negative <= high * positive, as whole numbers.
    scaled = F.col("positive_score").cast("decimal(22,0)")
    least, most = F.ceil(scaled * low / 100).cast("long"), F.floor(scaled * high / 100).cast("long")
    opened = positives.where(least <= most).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("p", least.alias("low"), most.alias("high")))).alias("open"))
    second = anchors.drop("own", "home", "subs").join(opened, anchors["rid"] == opened["anchor"]).join(blocks, "len")
    second = second.withColumn("windows", F.transform("open", lambda o: F.array(o["low"], o["high"])))
    found = merged(ask(second, False), top)
    which = opened.select("anchor", F.posexplode("open.p").alias("w", "p")).join(positives, ["anchor", "p"])
    out = found.withColumnRenamed("vec_id", "negative_id").join(which, ["anchor", "w"])
    return out.select("anchor_id", "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


def op11(vectors: DataFrame) -> DataFrame:
    """Anchors are the ids divisible by 100; every seventh id's label moves on by one of ten."""
    label = F.col("label").cast("long")
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


OP11_SQL = """
with good as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
         cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
  from good a join good b on a.vec_id <> b.vec_id
  where a.vec_id % 100 = 0),
positives as (
  select anchor_id, other as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, p.positive_id,
       cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) as int) as rank,
       s.other as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
  and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) <= 5
"""
