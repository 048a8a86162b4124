"""Best-fit packing with Martello-Toth dominance reduction.

Texts become token ids plus an end id; longer ones are cut into full pieces
with a shorter piece first. Full pieces are sequences of their own. The other
pieces are a bin-packing instance with integer sizes below the capacity, so its
histogram (at most ``capacity`` counts, whatever the corpus) says everything
about it: the histogram goes to the driver, the solver works on sizes with
multiplicities, and its answer, "pieces number i to j of size s lie in bins b,
b+1, ... at offset o", is broadcast. Pieces are numbered within their size by
hashed buckets, so a size that a third of the pieces share is no hot spot.

Reduction, for the largest size left: a piece that fills the rest exactly, or
the largest that fits where no set of two or more that fits can be larger, is
joined to it for good; such a bin dominates every other way to fill it. What is
left is packed best-fit decreasing.

Defined cases: null text is empty and takes one place, its end id; repeated
rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilefabric.tables import written

from .shared import running_start, with_own_id, with_text_id
from .tokens import token_ids

CAPACITY, END = 2_048, 0
BATCH = 100


def reduce_instance(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes dominating bins out of ``left`` (size -> count) and returns them as (sizes, times)."""
    fixed, sizes = [], sorted(left)

    def take(bin_: tuple[int, ...], times: int) -> None:
        fixed.append((bin_, times))
        for s in bin_:
            left[s] -= times
            if left[s] == 0:
                del left[s]
                sizes.pop(bisect_left(sizes, s))

    def smallest_sum(n: int, without: int) -> int:
        total = 0
        for s in sizes:
            have = left[s] - (s == without)
            total, n = total + s * min(n, have), n - min(n, have)
            if n <= 0:
                return total
        return capacity + 1

    def largest_pair(room: int, without: int) -> int:
        best, lo, hi = 0, 0, bisect_right(sizes, room) - 1
        while lo <= hi:
            a, b = sizes[lo], sizes[hi]
            if a + b > room:
                hi -= 1
            elif left[a] - (a == without) < 1 + (a == b):
                if a == b:
                    break
                lo += 1
            elif b == without and left[b] < 2:
                hi -= 1
            else:
                best, lo = max(best, a + b), lo + 1
        return best

    def dominating(s: int) -> tuple[int, int] | None:
        """The partner of a piece of size s in a bin that dominates (0: none), and how often; None: there is no such bin."""
        room = capacity - s
        at = bisect_right(sizes, room) - 1
        if at >= 0 and sizes[at] == s and left[s] == 1:
            at -= 1
        if at < 0:
            return 0, left[s] if s > room else 1
        k = sizes[at]
        if k < room and smallest_sum(2, s) <= room and (smallest_sum(3, s) <= room or largest_pair(room, s) > k):
            return None
        # Taking copies of s and k leaves fewer sets that fit, so this holds until one of the two runs out.
        return k, left[s] // 2 if k == s else min(left[s], left[k])

    for s in sorted(left, reverse=True):
        while s in left and (found := dominating(s)):
            take((s, found[0]) if found[0] else (s,), found[1])
    return fixed


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over sizes with multiplicities: bins as (sizes, times)."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []
    done = []

    def put(bin_: tuple[int, ...], times: int) -> None:
        room = capacity - sum(bin_)
        if room == 0:
            done.append((bin_, times))
            return
        if not open_bins[room]:
            insort(rooms, room)
        open_bins[room].append((bin_, times))

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            if (at := bisect_left(rooms, s)) < len(rooms):
                room = rooms[at]
                bin_, times = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(at)
                used = min(n, times)
                if used < times:
                    put(bin_, times - used)
                put((*bin_, s), used)
                n -= used
            else:
                each = capacity // s
                if full := n // each:
                    put((s,) * each, full)
                if n % each:
                    put((s,) * (n % each), 1)
                n = 0
    return done + [b for bins in open_bins.values() for b in bins]


def solve(counts: dict[int, int], capacity: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """For each size: first numbers, first bins and offsets of its runs of pieces; and the number of bins."""
    left = {s: n for s, n in counts.items() if n}
    bins = reduce_instance(left, capacity) + best_fit(left, capacity)
    given: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for sizes, times in bins:
        offset = 0
        for s in sizes:
            runs[s].append((given[s], first, offset))
            given[s], offset = given[s] + times, offset + s
        first += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}, first


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every whole text."""

    kinds = pa.schema([("doc_id", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):  # a slice at a time becomes Python's strings
                part = batch.slice(at, BATCH)
                rows = []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids = np.append(token_ids(text), np.uint32(end)).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
                    rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    rows = with_text_id(docs, F.coalesce("text", F.lit("")).alias("text"))
    return with_own_id(rows.mapInArrow(run, "doc_id string, piece int, start long, length long, ids_crc32 long"), docs)


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece with its sequence_id and its offset in it."""
    spark = docs.sparkSession
    cut = written(pieces(docs, capacity, end))
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < capacity)
    counts = {r[0]: r[1] for r in rest.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = solve(counts, capacity)
    runs = spark.sparkContext.broadcast(runs)
    numbered = running_start(rest, ["length"], F.lit(1).cast("long"), ["doc_id", "piece", "start", "ids_crc32"], "number", sum(counts.values()))

    def place(batches):
        for pdf in batches:
            bins, offsets = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for s, where in pdf.groupby("length").indices.items():
                numbers, firsts, at = runs.value[s]
                n = pdf["number"].to_numpy()[where]
                k = np.searchsorted(numbers, n, side="right") - 1
                bins[where], offsets[where] = firsts[k] + n - numbers[k], at[k]
            yield pdf.drop(columns="number").assign(sequence_id=bins, offset=offsets)

    rows = with_text_id(numbered, *cut.columns[1:], "number")
    placed = rows.mapInPandas(place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(with_own_id(placed, docs))


def op9(docs: DataFrame) -> DataFrame:
    return pack(docs)
