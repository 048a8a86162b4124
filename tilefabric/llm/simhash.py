"""SimHash near-dedup by anchor-point covering.

Fingerprints within ``THRESHOLD`` bits link. The anchors are a covering code of
{0,1}^64: the fingerprint, padded to 69 bits, is cut into three words of the
perfect binary Golay code (covering radius 3 each, so 9 in all). Every
fingerprint has one home anchor within the radius. It is replicated to every
anchor that can be home to a fingerprint within the threshold: those within
radius plus threshold, block by block (3 + d1, 3 + d2, 3 + d3 bits with d1 + d2 +
d3 <= 2), about 118 of them. At each anchor, fingerprints at home are compared
with all replicas, so no pair within the threshold is missed. Equal
fingerprints are one row throughout.

Defined cases: null and empty text (no words) has fingerprint zero and links
like any other; fewer words than a shingle count as one shingle; repeated rows
each get their result; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefabric.tables import written

from .shared import components, heavy_join, portions, spread, unused, with_own_id, with_text_id, without

SHINGLE, THRESHOLD, SEED = 3, 2, 42
#: Fixed values of the binary Golay code: generator polynomial, length, covering radius.
GENERATOR, LENGTH, RADIUS = 0b101011100011, 23, 3
BATCH = 1_000
#: Replicas that a task of the join by anchor gets, on average at most.
REPLICAS = 2_000_000
#: Bytes of text that are hashed at a time (one text at least).
BYTES = 4 << 20
LANES = np.uint64(0x0101010101010101)


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words; of all words together if they are fewer."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not words:
        return np.zeros(0, np.uint64)
    line, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hash64(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - shingle or None].tolist()
    found = (hash64(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True))
    return np.fromiter(found, np.uint64, len(starts))


def majority(hashed: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes: the bits set in over half of them.

    Eight bits are counted at once, in the bytes of a long, over runs of at most 255.
    """
    counts = np.array([len(h) for h in hashed], np.int64)
    out = np.zeros(len(hashed), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    h = np.concatenate(hashed)
    runs = -(-counts[filled] // 255)
    doc = np.repeat(np.arange(len(filled)), runs)
    first = np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(np.cumsum(counts[filled]) - counts[filled], runs) + 255 * (np.arange(len(doc)) - first)
    of_doc = np.searchsorted(doc, np.arange(len(filled)))
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & LANES, starts)
        set_in = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of_doc, axis=0)
        over = (2 * set_in > counts[filled, None]).astype(np.uint64)
        out[filled] |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *keep: str) -> DataFrame:
    """(doc_id, fp long) of every whole text, and the text columns ``keep``."""

    def run(batches):
        for pdf in batches:
            for at, to in portions(np.fromiter(map(len, pdf["text"]), np.int64, len(pdf)), BYTES):
                part = pdf.iloc[at:to]
                fp = majority([hashes(t, shingle) for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "fp": fp.view(np.int64)} | {c: part[c].to_numpy() for c in keep})

    rows = with_text_id(docs, F.coalesce("text", F.lit("")).cast("binary").alias("text"), *map(F.col, keep))
    return with_own_id(rows.mapInPandas(run, ", ".join(["doc_id string, fp long", *(f"{c} string" for c in keep)])), docs)


@cache
def cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of up to RADIUS + THRESHOLD bits and their excess over RADIUS; and the syndromes of the bits."""
    bits = []
    for i in range(LENGTH):
        r = 1 << i
        for k in range(LENGTH - 1, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        bits.append(r)
    by: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    for w in range(RADIUS + THRESHOLD + 1):
        for places in combinations(range(LENGTH), w):
            s = p = 0
            for i in places:
                s, p = s ^ bits[i], p | 1 << i
            by[s].append((p, max(0, w - RADIUS)))
    most = max(map(len, by))
    patterns, excess = np.zeros((2048, most), np.int64), np.full((2048, most), 99, np.int64)
    for s, found in enumerate(by):
        patterns[s, : len(found)], excess[s, : len(found)] = zip(*found)
    return patterns, excess, np.array(bits, np.int64)


def near_words(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word: the code words near it, as their 12 message bits, and their excess."""
    patterns, excess, bits = cosets()
    syndrome = np.zeros(len(word), np.int64)
    for i in range(LENGTH):
        syndrome ^= np.where(word >> i & 1, bits[i], 0)
    return (word[:, None] ^ patterns[syndrome]) >> 11, excess[syndrome]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, excess): every anchor within radius plus threshold of each fingerprint; excess 0: its home."""
    x, mask = fp.view(np.uint64), np.uint64((1 << LENGTH) - 1)
    blocks = [near_words((x >> np.uint64(LENGTH * k) & mask).astype(np.int64)) for k in range(3)]
    (c0, e0), (c1, e1), (c2, e2) = blocks
    two = e0[:, :, None] + e1[:, None, :]
    row, i, j = np.nonzero(two <= THRESHOLD)
    e, c = two[row, i, j], c0[row, i] << 24 | c1[row, j] << 12
    three = e[:, None] + e2[row]
    at, k = np.nonzero(three <= THRESHOLD)
    return row[at], c[at] | c2[row[at], k], three[at, k]


def linked(fps: DataFrame, rows: int) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the threshold; ``fps``: (fp) without repeats.

    The join by anchor has as many partitions as its rows need, and is a
    sort-merge join, which spills.
    """

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                fp = pdf["fp"].to_numpy()[at : at + BATCH]
                row, anchor, excess = anchors(fp)
                cut = np.cumsum(np.bincount(row, minlength=len(fp)))[:-1]
                yield pd.DataFrame({"fp": fp, "home": anchor[excess == 0], "near": np.split(anchor, cut)})

    placed = spread(fps, rows, 20_000, "fp").mapInPandas(run, "fp long, home long, near array<long>")
    placed = written(placed)
    home = placed.select(F.col("home").alias("anchor"), F.col("fp").alias("a"))
    near = placed.select(F.explode("near").alias("anchor"), F.col("fp").alias("b"))
    near, home = spread(near, 118 * rows, REPLICAS, "anchor"), spread(home, 118 * rows, REPLICAS, "anchor")
    return near.join(home.hint("merge"), "anchor").where(f"a <> b and bit_count(a ^ b) <= {THRESHOLD}").select("a", "b")


def rooted(each: DataFrame, least: Column) -> DataFrame:
    """(fp, n, least, root): of each fingerprint its rows' number and aggregate ``least``, and the class it is in."""
    fps = written(each.groupBy("fp").agg(F.count("*").alias("n"), least.alias("least")))
    groups = components(linked(fps.select("fp"), fps.count())).withColumnRenamed("node", "fp")
    return written(fps.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    each = written(fingerprints(docs))
    fps = rooted(each, F.min("doc_id"))
    ids = fps.groupBy("root").agg(F.min("least").alias("component_id"))
    return heavy_join(each, fps.join(ids, "root").select("fp", "n", "component_id"), ["fp"], each.count()).drop("n")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` from each class stays: of the smallest doc_id (a null one loses), then of the smallest digest of its text.

    Rows are told apart by doc_id and text, as ids may be null or repeat; of rows
    equal in both, which are in one class, the one of the largest hash over all
    columns but maps stays.
    """
    (sha,) = unused(docs, "_own_sha")
    own = docs.withColumn(sha, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    each = written(fingerprints(own, SHINGLE, sha).withColumnRenamed(sha, "sha"))
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")
    fps = rooted(each, F.min(name))
    best = fps.groupBy("root").agg(F.min("least").alias("best"))
    named = heavy_join(each, fps.join(best, "root").select("fp", "n", "best"), ["fp"], each.count())
    named = named.groupBy(F.col("doc_id").alias("id"), "sha").agg(F.count("*").alias("rows"), F.bool_or(name.eqNullSafe(F.col("best"))).alias("spare"))
    return without(own, sha, named.where("not spare or rows > 1")).drop(sha)


def op6(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
