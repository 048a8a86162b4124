"""Exact dedup by heavy-hitter split.

A frequent-items sketch of the Misra-Gries family (Spark's ``approx_top_k``:
counters that decrease together when the table is full) finds digests that
repeat often. Their groups are counted exactly, and the verified winners, at
most ``HEAVY`` rows, are broadcast: rows of such groups are settled on the map
side and never shuffled. All other digests go through an ordinary shuffle, in
which no group is large. A digest the sketch misses is only slower, not wrong.
The sketches count 64-bit hashes of the digests and merge in two levels, so no
task merges those of all partitions.

Defined cases: null text counts as empty; of rows equal in text and doc_id one
stays (in ``exact_dedup``, whose further columns may tell them apart, the one of
the largest hash over all columns but maps); a null doc_id loses to any other; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilefabric.tables import written

from .shared import unused, without

#: Digests that are looked up by broadcast at most, counters of a sketch, and groups of partitions that merge first.
HEAVY, COUNTERS, MERGERS = 1_000, 10_000, 256


def digests(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, sha, h) of every row, written once; rid tells repeated rows apart, h is a hash of sha."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2(text, 256).alias("sha"))
    return written(d.withColumn("h", F.xxhash64("sha")))


def frequent(d: DataFrame) -> DataFrame:
    """(h) of the digests that repeat most, at most ``HEAVY`` rows."""
    part = d.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_g")).agg(F.expr(f"approx_top_k_accumulate(h, {COUNTERS})").alias("s"))
    top = part.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {COUNTERS}), {HEAVY})").alias("top"))
    return top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("h"))


def decide(d: DataFrame) -> DataFrame:
    """Adds keep_id, group_size and kept to ``digests`` rows."""
    best = [F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size")]
    winners = written(d.join(F.broadcast(frequent(d)), "h", "left_semi").groupBy("sha").agg(*best))  # about HEAVY rows: one for each h, but for clashes
    marked = d.join(F.broadcast(winners), "sha", "left")
    rare = marked.where("best is null").select("sha", "rid", "doc_id")
    settled = marked.where("best is not null").drop("h").unionByName(rare.join(rare.groupBy("sha").agg(*best), "sha"))
    return settled.select("rid", "doc_id", "sha", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (any further columns stay) whose text no row of larger doc_id repeats."""
    lost = decide(digests(docs)).where("not kept")
    lost = lost.groupBy(F.col("doc_id").alias("id"), "sha").agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("spare"))
    (sha,) = unused(docs, "_own_sha")
    return without(docs.withColumn(sha, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), sha, lost).drop(sha)


def op2(docs: DataFrame) -> DataFrame:
    return decide(digests(docs)).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, row_number() OVER () AS r FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST, r DESC) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
