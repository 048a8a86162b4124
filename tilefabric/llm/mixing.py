"""Mixing sources to target weights.

Each source's words form one stream, cut into blocks of ``block`` words. Every
source has a quota of blocks (its target); every output shard draws its source
counts from the multinomial over the quotas, conditional on the quotas being
met over all shards: each quota slot is dealt to an output place by a keyed
permutation, and a shard's counts are the slots dealt to it. The slots a shard
draws from a source are a range of the source's slots; a slot's number within
its pass over the source goes through that pass's pseudorandom permutation of
block indexes, so a pass takes each block once. Blocks are joined with the
documents' spans by (source, block index). Everything is DataFrame expressions;
hashed buckets keep a source that holds any share of the rows out of one task.
Windows over the list of sources run in one task, a row a source: that holds for
millions of sources. Shards are of one size, so their number grows with the data.

Defined cases: null text has size 0 and is never taken; a null source is a
source of its own, last in order; no words at all: every target and taken is 0;
a source whose target is three times its size is taken three times in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilefabric.tables import written

from .shared import feistel, int_div, running_start, small, spread, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; weights by the sources' order, repeating; times a source is taken at most.
BLOCK, WEIGHTS, MOST = 128, (5, 2, 1), 3
#: Slots of an output shard.
SHARD_SLOTS = 1_024
CHUNK = 1 << 16
SRC = ["src", "src_null"]


@dataclass
class Mix:
    sizes: DataFrame  # (doc_id, src, src_null, text_hash, size), a row for each document
    sources: DataFrame  # a row for each source: source_size, weight, target, blocks, slots, base
    counts: DataFrame  # (src, src_null, shard, n, start): the draws of each shard
    draws: DataFrame  # (src, src_null, shard, pass, block): a row for each slot
    spans: DataFrame  # sizes + start: the document's place in its source's stream
    block: int


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: size, weight and target; what is above ``most`` times a source's size is shared again by weight.

    That ends where target = min(weight * level, most * size) sums to all words;
    the level is read off the sources in order of the level at which they fill up.
    """
    s = sizes.groupBy(*SRC).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("src_null", "src")) - 1  # one row a source
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("full_at", "src_null", "src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    first = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "src_null", "src"))
    s = s.withColumn("level", F.coalesce(F.min_by("level", first).over(everything), F.lit(0.0)))
    return s.select(*SRC, "source_size", "weight", F.least(F.col("weight") * F.col("level"), F.col("cap")).alias("target"))


def plan(docs: DataFrame, block: int = BLOCK, seed: int = 17) -> Mix:
    """Draws the mix of ``docs`` (doc_id, text, source)."""
    text, source = F.coalesce(F.col("text"), F.lit("")), F.col("source")
    sizes = written(docs.select("doc_id", F.coalesce(source, F.lit("")).alias("src"), source.isNull().cast("int").alias("src_null"), F.xxhash64(text).alias("text_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")))
    s = targets(sizes)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    rest = F.least(F.round((F.col("target") - passes * F.col("source_size")) / block).cast("long"), F.col("blocks"))
    s = s.withColumn("slots", passes * F.col("blocks") + rest)
    sources = written(s.withColumn("base", F.sum("slots").over(Window.orderBy(*SRC)) - F.col("slots")))
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    def exploded(df: DataFrame, n: str, rows: int, out: str) -> DataFrame:
        """A row for each of 0..n-1, in two steps so that no array is large and no task makes all rows of a source."""
        df = df.where(F.col(n) > 0).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(CHUNK).cast("long"))))
        df = spread(df, rows, 20 * CHUNK)
        return df.withColumn(out, F.explode(F.sequence("_c", F.least(F.col("_c") + CHUNK, F.col(n)) - 1))).drop("_c")

    slots = exploded(sources.select(*SRC, "slots", "base"), "slots", total, "j")
    dealt = feistel(F.col("base") + F.col("j"), F.lit(total).cast("long"), F.lit(seed))
    counts = slots.groupBy(*SRC, int_div(dealt, F.lit(SHARD_SLOTS).cast("long")).alias("shard")).agg(F.count("*").alias("n"))
    counts = written(counts)
    counts = written(running_start(counts, SRC, F.col("n"), ["shard", "n"], "start", counts.count()))

    draws = exploded(counts.join(small(sources.select(*SRC, "blocks")), SRC), "n", total, "k").withColumn("j", F.col("start") + F.col("k"))
    draws = draws.withColumn("pass", int_div(F.col("j"), F.col("blocks")))
    index = feistel(F.col("j") % F.col("blocks"), F.col("blocks"), F.xxhash64("src", "src_null", "pass", F.lit(seed)))
    draws = draws.select(*SRC, "shard", "pass", index.alias("block"))
    spans = running_start(sizes, SRC, F.col("size"), ["doc_id", "text_hash", "size"], "start", sizes.count())
    return Mix(sizes, sources, counts, draws, spans, block)


def pieces(m: Mix, *more: str) -> DataFrame:
    """A row for each block that a document's span touches: words [lo, hi) of the stream lie in it."""
    last, block = F.col("start") + F.col("size") - 1, F.lit(m.block).cast("long")
    p = m.spans.where("size > 0").select(*SRC, "doc_id", "text_hash", "size", "start", F.explode(F.sequence(int_div(F.col("start"), block), int_div(last, block))).alias("block"), *more)
    return p.withColumn("lo", F.greatest("start", F.col("block") * m.block)).withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * m.block))


def taken(m: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    times = m.draws.groupBy(*SRC, "block").agg(F.count("*").alias("times"))
    got = pieces(m).join(times, [*SRC, "block"], "left").groupBy(*SRC, "doc_id", "start", "size").agg(F.sum((F.col("hi") - F.col("lo")) * F.coalesce("times", F.lit(0))).alias("taken"))
    none = m.sizes.where("size = 0").select(*SRC, "doc_id", F.lit(0).cast("long").alias("start"), "size", F.lit(0).cast("long").alias("taken"))
    return got.unionByName(none).join(small(m.sources), SRC).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as rows of ``docs``: one row for each pass that takes words of a document.

    A row's text has the words taken in that pass, in order, with the white
    space after them; a document taken in full keeps its text. ``n_chars``, if
    there, is set anew. Documents equal in source, doc_id and text share the
    draw of the first of them.
    """
    m = plan(docs, block)
    key = [*SRC, "doc_id", "text_hash"]
    own, whole, taken_runs = unused(docs, "_own_key", "_own_all", "_own_runs")
    runs = pieces(m).join(m.draws.drop("shard"), [*SRC, "block"]).groupBy(*key, "size", "start", "pass")
    runs = runs.agg(F.array_sort(F.collect_list(F.struct((F.col("lo") - F.col("start")).alias("lo"), (F.col("hi") - F.col("lo")).alias("n")))).alias("runs"), F.sum(F.col("hi") - F.col("lo")).alias("words"))
    runs = runs.withColumn("first", F.min("start").over(Window.partitionBy(*key))).where("start = first")
    runs = runs.select(F.struct("src", "src_null", "doc_id", "text_hash").alias("_run_key"), (F.col("words") == F.col("size")).alias(whole), F.col("runs").alias(taken_runs))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(own, F.struct(F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().cast("int").alias("src_null"), F.col("doc_id"), F.xxhash64(text).alias("text_hash")))
    words = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # The words are bound once, or each run would cut the text anew.
    some = F.transform(F.array(words), lambda w: F.array_join(F.transform(taken_runs, lambda r: F.array_join(F.slice(w, r["lo"].cast("int") + 1, r["n"].cast("int")), "")), ""))[0]
    out = keyed.join(runs, keyed[own].eqNullSafe(runs["_run_key"])).withColumn("text", F.when(F.col(whole), F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(keyed[c] if c not in ("text", "n_chars") else F.col(c) for c in docs.columns))


def op1(docs: DataFrame) -> DataFrame:
    return taken(plan(docs))
