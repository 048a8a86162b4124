"""Training-order materialisation of token ids.

Documents become token ids plus an end id and are cut into sequences of at most
``stride`` ids. A keyed Feistel permutation with cycle-walking gives each of the
n sequences its global slot 0..n-1, so the training order needs no sort key and
any worker can compute it. Sequences go to partitions that are ranges of blocks
of one shard (``slot div per_shard``), ordered by slot, and are written as
fixed-stride records: record k of a shard is at byte k * stride * 2, so readers
seek straight to where they resume.

Sequences are numbered by partition counts (see ``with_number``), without a sort
or a shuffle of the ids; then the ids move once. Tasks pack the sorted records a
block at a time. Shards are rows of bytes in Parquet (``write_blocks``), which
recovers from lost executors by the committer.

Defined cases: null text is empty and gives one sequence, its end id; repeated
rows each get sequences; unused places of a record hold the padding id, and
``length`` tells how many count; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilefabric.tables import FAST_ZSTD, new_path, written

from .shared import feistel, int_div, portions, with_number, with_own_id, with_text_id
from .tokens import token_ids

STRIDE, END, PAD = 2_048, 50_256, 50_256
#: Sequences of a shard, records of a block, key of the order.
PER_SHARD, PER_BLOCK, KEY = 16_384, 64, 20_177
#: Bytes of text whose ids are held at a time (one text at least).
BYTES = 4 << 20


def sequences(docs: DataFrame, stride: int = STRIDE, end: int = END) -> DataFrame:
    """(doc_id, piece, length, ids, ids_crc32): ids are little-endian unsigned 16-bit, without padding."""

    def run(batches):
        for pdf in batches:
            for at, to in portions(np.fromiter(map(len, pdf["text"]), np.int64, len(pdf)), BYTES):
                part, rows = pdf.iloc[at:to], []
                for doc, text in zip(part["doc_id"].tolist(), part["text"].tolist(), strict=True):
                    ids = np.append(token_ids(text), end).astype("<u2")
                    for k, a in enumerate(range(0, len(ids), stride)):
                        raw = ids[a : a + stride].tobytes()
                        rows.append((doc, k, len(raw) // 2, raw, zlib.crc32(raw)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "length", "ids", "ids_crc32"])

    rows = with_text_id(docs, F.coalesce("text", F.lit("")).alias("text"))
    return with_own_id(rows.mapInPandas(run, "doc_id string, piece int, length long, ids binary, ids_crc32 long"), docs)


def ordered(seqs: DataFrame, rows: int, per_shard: int = PER_SHARD, stride: int = STRIDE, key: int = KEY) -> DataFrame:
    """Adds slot, shard, record (place in the shard) and byte offset; ``seqs`` is a written table of ``rows`` rows with their ids ``rid``."""
    numbered = with_number(seqs, "rid", "number")
    slot = feistel(F.col("number"), F.lit(rows).cast("long"), F.lit(key))
    per = F.lit(per_shard).cast("long")
    return numbered.withColumn("slot", slot).drop("rid", "number").withColumn("shard", int_div(F.col("slot"), per)).withColumn("record", F.col("slot") % per).withColumn("offset", F.col("record") * (2 * stride))


def write_blocks(placed: DataFrame, path: str, stride: int = STRIDE, pad: int = PAD, per_block: int = PER_BLOCK, rows: int | None = None, per_shard: int = PER_SHARD, mode: str = "errorifexists") -> None:
    """Writes the shards as rows (shard, block, records, doc_ids, pieces, lengths, payload, crc), sorted by shard and block.

    The payload is ``per_block`` fixed-stride records; a block that fails its
    crc, or is missing, is written again alone by filtering its slots (with the
    number of all ``rows`` and ``mode`` append). The ids move once, without padding, to a partition that is computed from the slot:
    it holds whole blocks of a single shard.
    """
    rows = placed.count() if rows is None else rows
    shards, of_shard = max(1, -(-rows // per_shard)), -(-per_shard // per_block)
    least = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_part = -(-of_shard // min(of_shard, -(-least // shards)))
    parts = -(-of_shard // of_part)
    long = lambda n: F.lit(n).cast("long")
    shown = placed.withColumn("block", int_div(F.col("record"), long(per_block)))
    shown = shown.withColumn("part", (F.col("shard") * parts + int_div(F.col("block"), long(of_part))).cast("int"))
    names = {"doc_ids": "doc_id", "pieces": "piece", "lengths": "length"}
    shown = shown.repartitionById(shards * parts, "part").sortWithinPartitions("slot").select("shard", "block", "record", *names.values(), "ids")
    kinds = {k: shown.schema[c].dataType for k, c in names.items()}
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("block", T.LongType()), T.StructField("records", T.IntegerType()), *(T.StructField(k, T.ArrayType(t)) for k, t in kinds.items()), T.StructField("payload", T.BinaryType()), T.StructField("crc", T.LongType())])

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of one block

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            room = np.full((t.num_rows, stride), pad, "<u2")
            for k, ids in enumerate(t["ids"]):
                raw = np.frombuffer(ids.as_buffer(), "<u2")
                room[k, : len(raw)] = raw
            payload = room.tobytes()
            lists = [pa.array([t[c].to_pylist()], pa.list_(t[c].type)) for c in names.values()]
            head = [pa.array([t["shard"][0].as_py()], pa.int64()), pa.array([t["block"][0].as_py()], pa.int64()), pa.array([t.num_rows], pa.int32())]
            return pa.RecordBatch.from_arrays([*head, *lists, pa.array([payload], pa.binary()), pa.array([zlib.crc32(payload)], pa.int64())], schema.fieldNames())

        for b in batches:
            at = np.asarray(b["shard"]) * of_shard + np.asarray(b["block"])
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for x, y in zip(cuts, cuts[1:]):
                if held and (held[0]["shard"][0].as_py(), held[0]["block"][0].as_py()) != (b["shard"][x].as_py(), b["block"][x].as_py()):
                    yield packed()
                    held = []
                held.append(b.slice(x, y - x))
        if held:
            yield packed()

    shown.mapInArrow(run, schema).write.mode(mode).options(**FAST_ZSTD).parquet(path)


def read_from(spark, path: str, slot: int, per_shard: int = PER_SHARD, per_block: int = PER_BLOCK) -> DataFrame:
    """Blocks from the one that holds ``slot`` on, in training order; the filter is pushed to the files."""
    shard, block = slot // per_shard, slot % per_shard // per_block
    later = (F.col("shard") > shard) | ((F.col("shard") == shard) & (F.col("block") >= block))
    return spark.read.parquet(path).where(later).orderBy("shard", "block")


def digests(blocks: DataFrame, stride: int = STRIDE, per_shard: int = PER_SHARD, per_block: int = PER_BLOCK) -> DataFrame:
    """One row for each record of written blocks, with the crc of the ids that the payload holds at its place."""

    def of(payload: Column) -> Column:
        def one(length: Column, k: Column) -> Column:
            ids = F.substr(payload, k * (2 * stride) + 1, (length * 2).cast("int"))
            return F.struct(F.get("doc_ids", k).alias("doc_id"), F.get("pieces", k).alias("piece"), length.alias("length"), k.alias("k"), F.crc32(ids).alias("ids_crc32"))

        return F.transform("lengths", one)

    # The payload is bound once, so that it isn't copied for each of its records.
    each = blocks.select("shard", "block", F.explode(F.transform(F.array("payload"), of)[0]).alias("r")).select("shard", "block", "r.*")
    each = each.withColumn("record", F.col("block") * per_block + F.col("k")).withColumn("slot", F.col("shard") * per_shard + F.col("record"))
    return each.select("doc_id", "piece", "length", "slot", "shard", "record", (F.col("record") * (2 * stride)).alias("offset"), "ids_crc32")


def op8(docs: DataFrame) -> DataFrame:
    """Places every sequence, writes the padded records in blocks of shards, reads them back and digests what they hold."""
    seqs = written(sequences(docs).withColumn("rid", F.monotonically_increasing_id()), **FAST_ZSTD)
    n = seqs.count()
    path = new_path(docs.sparkSession, "blocks")
    write_blocks(ordered(seqs, n), path, rows=n)
    return spread_by_slot(digests(docs.sparkSession.read.parquet(path)), n)


def spread_by_slot(placed: DataFrame, rows: int) -> DataFrame:
    """Range partitions by slot, each in training order."""
    least = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(max(least, -(-rows // PER_SHARD)), "slot").sortWithinPartitions("slot")
