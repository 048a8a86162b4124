"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a prime-sized table
(an offset and a step from its name's hash); shards take turns and claim their
first free slot. Shares differ by one slot at most, and a change of shards moves
few slots. The table has a fixed number of rows, so it is broadcast: placing a
row is one hash and one lookup, without a shuffle and whatever the skew.

Defined cases: a null key is placed as the empty string; rows with the same key
share a shard; an empty table gives no rows; a table's own ``slot`` or ``shard``
stays, and the new column's name is lengthened by underscores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hashable, unused

#: Prime table size and production shard names.
SIZE, SHARDS = 16_381, tuple(f"shard-{i:03d}" for i in range(64))


def lookup_table(shards=SHARDS, size: int = SIZE) -> list[int]:
    """The number of the shard at each slot."""
    if not shards or len(shards) > size or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("give 1 to `size` shards and a prime size")
    def walk(name: str) -> Iterator[int]:
        digest = hashlib.md5(name.encode()).digest()
        offset, step = int.from_bytes(digest[:8]) % size, int.from_bytes(digest[8:]) % (size - 1) + 1
        return ((offset + i * step) % size for i in range(size))

    walks = [walk(name) for name in shards]
    table, free = [-1] * size, size
    while free:
        for shard, slots in enumerate(walks):
            slot = next(s for s in slots if table[s] < 0)
            table[slot], free = shard, free - 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The first 60 bits of the key's MD5, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards=SHARDS, size: int = SIZE) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard`` (number of the shard), of longer names where it has such columns."""
    slot, shard = unused(df, "slot", "shard")
    table = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",").cast("array<int>")
    rows = df.sparkSession.range(1).select(F.posexplode(table).alias(slot, shard))  # `size` rows
    placed = df.withColumn(slot, slot_of(F.col(key), size)).join(F.broadcast(rows), slot)
    return placed.select(*df.columns, slot, shard)


def write_shards(df: DataFrame, key: str, path: str, shards=SHARDS, rows_per_file: int = 1_000_000) -> None:
    """Writes ``df`` as Parquet, a folder for each shard; a shard's rows spread over files of bounded size."""
    placed, shard = place(df, key, shards), unused(df, "shard")[0]
    parts = max(1, -(-df.count() // rows_per_file))
    spread_over = F.pmod(F.xxhash64(*hashable(df)), F.lit(-(-parts // len(shards))))
    placed.repartition(max(parts, len(shards)), shard, spread_over).write.partitionBy(shard).parquet(path)


def op7(docs: DataFrame) -> DataFrame:
    return place(docs.select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


def op7_sql() -> str:
    return f"""
WITH s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, CAST(list_extract({lookup_table()}, slot + 1) AS INTEGER) AS shard FROM s
"""
