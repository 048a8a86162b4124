"""Tables in the folder that all executors share: they cut lineage, outlive lost executors and are computed once."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths that ``new_path`` has given out and nobody has dropped, by application.
_MADE: dict[str, list[str]] = {}
#: The list that ``own_tables`` collects in, which other threads do not see.
_OWN: ContextVar[list[str] | None] = ContextVar("own_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where it is unset, a single-machine session (``local``, as in tests) gets a
    temporary folder; on a cluster that would be another folder on each machine,
    so there it is an error.
    """
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{os.path.realpath(tempfile.gettempdir())}/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, kind: str = "tables") -> str:
    """A path of its own in the shared folder, which ``drop_written`` deletes."""
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (own := _OWN.get()) is not None:
        own.append(path)
    return path


@contextmanager
def own_tables() -> Iterator[list[str]]:
    """The paths given out to this thread inside the block, for a ``drop_written`` that leaves other runs' tables alone."""
    own, outer = [], _OWN.get()
    held = _OWN.set(own)
    try:
        yield own
    finally:
        _OWN.reset(held)
        if outer is not None:
            outer.extend(own)


#: Options of a Parquet writer: the fastest level of zstd, for tables that are read once or twice.
FAST_ZSTD = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written to the shared folder, with a Parquet writer's ``options``, and read back."""
    path = new_path(df.sparkSession)
    df.write.options(**{"compression": "snappy", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """``df`` for a join that is not to broadcast it: rows that an explode made, or that compress well, look few to Spark."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as a shuffle has.

    The number is fixed: neither is one small file that becomes many rows one
    task, nor are rows that compress well put together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def made(spark: SparkSession) -> list[str]:
    """The paths there are now; a later ``drop_written`` can keep them."""
    return list(_MADE.get(spark.sparkContext.applicationId, ()))


def drop_written(spark: SparkSession, keep: Iterable[str] = (), among: Iterable[str] | None = None) -> None:
    """Deletes what ``new_path`` gave out (only ``among``, if given), but for ``keep``: to be called once no DataFrame needs those tables any more."""
    keep, among = set(keep), None if among is None else set(among)
    for path in made(spark):
        if path not in keep and (among is None or path in among):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            _MADE[spark.sparkContext.applicationId].remove(path)
