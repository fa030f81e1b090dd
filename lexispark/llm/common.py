"""Helpers that several operators share: tables, written intermediates, joins on skewed keys."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop_at_exit, shared_dir

#: ``[\x20\x09-\x0D]``, the only characters that count as white space around lines and words.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows that a broadcast of heavy keys can hold, and rows of a key that are no burden (see join_by_counts).
HEAVY, LIGHT = 2048, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Later stages then depend on replicated files, not on shuffle output of executors that may be lost.
    The files go when the session's file system is closed.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def written(df: DataFrame, name: str) -> str:
    """Where ``df`` was written as Parquet."""
    spark = df.sparkSession
    path = drop_at_exit(spark, f"{shared_dir(spark)}/lexispark/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return path


def others(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of ``df`` without those of the names, whatever their case: Spark can't tell such names apart."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns memory that this process has freed to the system, where the allocators know how."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with freed memory returned before and after: workers are used again, and would hold what a stage freed."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return tidied


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is.  Pure ASCII takes the byte-wise path of lower()."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def join_by_counts(left: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of ``left`` with ``groups`` (one row per key, ``n`` = its rows in ``left``), whatever the skew.

    A key with more than 1/HEAVY of the counted rows, and more than LIGHT, is heavy; there are fewer than HEAVY such
    keys, so they are broadcast.  The others, or all where none is heavy, are joined by shuffle, and none of them fills a
    partition.
    """
    counted = groups.agg(F.sum(n).alias("total"), F.max(n).alias("most")).first()
    least = max(LIGHT, (counted.total or 0) // HEAVY)
    if (counted.most or 0) <= least:
        return left.join(groups, keys)
    heavy = F.col(n) > least
    big, rest = groups.where(heavy), groups.where(~heavy)
    return left.join(F.broadcast(big), keys).unionByName(left.join(F.broadcast(big.select(*keys)), keys, "left_anti").join(rest, keys))
