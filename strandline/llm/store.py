"""Shared plumbing: work tables, Arrow batches and input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.work import filesystem, materialize, new_path, remove, root

__all__ = ["BATCH_ROWS", "col", "filesystem", "free_name", "join_spread", "materialize", "new_path", "quoted", "read", "remove", "root", "small_batches"]

#: Rows and bytes handed to Python at once. Texts can be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``, if they are
    larger. Plans run after this returns, so the settings stay; results don't depend on them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores, so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def col(name: str) -> Column:
    """The column of exactly this name, whatever dots or backticks it holds."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: A key with more than one part in HEAVY of all rows is joined by broadcast: fewer than HEAVY keys are.
HEAVY = 10_000


def join_spread(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key, with the key's number of rows as ``weight``,
    which is dropped), all keys there. Frequent keys, which would fill single tasks of a
    shuffle, are broadcast; their number is bounded whatever the data."""
    often = F.col(weight) > total // HEAVY
    heavy, rest = (table.where(k).drop(weight) for k in (often, ~often))
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(heavy), key).unionByName(light)
