"""Work tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own = threading.local()  # what a thread made inside ``removed_after``
_local: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a folder of its own; elsewhere a
    machine-local folder would be invisible to other executors, so it is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="strandline-")
    return _local[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; it is removed when the driver ends."""
    path = f"{root(spark)}/strandline-{uuid.uuid4().hex}/{label}"
    _made.append((spark, path))
    if (inner := getattr(_own, "made", None)) is not None:
        inner.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once and returns it as a table scan, so that a lost executor
    costs a reread of the table and not the lineage before it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's FileSystem of ``path``, and ``path`` as its Path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path.rpartition("/")[0])
    fs.delete(at, True)


@contextmanager
def removed_after() -> Iterator[None]:
    """Removes the work tables that this thread makes inside, when it leaves. Only for work
    whose results are written elsewhere by then."""
    outer, _own.made = getattr(_own, "made", None), []
    try:
        yield
    finally:
        inner, _own.made = _own.made, outer
        for spark, path in inner:
            remove(spark, path)
            _made.remove((spark, path))


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session is gone
            return
