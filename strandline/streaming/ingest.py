"""Incremental ingest of pairs: a batch clusters its own pairs and the members of those
standing clusters that they overlap, and nothing else.

A component that holds a new pair is made of new pairs and of whole standing components,
each with a member that overlaps a new pair. So these standing clusters are superseded, and
all others stay as they are.

``members`` and ``calls`` grow by appends, each under its batch's id. A row of ``calls`` is a
cluster, or (``gone``) the key of one that the batch supersedes; a member counts unless its
cluster was superseded by a later batch. A batch reads only what batches before it wrote, so
one that is replayed after a failure replaces its own files and counts once. Its work tables
are removed when it ends. A batch scans the live members of its chromosome pairs to find the
overlaps; only touched clusters are shuffled and written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strandline import work
from strandline.operators import clusters

KEYS = ("chr_l", "chr_r")
CALL = ("cluster_id", *KEYS)
PAIRS = "name string, chr_l long, l_start long, l_end long, l_or string, chr_r long, r_start long, r_end long, r_or string, lmin long, lmax long"


def _log(spark: SparkSession, path: str, like: T.StructType) -> DataFrame:
    """The rows of all batches under ``path``, with their ``batch``; none before the first."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in like]).add("batch", "long")
    fs, at = work.filesystem(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def _calls(spark: SparkSession, path: str) -> DataFrame:
    like = clusters.summarize(clusters.no_cluster(clusters.valid_pairs(spark.createDataFrame([], PAIRS))))
    return _log(spark, f"{path}/calls", like.withColumn("gone", F.lit(False)).schema)


def _live(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Rows (with CALL and batch) of clusters that no later batch supersedes."""
    gone = calls.where("gone").groupBy(*CALL).agg(F.max("batch").alias("_gone"))
    return rows.join(gone, list(CALL), "left").where(F.col("_gone").isNull() | (F.col("_gone") <= F.col("batch"))).select(*rows.columns)


def apply_batch(batch: DataFrame, batch_id: int, path: str, min_size: int = 4) -> None:
    """Adds a batch of pr rows to the clusters so far."""
    with work.removed_after():
        _apply(batch, batch_id, path, min_size)


def _apply(batch: DataFrame, batch_id: int, path: str, min_size: int) -> None:
    spark = batch.sparkSession
    prs = work.materialize(clusters.valid_pairs(batch), "batch")
    touched = prs.select(*KEYS).distinct().collect()  # at most one row per chromosome pair
    if not touched:
        return
    before = F.col("batch") < batch_id
    like = clusters.no_cluster(prs)
    # filters on the folders' names, so no other chromosome pair is read
    here = F.col("chr_l").isin([r[0] for r in touched]) & F.col("chr_r").isin([r[1] for r in touched])
    standing = _log(spark, f"{path}/members", like.schema).where(before & here)
    standing = _live(standing, _calls(spark, path).where(before & here))
    met = standing.join(clusters.overlapping(standing, prs), "name", "left_semi")
    met = work.materialize(met.select(*CALL).distinct(), "met")
    again = standing.join(met, list(CALL), "left_semi").select(*prs.columns).unionByName(prs)
    found = clusters.cluster_members(work.materialize(again, "again"))
    found.select(*like.columns).write.mode("overwrite").partitionBy(*KEYS).parquet(f"{path}/members/batch={batch_id}")
    own = _log(spark, f"{path}/members", like.schema).where(F.col("batch") == batch_id).drop("batch")
    calls = clusters.size_filter(clusters.summarize(own), min_size).withColumn("gone", F.lit(False))
    calls.unionByName(met.withColumn("gone", F.lit(True)), allowMissingColumns=True).write.mode("overwrite").parquet(f"{path}/calls/batch={batch_id}")


def cluster_stream(pairs: DataFrame, path: str, checkpoint: str, min_size: int = 4, **trigger) -> StreamingQuery:
    """Starts the stream ``pairs`` into ``path``; ``trigger`` as of writeStream.trigger."""
    write = pairs.writeStream.foreachBatch(lambda df, k: apply_batch(df, k, path, min_size)).option("checkpointLocation", checkpoint)
    return write.trigger(**(trigger or {"availableNow": True})).start()


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """The clusters so far; no rows before the first cluster."""
    calls = _calls(spark, path)
    return _live(calls.where("not gone"), calls).drop("gone", "batch")
