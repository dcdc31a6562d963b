"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source has a target number of words; each of its documents is expected
``target / source_size`` times. Documents are put in order within their source,
their expected copies are summed up, one random offset is added, and a document is
emitted once for every integer that its stretch of the running sum crosses. Every
document of a source has the same rate, so the running sum is ``rank * rate``, and
ranks need no task that holds a whole source: documents are dealt to cells
(source, size class, salt), ranked inside their cell, and shifted by the number of
documents in earlier cells. Ordering by size class makes the sample stratified by
size, so the words taken come near the target.

Defined cases: a null text has size 0; a null source is one source of its own and
comes last; a source without words has target 0 and its documents are not taken;
equal doc_ids with equal sizes are interchangeable; an empty table gives an empty
result. Nothing depends on partitioning, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import store

#: Runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
MAX_COPIES = 3
#: Documents of a (source, size class, salt) cell, which one task ranks; salts, at least.
CELL, SALTS = 100_000, 16
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """Adds ``target`` to a table (source, source_size), one row per source.

    Sources, by code point with null last, weigh ``weights`` in turn and share all
    words; a source at ``max_copies`` times its size stops there and the excess is
    shared again by weight. In the end a source is at its limit exactly if its limit
    divided by its weight is below the common level, so one running sum over the
    sources in order of that quotient finds the level. The windows hold one row per
    source, never documents.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("ratio"), F.col("place"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % n + 1).cast("int"))
    ranked = (
        per_source.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * F.lit(max_copies).cast("long"))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight").cast("double"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("full", F.col("left").cast("double") * F.col("weight").cast("double") / F.col("weight_left").cast("double") >= F.col("cap").cast("double"))
    )
    # the first source that is not full fixes the level for itself and all after it
    level = F.min(F.when(~F.col("full"), F.struct("ratio", "place", "left", "weight_left"))).over(whole)
    capped = F.col("level").isNull() | (F.struct("ratio", "place") < F.struct(F.col("level.ratio").alias("ratio"), F.col("level.place").alias("place")))
    share = F.col("level.left").cast("double") * F.col("weight").cast("double") / F.col("level.weight_left").cast("double")
    return ranked.withColumn("level", level).select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _salts(docs: DataFrame) -> int:
    """So many that cells stay bounded even where all documents have one source and size."""
    return max(SALTS, math.ceil(docs.count() / CELL))


def _with_cells(docs: DataFrame, sizes: Column, key: Column, salts: int) -> DataFrame:
    """Adds size, the size class (the highest four bits and their place) and the salt."""
    bits = F.length(F.bin(F.col("_size")))
    return (
        docs.withColumn("_size", sizes)
        .withColumn("_hash", F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")))
        .withColumn("_class", bits * 16 + F.expr("shiftright(_size, greatest(length(bin(_size)) - 4, 0))"))
        .withColumn("_salt", F.conv(F.substring("_hash", 1, 7), 16, 10).cast("int") % salts)
    )


def _copies(spark: SparkSession, sized: DataFrame, small: DataFrame, weights, max_copies: int, seed: str) -> DataFrame:
    """Adds source_size, target and copies to ``sized``; ``small`` is the same rows
    with the cell columns alone, whose cost is one more scan."""
    cells = small.groupBy("_source", "_class", "_salt").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"))
    cells = store.materialize(cells, "mix-cells")
    earlier = Window.partitionBy("_source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    per_source = cells.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"))
    goal = targets(per_source, weights, max_copies)
    cells = cells.select("*", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).drop("_n", "_words")
    cells = cells.join(goal, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("_source", "_class", "_salt").orderBy("_size", "_hash")
    ranked = sized.withColumn("_rank", F.row_number().over(inside))
    c = cells.select(F.col("_source").alias("_s"), F.col("_class").alias("_c"), F.col("_salt").alias("_t"), "_before", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    on = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_salt") == F.col("_t"))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size").cast("double")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("_source"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    place = (F.col("_before") + F.col("_rank")).cast("double")
    crossed = F.floor(F.col("_offset") + place * F.col("_rate")) - F.floor(F.col("_offset") + (place - 1) * F.col("_rate"))
    return ranked.join(c, on).drop("_s", "_c", "_t").withColumn("_rate", rate).withColumn("_offset", offset).withColumn("_copies", F.least(crossed.cast("long"), F.lit(max_copies).cast("long")))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken."""
    slim = docs.select(F.col("doc_id"), F.col("source").alias("_source"), F.col("text").alias("_text"))
    sized = _with_cells(slim, words(F.col("_text")), F.col("doc_id"), _salts(docs)).drop("_text")
    sized = store.materialize(sized, "mix-sizes")
    out = _copies(spark, sized, sized.select("_source", "_class", "_salt", "_size"), weights, max_copies, seed)
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as it has copies.

    Whole rows travel with their cell, so repeated or null doc_ids need no join back.
    """
    held = "_row"
    packed = docs.select(F.col("doc_id"), F.col("source").alias("_source"), F.struct(*[store.col(c) for c in docs.columns]).alias(held))
    salts = _salts(docs)
    sized = _with_cells(packed, words(F.col(f"{held}.text")), F.col("doc_id"), salts)
    small = _with_cells(docs.select("doc_id", F.col("source").alias("_source"), "text"), words(F.col("text")), F.col("doc_id"), salts).select("_source", "_class", "_salt", "_size")
    out = _copies(spark, sized, small, weights, max_copies, seed).where(F.col("_copies") > 0)
    return out.select(held, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).select(f"{held}.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, store.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
c AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS cls,
         CAST('0x' || substr(h, 1, 7) AS INTEGER) % greatest(16, CAST(ceil((SELECT count(*) FROM documents) / 100000.0) AS INTEGER)) AS salt
  FROM d),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM per),
w AS (
  SELECT *, 1 + (place - 1) % 3 AS weight, 3 * source_size AS cap FROM r),
x AS (
  SELECT *, CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio, sum(source_size) OVER () AS total FROM w),
y AS (
  SELECT *,
    total - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl
  FROM x),
z AS (
  SELECT *, CAST(lft AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(wl AS DOUBLE) >= CAST(cap AS DOUBLE) AS is_full FROM y),
first_open AS (SELECT ratio, place, lft, wl FROM z WHERE NOT is_full ORDER BY ratio, place LIMIT 1),
t AS (
  SELECT z.source, z.source_size,
    CASE WHEN f.place IS NULL OR (z.ratio, z.place) < (f.ratio, f.place) THEN CAST(z.cap AS DOUBLE)
         ELSE CAST(f.lft AS DOUBLE) * CAST(z.weight AS DOUBLE) / CAST(f.wl AS DOUBLE) END AS target
  FROM z LEFT JOIN first_open f ON true),
k AS (
  SELECT c.*, row_number() OVER (PARTITION BY source ORDER BY cls, salt, size, h) AS n FROM c),
j AS (
  SELECT k.doc_id, k.size, k.n, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(k.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * least(CAST(floor(u + CAST(n AS DOUBLE) * rate) - floor(u + (CAST(n AS DOUBLE) - 1) * rate) AS BIGINT), 3) AS taken
FROM j
"""
