"""Connected components by alternating star operations on an edge table.

Before the first round every partition replaces its own edges by stars, in numpy and some
hundred thousand edges at a time, as partial sums do before a shuffle, so dense groups are
sent on as trees.
Each round hangs every vertex's larger neighbours (large star), then its smaller
neighbours and itself (small star), under the smallest vertex it knows of. Rounds
grow with the logarithm of a component's diameter, the edge count does not grow, and
every step is an aggregation with partial sums and a join, so no task holds a
component. Rounds are written to the shared work folder, which cuts lineage.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import work

MAX_ROUNDS = 60
HELD = 1_000_000  # edges that a partition holds before it contracts them
FINISH = 2_000_000  # for ``finish``: edges that one task may contract


def contract(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The stars of the connected sets of edges (u, v). Vertices are numbered in their
    order, and every set's numbers hang under its least by repeated hooking."""
    ids = pc.unique(pa.concat_arrays([u, v]))
    ids = ids.take(pc.sort_indices(ids))
    a, b = (pc.index_in(k, value_set=ids).to_numpy(zero_copy_only=False) for k in (u, v))
    root = hooked(len(ids), a, b)
    leaves = np.flatnonzero(root < np.arange(len(root)))
    return ids.take(pa.array(leaves)), ids.take(pa.array(root[leaves]))


def hooked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of vertices 0 to n - 1, each one's least in its connected set of edges (a, b)."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low < high
        if not apart.any():
            break
        a, b = low[apart], high[apart]
        np.minimum.at(root, b, a)
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
    return root


def _stars(batches: Iterator[pa.RecordBatch], held_most: int = HELD) -> Iterator[pa.RecordBatch]:
    """A star for every connected set of the edges seen, in place of those edges."""
    held: list[pa.RecordBatch] = []

    def contracted() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ends = contract(*[table.column(k).combine_chunks() for k in (0, 1)])
        return pa.RecordBatch.from_arrays([k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in ends], names=["u", "v"])

    for b in batches:
        held.append(b)
        if sum(k.num_rows for k in held) >= held_most:
            held = [contracted()]
            if held[0].num_rows > held_most // 2:  # contracting again would not pay
                yield held.pop()
    if held:
        yield contracted()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every vertex hangs under one root, and no root under another. Edges lead
    from greater to lesser ids, so a root is then the least of its component."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi")
    return twice.select("u").unionByName(chained.select("u")).isEmpty()


def connected_components(edges: DataFrame, loops: bool = True, finish: int = 0) -> DataFrame:
    """(id, root) for every vertex of ``edges`` (u, v); root is the least id of its component.

    Vertices of any orderable type. Loops and repeated edges are allowed, rows with a
    null end are ignored, and vertices without edges are the caller's to add. ``edges``
    is read once more for vertices that have only loops, unless ``loops`` is False. Once
    fewer than ``finish`` edges are left, one task contracts them instead of more rounds.
    """
    edges = edges.select("u", "v").where(F.col("u").isNotNull() & F.col("v").isNotNull())
    stars = edges.where("u <> v").mapInArrow(_stars, edges.schema)
    now = work.materialize(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for k in range(MAX_ROUNDS):
        if finish and now.count() < finish:
            now = work.materialize(now.coalesce(1).mapInArrow(functools.partial(_stars, held_most=finish), now.schema), "stars")
            break
        if _all_stars(now):
            break
        now = work.materialize(_small_star(_large_star(now)), f"stars-{k}")
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    if not loops:
        return leaves.unionByName(roots)
    looped = edges.where("u = v").select(F.col("u").alias("id")).distinct()
    alone = looped.join(leaves.select("id").unionByName(roots.select("id")), "id", "left_anti").select("id", F.col("id").alias("root"))
    return leaves.unionByName(roots).unionByName(alone)
