"""Approximate nearest neighbours: stable projections indexed by kd-trees.

The search is for the largest inner product. Vectors get one more component that makes
their length equal, and queries are scaled to that length, so the largest inner product
is the least Euclidean distance d. ``PROJECTIONS`` Gaussian (2-stable) projections then
make the squared projected distance of a point d^2 times a chi-square variable. A query
takes the points of a kd-tree one by one in order of projected distance, leaf after leaf
as their boxes come into reach, and verifies each by its exact inner product. It stops at
the first point whose squared projected distance is above d_k^2 times the chi-square
quantile of ``SURE``, where d_k is the distance of its k-th best so far: a point as near
as that one would have come earlier with probability ``SURE``. Column ``verified`` of the
result says how many different vectors a query has verified.

Where distances hardly differ (random vectors of many dimensions) the test can only hold
late, and a large share is verified; where vectors lie near a surface of few dimensions
it holds early. The README has both shares.

Scale. A top kd-tree over a bounded sample (``SAMPLE`` rows of least id hash; every row
is indexed) cuts the projected space into up to ``CELLS`` cells, and cells above two
blocks get a tree of their own with up to ``CELLS_OF_CELL`` cells, so cells grow in
number with the table and not in size. A block is about ``BLOCK_BYTES`` of vectors; what
still exceeds two blocks (copies of one vector, tables of over 1e9 rows) is cut by a hash
into blocks that are all searched. A query first visits its own cell; the k-th best found
there bounds the cells that the stopping test leaves to visit. A block that more than
``QUERIES`` queries visit is dealt out several times, each time to a part of them. Equal
vectors are one point of a block with all their ids. The driver holds trees, boxes and
counts of cells alone, at most ``CELLS * CELLS_OF_CELL``.

Defined cases: vectors that are null, zero, or hold null or non-finite components take
no part, nor do those whose dimension is not the commonest (ties: the least); a null
vec_id takes no part. Repeated rows are rows, and each may be a neighbour; rows with the
query's own vec_id are none of its neighbours, and query rows of one vec_id are one query,
by their least vector. Ties go to the smaller vec_id; fewer candidates than k give fewer
rows. Components are scaled by a power of two, so squares don't overflow.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import store

PROJECTIONS, SURE = 24, 0.97
LEAF, BLOCK_BYTES, SAMPLE = 64, 8 << 20, 16_384
CELLS, CELLS_OF_CELL = 1024, 64
QUERIES = 16_384  # of a dealt block
NEIGHBOURS = 20
BATCH, CHUNK = 256, 64  # queries at once; points verified at once of each, up to four times as many


def chi_square(x: np.ndarray, m: int = PROJECTIONS) -> np.ndarray:
    """P(chi-square with an even number m of degrees <= x)."""
    half = np.minimum(x / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_bound(sure: float = SURE, m: int = PROJECTIONS) -> float:
    """The x at which ``chi_square`` is ``sure``."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(np.array(mid), m) < sure else (lo, mid)
    return hi


def projection(dim: int) -> np.ndarray:
    """The fixed Gaussian matrix (dim + 1) x PROJECTIONS."""
    seed = int.from_bytes(hashlib.blake2b(f"stable:{dim}".encode(), digest_size=8).digest(), "little")
    return np.random.default_rng(seed).standard_normal((dim + 1, PROJECTIONS))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Points with a last component that makes their length ``longest``."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - (x * x).sum(1)))
    return np.column_stack([x, rest])


def lengths(q: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows that are not zero, however small."""
    top = np.abs(q).max(1, keepdims=True)
    return top[:, 0] * np.linalg.norm(q / top, axis=1)


def scaled(q: np.ndarray, longest: float) -> np.ndarray:
    q = q / np.abs(q).max(1, keepdims=True)
    return np.column_stack([q * (longest / np.linalg.norm(q, axis=1))[:, None], np.zeros(len(q))])


class Tree:
    """A kd-tree by median cuts: inner nodes (dimension, cut), leaves numbered left to right."""

    def __init__(self, p: np.ndarray, leaf: int):
        self.depth = max(0, math.ceil(math.log2(max(1, len(p)) / leaf))) if len(p) else 0
        self.dims = np.zeros(max(1, 2**self.depth), np.int64)
        self.cuts = np.zeros(max(1, 2**self.depth))
        rows = {1: np.arange(len(p))}
        for node in range(1, 2**self.depth):
            own = rows.pop(node)
            d = int(np.argmax(np.ptp(p[own], axis=0))) if len(own) else 0
            cut = float(np.median(p[own, d])) if len(own) else 0.0
            self.dims[node], self.cuts[node] = d, cut
            right = p[own, d] > cut
            rows[2 * node], rows[2 * node + 1] = own[~right], own[right]
        self.rows = [rows[k] for k in sorted(rows)]

    @classmethod
    def of(cls, depth: int, dims: list[int], cuts: list[float]) -> Tree:
        """A tree without its rows."""
        tree = cls.__new__(cls)
        tree.depth, tree.dims, tree.cuts = depth, np.array(dims, np.int64), np.array(cuts)
        return tree

    def leaf_of(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.dims[node]] > self.cuts[node])
        return node - 2**self.depth


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of queries (rows) to boxes (columns)."""
    total = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(0.0, np.maximum(low[:, d] - q[:, d : d + 1], q[:, d : d + 1] - high[:, d]))
        total += gap * gap
    return total


class Forest:
    """A top tree some of whose cells have trees of their own; all cells are numbered through."""

    def __init__(self, top: Tree, below: dict[int, Tree]):
        self.top, self.below = top, below
        n = np.array([2 ** below[c].depth if c in below else 1 for c in range(2**top.depth)])
        self.first, self.cells = np.cumsum(n) - n, int(n.sum())

    def cell_of(self, p: np.ndarray) -> np.ndarray:
        at = self.top.leaf_of(p)
        out = self.first[at]
        for c in np.unique(at) if self.below else ():
            if c in self.below:
                own = at == c
                out[own] += self.below[c].leaf_of(p[own])
        return out


class BlockIndex:
    """The distinct vectors of a block in a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order]) + 0.0  # no negative zero
        flat = x.view(np.dtype((np.void, x.shape[1] * 8))).ravel()
        _, first, group = np.unique(flat, return_index=True, return_inverse=True)
        # vectors are numbered by their least id, so that equal scores go to it
        number = np.empty(len(first), np.int64)
        number[np.argsort(first)] = np.arange(len(first))
        group, first = number[group], np.sort(first)
        by_group = np.argsort(group, kind="stable")
        self.ids, self.count = ids[by_group], np.bincount(group)
        self.start = np.cumsum(self.count) - self.count
        self.known = np.unique(ids)
        self.place = group[by_group] * len(self.known) + np.searchsorted(self.known, self.ids)
        self.x, self.longest, self.matrix = x[first], longest, matrix
        p = lifted(self.x, longest) @ matrix
        leaves = [r for r in Tree(p, LEAF).rows if len(r)]
        self.low = np.array([p[r].min(0) for r in leaves])
        self.high = np.array([p[r].max(0) for r in leaves])
        self.leaves = np.full((len(leaves), max(map(len, leaves))), -1, np.int32)
        for k, r in enumerate(leaves):
            self.leaves[k, : len(r)] = r
        self.p, self.p2 = p, np.append((p * p).sum(1), np.inf)  # -1: nowhere

    def _opened(self, own: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared projected distances from queries to the points of each one's leaves
        (-1: none), and the points."""
        rows, width = leaf.shape[0], self.leaves.shape[1]
        points = np.where(leaf[:, :, None] >= 0, self.leaves[leaf], -1)
        gap = np.full(points.shape, np.inf, np.float32)
        flat = leaf.ravel()
        by = np.argsort(flat, kind="stable")
        by = by[np.searchsorted(flat[by], 0) :]
        own2 = (own * own).sum(1)
        for part in np.split(by, np.flatnonzero(np.diff(flat[by])) + 1) if len(by) else ():
            q, slot, mine = part // leaf.shape[1], part % leaf.shape[1], self.leaves[flat[part[0]]]
            gap[q, slot] = np.maximum(own2[q, None] + self.p2[mine] - 2 * (own[q] @ self.p[mine].T), 0.0)
        return gap.reshape(rows, -1), points.reshape(rows, -1)

    def nearest(self, q: np.ndarray, floor: np.ndarray, keep: int, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query: the ``keep`` best vectors (-1: none), their scores, and how many
        vectors were verified until the test held."""
        n, leaves = len(q), len(self.leaves)
        best, which, verified = np.full((n, keep), -np.inf), np.full((n, keep), -1), np.zeros(n, np.int64)
        far, slope = 2 * self.longest**2, 2 * self.longest / lengths(q)
        own = scaled(q, self.longest) @ self.matrix
        near = box_distance(own, self.low, self.high)
        order = np.argsort(near, axis=1, kind="stable")
        near = np.column_stack([np.take_along_axis(near, order, 1), np.full(n, np.inf)])

        def reach(rows: np.ndarray) -> np.ndarray:
            """The squared projected distance beyond which the test holds."""
            d2 = far - slope[rows] * np.maximum(best[rows, -1], floor[rows])
            return bound * np.maximum(d2, 0.0) * (1 + 1e-5) + 1e-6 * far

        active, opened = np.arange(n), 0
        held_d, held_u = np.empty((n, 0), np.float32), np.empty((n, 0), np.int32)
        while len(active) and opened < leaves:
            # each query opens as many leaves again as it has; points wait for their turn
            then = min(leaves, max(4, 2 * opened))
            mine = np.where(near[active, opened:then] <= reach(active)[:, None], order[active, opened:then], -1)
            d, u = self._opened(own[active], mine)
            held_d, held_u = np.concatenate([held_d, d], 1), np.concatenate([held_u, u], 1)
            by = np.argsort(held_d, axis=1)
            held_d, held_u = np.take_along_axis(held_d, by, 1), np.take_along_axis(held_u, by, 1)
            ahead, at, size = near[active, then], 0, CHUNK  # what comes later is at least as far as ``ahead``
            todo = np.arange(len(active))
            while len(todo) and at < held_d.shape[1]:
                part = held_d[todo, at : at + size]
                ready = part <= np.minimum(ahead[todo], reach(active[todo]))[:, None]
                ready &= np.isfinite(part)
                row, slot = np.nonzero(ready)
                if not len(row):
                    break
                mine, q_row = held_u[todo, at : at + size], active[todo[row]]
                score = np.full(ready.shape, -np.inf)
                # in the order of components, so the same for equal vectors
                score[row, slot] = np.einsum("ij,ij->i", q[q_row], self.x[mine[row, slot]])
                a = active[todo]
                s, w = np.concatenate([best[a], score], 1), np.concatenate([which[a], np.where(ready, mine, -1)], 1)
                if s.shape[1] > 4 * keep:  # all that reach the least score kept
                    cut = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
                    wide = int((s >= cut[:, None]).sum(1).max())
                    if wide < s.shape[1] // 2:
                        some = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
                        s, w = np.take_along_axis(s, some, 1), np.take_along_axis(w, some, 1)
                by = np.lexsort((w, -s), axis=-1)[:, :keep]
                best[a], which[a] = np.take_along_axis(s, by, 1), np.take_along_axis(w, by, 1)
                verified += np.bincount(q_row, minlength=n)
                held_d[todo[row], at + slot] = np.inf
                todo = todo[ready.all(1)]
                at, size = at + size, min(2 * size, 4 * CHUNK)
            opened = then
            goes = near[active, then] <= reach(active)
            goes |= (held_d <= reach(active)[:, None]).any(1) & (then < leaves)
            active, held_d, held_u = active[goes], held_d[goes], held_u[goes]
            wide = int((held_d <= reach(active)[:, None]).sum(1).max(initial=0)) if len(active) else 0
            by = np.argpartition(held_d, wide - 1, axis=1)[:, :wide] if 0 < wide < held_d.shape[1] else np.broadcast_to(np.arange(wide), (len(active), wide))
            held_d, held_u = np.take_along_axis(held_d, by, 1), np.take_along_axis(held_u, by, 1)
        return which, best, verified

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vec_id, score) of each query's best k rows in this block, of those that
        reach its ``floor``, the k-th best score that it has elsewhere; and vectors verified."""
        which, best, verified = self.nearest(q, floor, k + 1, bound)  # one more, for the query itself
        row, slot = np.nonzero(which >= 0)
        u, score = which[row, slot], best[row, slot]
        # rows of a vector without the query's own, which lie together
        code = np.minimum(np.searchsorted(self.known, q_ids), len(self.known) - 1)
        key = np.where(self.known[code] == q_ids, code, -1)[row]
        mine = u * len(self.known) + key
        lo = np.where(key >= 0, np.searchsorted(self.place, mine, "left"), self.start[u])
        own = np.where(key >= 0, np.searchsorted(self.place, mine, "right") - lo, 0)
        take = np.minimum(self.count[u] - own, k)
        at = np.repeat(self.start[u], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        at += np.where(at >= np.repeat(lo, take), np.repeat(own, take), 0)
        row, score, vec = np.repeat(row, take), np.repeat(score, take), self.ids[at]
        ok = score >= floor[row]
        row, vec, score = row[ok], vec[ok], score[ok]
        by = np.lexsort((vec, -score, row))
        row, vec, score = row[by], vec[by], score[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return row[rank < k], vec[rank < k], score[rank < k], verified


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): rows that take part, as doubles."""
    x = store.col(vec_col).cast("array<double>")
    got = df.select(store.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    got = got.where(fine & F.exists("x", lambda v: v != 0))
    common = got.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return got.where(F.size("x") == (common["n"] if common else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, longest: float, matrix: np.ndarray, k: int, bound: float) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, is_query, vec_id, floor, x), sorted so, points first. A row
    without vec_id gives the number of vectors that a query has verified as its score."""
    names = ["query_id", "vec_id", "score"]
    at, index, ids, points = None, None, [], []
    for b in batches:
        key = np.column_stack([b.column(c).to_numpy() for c in range(3)])
        vec, floor, x = b.column(3).to_numpy(), b.column(4).to_numpy(), _matrix(b.column(5), dim)
        cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1
        for rows in np.split(np.arange(len(key)), cuts):
            if not len(rows):
                continue
            if tuple(key[rows[0], :2]) != at:
                at, index, ids, points = tuple(key[rows[0], :2]), None, [], []
            if not key[rows[0], 2]:
                ids.append(vec[rows])
                points.append(x[rows])
                continue
            if not ids:
                continue
            if index is None:
                index = BlockIndex(np.concatenate(ids), np.concatenate(points), longest, matrix)
            for lo in range(0, len(rows), BATCH):
                own = rows[lo : lo + BATCH]
                row, found, score, verified = index.search(vec[own], x[own], floor[own], k, bound)
                yield pa.RecordBatch.from_arrays([pa.array(vec[own][row]), pa.array(found, pa.int64()), pa.array(score, pa.float64())], names=names)
                yield pa.RecordBatch.from_arrays([pa.array(vec[own]), pa.nulls(len(own), pa.int64()), pa.array(verified.astype(float))], names=names)


def _subtrees(points: DataFrame, place, counts: dict[int, int], block: int, most: int) -> dict[int, Tree]:
    """Trees of the cells of over two blocks, each from a bounded sample of its rows."""
    wanted = {c: min(most, math.ceil(n / block)) for c, n in counts.items() if n > 2 * block}
    if not wanted:
        return {}

    def sample(batches):
        for vec, x, p, cell in map(place, batches):
            share = np.array([min(1.0, 16 * wanted.get(int(c), 0) / counts[int(c)]) for c in cell])
            # a fixed hash of the id, so that reruns agree; equal ids count once below
            own = np.flatnonzero((vec.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / 2**53 < share)
            yield pa.RecordBatch.from_arrays([pa.array(cell[own].astype(np.int64)), pa.array(vec[own]), pa.array(list(p[own]), pa.list_(pa.float64()))], names=["cell", "vec_id", "p"])

    def grown(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = np.array(rows["p"].tolist())
        tree = Tree(p, max(1, len(p) / wanted[key[0]]))
        return pd.DataFrame({"cell": [key[0]], "depth": [tree.depth], "dims": [tree.dims.tolist()], "cuts": [tree.cuts.tolist()]})

    found = points.mapInArrow(sample, "cell long, vec_id long, p array<double>").dropDuplicates(["cell", "vec_id"])
    grown_rows = found.groupBy("cell").applyInPandas(grown, "cell long, depth int, dims array<long>, cuts array<double>").collect()  # a row per cell
    return {r["cell"]: Tree.of(r["depth"], r["dims"], r["cuts"]) for r in grown_rows}


def search(spark: SparkSession, df: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", vec_col: str = "embedding", sure: float = SURE, block: int | None = None, cells: int = CELLS, cells_of_cell: int = CELLS_OF_CELL, queries_of_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score, verified: the k nearest found of each query row of
    ``df``. ``is_query`` is a condition on the column ``vec_id``."""
    base = store.materialize(usable(df, id_col, vec_col), "vectors")
    sq = F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim"), F.max(sq).alias("top")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    n, dim = facts["n"], facts["dim"]
    # a power of two: scaled vectors have the same scores but for the exponent
    scale = 2.0 ** max(-1022, min(1022, math.frexp(facts["top"])[1]))
    base = base.withColumn("x", F.transform("x", lambda v: v / scale))
    longest = math.sqrt(base.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0]) * (1 + 1e-12)
    matrix, bound = projection(dim), chi_square_bound(sure)
    block = block or max(1024, BLOCK_BYTES // (8 * dim))
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, n)).select("x").toPandas()
    n_cells = min(max(1, math.ceil(n / block)), max(1, len(sample) // 16), cells)
    top = Tree(lifted(np.array(sample["x"].tolist()), longest) @ matrix, max(1, len(sample) / n_cells))

    def placed(forest: Forest):
        def place(b: pa.RecordBatch):
            x = _matrix(b.column(1), dim)
            p = lifted(x, longest) @ matrix
            return b.column(0).to_numpy(), x, p, forest.cell_of(p)

        return place

    names = ["cell", "n", "low", "high"]

    def boxes(place, inner: DataFrame) -> list:
        """(cell, rows, box) of each cell that has rows."""

        def run(batches):
            for _, _, p, cell in map(place, batches):
                own = np.unique(cell)
                part = [(int(c), int((cell == c).sum()), p[cell == c].min(0), p[cell == c].max(0)) for c in own]
                cols = list(zip(*part, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names=names)

        made = inner.mapInArrow(run, "cell long, n long, low array<double>, high array<double>")
        edge = [f(F.col(c)[d]) for c, f in (("low", F.min), ("high", F.max)) for d in range(PROJECTIONS)]
        return made.groupBy("cell").agg(F.sum("n"), F.array(*edge[:PROJECTIONS]), F.array(*edge[PROJECTIONS:])).collect()  # a row per cell

    rows = boxes(placed(Forest(top, {})), base)
    below = _subtrees(base, placed(Forest(top, {})), {r[0]: r[1] for r in rows}, block, cells_of_cell)
    forest = Forest(top, below)
    if below:
        rows = boxes(placed(forest), base)
    place = placed(forest)
    low = np.full((forest.cells, PROJECTIONS), np.inf)
    high = np.full((forest.cells, PROJECTIONS), -np.inf)
    salts = np.zeros(forest.cells, np.int64)
    for r in rows:
        low[r[0]], high[r[0]], salts[r[0]] = r[2], r[3], math.ceil(r[1] / (2 * block))
    first_block = np.cumsum(salts) - salts
    held = spark.sparkContext.broadcast((low, high, salts, first_block))
    least = Window.partitionBy("vec_id").orderBy("x")
    queries = base.where(is_query).withColumn("_n", F.row_number().over(least)).where("_n = 1").select("vec_id", "x")

    def visits(b: pa.RecordBatch, home: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of the blocks that queries (vec_id, x, floor) go to."""
        low, high, salts, first_block = held.value
        _, x, _, own = place(b)
        if home:
            row, cell = np.arange(len(x)), own
        else:
            far = np.maximum(2 * longest**2 - 2 * longest / lengths(x) * b.column(2).to_numpy(), 0.0)
            reach = bound * far * (1 + 1e-5) + 2e-6 * longest**2
            go = [np.flatnonzero(box_distance(q[None], low, high)[0] <= r) for q, r in zip(scaled(x, longest) @ matrix, reach, strict=True)]
            row, cell = np.repeat(np.arange(len(x)), [len(g) for g in go]), np.concatenate([np.zeros(0, np.int64), *go])
            row, cell = row[cell != own[row]], cell[cell != own[row]]
        times = salts[cell]
        salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(row, times), np.repeat(first_block[cell], times) + salt

    def part_of(vec: np.ndarray, parts: np.ndarray) -> np.ndarray:
        mixed = vec.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)

    def visited(q: DataFrame, home: bool) -> DataFrame:
        q = q.select("vec_id", "x", "floor")

        def count(batches):
            for b in batches:
                block, n = np.unique(visits(b, home)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(n.astype(np.int64))], names=["block", "n"])

        loads = q.mapInArrow(count, "block long, n long").groupBy("block").agg(F.sum("n")).collect()  # a row per block
        parts = np.zeros(int(salts.sum()), np.int64)
        for r in loads:
            parts[r[0]] = math.ceil(r[1] / queries_of_block)
        dealt = spark.sparkContext.broadcast(parts)
        names = ["block", "part", "kind", "vec_id", "floor", "x"]

        def points(batches):
            _, _, salts, first_block = held.value
            for b in batches:
                vec, _, _, cell = place(b)
                own = first_block[cell] + part_of(vec + 1, salts[cell])
                times = dealt.value[own]
                row = np.repeat(np.arange(len(vec)), times)
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                for lo in range(0, len(row), 4096):
                    r = row[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(part[lo : lo + 4096]), pa.array(np.zeros(len(r), np.int32)), b.column(0).take(pa.array(r)), pa.array(np.zeros(len(r))), b.column(1).take(pa.array(r))], names=names)

        def askers(batches):
            for b in batches:
                row, own = visits(b, home)
                part = part_of(b.column(0).to_numpy()[row], dealt.value[own])
                for lo in range(0, len(row), 4096):
                    r = row[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(own[lo : lo + 4096]), pa.array(part[lo : lo + 4096]), pa.array(np.ones(len(r), np.int32)), b.column(0).take(pa.array(r)), b.column(2).take(pa.array(r)), b.column(1).take(pa.array(r))], names=names)

        schema = "block long, part long, kind int, vec_id long, floor double, x array<double>"
        both = base.mapInArrow(points, schema).unionByName(q.mapInArrow(askers, schema))
        both = both.repartition("block", "part").sortWithinPartitions("block", "part", "kind", "vec_id")
        return both.mapInArrow(lambda it: _blocks(it, dim, longest, matrix, k, bound), "query_id long, vec_id long, score double")

    lowest = F.lit(-1e300)
    first = store.materialize(visited(queries.withColumn("floor", lowest), True), "own-cells")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = first.where("vec_id IS NOT NULL")
    kth = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    bounded = store.materialize(queries.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("floor", lowest)), "bounds")
    # a query visits each block once, so no row is found twice
    best = store.materialize(first.unionByName(visited(bounded, False)), "found")
    work = best.where("vec_id IS NULL").groupBy("query_id").agg(F.sum("score").cast("long").alias("verified"))
    best = best.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(work, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (F.col("score") * scale * scale).alias("score"), "verified")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, store.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
