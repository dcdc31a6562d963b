"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

Documents are encoded, closed by id 0 and cut only where they exceed the sequence
length. The histogram of piece lengths has at most ``max_len`` entries, so the plan
is made on the driver from that alone: patterns of up to three lengths that fill a
sequence exactly are enumerated, repeat counts that best explain the histogram are
found by non-negative least squares, rounded down to whole sequences, and what is
left is packed by best fit, longest first, into whatever room is open. All steps run
on runs of equal sequences, so the plan's size depends on ``max_len`` and not on the
number of documents. Each piece then finds its place by its rank among the pieces of
its length; ranks are made from (length, salt) cells, so a length that a third of all
pieces share is spread over many tasks.

Defined cases: a null text is empty and packs as one piece, id 0 alone; equal doc_ids
are separate documents; a null doc_id is kept; an empty table gives an empty result; bytes
that are not valid UTF-8 are encoded as replacement characters.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import store, tokens

MAX_LEN = 2048
#: Pieces of a (length, salt) cell, which one task ranks; salts, at least.
CELL, SALTS = 100_000, 64


def patterns(max_len: int, present: np.ndarray) -> np.ndarray:
    """All sets of one to three lengths that add up to ``max_len``, as rows of three
    lengths, padded with 0; only of lengths that ``present`` marks."""
    a = np.arange(1, max_len + 1)
    found = [np.array([[max_len, 0, 0]])] if present[max_len] else []
    two = a[: max_len // 2]
    two = two[present[two] & present[max_len - two]]
    found.append(np.stack([max_len - two, two, np.zeros_like(two)], 1))
    for c in np.flatnonzero(present[: max_len // 3 + 1]):
        if c:
            b = np.arange(c, (max_len - c) // 2 + 1)
            b = b[present[b] & present[max_len - c - b]]
            found.append(np.stack([max_len - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(found).astype(np.int64)


def nnls(pats: np.ndarray, hist: np.ndarray, rounds: int = 24, steps: int = 200, fresh: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and repeat counts x >= 0 that make the squared difference between
    ``hist`` and the lengths used small.

    Columns enter as an active set: in each round the patterns whose gradient is best
    and that share no length enter, the counts are fitted by accelerated projected
    gradient steps, and patterns at 0 leave.
    """
    h = hist.astype(float).copy()
    h[0] = 0
    used, x = np.zeros((0, 3), np.int64), np.zeros(0)

    def residual(p, y):
        r = h - np.bincount(p.ravel(), np.repeat(y, 3), len(h))
        r[0] = 0
        return r

    for _ in range(rounds):
        r = residual(used, x)
        gain = r[pats].sum(1)
        best = np.argpartition(-gain, min(8 * fresh, len(gain) - 1))[: 8 * fresh] if len(gain) > 8 * fresh else np.arange(len(gain))
        best = best[np.argsort(-gain[best], kind="stable")]
        taken, add = set(), []
        for k in best:
            if gain[k] <= 0.5 or len(add) >= fresh:
                break
            own = {v for v in pats[k].tolist() if v}
            if not own & taken:
                taken |= own
                add.append(k)
        if not add:
            break
        new = pats[add]
        start = np.maximum(0, np.where(new > 0, r[new], np.inf).min(1)) / 2
        used, x = np.concatenate([used, new]), np.concatenate([x, start])
        used, first = np.unique(used, axis=0, return_index=True)
        x = x[first]
        degree = np.bincount(used.ravel(), minlength=len(h))
        degree[0] = 0
        rate = 1.0 / max(1, 3 * int(degree.max()))
        y, t = x.copy(), 1.0
        for _ in range(steps):
            nxt = np.maximum(0, y + rate * residual(used, y)[used].sum(1))
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
        keep = x > 1e-6
        used, x = used[keep], x[keep]
    return used, x


class Plan:
    """Where the k-th piece of a length goes: rows (length, first rank, count,
    first sequence, offset), filled by ``fill`` and ``best_fit``."""

    def __init__(self, hist: np.ndarray, max_len: int):
        self.left, self.max_len = hist.astype(np.int64).copy(), max_len
        self.next_rank = np.zeros(max_len + 1, np.int64)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []

    def _take(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.next_rank[length]), n, sequence, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def fill(self, used: np.ndarray, x: np.ndarray) -> None:
        for k in np.argsort(-x, kind="stable"):
            parts = [int(v) for v in used[k] if v]
            n = min([int(x[k] + 1e-6), *(int(self.left[v]) // parts.count(v) for v in parts)])
            if n <= 0:
                continue
            at = 0
            for v in parts:
                self._take(v, n, self.sequences, at)
                at += v
            self.sequences += n

    def best_fit(self) -> None:
        """Longest first, each into the open sequence with the least room that holds it."""
        open_by_room: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []  # sorted

        def put(room: int, first: int, n: int) -> None:
            if room <= 0 or n <= 0:
                return
            if room not in open_by_room:
                insort(rooms, room)
                open_by_room[room] = []
            open_by_room[room].append((first, n))

        for length in range(self.max_len, 0, -1):
            while (todo := int(self.left[length])) > 0:
                k = bisect_left(rooms, length)
                if k == len(rooms):
                    each = self.max_len // length
                    full, rest = divmod(todo, each)
                    for slot in range(each if full else 0):
                        self._take(length, full, self.sequences, slot * length)
                    put(self.max_len - each * length, self.sequences, full)
                    self.sequences += full
                    if rest:
                        for slot in range(rest):
                            self._take(length, 1, self.sequences, slot * length)
                        put(self.max_len - rest * length, self.sequences, 1)
                        self.sequences += 1
                    continue
                room = rooms[k]
                first, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(k)
                # a sequence takes as many of this length as fit
                each = min(room // length, todo)
                m = min(n, todo // each)
                for slot in range(each):
                    self._take(length, m, first, self.max_len - room + slot * length)
                put(room - each * length, first, m)
                put(room, first + m, n - m)

    def arrays(self) -> dict[str, np.ndarray]:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return {"length": rows[:, 0], "rank": rows[:, 1], "sequence": rows[:, 3], "offset": rows[:, 4]}


def make_plan(hist: np.ndarray, max_len: int = MAX_LEN) -> Plan:
    plan = Plan(hist, max_len)
    pats = patterns(max_len, hist[: max_len + 1] > 0)
    if len(pats):
        plan.fill(*nnls(pats, hist))
    plan.best_fit()
    return plan


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def cut(docs: DataFrame, path: str, max_len: int = MAX_LEN) -> DataFrame:
    """The pieces of each document: its ids and a closing 0, cut at ``max_len``."""
    store.small_batches(docs.sparkSession)

    def run(batches):
        tok = tokens.get(path)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = memoryview((tok.encode(text.decode("utf-8", "replace")) if text else b"") + b"\0\0\0\0")
                for k, at in enumerate(range(0, len(data), 4 * max_len)):
                    part = data[at : at + 4 * max_len]
                    crc = zlib.crc32(part)
                    for c, v in zip(out, (doc_id, k, at // 4, len(part) // 4, crc, (crc ^ (doc_id or 0) * 2654435761) & 0x7FFFFFFF), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, PIECES)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = store.materialize(cut(docs, path or tokens.default_path(), max_len), "pieces")
    salts = max(SALTS, math.ceil(pieces.count() / CELL))  # a length that all pieces have makes cells of CELL pieces
    pieces = pieces.withColumn("salt", F.col("salt") % salts)
    cells = pieces.groupBy("length", "salt").count()
    cells = store.materialize(cells, "piece-cells")
    hist = np.zeros(max_len + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most max_len rows
        hist[r["length"]] = r["n"]
    plan = make_plan(hist, max_len).arrays()
    held = spark.sparkContext.broadcast(plan)  # bounded by max_len
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside)).join(cells, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank"))

    def place(batches):
        p = held.value
        top = int(p["rank"].max(initial=0)) + 1
        key = p["length"] * top + p["rank"]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            # the last plan row of this length that starts at or before the rank
            k = np.searchsorted(key, length * top + np.minimum(rank, top - 1), side="right") - 1
            sequence = p["sequence"][k] + rank - p["rank"][k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(p["offset"][k])], names=[x.split()[0] for x in PACKED.split(", ")])

    return ranked.mapInArrow(place, PACKED)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, store.read(spark, sf_dir, "documents"))
