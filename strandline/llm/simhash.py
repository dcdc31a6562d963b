"""SimHash near duplicates by a segment-popcount embedding.

A fingerprint's bits are the majority of its shingle hashes' bits. It is cut into segments,
and the numbers of set bits per segment are its point: the Manhattan distance of two points
is at most the Hamming distance of the fingerprints, so only points at distance 2 or less
have to meet. Each point goes to its own cell of the grid and to those one step up or down
in one segment; two points at distance 2 or less share such a cell, and of those that they
share one is theirs, where the fingerprints are compared exactly.

Scale. Equal fingerprints are one row with the least doc_id, so copies never meet. Cells are
spread over tasks and held in bounded memory; tasks send on stars, not pairs. A cell of more
than ``LIMIT`` fingerprints is never compared: its fingerprints go on to a grid of twice as
many segments, up to one segment per bit, where a cell is a fingerprint and its neighbours,
65 at most. So no group makes pairs that grow with its square, and no link is lost: a pair
is compared in its cell, or both go on. Cells around points with more than a 10,000th of all
fingerprints (hence fewer than 10,000 points) are known before the shuffle and sent nowhere.
Components come from an iterative Spark job.

Defined cases: a text without words (null, empty, blank) has fingerprint 0 and is linked
like any other; a text of one or two words is one shingle; bytes that are not UTF-8 are
hashed as they are; repeated rows are rows of their own; a null doc_id names a component
only if it has no other; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import store, words
from strandline.operators.components import connected_components, contract

SHINGLE, SEED, DISTANCE = 3, 42, 2
LEVELS = (16, 32, 64)  # segments of the grids
LIMIT = 4096  # fingerprints of a cell that is compared
HEAVY = 10_000  # points with more than one part in HEAVY of all fingerprints are heavy

def fingerprint(raw: bytes) -> int:
    """The 64-bit fingerprint of a text: bit k is set if more than half of the hashes of its
    word shingles, repeats included, have bit k. Only A-Z are lower-cased."""
    votes, n = np.zeros(64, np.int64), 0
    for part, _ in words.pieces(raw.lower(), SHINGLE - 1):
        grams = map(b" ".join, zip(*[part[k:] for k in range(SHINGLE)])) if len(part) >= SHINGLE else [b" ".join(part)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8")
        for lo in range(0, len(h), 1 << 16):
            votes += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each document; fp holds the fingerprint's bits as a signed long."""
    store.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(store.col("doc_id").cast("long").alias("doc_id"), store.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def points(fp: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts): set bits per segment, and the cell they make, counts side by side in
    as many bits as the greatest count needs."""
    width = 64 // segments
    shifts = np.arange(segments, dtype=np.uint64) * np.uint64(width)
    counts = np.bitwise_count((fp[:, None] >> shifts) & np.uint64((1 << width) - 1)).astype(np.uint64)
    return (counts * _steps(segments)).sum(1, dtype=np.uint64), counts


def _steps(segments: int) -> np.ndarray:
    return np.uint64(1) << (np.arange(segments, dtype=np.uint64) * np.uint64((64 // segments).bit_length()))


def neighbourhood(fp: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, row, role) of each fingerprint's own cell (role 0) and of those one step up
    (role 1 + segment) or down (minus that) in one segment, as far as there are such points."""
    own, counts = points(fp, segments)
    steps, rows = _steps(segments), np.arange(len(fp))
    up_row, up_at = np.nonzero(counts < 64 // segments)
    down_row, down_at = np.nonzero(counts > 0)
    cells = np.concatenate([own, own[up_row] + steps[up_at], own[down_row] - steps[down_at]])
    return cells, np.concatenate([rows, up_row, down_row]), np.concatenate([np.zeros(len(fp), np.int64), 1 + up_at, -1 - down_at]).astype(np.int8)


def _chosen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a cell where two points have these roles is the one of theirs to be compared
    in. Equal points: their own. One step apart: the lower one's own. Two apart: the cell
    below both, or the one between them that is up in the earlier segment."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    return ((low == 0) & (high == 0)) | ((low < 0) & (high <= -low) & (low < high))


def links_in_cells(cell: np.ndarray, fp: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints, compared in the cells that are theirs, at DISTANCE or less. Rows
    are sorted by cell."""
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(cell)))
    after = np.repeat(starts + sizes, sizes) - np.arange(len(cell))  # rows from here to the cell's end
    row, u, v = np.arange(len(cell)), [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for d in range(1, int(sizes.max(initial=1))):
        row = row[after[row] > d]
        near = np.bitwise_count(fp[row] ^ fp[row + d]) <= DISTANCE
        i = row[near]
        i = i[_chosen(role[i], role[i + d])]
        u.append(fp[i])
        v.append(fp[i + d])
    return np.concatenate(u), np.concatenate(v)


EDGES = "u long, v long"  # v is null: u goes on to the next grid


def _edges(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
    left = pa.array(np.ascontiguousarray(u).view(np.int64))
    if v is None:
        return pa.RecordBatch.from_arrays([left, pa.nulls(len(u), pa.int64())], names=["u", "v"])
    left, right = contract(left, pa.array(np.ascontiguousarray(v).view(np.int64)))
    return pa.RecordBatch.from_arrays([left, right], names=["u", "v"])


def compare_sorted(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """From (cell, fp, role) arrays in order of cells: links (u, v), and (fp, None) for cells
    of more than ``limit`` rows. Only the last cell's rows are held between arrays, and of
    a cell that is over the limit none."""
    held = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8)]
    over = None
    for part in batches:
        cell, fp, role = (np.concatenate([h, p]) for h, p in zip(held, part, strict=True))
        if over is not None:
            more = int(np.searchsorted(cell, over, "right"))
            if more:
                yield fp[:more], None
            cell, fp, role = cell[more:], fp[more:], role[more:]
        if not len(cell):
            held = [cell, fp, role]
            continue
        over = None
        last = int(np.searchsorted(cell, cell[-1]))
        if len(cell) - last > limit:
            over = cell[-1]
            yield fp[last:], None
            held = [k[:0] for k in (cell, fp, role)]
        else:
            held = [k[last:] for k in (cell, fp, role)]
        yield from _whole_cells(cell[:last], fp[:last], role[:last], limit)
    yield from _whole_cells(*held, limit)


def _whole_cells(cell, fp, role, limit) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    if not len(cell):
        return
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    sizes = np.diff(np.append(starts, len(cell)))
    full = np.repeat(sizes > limit, sizes)
    if full.any():
        yield fp[full], None
        cell, fp, role = cell[~full], fp[~full], role[~full]
    u, v = links_in_cells(cell, fp, role)
    if len(u):
        yield u, v


def _heavy_cells(fps: DataFrame, segments: int, total: int, limit: int) -> np.ndarray:
    """The cells around points with more than ``limit`` and one part in HEAVY of all
    fingerprints, sorted: at most HEAVY points and their neighbours."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = points(b.column(0).to_numpy().view(np.uint64), segments)[0]
            yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64))], names=["cell"])

    least = max(limit, total // HEAVY)
    rows = fps.select("fp").mapInArrow(own, "cell long").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).collect()
    cells = np.array([r["cell"] for r in rows], np.int64).view(np.uint64)
    bits = (64 // segments).bit_length()
    counts = (cells[:, None] >> (np.arange(segments, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
    steps = _steps(segments)
    up, down = np.nonzero(counts < 64 // segments), np.nonzero(counts > 0)
    return np.unique(np.concatenate([cells, cells[up[0]] + steps[up[1]], cells[down[0]] - steps[down[1]]]))


def _level(fps: DataFrame, segments: int, total: int, limit: int) -> DataFrame:
    """EDGES of one grid: links, and fingerprints of full cells with a null v."""
    heavy = _heavy_cells(fps, segments, total, limit) if segments < 64 else np.zeros(0, np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(fp), 1 << 14):
                part = fp[lo : lo + (1 << 14)]
                cell, row, role = neighbourhood(part, segments)
                at = np.minimum(np.searchsorted(heavy, cell), max(0, len(heavy) - 1))
                full = heavy[at] == cell if len(heavy) else np.zeros(len(cell), bool)
                on = part[np.unique(row[full])]
                light = ~full
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(cell[light].view(np.int64)), pa.nulls(len(on), pa.int64())]),
                        pa.array(np.concatenate([part[row[light]], on]).view(np.int64)),
                        pa.array(np.concatenate([role[light], np.zeros(len(on), np.int8)])),
                    ],
                    names=["cell", "fp", "role"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays():
            for b in batches:
                cell, fp, role = (b.column(k).to_numpy() for k in range(3))
                yield (cell.view(np.uint64) ^ np.uint64(1 << 63)), fp.view(np.uint64), role  # as sorted: signed

        for u, v in compare_sorted(arrays(), limit):
            yield _edges(u, v)

    rows = fps.select("fp").mapInArrow(spread, "cell long, fp long, role byte")
    met = rows.where("cell is not null").repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, EDGES)
    return met.unionByName(rows.where("cell is null").select(F.col("fp").alias("u"), F.lit(None).cast("long").alias("v"))) if len(heavy) else met


def near_links(fps: DataFrame, total: int, limit: int = LIMIT) -> DataFrame:
    """(u, v): edges that connect the fingerprints (``fp``, distinct) that chains of links at
    DISTANCE or less connect."""
    links = []
    for segments in LEVELS:
        found = store.materialize(_level(fps, segments, total, limit if segments < 64 else 65), f"cells-{segments}")
        links.append(found.where("v is not null"))
        on = found.where("v is null").select(F.col("u").alias("fp")).distinct()
        if segments == 64 or on.isEmpty():
            break
        fps = store.materialize(on, f"on-{segments}")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the least
    doc_id that chains of links reach)."""
    prints = store.materialize(fingerprints(docs), "fingerprints")
    fps = store.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "distinct")
    total = fps.agg(F.count(F.lit(1)), F.sum("copies")).first()
    roots = connected_components(near_links(fps, total[0], limit), loops=False).select(F.col("id").alias("fp"), "root")
    named = store.materialize(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = store.join_spread(named, least, "root", "n", total[0] or 0).select("fp", "component_id", "copies")
    out = store.join_spread(prints, store.materialize(named, "named"), "fp", "copies", total[1] or 0)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(store.read(spark, sf_dir, "documents"))
