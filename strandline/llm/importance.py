"""Importance resampling towards a target distribution.

Word and word pair features are hashed to buckets. What a bucket gains, the logarithm of its
share in the target texts over that in all documents, is an array that every task holds; a
document's weight is the mean gain of its features, looked up in it. Weights with Gumbel noise
from a hash of the doc_id make the greatest scores a sample without replacement.

The draw is a distributed merge. Every task sorts its eligible documents into runs. The number
of documents of each score says where the draw ends, cuts the scores into ranges of about
``RANGE`` documents, and gives each range the rank that it starts at. Runs are shuffled in
sorted blocks by range; documents beyond the last range are not. In each range a tournament
tree merges the blocks of all runs, takes as long stretches from the winner as no other run
comes between, numbers them, and stops at the exact draw count.

Scale. Texts are read twice and never shuffled; a task sends on one count per bucket. Buckets
(10,000) and different scores come to the driver: gains are at most 1000 ln(features) and the
noise is between -3,100 and 22,200, so below 100,000 scores whatever the number of documents,
and one cut a range. A score with more documents than a range has is cut by doc_id. Equal
rows are one entry with a count in each run, so even a row repeated in a third of the table
is one entry a run.

Defined cases: null, empty and word-less texts have no features, weight 0 and are not drawn
(below ``least_words``); null doc_ids are hashed as "null" and come last among equal scores;
repeated rows are drawn each for itself; an empty target has count 0 in every bucket; bytes
that are not UTF-8 are words like other non-ASCII bytes; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import store, words

BUCKETS = 10_000
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
RANGE = 1 << 18  # documents of a range, and of a run
BLOCK = 1 << 16  # entries of a block of a run
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def features(raw: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """(buckets, words) of a text, a bounded part at a time: a bucket for each word and each
    pair of neighbouring words, joined by a space. Words are ASCII letters, lower-cased,
    digits and all non-ASCII characters."""
    for part, seen in words.pieces(raw.translate(_TABLE), 1):
        one = list(map(crc32, part))
        two = map(crc32, [b" " + w for w in part[1:]], one)
        yield np.concatenate([np.array(one[seen:], np.int64), np.fromiter(two, np.int64)]) % BUCKETS, len(part) - seen


def _texts(docs: DataFrame, *others: str) -> DataFrame:
    return docs.select(*[store.col(k).cast("long").alias(k) for k in others], store.col("text").cast("string").cast("binary").alias("text"))


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n): features of all texts by bucket. Each task counts in one array."""
    store.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            own = [k for text in b.column(0) if text.is_valid for k, _ in features(text.as_buffer().to_pybytes())]
            if own:
                total += np.bincount(np.concatenate(own), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return _texts(docs).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """A bucket's logarithmic gain in thousandths, both counts smoothed by one a bucket."""
    both = []
    for texts in (docs, target):
        held = np.zeros(BUCKETS)
        for r in bucket_counts(texts).collect():  # at most BUCKETS rows
            held[r["bucket"]] = r["n"]
        both.append(held)
    s, t = both
    ratio = (t + 1.0) * (s.sum() + BUCKETS) / ((s + 1.0) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths from a hash of the doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_features long, weight long, score long, n_words long"


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """SCORED of each document."""
    store.small_batches(docs.sparkSession)
    names = [c.split()[0] for c in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total = n = n_words = 0
                for own, k in features(text.as_buffer().to_pybytes()) if text.is_valid else ():
                    total, n, n_words = total + int(gain[own].sum()), n + len(own), n_words + k
                weight = total // n if n else 0
                out.append((doc_id, n, weight, weight + noise(doc_id, seed), n_words))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))], names=names)

    return _texts(docs, "doc_id").mapInArrow(run, SCORED)


@dataclass
class Plan:
    """Ranges of the order (score falling, doc_id rising): where each starts, how many of its
    documents are drawn, and what lies beyond the last."""

    drawn: int
    floor: int | None = None  # the least score of the last range
    top: int | None = None  # the greatest doc_id of the last range at that score; None: all
    lows: list[int] = field(default_factory=list)  # the least score of each range of scores, falling
    ids: list[int] = field(default_factory=list)  # the number of the first range of each of those
    cuts: dict[int, list[int]] = field(default_factory=dict)  # score -> greatest doc_ids of all its ranges but the last
    firsts: list[int] = field(default_factory=list)  # by range: rank of its first document
    takes: list[int] = field(default_factory=list)  # by range: documents drawn

    def range_of(self, score: np.ndarray, none: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        """The range of each document; -1 beyond the last."""
        at = np.searchsorted(-np.array(self.lows, np.int64), -score)
        out = np.array(self.ids, np.int64)[at] if len(at) else np.zeros(0, np.int64)
        for s, cuts in self.cuts.items():
            own = np.flatnonzero(score == s)
            if len(own):
                out[own] += np.where(none[own], len(cuts), np.searchsorted(np.array(cuts, np.int64), doc_id[own]))
        return np.where(out < len(self.firsts), out, -1)


def make_plan(scored: DataFrame, percent: int, least_words: int, per_range: int) -> Plan:
    """Where the draw of ``percent`` of the eligible documents ends, and its ranges."""
    able = scored.where(F.col("n_words") >= least_words)
    counts = sorted(((r["score"], r["n"]) for r in able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    plan = Plan(percent * sum(n for _, n in counts) // 100)
    if not plan.drawn:
        return plan
    before, groups = 0, []  # groups of neighbouring scores
    for s, n in counts:
        if before >= plan.drawn:
            break
        if groups and groups[-1][1] + n <= per_range:
            groups[-1] = (s, groups[-1][1] + n)
        else:
            groups.append((s, n))
        before += n
    plan.floor = groups[-1][0]
    parts = _cut_by_id(able, {s: n for s, n in groups if n > per_range}, per_range)
    before = 0
    for s, n in groups:
        plan.lows.append(s)
        plan.ids.append(len(plan.firsts))
        cuts, sizes = parts.get(s, ([], [n]))
        if cuts:
            plan.cuts[s] = cuts
        for k, size in enumerate(sizes):
            if before >= plan.drawn:
                break
            plan.firsts.append(before + 1)
            plan.takes.append(min(size, plan.drawn - before))
            plan.top = cuts[k] if k < len(cuts) else None
            before += size
    return plan


def _cut_by_id(able: DataFrame, large: dict[int, int], per_range: int) -> dict[int, tuple[list[int], list[int]]]:
    """For each score with more documents than a range has: doc_ids to cut it at, and the
    exact number of documents between them (null doc_ids are in the last part)."""
    if not large:
        return {}
    rows = able.where(F.col("score").isin(list(large)))
    parts = max(-(-n // per_range) for n in large.values())
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    found = {r["score"]: sorted(set(r["cuts"] or [])) for r in rows.groupBy("score").agg(F.percentile_approx("doc_id", shares, 10_000).alias("cuts")).collect()}
    cut = F.create_map(*[x for s, c in found.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in c]).cast("array<long>"))])
    part = F.when(F.col("doc_id").isNull(), F.size("cuts")).otherwise(F.size(F.filter("cuts", lambda v: v < F.col("doc_id"))))
    sizes = {(r["score"], r["part"]): r["n"] for r in rows.withColumn("cuts", cut[F.col("score")]).groupBy("score", part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {s: (c, [sizes.get((s, k), 0) for k in range(len(c) + 1)]) for s, c in found.items()}


#: A block of a run: entries in order of (score falling, doc_id rising, nulls last, n_features)
BLOCKS = "range long, run string, seq long, score array<long>, none array<long>, doc_id array<long>, n_features array<long>, weight array<long>, copies array<long>"
_ENTRY = ("score", "none", "doc_id", "n_features", "weight", "copies")


def sorted_blocks(rows: dict[str, np.ndarray], ranges: np.ndarray, run: str) -> Iterator[dict]:
    """One run: BLOCKS rows of documents (without copies), sorted, equal ones as one entry."""
    order = np.lexsort((rows["n_features"], rows["doc_id"], rows["none"], -rows["score"], ranges))
    rows, ranges = {k: v[order] for k, v in rows.items()}, ranges[order]
    keys = np.stack([ranges, rows["score"], rows["none"], rows["doc_id"], rows["n_features"]], 1)
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else np.zeros(0, np.int64)
    rows = {k: v[first] for k, v in rows.items()} | {"copies": np.diff(np.append(first, len(keys)))}
    ranges = ranges[first]
    starts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(ranges) else []
    for lo, hi in zip(starts, [*starts[1:], len(ranges)], strict=True):
        for seq, at in enumerate(range(lo, hi, BLOCK)):
            part = slice(at, min(at + BLOCK, hi))
            yield {"range": int(ranges[lo]), "run": run, "seq": seq} | {k: rows[k][part] for k in _ENTRY}


class Run:
    """A sorted run of entries in blocks, and the place that a merge has come to."""

    def __init__(self, number: int, blocks: list[dict]):
        self.number, self.blocks = number, blocks
        self._open(0)

    def _open(self, block: int) -> None:
        self.block, self.at, self.keys = block, 0, []
        if block < len(self.blocks):
            b = self.blocks[block]
            self.keys = list(zip((-b["score"]).tolist(), *[b[k].tolist() for k in ("none", "doc_id", "n_features")], repeat(self.number)))

    def head(self) -> tuple:
        """The key of the next entry; beyond all keys at the end."""
        return self.keys[self.at] if self.keys else (math.inf,)

    def take_before(self, bound: tuple) -> tuple[dict, int, int]:
        """The entries of the current block that come before ``bound``, as (block, from, to);
        at least one does."""
        start, end = self.at, self.at + 1
        if end < len(self.keys) and self.keys[end] < bound:
            end = bisect_left(self.keys, bound, end)
        b, self.at = self.blocks[self.block], end
        if end == len(self.keys):
            self._open(self.block + 1)
        return b, start, end

    def rest(self) -> Iterator[tuple[dict, int, int]]:
        while self.keys:
            yield self.take_before((math.inf,))


class Tournament:
    """A tree whose leaves are runs. Every inner node keeps the loser of the match there, so
    after the winner moves on only the matches on its way up are played again."""

    def __init__(self, runs: list[Run]):
        self.leaves = 1
        while self.leaves < len(runs):
            self.leaves *= 2
        self.runs = runs + [Run(len(runs) + k, []) for k in range(self.leaves - len(runs))]
        self.losers: list[tuple[tuple, int]] = [((math.inf,), 0)] * self.leaves
        best = [(r.head(), k) for k, r in enumerate(self.runs)]
        for node_from in iter(lambda: len(best) // 2, 0):
            for k in range(node_from):
                a, b = best[2 * k], best[2 * k + 1]
                best[k], self.losers[node_from + k] = min(a, b), max(a, b)
            best = best[:node_from]
        self.winner = best[0]

    def stretches(self) -> Iterator[tuple[dict, int, int]]:
        """All entries in order, in stretches of one run that no other comes between."""
        while self.winner[0] < (math.inf,):
            leaf = self.winner[1]
            node, second = (self.leaves + leaf) // 2, (math.inf,)
            while node:
                second = min(second, self.losers[node][0])
                node //= 2
            yield self.runs[leaf].take_before(second)
            now, node = (self.runs[leaf].head(), leaf), (self.leaves + leaf) // 2
            while node:
                if self.losers[node] < now:
                    now, self.losers[node] = self.losers[node], now
                node //= 2
            self.winner = now


#: Entries with the rank of the first of n rows; rank is null for rows that are not drawn
RANKED = "doc_id long, n_features long, weight long, score long, first long, n long"
COPIES = 50_000  # rows of an entry of RANKED


def _joined(stretches: list[tuple[dict, int, int]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([b[k][lo:hi] for b, lo, hi in stretches]) for k in _ENTRY}


def merge(blocks: list[dict], first: int, take: int) -> Iterator[dict[str, np.ndarray]]:
    """RANKED columns of one range: ranks from ``first`` on for its ``take`` first documents.
    What is left of the runs then is not merged any more."""
    by: dict[str, list[dict]] = {}
    for b in sorted(blocks, key=lambda b: (b["run"], b["seq"])):
        by.setdefault(b["run"], []).append(b)
    runs = [Run(k, v) for k, v in enumerate(by.values())]
    left, held, size = take, [], 0
    for stretch in chain(Tournament(runs).stretches() if take else (), [None]):
        if stretch is not None:
            held.append(stretch)
            size += stretch[2] - stretch[1]
            if size < min(left, BLOCK):
                continue
        if held:
            part = _joined(held)
            before = np.cumsum(part["copies"]) - part["copies"]
            drawn = np.clip(left - before, 0, part["copies"])
            yield _ranked(part, drawn, first + take - left + before)
            yield _ranked(part, part["copies"] - drawn, None)
            left, held, size = left - int(drawn.sum()), [], 0
        if not left:
            break
    for run in runs:
        for b, lo, hi in run.rest():
            yield _ranked({k: b[k][lo:hi] for k in _ENTRY}, b["copies"][lo:hi], None)


def _ranked(part: dict, n: np.ndarray, first: np.ndarray | None) -> dict:
    """Columns of RANKED; entries of more than COPIES rows are cut."""
    has = np.flatnonzero(n > 0)
    pieces = -(-n[has] // COPIES)
    row = np.repeat(has, pieces)
    k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(COPIES, n[row] - k * COPIES)
    out = {c: part[c][row] for c in ("doc_id", "none", "n_features", "weight", "score")}
    return out | {"first": None if first is None else first[row] + k * COPIES, "n": size}


def _batch(cols: dict) -> pa.RecordBatch:
    n = len(cols["n"])
    first = pa.nulls(n, pa.int64()) if cols["first"] is None else pa.array(cols["first"].astype(np.int64))
    arrays = [pa.array(cols["doc_id"], mask=cols["none"] != 0), *[pa.array(cols[c]) for c in ("n_features", "weight", "score")], first, pa.array(cols["n"].astype(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in RANKED.split(", ")])


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, per_range: int = RANGE) -> DataFrame:
    """Every row of ``scored`` with its ``rank`` (null: not drawn)."""
    plan = make_plan(scored, percent, least_words, per_range)
    names = ("doc_id", "n_features", "weight", "score")
    no_rank = F.lit(None).cast("long").alias("rank")
    if not plan.drawn:
        return scored.select(*names, no_rank)
    within: Column = F.col("score") >= plan.floor
    if plan.top is not None:
        within = within & ((F.col("score") > plan.floor) | F.coalesce(F.col("doc_id") <= plan.top, F.lit(False)))
    within = within & (F.col("n_words") >= least_words)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, made = [], 0, 0
        task = TaskContext.get().partitionId()
        schema = pa.schema([("range", pa.int64()), ("run", pa.string()), ("seq", pa.int64()), *[(k, pa.list_(pa.int64())) for k in _ENTRY]])

        def sort_held() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            none = t["doc_id"].is_null().to_numpy().astype(np.int64)
            rows = {k: t[k].to_numpy() for k in ("score", "n_features", "weight")} | {"none": none, "doc_id": t["doc_id"].fill_null(0).to_numpy()}
            for block in sorted_blocks(rows, plan.range_of(rows["score"], none != 0, rows["doc_id"]), f"{task}-{made}"):
                yield pa.RecordBatch.from_pylist([block], schema=schema)

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= per_range:
                yield from sort_held()
                held, size, made = [], 0, made + 1
        if size:
            yield from sort_held()

    def ranked(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [{"run": b["run"][k].as_py(), "seq": b["seq"][k].as_py()} | {c: b[c][k].values.to_numpy(zero_copy_only=False) for c in _ENTRY} for b in batches for k in range(b.num_rows)]
        at = key[0].as_py()
        for cols in merge(blocks, plan.firsts[at], plan.takes[at]):
            yield _batch(cols)

    merged = scored.where(within).select(*names).mapInArrow(runs, BLOCKS).groupBy("range").applyInArrow(ranked, RANKED)
    each = merged.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select(*names, (F.col("first") + F.col("_k")).alias("rank")).unionByName(scored.where(~within).select(*names, no_rank))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, per_range: int = RANGE) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank in the draw (null: not drawn)."""
    return draw(store.materialize(scores(docs, gains(docs, target), seed), "scored"), percent, least_words, per_range)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(store.read(spark, sf_dir, "documents"), store.read(spark, sf_dir, "benchmark"))
