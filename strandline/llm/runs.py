"""Periodic run detection in word sequences, in linear time.

A run is a stretch of words with smallest period q and at least two periods that no
neighbour extends. Every run holds a Lyndon root under one of the two orders of the
alphabet, and a root at i ends where the next smaller suffix starts, so the edges
(i, next smaller suffix of i) of both orders, each extended to the right and to the left
as far as the period holds, are all runs.

Extensions are found by comparing words, without hashes or suffix structures, and no word
is compared twice: the rightmost matched stretch so far is kept, a suffix that starts in it
has the edges of its image one shift before, and comparing goes on only where that stretch
ends. Extensions to the left do the same from the other side. Both passes are linear over
any ordered alphabet.

Each document is worked out alone, in the task that reads it; nothing is shuffled. Words
that occur once in a document (and then once in the stretch around them) are in no run and
split it into independent stretches, so most of a text never reaches the passes.

Defined cases: null, empty and blank texts have no words and no runs; words are bytes, so
bytes that are not UTF-8 don't matter; a null doc_id has no planted repeat; repeated rows
are rows of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import store

LEAST = 12  # words of the shortest run that counts

Run = tuple[int, int, int]  # start, length, period


def lyndon_edges(w: list[int]) -> tuple[list[int], list[int]]:
    """(nss, right): for every position its next smaller suffix (len(w), if none) and how
    many words the two suffixes have in common. Words are numbers from 0 up.

    Suffixes are taken from left to right. ``pss`` chains the candidates, suffixes that
    no later one has undercut. (l, r, reach): suffixes l < r, compared before, are equal
    up to ``reach`` in the second, and no comparison went further.
    """
    n = len(w)
    w = [*w, -1]  # the end is smaller than any word
    nss, right = [n] * n, [0] * n
    pss, back = [-1] * n, [0] * n
    l = r = reach = 0  # noqa: E741
    for i in range(1, n):
        j, before, x = i - 1, -1, 0
        while j >= 0:
            look = True
            if i < reach and j >= r:
                # both start in the matched stretch: their images were compared before
                shift = r - l
                x = right[j - shift] if nss[j - shift] == i - shift else back[i - shift]
                if x < reach - i:
                    look = False
                else:
                    x = reach - i
            elif before >= 0:
                # the candidate before had x words in common with i, and y with this one
                y = back[before]
                if y != x:
                    look = False
                    if y < x:
                        x = y
            if look:
                while w[j + x] == w[i + x]:
                    x += 1
                if i + x >= reach:
                    l, r, reach = j, i, i + x  # noqa: E741
            if w[i + x] > w[j + x]:
                pss[i], back[i] = j, x
                break
            nss[j], right[j] = i, x
            before, j = j, pss[j]
    return nss, right


def left_extensions(w: list[int], nss: list[int]) -> list[int]:
    """For every edge (i, nss[i]) that ends within the words: how many words before i equal
    those before nss[i].

    Edges are taken from right to left. (l, shift, reach): the words from ``reach`` to l
    equal those ``shift`` further on, and no comparison went further. Edges that start
    there are images of those one shift on, whose extensions are known.
    """
    n = len(w)
    left = [0] * n
    l = reach = n  # noqa: E741
    shift = 0
    for i in range(n - 1, -1, -1):
        j = nss[i]
        if j == n:
            continue
        k = 0
        if reach <= i < l:
            k = left[i + shift]
            if k < i - reach:
                left[i] = k
                continue
            k = i - reach
        while k < i and w[i - 1 - k] == w[j - 1 - k]:
            k += 1
        left[i] = k
        if i - k <= reach:
            l, shift, reach = i, j - i, i - k  # noqa: E741
    return left


def all_runs(w: list[int], least: int = 2) -> set[Run]:
    """The runs of at least ``least`` words of a sequence of numbers from 0 up."""
    found: set[Run] = set()
    top = max(w, default=0)
    for order in (w, [top - v for v in w]):
        nss, right = lyndon_edges(order)
        left = left_extensions(order, nss)
        n = len(w)
        for i, j in enumerate(nss):
            if j < n and left[i] + right[i] >= j - i:
                length = left[i] + right[i] + j - i
                if length >= least:
                    found.add((i - left[i], length, j - i))
    return found


def _stretches(ids: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Stretches of at least ``least`` words, none of which occurs once: outside of them
    there are no runs. The second round looks for words that occur once in their stretch."""

    def cut(lo: int, hi: int) -> Iterator[tuple[int, int]]:
        part = np.unique(ids[lo:hi], return_inverse=True)[1]
        edges = np.flatnonzero(np.bincount(part)[part] == 1)
        ends = np.append(edges, hi - lo)
        starts = np.append(0, edges + 1)
        for k in np.flatnonzero(ends - starts >= least):
            yield lo + int(starts[k]), lo + int(ends[k])

    if len(ids) >= least:
        for lo, hi in cut(0, len(ids)):
            yield from cut(lo, hi)


def word_runs(words: list[bytes], least: int = LEAST) -> list[Run]:
    """Runs of at least ``least`` words, by start and period."""
    if len(words) < least:
        return []
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(v, len(known)) for v in words], np.int64)
    found = []
    for lo, hi in _stretches(ids, least):
        found += [(lo + s, n, q) for s, n, q in all_runs(ids[lo:hi].tolist(), least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repeat that the contract plants in a tenth of the documents."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return b" ".join(compress(words, np.cumsum(change[:-1]) == 0))


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per document: how many runs it has, its longest run, and digests of all runs and of
    the text with every run cut to its first period. ``plant`` as in ``planted``."""
    store.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if plant:
                    words = planted(words, doc_id)
                found = word_runs(words)
                best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
                row = (
                    doc_id,
                    len(found),
                    *best,
                    1000 * best[1] // best[2] if found else None,
                    hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
                    hashlib.sha256(collapsed(words, found)).hexdigest(),
                )
                for held, v in zip(out, row, strict=True):
                    held.append(v)
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(store.col("doc_id").cast("long").alias("doc_id"), store.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with every run of its texts cut to the first period; words are then joined
    by single spaces. Texts without runs, and null ones, stay as they are."""
    store.small_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # whatever dots the names hold
    at = names.index("text")
    plain = plain.withColumn(f"c{at}", store.col(f"c{at}").cast("string").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text in b.column(at):
                raw = text.as_buffer().to_pybytes() if text.is_valid else None
                words = raw.split() if raw else []
                found = word_runs(words)
                texts.append(collapsed(words, found) if found else raw)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    out = plain.mapInArrow(run, plain.schema)
    return out.withColumn(f"c{at}", store.col(f"c{at}").cast("string")).toDF(*names)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(store.read(spark, sf_dir, "documents"), plant=True)
