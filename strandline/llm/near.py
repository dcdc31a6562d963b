"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. Texts that share a band of MinHash values
are candidates. Their MinHash values are compared a few at a time; with m matches in
n values, the posterior of the similarity under a uniform prior is Beta(m+1, n-m+1),
and a pair goes as soon as the probability of reaching the threshold falls below a
tolerance. The Jaccard similarity of the rest is computed exactly from their texts.

Scale. Equal texts are one vertex with a copy count, so groups of copies never meet
pairwise. A bucket is never expanded into pairs: up to ``BLOCK`` texts (or ``WEIGHT``
shingles) of it are one task's work, and a larger one is cut into blocks by a hash of the
text's id. Block pairs are dealt over the cluster, and each sends on only which texts have
surviving partners, then link counts and one star of links per linked set. So a group of n
different near copies makes n rows a bucket up to ``BLOCK``, and n * n / ``BLOCK`` beyond:
every pair has to meet somewhere, and tasks are bounded.
Buckets with the same members in several bands are kept once, and a pair is handled
in the first band that it shares, so no link is counted twice. Components come from
an iterative Spark job. Nothing about documents is collected or broadcast.

Defined cases: words are what white space separates, compared in lower case; a text
of one to four words is one shingle; a text without words (null, empty, blank) has no
shingles, links to nothing and is a class of its own; equal texts are similar 1;
repeated rows count as documents; null doc_ids are kept and sort last; a class is
named by its least doc_id (null if it has none). Bytes that are not valid UTF-8 are read
as replacement characters; texts are equal if their bytes are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import store
from strandline.operators.components import connected_components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
TOLERANCE = 1e-7
STEP_BANDS = 8  # bands compared at once
BLOCK, WEIGHT = 2048, 1 << 20  # texts of a block, and shingles
HASHES = BANDS * ROWS
_MASK = (1 << 64) - 1


def _odd(n: int, seed: str) -> np.ndarray:
    raw = b"".join(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest() for k in range(n))
    return np.frombuffer(raw, "<u8") | np.uint64(1)


class Shingler:
    """Shingle sets and MinHash signatures of texts."""

    def __init__(self, cache: int = 200_000):
        self.words: dict[str, int] = {}
        self.limit = cache
        self.place = _odd(SHINGLE, "place")
        self.hashes = _odd(HASHES, "minhash")

    def shingles(self, text: str) -> np.ndarray:
        """The sorted distinct 64-bit shingle hashes of a text."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            h = np.array([known[w] for w in words], np.uint64)
        n = max(1, len(h) - SHINGLE + 1)
        x = np.full(n, min(len(h), SHINGLE), np.uint64)
        for k in range(min(SHINGLE, len(h))):
            x += h[k : k + n] * self.place[k]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x.sort()
        return x[np.append(True, x[1:] != x[:-1])]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Sixteen bits of each MinHash value."""
        least = np.full(HASHES, _MASK, np.uint64)
        for at in range(0, len(shingles), 2048):
            np.minimum(least, (shingles[at : at + 2048, None] * self.hashes).min(0), out=least)
        return (least >> np.uint64(24)).astype("<u2")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n = 0 .. HASHES values compared: the fewest matches with which
    P(similarity >= threshold | m of n match) is at least ``tolerance``.

    That probability is P(Binomial(n + 1, threshold) <= m).
    """
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(HASHES + 1):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out[n] = m
                break
    return out


def survivors(sig: np.ndarray, others: np.ndarray, band: int, fewest: np.ndarray) -> np.ndarray:
    """Which rows of ``others`` stay as partners of ``sig`` in the bucket of ``band``."""
    alive, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for first in range(0, BANDS, STEP_BANDS):
        lo, hi = first * ROWS, min(BANDS, first + STEP_BANDS) * ROWS
        same = others[alive, lo:hi] == sig[lo:hi]
        matches = matches + same.sum(1)
        ok = matches >= fewest[hi]
        shared = same.reshape(len(alive), -1, ROWS).all(2)
        if band > first:  # an earlier shared band has this pair
            ok &= ~shared[:, : band - first].any(1)
        if first <= band < first + STEP_BANDS:  # equal keys of different bands are no bucket
            ok &= shared[:, band - first]
        alive, matches = alive[ok], matches[ok]
        if not len(alive):
            break
    return alive


def _groups(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal leading columns in sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy() for k in range(n_key)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            own = tuple(keys[lo].tolist())
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def _binary(column: pa.ChunkedArray, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _rounds(key: tuple, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the first block, the rows of the other (later ones, if it is the same)."""
    if key[1] == key[2]:
        for i in range(len(side) - 1):
            yield i, np.arange(i + 1, len(side))
    else:
        right = np.flatnonzero(side == key[2])
        for i in np.flatnonzero(side == key[1]) if len(right) else ():
            yield i, right


def sketches(docs: DataFrame) -> DataFrame:
    """(tid, doc_id, sig, size) of each document with words; tid is the text's MD5, size its
    number of shingles."""
    store.small_batches(docs.sparkSession)

    def run(batches):
        made = Shingler()
        for b in batches:
            ids, sigs, rows, sizes, seen = [], [], [], [], {}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                tid = hashlib.md5(raw).digest()
                if tid not in seen:
                    s = made.shingles(raw.decode("utf-8", "replace"))
                    seen[tid] = (made.signature(s).tobytes(), len(s)) if len(s) else None
                if seen[tid] is not None:
                    ids.append(doc_id)
                    rows.append(tid)
                    sigs.append(seen[tid][0])
                    sizes.append(seen[tid][1])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["tid", "doc_id", "sig", "size"])

    return docs.select(F.col("doc_id").cast("long"), _bytes("text").alias("text")).where(F.col("text").isNotNull()).mapInArrow(run, "tid binary, doc_id long, sig binary, size long")


def _bytes(name: str) -> Column:
    return store.col(name).cast("string").cast("binary")


def _bands(texts: DataFrame) -> DataFrame:
    """(key, vid, size) of each band; the band is in the key's top bits."""

    def run(batches):
        mul = _odd(ROWS, "band").astype(np.uint64)
        top = (np.arange(BANDS, dtype=np.uint64) << np.uint64(58))[None, :]
        for b in batches:
            if not b.num_rows:
                continue
            sig = _binary(b.column(1), "<u2", HASHES).astype(np.uint64).reshape(-1, BANDS, ROWS)
            h = (sig * mul).sum(2, dtype=np.uint64)
            h ^= h >> np.uint64(30)
            h *= np.uint64(0x94D049BB133111EB)
            key = (h >> np.uint64(6)) | top
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(np.repeat(b.column(2).to_numpy(), BANDS))], names=["key", "vid", "size"])

    return texts.select("vid", "sig", "size").mapInArrow(run, "key long, vid long, size long")


def _buckets(texts: DataFrame) -> DataFrame:
    """(key, vid, bi, bj, side): each bucket of two or more texts, cut into block pairs."""
    bands = store.materialize(_bands(texts), "bands")
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.bit_xor(F.xxhash64("vid")).alias("x"), F.min("vid").alias("least")).where("n > 1")
    kept = sizes.groupBy("n", "x", "least").agg(F.min("key").alias("key"), F.max("weight").alias("weight"))
    blocks = F.least(F.col("n"), F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / WEIGHT))).cast("int")
    members = bands.drop("size").join(kept.select("key", blocks.alias("blocks")), "key")
    own = F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")
    members = members.select("key", "vid", own.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return members.select("key", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "vid")


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")


def _pruned(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``buckets`` whose text has a surviving partner in that block pair."""
    fewest = least_matches()
    rows = _dealt(buckets.join(texts.select("vid", "sig"), "vid").select("key", "bi", "bj", "side", "vid", "sig"))

    def run(batches):
        for key, t in _groups(batches, 3):
            side, sig = t["side"].to_numpy(), _binary(t["sig"], "<u2", HASHES)
            hit, band = np.zeros(len(side), bool), key[0] >> 58
            for i, js in _rounds(key, side):
                stay = survivors(sig[i], sig[js], band, fewest)
                if len(stay):
                    hit[i] = True
                    hit[js[stay]] = True
            if hit.any():
                u = t.filter(pa.array(hit)).select(["key", "bi", "bj", "side", "vid"])
                yield from u.to_batches()

    return rows.mapInArrow(run, "key long, bi int, bj int, side int, vid long")


LINKS = "vid long, root long, n_links long, n_texts long"


def _verified(pruned: DataFrame, texts: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(vid, root, n_links, n_texts) per block pair: exact links, counted."""
    fewest = least_matches(threshold)
    alive = store.materialize(pruned.select("vid").distinct().join(texts, "vid").select("tid", "vid", "sig", "copies"), "alive")
    # of all texts only those with a surviving partner are shuffled, each once, and then
    # sent to their block pairs
    bodies = docs.select(_tid(F.col("text")).alias("tid"), _bytes("text").alias("text")).join(alive.select("tid"), "tid", "left_semi").dropDuplicates(["tid"])
    bodies = store.materialize(bodies.join(alive, "tid").select("vid", "sig", "copies", "text"), "bodies")
    rows = _dealt(pruned.join(bodies, "vid").select("key", "bi", "bj", "side", "vid", "sig", "copies", "text"))

    def run(batches):
        made = Shingler()
        for key, t in _groups(batches, 3):
            side, vid, copies = t["side"].to_numpy(), t["vid"].to_numpy(), t["copies"].to_numpy()
            sig, band = _binary(t["sig"], "<u2", HASHES), key[0] >> 58
            sets = [made.shingles(x.as_py().decode("utf-8", "replace")) for x in t["text"]]
            size = np.array([len(s) for s in sets])
            # shingles as numbers from 0, so that membership is one array lookup
            names, ids = np.unique(np.concatenate(sets), return_inverse=True)
            start = np.cumsum(size) - size
            mark = np.zeros(len(names), np.int32)
            root, n_links, n_texts = np.arange(len(vid)), np.zeros(len(vid), np.int64), np.zeros(len(vid), np.int64)

            def find(a, root=root):
                while root[a] != a:
                    root[a] = root[root[a]]
                    a = root[a]
                return a

            for i, js in _rounds(key, side):
                js = js[survivors(sig[i], sig[js], band, fewest)]
                js = js[np.minimum(size[js], size[i]) >= threshold * np.maximum(size[js], size[i]) - 1e-9]
                if not len(js):
                    continue
                mine = ids[start[i] : start[i] + size[i]]
                mark[mine] = 1
                if 50 * len(js) > len(sets):  # all at once is cheaper than one by one
                    common = np.add.reduceat(mark[ids], start)[js]
                else:
                    common = np.array([mark[ids[start[j] : start[j] + size[j]]].sum() for j in js])
                mark[mine] = 0
                # J >= threshold, in whole numbers of shingles
                linked = js[common >= threshold * (size[i] + size[js] - common) - 1e-9]
                if len(linked):
                    n_links[i] += copies[linked].sum()
                    n_texts[i] += len(linked)
                    n_links[linked] += copies[i]
                    n_texts[linked] += 1
                    for j in linked:
                        a, c = find(i), find(j)
                        if a != c:
                            root[max(a, c)] = min(a, c)
            has = np.flatnonzero(n_texts)
            if len(has):
                top = vid[[find(k) for k in has]]
                yield pa.RecordBatch.from_arrays([pa.array(vid[has]), pa.array(top), pa.array(n_links[has]), pa.array(n_texts[has])], names=["vid", "root", "n_links", "n_texts"])

    return rows.mapInArrow(run, LINKS)


def classes(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per distinct text with words: tid, copies, n_links, n_texts, class_id, class_size,
    keeper (the class's least (doc_id, tid), as a struct)."""
    sk = sketches(docs)
    texts = sk.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    texts = store.materialize(texts.withColumn("vid", F.monotonically_increasing_id()), "texts")
    pruned = store.materialize(_pruned(_buckets(texts), texts), "pruned")
    links = store.materialize(_verified(pruned, texts, docs, threshold), "links")
    counts = links.groupBy("vid").agg(F.sum("n_links").alias("n_links"), F.sum("n_texts").alias("n_texts"))
    roots = connected_components(links.select(F.col("vid").alias("u"), F.col("root").alias("v")))
    named = texts.drop("sig", "size").join(counts, "vid", "left").join(roots.withColumnRenamed("id", "vid"), "vid", "left")
    named = named.select("tid", "doc_id", "copies", F.coalesce("root", "vid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")
    heads = named.groupBy("root").agg(F.min(first).alias("keeper"), F.sum("copies").alias("class_size"))
    out = named.join(heads, "root")
    return out.select("tid", "copies", (F.col("n_links") + F.col("copies") - 1).alias("n_links"), "n_texts", F.col("keeper.doc_id").alias("class_id"), "class_size", "keeper")


#: A character that Python's str.split() does not take for white space.
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"


def _row_key(doc_id: Column, tid: Column) -> Column:
    return F.concat(tid, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))


def _tid(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def join(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links (other documents at
    or above the threshold, copies counted) and n_texts (different texts among them)."""
    found = classes(spark, docs, threshold)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tid(F.col("text")).alias("t"))
    return base.join(found, F.col("t") == F.col("tid"), "left").select(
        "doc_id",
        F.when(F.col("tid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
    )


def one_of_each(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: its least doc_id (nulls last), then least
    text MD5, then the least of its other columns as JSON. Of repeated rows one stays.
    Documents without words all stay."""
    found = classes(spark, docs, threshold).select(_row_key(F.col("keeper.doc_id"), F.hex("keeper.tid")).alias("_key")).distinct()
    held = docs.select(F.struct(*[store.col(c) for c in docs.columns]).alias("_row"))
    text = F.col("_row.text").cast("string")
    blank = text.isNull() | ~text.rlike(NOT_SPACE)
    kept = held.where(~blank).withColumn("_key", _row_key(F.col("_row.doc_id").cast("long"), F.upper(F.md5(text.cast("binary")))))
    # repeated rows of one document fall to one in the shuffle that the join needs anyway
    others = [F.col("_row." + store.quoted(c)) for c in docs.columns if c != "text"]
    order = [F.to_json(F.struct(*others))] if others else [F.lit(0)]
    kept = kept.join(found, "_key").withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_n = 1")
    return kept.select("_row.*").unionByName(held.where(blank).select("_row.*"))


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, store.read(spark, sf_dir, "documents"))
