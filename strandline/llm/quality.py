"""Compression classifier: a text is likelier good if a dictionary of good text
compresses it better than one of bad text.

Two zstandard dictionaries are built from labelled texts, one per label. A text is
cut into blocks, since a dictionary helps only the start of a long input, and each
block of the whole text is compressed with the good and with the bad dictionary. The
difference of the compressed sizes per byte of text, and nothing else, is calibrated to a
probability by logistic regression on texts that the dictionaries did not see (folds by
crc32 of the id).

The fit uses a bounded sample: at most ``max_rows`` labelled rows per label, those
with the least crc32 of their id (of several texts of one id, that of least hash), and at
most ``max_bytes`` of text in total: if the sampled texts are longer, the longest give
blocks from all over them instead. Scoring reads every whole text.

Defined cases: null and empty texts are scored as empty (a difference of 0); a document
whose label is null is not learned from; several labels of one doc_id all count; without
rows of both labels the score is 0.5 for all; a null doc_id counts as the text '' for the
hold-out. Labels, lang, source, doc_id and the text's length are no inputs of a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import store

BLOCK, LEVEL, DICTIONARY = 256, 3, 112_640
MAX_ROWS, MAX_BYTES, FOLDS = 3_000, 24_000_000, 3
THRESHOLD = 0.3


def id_crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


@dataclass
class Model:
    """What scoring needs; small enough to travel with a task."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_sizes"}

    def score(self, data: bytes) -> float:
        if not self.slope and not self.offset:
            return 0.5
        if not hasattr(self, "_sizes"):
            self._sizes = Sizes(self.good, self.bad)
        return float(_sigmoid(self.offset + self.slope * self._sizes.difference(data)))


class Sizes:
    """Compressed sizes of a text's blocks."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        def made(d):
            return z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d), write_content_size=False, write_checksum=False)

        self.good, self.bad = made(good), made(bad)

    def difference(self, data: bytes) -> float:
        """How many bytes fewer the good dictionary takes for a byte of text."""
        good, bad, total = self.good.compress, self.bad.compress, 0
        for at in range(0, len(data), BLOCK):
            part = data[at : at + BLOCK]
            total += len(bad(part)) - len(good(part))
        return total / max(1, len(data))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(a: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = _sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard as z

    parts = [t[at : at + 2 * BLOCK] for t in texts for at in range(0, len(t), 2 * BLOCK)]
    total = sum(map(len, parts))
    try:
        return z.train_dictionary(min(DICTIONARY, max(256, total // 4)), parts).as_bytes()
    except z.ZstdError:  # too little text to select from: the text itself
        return b"".join(parts)[-DICTIONARY:]


def fit(rows: list[tuple[int, bytes, int]]) -> Model:
    """A model of rows (crc of the id, text or blocks of it, label 0 or 1)."""
    rows = sorted(rows)
    y = np.array([r[2] for r in rows])
    if not rows or y.min() == y.max():
        return Model(b"", b"")
    fold = np.array([r[0] // 5 % FOLDS for r in rows])
    x, ok = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for k in range(FOLDS):
        sides = [[t for (_, t, label), f in zip(rows, fold, strict=True) if label == side and f != k and t] for side in (1, 0)]
        if not all(sides):
            continue
        sizes = Sizes(*map(_dictionary, sides))
        for i in np.flatnonzero(fold == k):
            x[i], ok[i] = sizes.difference(rows[i][1]), True
    if not ok.any() or y[ok].min() == y[ok].max():
        return Model(b"", b"")
    mean, scale = x[ok].mean(), x[ok].std() + 1e-9
    offset, slope = _logistic(np.column_stack([np.ones(ok.sum()), (x[ok] - mean) / scale]), y[ok])
    good, bad = (_dictionary([t for _, t, label in rows if label == side and t]) for side in (1, 0))
    return Model(good, bad, float(slope / scale), float(offset - slope * mean / scale))


def _share(sizes: list[int], budget: int) -> int:
    """The most bytes of each text with which all fit in ``budget``."""
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > budget:
            return max(1, budget // (len(sizes) - k))
        budget -= n
    return max(sizes, default=1)


def _blocks(most: int) -> Column:
    """Column ``data`` of ``n`` bytes in an array: whole, or blocks of up to ``most`` bytes in
    all, one at a place given by ``key`` in each of equal stretches of the text."""
    size = min(BLOCK, most)
    count = most // size
    stretch = F.col("n") / count
    at = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * stretch + F.pmod(F.xxhash64("key", i), F.lit(1024)) / 1024 * (stretch - size)).cast("int"))
    return F.when(F.col("n") <= most, F.array("data")).otherwise(F.transform(at, lambda p: F.substring("data", p + 1, F.lit(size))))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Learns from labelled rows that are not held out."""
    crc = id_crc(F.col("doc_id"))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc % 5 != 0)).distinct()
    usable = usable.withColumn("crc", id_crc(F.col("doc_id")))
    chosen = [r for side in (0, 1) for r in usable.where(F.col("quality") == side).orderBy("crc", "doc_id").limit(max_rows).collect()]
    if not chosen:
        return fit([])
    wanted = spark.createDataFrame([tuple(r) for r in chosen], usable.schema).coalesce(1)  # at most 2 * max_rows rows
    have = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id")
    keys = ["crc", "doc_id", "quality", "n", "key"]
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = have.select("crc", "doc_id", "quality", F.octet_length(data).cast("long").alias("n"), F.xxhash64(data).alias("key"), data.alias("data"))
    # of several texts of an id, one: at most a row for each chosen label
    one = texts.groupBy(*keys[:3]).agg(F.min(F.struct("key", "n")).alias("k")).select(*keys[:3], "k.key", "k.n")
    sizes = [r["n"] for r in one.select("n").collect()]
    got = texts.join(F.broadcast(one), keys).select(*keys, _blocks(_share(sizes, max_bytes)).alias("data")).dropDuplicates(keys)
    return fit([(int(r["crc"]), b"".join(map(bytes, r["data"])), r["quality"]) for r in got.toLocalIterator()])


def score(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str] | None = None, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) with a score and prediction for each row."""
    store.small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    plain = [f"c{k}" for k in range(len(keep))]  # whatever dots the names hold
    given = docs.select(*[store.col(c).alias(p) for c, p in zip(keep, plain, strict=True)], F.col("text").cast("string").alias("text"))
    made = ("score", "predicted")
    schema = given.select(*plain, F.lit(0.0).alias(made[0]), F.lit(0).alias(made[1])).schema

    def run(batches):
        m = held.value
        for b in batches:
            s = [m.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(len(plain))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(plain)], pa.array(s, pa.float64()), pa.array([int(v >= THRESHOLD) for v in s], pa.int32())], names=[*plain, *made])

    return given.mapInArrow(run, schema).toDF(*keep, *out)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.read(spark, sf_dir, "documents")
    model = train(spark, docs, store.read(spark, sf_dir, "labels"))
    scored = score(spark, docs, model, ["doc_id"])
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", "predicted")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    names = (store.free_name(docs, "score"), store.free_name(docs, "predicted"))
    scored = score(spark, docs, train(spark, docs, labels), out=names)
    return scored.where(store.col(names[1]) == 1).select(*[store.col(c) for c in docs.columns])
