"""Token counts: additive totals by source, language and tokenizer version, kept by deltas.

A batch of changes carries, per document, what it did: ``insert`` (counts ``tokens``),
``delete`` (takes back ``prev_tokens``) or ``revise`` (``tokens`` instead of
``prev_tokens``). ``delta`` turns that into signed sums per (source, lang, version),
with partial sums before the shuffle, so a source that holds a third of all rows costs
no more than any other.

``commit`` writes a batch's sums to a folder of their own and then one entry to a log, a
numbered file that can be made only once: by a hard link on a local file system, by a
rename that fails if the name is taken elsewhere (HDFS and whatever renames atomically; an
object store without that is no place for a rollup). Of two committers one makes the entry, and the other
reads the log again and tries the next number, or leaves it if its batch is there by now.
So a batch id counts once, and a driver or executor lost on the way leaves only a folder
that no entry names, which ``vacuum`` deletes. A commit runs one Spark job, whatever came
before; every ``FULL``-th entry holds the whole state, so at most ``FULL`` are read.
``totals`` adds up the folders that the log names; ``compact`` folds them into one, unless
another committer has folded any of them in the meantime.

Defined cases: null tokens count as 0, as do prev_tokens; a null source or language is a
group of its own; an unknown kind of change fails the batch; equal change rows all count,
each is a change; an empty batch commits and adds nothing; groups whose documents and
tokens add up to 0 stay, as 0, until ``compact`` drops them. Bytes that are not valid
UTF-8 are encoded as replacement characters.
"""

from __future__ import annotations

import json
import os
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import store, tokens
from strandline.llm.mixing import words

KEYS = ("source", "lang", "version")
DELTA = "source string, lang string, version string, documents long, tokens long"


def delta(changes: DataFrame) -> DataFrame:
    """Signed sums of changes (kind, source, lang, version, tokens, prev_tokens)."""
    now, before = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("tokens", "prev_tokens"))
    kind = F.col("kind")
    wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null"))))
    documents = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(wrong.cast("int"))
    amount = F.when(kind == "insert", now).when(kind == "delete", -before).otherwise(now - before)
    return changes.select(*KEYS, documents.cast("long").alias("documents"), amount.alias("tokens")).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


FULL = 100


class Rollup:
    """Totals under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name in ("log", "sums", "new"):
            fs, at = store.filesystem(spark, f"{self.path}/{name}")
            fs.mkdirs(at)

    def _names(self, folder: str) -> list[str]:
        fs, at = store.filesystem(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at))

    def _entry(self, number: int) -> dict:
        fs, at = store.filesystem(self.spark, f"{self.path}/log/{number:020d}")
        with_stream = fs.open(at)
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(with_stream)
        finally:
            with_stream.close()
        return json.loads(bytes(raw))

    def _state(self) -> tuple[int, list[str], list[str]]:
        """The number of the last entry, the folders that count, and all batch ids."""
        numbers = [int(n) for n in self._names("log")]
        last = max(numbers, default=0)
        folders: list[str] = []
        ids: list[str] = []
        for k in range(max(1, last // FULL * FULL), last + 1):
            entry = self._entry(k)
            if "state" in entry:
                folders, ids = entry["state"]
            else:
                folders = [f for f in folders if f not in entry["drop"]] + entry["add"]
                ids = ids + entry["ids"]
        return last, folders, ids

    def _append(self, number: int, state: tuple[list[str], list[str]], add: list[str], drop: list[str], ids: list[str]) -> bool:
        """Makes entry ``number``; False if it is there already."""
        entry = {"add": add, "drop": drop, "ids": ids}
        if number % FULL == 0:
            entry = {"state": [[f for f in state[0] if f not in drop] + add, state[1] + ids]}
        fs, new = store.filesystem(self.spark, f"{self.path}/new/{uuid.uuid4().hex}")
        stream = fs.create(new, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        final = store.filesystem(self.spark, f"{self.path}/log/{number:020d}")[1]
        try:
            if fs.getUri().getScheme() == "file":
                os.link(new.toUri().getPath(), final.toUri().getPath())
            else:
                jvm = self.spark.sparkContext._jvm
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, final, none)
        except Exception:  # of whatever kind: what counts is whether another has made it
            if not fs.exists(final):
                raise
            return False
        finally:
            fs.delete(new, False)
        return True

    def _written(self, sums: DataFrame) -> str:
        name = uuid.uuid4().hex
        sums.write.parquet(f"{self.path}/sums/{name}")
        return name

    def _discard(self, folders: list[str]) -> None:
        for f in folders:
            fs, at = store.filesystem(self.spark, f"{self.path}/sums/{f}")
            fs.delete(at, True)

    def committed(self) -> list[str]:
        """Ids of the batches that the totals hold, compacted ones included."""
        return sorted(self._state()[2])

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; False, and no change, if it is there already."""
        if not batch_id:
            raise ValueError("a batch needs an id")
        if batch_id in self._state()[2]:
            return False
        made = self._written(delta(changes))
        while True:
            last, folders, ids = self._state()
            if batch_id in ids:  # another committer was first
                self._discard([made])
                return False
            if self._append(last + 1, (folders, ids), [made], [], [batch_id]):
                return True

    def _sums(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        paths = [f"{self.path}/sums/{f}" for f in folders]
        return self.spark.read.schema(DELTA).parquet(*paths).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens) over all committed batches."""
        return self._sums(self._state()[1])

    def compact(self) -> bool:
        """Folds the folders that count into one; False if there is nothing to fold, or
        another has folded some of them meanwhile. The old folders stay for readers that
        have begun, until ``vacuum``."""
        old = self._state()[1]
        if len(old) < 2:
            return False
        made = self._written(self._sums(old).where("documents <> 0 OR tokens <> 0").coalesce(1))  # a row per group
        while True:
            last, folders, ids = self._state()
            if not set(old) <= set(folders):
                self._discard([made])
                return False
            if self._append(last + 1, (folders, ids), [made], old, []):
                return True

    def vacuum(self, older_than: float = 7 * 86_400) -> int:
        """Deletes folders of over so many seconds that do not count; how many."""
        until, used = (time.time() - older_than) * 1000, set(self._state()[1])
        n = 0
        for folder in ("sums", "new"):
            fs, at = store.filesystem(self.spark, f"{self.path}/{folder}")
            for s in fs.listStatus(at):
                if s.getPath().getName() not in used and s.getModificationTime() <= until:
                    n += bool(fs.delete(s.getPath(), True))
        return n


def counted(docs: DataFrame, path: str) -> DataFrame:
    """(source, lang, n_words, n_tokens): white-space words, and ids of the tokenizer file."""
    store.small_batches(docs.sparkSession)
    given = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), words(F.col("text")).alias("n_words"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches):
        tok = tokens.get(path)
        for b in batches:
            n = [tok.count(t.decode("utf-8", "replace")) if t else 0 for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64())], names=["source", "lang", "n_words", "n_tokens"])

    return given.mapInArrow(run, "source string, lang string, n_words long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents: inserted with word counts under one
    version and with token counts under another; word counts revised to tokens under a
    third; that version's documents deleted again; and the first batch sent twice."""
    path = tokens.default_path()
    n = store.materialize(counted(store.read(spark, sf_dir, "documents"), path), "counts")
    none = F.lit(None).cast("long")

    def changes(kind, version, now, before):
        return n.select(F.lit(kind).alias("kind"), "source", "lang", F.lit(version).alias("version"), now.alias("tokens"), before.alias("prev_tokens"))

    a, b = F.col("n_words"), F.col("n_tokens")
    first = changes("insert", "words-1", a, none).unionByName(changes("insert", "word_bpe_49k-1", b, none))
    roll = Rollup(spark, store.new_path(spark, "rollup"))
    roll.commit("1-insert", first)
    roll.commit("2-migrate", changes("insert", "migrated", a, none))
    roll.commit("3-revise", changes("revise", "migrated", b, a))
    roll.commit("1-insert", first)
    roll.commit("4-delete", changes("delete", "words-1", none, a))
    return roll.totals()
