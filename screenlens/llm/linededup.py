"""Line dedup over levelled sorted runs of line hashes.

`LineRuns` is a log-structured store in the shared folder. A run is a table of (k1, k2, n, doc): the 128-bit
hash of a line key, the number of rows that hold it and the largest doc_id that does. All runs are dealt into the same
buckets by key and sorted in them, one file a bucket, so that runs are merged, and batches compared with them, without any
exchange or sort of a run. A new batch is merge-anti-joined with the runs, which takes away what changes nothing there, and
adds the rest as its own run. When a level has `fanout` runs, they are merged into one run of the next level.

`dedup` reads the texts twice: once for the keys, which a task sums before they are shuffled, so that a very common line
is a few rows a task; and once to drop lines. The keys are added batch by batch (four at least, and one for each
BATCH of them). Lines whose key is in at least `min_docs` rows go, except in the largest doc_id holding it. The keys
concerned are broadcast only if there are at most `broadcast_keys` (about 150 bytes each in a worker); else documents
meet them by join.

Defined results: a null or empty text is one empty line; a null doc_id sorts below all others; each row
counts as a document of its own, and rows that repeat a doc_id keep or lose a line together; texts are read whole, whatever
their length or number of lines; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, remove, scratch, stored, tidied, tidy, tune

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
NO_ID = -(1 << 63)
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Keys that a task sums at once; keys of a batch and of a bucket; parts that the keys are written in, and so the most batches.
HELD, BATCH, BUCKET, PARTS = 1_000_000, 1 << 31, 2_000_000, 64


def key_of(line: str, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, or None if the key is short."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())


def summed(k: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (rows of two integers) sorted and each once, with their numbers added up and the largest doc."""
    o = np.lexsort((k[:, 1], k[:, 0]))
    k, n, doc = k[o], n[o], doc[o]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(1)))
    return k[first], np.add.reduceat(n, first), np.maximum.reduceat(doc, first)


def keys(docs: DataFrame, min_chars: int = 20, batches: int = 1, whole: bool = True) -> DataFrame:
    """(batch, k1, k2, n, doc): the distinct long line keys of each row; whole=False: summed over the rows of a task."""

    def emit(batches_of):
        from pyspark import TaskContext

        batch = TaskContext.get().partitionId() % batches
        held: list[tuple] = []
        size = 0

        def out(k, n, doc):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), batch, np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in (k[:, 0], k[:, 1], n, doc))], names=["batch", "k1", "k2", "n", "doc"])

        for b in batches_of:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            found, owner = [], []
            for i, t in zip(ids, texts, strict=True):
                mine = {key_of(x, min_chars) for x in (t or "").split("\n")}
                mine.discard(None)
                found += mine
                owner += [NO_ID if i is None else i] * len(mine)
            k = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)
            row = k, np.ones(len(k), np.int64), np.array(owner, dtype=np.int64)
            if whole:
                yield out(*row)
                continue
            if len(k):
                held.append(row)
                size += len(k)
            if size >= HELD:
                held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if 2 * size >= HELD:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return docs.select("doc_id", "text").mapInArrow(tidy(emit), "batch int, k1 long, k2 long, n long, doc long")


class LineRuns:
    """Levels of sorted runs; `levels[i]` lists the tables of level i.

    enough: the count from which on a key's number no longer matters (None: all are exact). buckets: of every run.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, enough: int | None = None, buckets: int = 8):
        self.spark, self.fanout, self.enough, self.buckets, self.levels = spark, fanout, enough, buckets, [[]]
        self.paths: dict[str, str] = {}
        # One file a bucket: its order is the table's.
        spark.conf.set(ORDERED, "true")

    def _read(self, names: list[str]) -> DataFrame:
        """All keys of some runs with their counts, each once: a full outer merge join of sorted runs."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            a, b = a.alias("a").hint("merge"), b.alias("b")
            key = (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2"))
            n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
            return a.join(b, key, "full_outer").select(F.coalesce("a.k1", "b.k1").alias("k1"), F.coalesce("a.k2", "b.k2").alias("k2"), n.alias("n"), F.greatest("a.doc", "b.doc").alias("doc"))

        return functools.reduce(both, (self.spark.table(n) for n in names))

    def _write(self, run: DataFrame) -> str:
        path = scratch(self.spark, "run")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        run.write.format("parquet").bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Remove all runs and the settings made for them."""
        self._drop(list(self.paths))
        self.spark.conf.unset(ORDERED)

    def add(self, batch: DataFrame) -> None:
        """Add the rows (k1, k2, doc, and n if they are summed) of a batch as a run, then compact full levels."""
        n = F.col("n") if "n" in batch.columns else F.lit(1).cast("long")
        run = batch.select("k1", "k2", n.alias("n"), "doc").repartition(self.buckets, "k1", "k2").groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("doc").alias("doc"))
        if self.enough is not None:
            run = self._unsettled(run)
        self.levels[0].append(self._write(run))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            old = self.levels[level]
            self.levels[level + 1].append(self._merge(old))
            self.levels[level] = []
            level += 1

    def _meet(self, batch: DataFrame, found) -> DataFrame:
        """The rows of a batch for which found(count, largest doc in the runs) does not hold: a merge join with each run in turn."""
        n, holder = F.lit(0).cast("long"), F.lit(None).cast("long")
        for k, name in enumerate(p for level in self.levels for p in level):
            batch = batch.hint("merge").join(self.spark.table(name).select("k1", "k2", F.col("n").alias(f"n{k}"), F.col("doc").alias(f"doc{k}")), ["k1", "k2"], "left")
            n = n + F.coalesce(f"n{k}", F.lit(0))
            holder = F.greatest(holder, F.col(f"doc{k}"))
        return batch.where(~found(n, F.coalesce(holder, F.lit(NO_ID))))

    def _unsettled(self, run: DataFrame) -> DataFrame:
        """Merge anti-join: the rows of a batch but those whose key is held often enough already, and by a later document."""
        return self._meet(run, lambda n, holder: (n >= self.enough) & (F.col("doc") <= holder)).select("k1", "k2", "n", "doc")

    def _merge(self, names: list[str]) -> str:
        """One run of some, two at a time: each merge reads its runs bucket by bucket in order."""
        names = list(names)
        while len(names) > 1:
            a, b = names[:2]
            names = [*names[2:], self._write(self._read([a, b]))]
            self._drop([a, b])
        return names[0]

    def compact(self) -> None:
        """Merge all runs into one, the lower levels first."""
        names = [p for level in self.levels for p in level]
        if names:
            self.levels = [[] for _ in self.levels[1:]] + [[self._merge(names)]]

    def view(self) -> DataFrame:
        """All keys with their counts, each once."""
        names = [p for level in self.levels for p in level]
        if not names:
            return self.spark.createDataFrame([], "k1 long, k2 long, n long, doc long")
        return self._read(names)

    def novel(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key no run has yet."""
        return self._meet(batch, lambda n, _: n > 0).select(*batch.columns)


def drop_lines(text: str | None, min_chars: int, doomed) -> tuple[int, list[str]]:
    """Number of lines, and those that stay; doomed: key -> bool."""
    lines = (text or "").split("\n")
    kept = []
    for x in lines:
        k = key_of(x, min_chars)
        if k is None or not doomed(k):
            kept.append(x)
    return len(lines), kept


def _apply(docs: DataFrame, min_chars: int, doomed_of) -> DataFrame:
    """docs: row, text and what `doomed_of(batch)` needs to give, for each row, its test for keys."""

    def apply(batches):
        for b in batches:
            rows = [drop_lines(t, min_chars, d) for t, d in zip(b.column("text").to_pylist(), doomed_of(b), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([n for n, _ in rows], pa.int64()), pa.array([n - len(k) for n, k in rows], pa.int64()), pa.array(["\n".join(k) for _, k in rows], pa.string())],
                names=["row", "n_lines", "n_dropped", "kept"],
            )

    return docs.mapInArrow(tidy(apply), f"row {docs.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")


@tidied
def dedup(spark: SparkSession, docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 4, broadcast_keys: int = 200_000) -> DataFrame:
    """row (struct of all columns but text), n_lines, n_dropped, kept (the remaining text) of every row. batches: how many (None: by the number of keys)."""
    tune(spark)
    docs = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"), "doc_id", "text")
    path = scratch(spark, "keys")
    keys(docs, min_chars, PARTS, False).write.partitionBy("batch").parquet(path)
    found = spark.read.schema("k1 long, k2 long, n long, doc long, batch int").parquet(path)
    size = found.count()
    batches = batches or max(4, -(-size // BATCH))
    runs = LineRuns(spark, fanout, min_docs, max(8, -(-size // BUCKET)))
    for k in range(min(batches, PARTS)):
        runs.add(found.where(F.col("batch") % min(batches, PARTS) == k))
    runs.compact()
    doomed = stored(runs.view().where(F.col("n") >= min_docs), "doomed")
    runs.close()
    remove(spark, path)
    if doomed.count() <= broadcast_keys:
        rows = doomed.collect()
        table = spark.sparkContext.broadcast({np.array([r.k1, r.k2]).tobytes(): r.doc for r in rows})

        def tests(b):
            holder = table.value
            for i in b.column("row").field("doc_id").to_pylist():
                own = NO_ID if i is None else i
                yield lambda k, own=own: holder.get(k, own) != own

        return _apply(docs.select("row", "text"), min_chars, tests)
    own = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    hit = by_key(keys(docs, min_chars).select("k1", "k2", "doc"), doomed.withColumnRenamed("doc", "holder"), "k1", "k2", count="n").where("doc <> holder")
    lists = hit.groupBy("doc").agg(F.collect_set(F.struct("k1", "k2")).alias("ks"))
    joined = docs.withColumn("own", own).join(lists.withColumnRenamed("doc", "own"), "own", "left").select("row", "text", F.col("ks.k1").alias("k1s"), F.col("ks.k2").alias("k2s"))

    def listed(b):
        for one, two in zip(b.column("k1s").to_pylist(), b.column("k2s").to_pylist(), strict=True):
            mine = {np.array(p).tobytes() for p in zip(one or (), two or (), strict=True)}
            yield mine.__contains__

    return _apply(joined, min_chars, listed)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of `dedup`."""
    return result.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def clean(result: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the documents, with text replaced by what is left of it and n_chars by its length."""
    return result.select(*(F.col("kept").alias(c) if c == "text" else F.length("kept").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in columns))
