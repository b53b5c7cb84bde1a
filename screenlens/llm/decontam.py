"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into segments of whole documents. A segment is one row of the index table in the
shared folder: its documents, the sorted list of its terms, and for each term the sorted list of its positions, for all
tokens (differences of positions in one array, with pointers). Arrays are kept as bytes, so that Spark moves each as one value, and
row groups have ROW_GROUP bytes at most, or one segment: so much is what a task that writes or reads the index holds,
whatever its input. The index knows no benchmark: it is built once, and
any number of benchmarks, or blocks of one, are answered from it. Segments need no exchange with one another, whatever is
frequent in them.

* Phrases: the lists of a window's terms, each shifted by the term's offset, are intersected from the rarest on.
  Documents lie a gap apart, so no phrase crosses them.
* Proximity: an item's consecutive blocks of `width` words match where one document has all of a block's words, in
  any order, within `reach` words; places are looked for around the rarest term.

The benchmark is the stated query set. It is broadcast in blocks of at most about `block_chars`
characters; with several blocks, the answers of the blocks meet by document.

Defined results: null or word-free text has no words and no hits; items without words, or null,
have no window; a null item_id counts as the empty string and items that share an id as one; rows
that repeat a doc_id are answered each for itself; texts are read whole, and one longer than a segment is a segment of its
own; a word at the same distance on both sides counts once; empty tables give no rows, or no hits; other columns are
ignored.
"""

from __future__ import annotations

import collections
import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, stored, tidied, tidy, tune

#: ASCII that is neither digit nor letter parts words; A-Z becomes a-z; all else stays.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of text in a segment, or one document more.
SEGMENT = 2_000_000
#: Words among which those of a block must lie for a proximity match.
REACH = 20
#: Each but terms holds little-endian integers: docs 64-bit ones, of which known tells which are not null; the others 32-bit ones.
INDEX = "docs binary, known binary, starts binary, sizes binary, terms binary, ptr binary, steps binary"
#: Spark's writer otherwise looks at sizes after 100 rows, which may be 200 MB here, and Spark's reader takes a row group at once.
ROW_GROUP = 4 << 20
WRITE = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}
HITS = "seg long, at int, doc_id long, n_words long, first array<int>, last array<int>, items array<string>, near array<string>"
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def windows(items: list[tuple[str | None, str | None]], width: int, step: int = 1) -> dict[tuple[bytes, ...], set[str]]:
    """Each window, beginning at every `step`th word, and the ids of the items that have it."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        w = words(text)
        for i in range(0, max(len(w) - width, 0) + 1 if w else 0, step):
            out.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    return out


class Segment:
    """Posting lists of some documents. terms: in order; positions of the k-th are those from ptr[k] to ptr[k + 1]."""

    def __init__(self, docs, starts, sizes, terms: list[bytes], ptr, positions):
        self.docs, self.terms = docs, terms
        self.starts, self.sizes, self.ptr, self.positions = (np.asarray(x, dtype=np.int32) for x in (starts, sizes, ptr, positions))

    @classmethod
    def build(cls, docs: list, texts: list[str | None]) -> Segment:
        # Its factory must not refer to it: a ring would keep each segment's words until some later garbage collection.
        number: collections.defaultdict[bytes, int] = collections.defaultdict(itertools.count().__next__)
        ids, sizes = [], []
        for t in texts:
            w = words(t)
            sizes.append(len(w))
            ids.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
        starts = np.cumsum([0, *(n + 1 for n in sizes[:-1])]) if sizes else []
        terms = sorted(number)
        rank = np.empty(len(terms), dtype=np.int32)
        rank[np.fromiter((number[t] for t in terms), np.int64, len(terms))] = np.arange(len(terms), dtype=np.int32)
        flat = rank[np.concatenate(ids)] if ids else np.zeros(0, np.int32)
        order = np.argsort(flat, kind="stable")
        ptr = np.append(0, np.cumsum(np.bincount(flat, minlength=len(terms))))
        return cls(docs, starts, sizes, terms, ptr, ranges(starts, sizes)[order])

    def numbers(self, vocabulary) -> np.ndarray:
        """The place of each word of a vocabulary among the terms, or -1."""
        place = {t: k for k, t in enumerate(self.terms)}
        return np.fromiter((place.get(w, -1) for w in vocabulary), np.int32, len(vocabulary))

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.ptr[term] : self.ptr[term + 1]] if term >= 0 else self.positions[:0]

    def phrase(self, terms) -> np.ndarray:
        """Positions where the terms stand one after another: shifted lists are intersected, the rarest first."""
        lists = sorted(((self.postings(t), k) for k, t in enumerate(terms)), key=lambda x: len(x[0]))
        found = lists[0][0] - lists[0][1]
        for p, k in lists[1:]:
            if not len(found):
                break
            i = np.searchsorted(p, found + k)
            found = found[(i < len(p)) & (p[np.minimum(i, len(p) - 1)] == found + k)] if len(p) else found[:0]
        return found

    def near(self, terms, reach: int) -> np.ndarray:
        """Positions of the rarest term that lie, in one document, with all other terms within `reach` words."""
        lists = sorted((self.postings(t) for t in set(map(int, terms))), key=len)
        found = lists[0]
        for p in lists[1:]:
            if not len(found):
                return found
            # Another term within reach on either side; what is further in that list is further away.
            i = np.searchsorted(p, found)
            ok = np.zeros(len(found), bool)
            for j in (i - 1, i) if len(p) else ():
                q = p[np.clip(j, 0, len(p) - 1)]
                ok |= (np.abs(q - found) < reach) & (self.owner(q) == self.owner(found))
            found = found[ok]
        return found[np.fromiter((self._covered(lists[1:], int(x), reach) for x in found), bool, len(found))]

    def _covered(self, lists, x: int, reach: int) -> bool:
        """Whether some `reach` words that hold place x have a place of each list."""
        d = int(self.owner(np.array([x]))[0])
        low, high = max(x - reach + 1, int(self.starts[d])), min(x + reach, int(self.starts[d] + self.sizes[d]))
        at = [p[np.searchsorted(p, low) : np.searchsorted(p, high)] for p in lists]
        starts = {x, *(int(v) for p in at for v in p if v <= x)}
        return any(all(((p >= s) & (p < s + reach)).any() for p in at) for s in starts)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1

    def present(self, matrix: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each row of word numbers (-1: none): whether all of them have postings here; place: that of each word among the terms."""
        return ((matrix < 0) | (np.append(place, -1)[matrix] >= 0)).all(1)


class Queries:
    """Windows (each phrase) and blocks (each to be found within reach) as rows of word numbers, each with its item ids."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        number: dict[bytes, int] = {}
        self.windows, self.items = self._rows(windows(items, width), width, number)
        self.blocks, self.near_items = self._rows(windows(items, width, width), width, number)
        self.vocabulary = list(number)

    def _rows(self, found: dict[tuple[bytes, ...], set[str]], width: int, number: dict[bytes, int]):
        matrix = np.full((len(found), width), -1, dtype=np.int32)
        for k, w in enumerate(found):
            matrix[k, : len(w)] = [number.setdefault(x, len(number)) for x in w]
        return matrix, [sorted(x) for x in found.values()]


def build_index(docs: DataFrame) -> DataFrame:
    """The index table of docs (doc_id, text) with the postings of all tokens; one row a segment."""

    def build(batches):
        ids, texts, size = [], [], 0

        def row():
            s = Segment.build(ids, texts)
            docs = np.array([0 if d is None else d for d in s.docs], "<i8"), np.array([d is not None for d in s.docs])
            numbers = (x.astype("<i4") for x in (s.starts, s.sizes, s.ptr, np.diff(s.positions, prepend=np.int32(0))))
            starts, sizes, ptr, steps = (x.tobytes() for x in numbers)
            values = [docs[0].tobytes(), docs[1].tobytes(), starts, sizes, b" ".join(s.terms), ptr, steps]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in values], names=["docs", "known", "starts", "sizes", "terms", "ptr", "steps"])

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= SEGMENT:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(tidy(build), INDEX)


def segments(batch):
    """(seg, Segment) of each row of an index table's batch."""
    for k, seg in enumerate(batch.column("seg").to_pylist()):
        starts, sizes, ptr, steps = (np.frombuffer(batch.column(x)[k].as_buffer(), "<i4") for x in ("starts", "sizes", "ptr", "steps"))
        ids, known = (np.frombuffer(batch.column(x)[k].as_buffer(), t).tolist() for x, t in (("docs", "<i8"), ("known", bool)))
        docs = [d if ok else None for d, ok in zip(ids, known, strict=True)]
        yield seg, Segment(docs, starts, sizes, batch.column("terms")[k].as_py().split(), ptr, np.cumsum(steps, dtype=np.int32))


def covered(first: list[int], last: list[int]) -> int:
    """Number of integers in the union of the ranges."""
    total, end = 0, -1
    for a, b in sorted(zip(first, last, strict=True)):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def digest(hits: pa.RecordBatch) -> pa.RecordBatch:
    """OUT of HITS."""
    n = [covered(x, y) for x, y in zip(hits.column("first").to_pylist(), hits.column("last").to_pylist(), strict=True)]
    items = [sorted(set(x)) for x in hits.column("items").to_pylist()]
    near = [len(set(x)) for x in hits.column("near").to_pylist()]
    return pa.RecordBatch.from_arrays(
        [hits.column("doc_id"), hits.column("n_words"), pa.array(n, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([x > 0 for x in n], pa.bool_()), pa.array(near, pa.int64())],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"],
    )


def answer(index: DataFrame, queries, reach: int = REACH, only: bool = True) -> DataFrame:
    """For each document of each segment: the word ranges that windows hit, the items concerned, and the items with a block within reach (HITS); OUT if these queries are the only ones."""

    def search(batches):
        q = queries.value
        for b in batches:
            for seg, s in segments(b):
                place = s.numbers(q.vocabulary)
                first: dict[int, list[int]] = {}
                last: dict[int, list[int]] = {}
                items: dict[int, set[str]] = {}
                near: dict[int, set[str]] = {}
                for w in np.flatnonzero(s.present(q.windows, place)):
                    terms = q.windows[w][q.windows[w] >= 0]
                    at = s.phrase(place[terms])
                    for d, p in zip(s.owner(at).tolist(), at.tolist(), strict=True):
                        p -= int(s.starts[d])
                        first.setdefault(d, []).append(p)
                        last.setdefault(d, []).append(p + len(terms))
                        items.setdefault(d, set()).update(q.items[w])
                for w in np.flatnonzero(s.present(q.blocks, place)):
                    for d in set(s.owner(s.near(place[q.blocks[w][q.blocks[w] >= 0]], reach)).tolist()):
                        near.setdefault(d, set()).update(q.near_items[w])
                n = len(s.docs)
                hits = pa.RecordBatch.from_arrays(
                    [pa.array([seg] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(s.docs, pa.int64()), pa.array(s.sizes, pa.int64())]
                    + [pa.array([x.get(d, []) for d in range(n)], pa.list_(pa.int32())) for x in (first, last)]
                    + [pa.array([sorted(x.get(d, ())) for d in range(n)], pa.list_(pa.string())) for x in (items, near)],
                    names=["seg", "at", "doc_id", "n_words", "first", "last", "items", "near"],
                )
                yield digest(hits) if only else hits

    return index.mapInArrow(tidy(search), OUT if only else HITS)


def index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text), written to the shared folder; `look_up` answers any benchmark from it."""
    tune(docs.sparkSession)
    return stored(build_index(docs).withColumn("seg", F.monotonically_increasing_id()), "postings", WRITE)


def look_up(postings: DataFrame, benchmark: DataFrame, width: int = 10, reach: int = REACH, block_chars: int = 16_000_000) -> DataFrame:
    """Columns OUT of every document of an index for benchmark (item_id, text). n_near counts the items with a block of `width` words within `reach` words of a document."""
    benchmark = benchmark.select("item_id", "text").where("text is not null")
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    parts = []
    for k in range(blocks):
        block = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        q = postings.sparkSession.sparkContext.broadcast(Queries([(r.item_id, r.text) for r in block.toLocalIterator()], width))
        parts.append(answer(postings, q, reach, blocks == 1))
    if blocks == 1:
        return parts[0]
    hits = functools.reduce(DataFrame.unionByName, parts).groupBy("seg", "at")
    hits = hits.agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("first", "last", "items", "near")))
    return hits.mapInArrow(tidy(lambda batches: map(digest, batches)), OUT)


@tidied
def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = 16_000_000, reach: int = REACH) -> DataFrame:
    """Columns OUT of every row of docs (doc_id, text)."""
    return look_up(index(docs), benchmark, width, reach, block_chars)
