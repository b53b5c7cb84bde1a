"""Suffix-array dedup: remove each byte covered by a string of `length` bytes that also starts earlier.

All strings of the corpus that occur twice must meet in one shard. Each window of `length` bytes has
one anchor: its leftmost least hashed gram of `GRAM` bytes. Equal windows have equal anchors, so
shards are dealt by anchor and no repeat crosses them. Neighbouring windows with the same anchor form
one context. Anchors that a sample finds in very many different contexts (a phrase in every document, say) are hot: their
windows become contexts of their own, whose anchor is a hash of the whole window, so that they are dealt over all
tasks; equal ones still meet.

1. A scan emits the contexts as (anchor, hash of the context's bytes, place), once for each task and
   equal context; what repeats within the task is a span already. That keeps hot lines small.
2. Sorted by anchor and hash, a stream keeps each context's first occurrence; all others are spans.
   An anchor with a single context needs no more; those with several may share windows.
3. The bytes of the contexts of step 2 that remain are dealt to shards by anchor. Each shard sorts
   its suffixes by external induced sorting (`induced`), which carries common-prefix values; suffixes with
   `length` bytes in common are equal windows, and all but the first are covered.
4. Documents meet their spans and lose them.

Order is (doc_id, position). Spans and contexts grow with the corpus and are only ever shuffled. The
context's hash has 64 bits and must agree together with the 64-bit anchor; both are of texts of under 300 bytes.

Defined results: a null text counts as empty; texts shorter than `length` bytes lose nothing; very long texts are cut into overlapping pieces of CHUNK bytes, so that none is held twice, and nothing is lost; an empty table gives an empty one; a
null doc_id sorts below all others; rows that repeat a doc_id are ordered by a hash of their texts,
and if the texts are equal too, all copies lose the same; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import induced
from .common import SHARE, ranges, stored, tidied, tidy, tune

LENGTH, GRAM = 100, 32
#: Bytes handled at once; contexts that a task compares at once; bytes of a shard.
CHUNK, ROWS, SHARD = 4_000_000, 1_000_000, 8_000_000
#: Documents in which hot anchors are looked for, about.
SAMPLE = 10_000
NO_ID = -(1 << 63)
ROW = "anchor long, ctx long, doc long, h long, start long, n long"
FOUND = "kind byte, anchor long, doc long, h long, start long, n long"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

_RNG = np.random.default_rng(20240229)
#: Odd 64-bit numbers: one for each byte and hash, and multipliers for the doublings.
BYTE_A, BYTE_B = (_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
MULTIPLY = [np.uint64(int(x) * 2 + 1) for x in _RNG.integers(1 << 61, 1 << 62, 8, dtype=np.uint64)]
BASE = int(MULTIPLY[7])
LOW = np.uint64((1 << 24) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MULTIPLY[5]
    return x ^ (x >> np.uint64(29))


def grams(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes (a power of two) from each place."""
    x, n = BYTE_A[b], 1
    while n < GRAM:
        x = x[:-n] * MULTIPLY[n.bit_length() % 5] + x[n:]
        n *= 2
    return mix(x)


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = 1
    while 2 * n <= width:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    return np.minimum(key[: len(key) - (width - n)], key[width - n :]) if width > n else key


def prefix_hashes(values: np.ndarray, base: int):
    """Function of starts and lengths: the hash of these values, the same wherever they stand."""
    power = np.full(len(values) + 1, base, dtype=np.uint64)
    back = np.full(len(values) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    total = np.append(np.uint64(0), np.cumsum(values * power[:-1]))
    return lambda start, n: (total[start + n] - total[start]) * back[start]


def split_hot(b: np.ndarray, found: tuple, of, hot: np.ndarray, length: int) -> tuple:
    """The contexts found, those with hot anchors cut into single windows, each with its own anchor: two hashes of the whole window."""
    anchor, ctx, first, n = found
    at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
    is_hot = hot[at] == anchor
    if not is_hot.any():
        return found
    p = ranges(first[is_hot], n[is_hot])
    other = prefix_hashes(BYTE_A[b], int(MULTIPLY[6]))
    alone = mix(other(p, length)).view(np.int64), mix(of(p, length)).view(np.int64), p, np.ones(len(p), np.int64)
    return tuple(np.concatenate([x[~is_hot], y]) for x, y in zip(found, alone, strict=True))


def contexts(b: np.ndarray, owner_end: np.ndarray, length: int, hot: np.ndarray | None = None):
    """Of the joined documents b that end at owner_end: anchor, context hash, first window, number of windows."""
    x = grams(b)
    key = (x & ~LOW) | np.arange(len(x), dtype=np.uint64)
    at = (sliding_least(key, length - GRAM + 1) & LOW).astype(np.int64)
    starts = np.append(0, owner_end[:-1])
    p = ranges(starts, np.maximum(owner_end - starts - length + 1, 0))
    if not len(p):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    a = at[p]
    new = np.flatnonzero((np.diff(a) != 0) | (np.diff(p) != 1)) + 1
    first, last = p[np.append(0, new)], p[np.append(new - 1, len(p) - 1)]
    of = prefix_hashes(BYTE_B[b], BASE)
    n = last - first + 1
    ctx = mix(of(first, n - 1 + length) + n.astype(np.uint64) * MULTIPLY[6] + (at[first] - first).astype(np.uint64) * MULTIPLY[4])
    found = x[at[first]].view(np.int64), ctx.view(np.int64), first, n
    return found if hot is None or not len(hot) else split_hot(b, found, of, hot, length)


def pieces(batches, length: int):
    """(doc, h, offset, bytes): documents, cut where they are very long so that each window is in one piece."""
    for batch in batches:
        for d, h, t in zip(batch.column("doc").to_pylist(), batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = t.encode("utf-8", "surrogatepass") if t else b""
            for o in range(0, max(len(raw) - length + 1, 0), CHUNK):
                yield d, h, o, raw[o : o + CHUNK + length - 1]


def merge(doc, h, start, n):
    """Rows (doc, h, start, n) sorted, with windows that follow one another joined."""
    o = np.lexsort((start, h, doc))
    doc, h, start, n = doc[o], h[o], start[o], n[o]
    if not len(doc):
        return doc, h, start, n
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (start[1:] > start[:-1] + n[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], h[first], start[first], start[last] + n[last] - start[first]


def _rows(names, arrays, kind=None):
    out = [pa.array(np.ascontiguousarray(x), pa.int64()) for x in arrays]
    if kind is not None:
        out = [pa.array(np.full(len(arrays[0]), kind, np.int8)), *out]
    return pa.RecordBatch.from_arrays(out, names=names)


NAMES = ["anchor", "ctx", "doc", "h", "start", "n"]


def scan_contexts(docs: DataFrame, length: int, hot=None) -> DataFrame:
    """Step 1 over docs (doc, h, text); hot: broadcast sorted anchors. Spans have ctx 0 and n below zero."""

    def run(batches):
        held: list[tuple] = []
        many = 0
        part, size = [], 0

        def hashed():
            b = np.frombuffer(b"".join(x[3] for x in part), dtype=np.uint8)
            ends = np.cumsum([len(x[3]) for x in part])
            anchor, ctx, first, n = contexts(b, ends, length, hot.value if hot is not None else None)
            k = np.searchsorted(ends, first, side="right")
            doc, h, offset = (np.array([x[i] for x in part], dtype=np.int64) for i in range(3))
            return anchor, ctx, doc[k], h[k], first - np.append(0, ends[:-1])[k] + offset[k], n

        def deduped():
            anchor, ctx, doc, h, start, n = (np.concatenate(x) for x in zip(*held, strict=True))
            o = np.lexsort((start, h, doc, ctx, anchor))
            anchor, ctx, doc, h, start, n = (x[o] for x in (anchor, ctx, doc, h, start, n))
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (ctx[1:] != ctx[:-1]))
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = ~new & ((doc != doc[lead]) | (h != h[lead]) | (start != start[lead]))
            d, g, s, m = merge(doc[again], h[again], start[again], n[again])
            yield _rows(NAMES, [x[new] for x in (anchor, ctx, doc, h, start, n)])
            # Spans are dealt by place, not by anchor.
            yield _rows(NAMES, [mix((d ^ (s << 20)).view(np.uint64)).view(np.int64), np.zeros(len(d), np.int64), d, g, s, -m])

        for x in pieces(batches, length):
            part.append(x)
            size += len(x[3])
            if size >= CHUNK:
                held.append(hashed())
                many += len(held[-1][0])
                part, size = [], 0
                if many >= ROWS:
                    yield from deduped()
                    held, many = [], 0
        if part:
            held.append(hashed())
        if held:
            yield from deduped()

    return docs.mapInArrow(tidy(run), ROW)


def hot_anchors(docs: DataFrame, length: int) -> np.ndarray:
    """Sorted anchors that more than one in SHARE of the different contexts of a sample has: fewer than SHARE. They only decide the dealing."""
    most = max(1, docs.count() // SAMPLE)
    seen = scan_contexts(docs.where(F.pmod(F.xxhash64("doc", "h", F.lit("sample")), F.lit(most)) == 0), length).where("n > 0").groupBy("anchor").agg(F.count_distinct("ctx").alias("n"))
    seen = stored(seen.where("n > 2"), "anchors")
    total = seen.agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r.anchor for r in seen.where(F.col("n") * SHARE > max(total, SHARE)).toLocalIterator()], dtype=np.int64))


def first_contexts(rows: DataFrame) -> DataFrame:
    """Step 2 over the rows of step 1, dealt by anchor and sorted: kind 1 spans, kind 2 contexts that must be compared."""
    names = ["kind", "anchor", "doc", "h", "start", "n"]

    def run(batches):
        lead = None  # the last context's anchor, hash and first occurrence, and whether it waits for a second context
        for batch in batches:
            anchor, ctx, doc, h, start, n = (batch.column(x).to_numpy() for x in NAMES)
            span = n < 0
            yield _rows(names, [anchor[span], doc[span], h[span], start[span], -n[span]], 1)
            anchor, ctx, doc, h, start, n = (x[~span] for x in (anchor, ctx, doc, h, start, n))
            if lead is not None:
                anchor, ctx, doc, h, start, n = (np.append(np.int64(a), x) for a, x in zip(lead[:6], (anchor, ctx, doc, h, start, n), strict=True))
            if not len(anchor):
                continue
            other = np.append(True, anchor[1:] != anchor[:-1])
            new = other | np.append(True, ctx[1:] != ctx[:-1])
            at = np.flatnonzero(new)
            first = at[np.cumsum(new) - 1]
            again = ~new & ((doc != doc[first]) | (h != h[first]) | (start != start[first]))
            d, g, s, m = merge(doc[again], h[again], start[again], n[again])
            yield _rows(names, [np.zeros(len(d), np.int64), d, g, s, m], 1)
            # A context must be compared if another one of its anchor stands before or after it.
            before = ~other[at]
            after = np.append(before[1:], False)
            emit = before | after
            waits = not emit[-1]
            if lead is not None and lead[6]:  # emitted in an earlier batch
                emit[0] = False
                waits = waits and len(at) > 1
            keep = at[emit]
            yield _rows(names, [anchor[keep], doc[keep], h[keep], start[keep], n[keep]], 2)
            k = at[-1]
            lead = (anchor[k], ctx[k], doc[k], h[k], start[k], n[k], not waits)

    return rows.repartition("anchor").sortWithinPartitions("anchor", "ctx", "doc", "h", "start").mapInArrow(tidy(run), FOUND)


def shard_spans(rows: DataFrame, length: int) -> DataFrame:
    """Step 3 over (doc, h, start, n, bytes) of one shard a partition: the windows that start earlier elsewhere, as spans."""

    def run(batches):
        meta: list[tuple] = []

        def strings():
            for batch in batches:
                meta.append(tuple(batch.column(x).to_numpy() for x in ("doc", "h", "start", "n")))
                yield from batch.column("bytes").to_pylist()

        text = induced.mapped(strings())
        if not len(text):
            return
        doc, h, start, n = (np.concatenate(x) for x in zip(*meta, strict=True))
        begin = np.append(0, np.cumsum(n + length))[:-1]
        place = np.empty(len(doc), dtype=np.int64)
        o = np.lexsort((h, doc))
        place[o] = np.cumsum(np.append(0, (doc[o][1:] != doc[o][:-1]) | (h[o][1:] != h[o][:-1])))
        covered = np.zeros(len(text), dtype=bool)
        least: list = []  # the open group's first window: its order and its position in the text

        def windows(pos):
            k = np.searchsorted(begin, pos, side="right") - 1
            o = pos - begin[k]
            return o < n[k], place[k] << 32 | (start[k] + o)

        def settle(key, pos, joins):
            """Groups of windows, in a row; if joins[0], the first one goes on with the open group. The last one stays open."""
            begins = np.flatnonzero(~joins)
            if joins[0]:
                begins = np.append(0, begins)
            size = np.diff(np.append(begins, len(key)))
            low = np.minimum.reduceat(key, begins)
            if joins[0] and least:
                if least[0] < low[0]:
                    low[0] = least[0]
                else:
                    covered[least[1]] = True
            rest = key != np.repeat(low, size)
            covered[pos[rest]] = True
            end = slice(begins[-1], None)
            i = int(key[end].argmin())
            if key[end][i] == low[-1]:
                least[:] = [int(low[-1]), int(pos[end][i])]

        def sink(pos, lcp):
            same = lcp >= length
            # Only windows with an equal neighbour matter; the block's last one may have it in the next block.
            at = np.flatnonzero(same | np.append(same[1:], True))
            ok, key = windows(pos[at])
            at, key = at[ok], key[ok]
            if len(at):
                settle(key, pos[at], same[at])

        induced.Inducer(text, length).run(sink)
        p = np.flatnonzero(covered)
        if not len(p):
            return
        k = np.searchsorted(begin, p, side="right") - 1
        new = np.append(True, (p[1:] != p[:-1] + 1) | (k[1:] != k[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        k = k[first]
        yield _rows(["kind", "anchor", "doc", "h", "start", "n"], [np.zeros(len(k), np.int64), doc[k], h[k], start[k] + p[first] - begin[k], p[last] - p[first] + 1], 1)

    return rows.mapInArrow(tidy(run), FOUND)


def cut(raw: bytes, starts, numbers, length: int) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal runs removed."""
    out, at, removed, spans, end = [], 0, 0, 0, -1
    for s, n in sorted(zip(starts, numbers, strict=True)):
        e = s + n - 1 + length
        if s > end:
            out.append(raw[at:s])
            spans += 1
            removed += e - s
        elif e > end:
            removed += e - end
        end = at = max(end, e)
    out.append(raw[at:])
    return b"".join(out), removed, spans


@tidied
def dedup(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of every row of docs (doc_id, text)."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    tune(spark)
    docs = docs.select("doc_id", "text")
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    h = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), h.alias("h"), "text")
    hot = spark.sparkContext.broadcast(hot_anchors(keyed.select("doc", "h", "text"), length))
    found = stored(first_contexts(scan_contexts(keyed.select("doc", "h", "text"), length, hot)), "contexts")
    todo = found.where("kind = 2").select("anchor", "doc", "h", "start", "n")
    size = todo.agg(F.sum(F.col("n") + length)).first()[0] or 0
    spans = found.where("kind = 1").select("doc", "h", "start", "n")
    if size:
        texts = keyed.select("doc", "h", F.col("text").cast("binary").alias("raw"))
        texts = texts.dropDuplicates(["doc", "h"]) if repeated else texts
        own = todo.join(texts, ["doc", "h"]).select("anchor", "doc", "h", "start", "n", F.expr(f"substring(raw, int(start + 1), int(n + {length - 1}))").alias("bytes"))
        shards = own.repartition(-(-size // SHARD), "anchor").select("doc", "h", "start", "n", "bytes")
        spans = spans.unionByName(stored(shard_spans(shards, length), "spans").select("doc", "h", "start", "n"))
    lists = spans.groupBy("doc", "h").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("numbers"))
    joined = keyed.join(lists, ["doc", "h"], "left").select("doc_id", "text", "starts", "numbers")

    def apply(batches):
        for b in batches:
            raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in b.column("text").to_pylist()]
            rows = [cut(r, s or (), n or (), length) for r, s, n in zip(raws, b.column("starts").to_pylist(), b.column("numbers").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64()), pa.array([x[0] for x in rows], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(tidy(apply), OUT)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of `dedup`."""
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
