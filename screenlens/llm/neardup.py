"""Near-duplicate documents: SimHash candidates from BK-trees, completed by prefixes of word shingle sets, each verified.

Documents are near-duplicates if their sets of five-word shingles have a Jaccard similarity of 0.8 or more,
and so are documents that a chain of such pairs joins. All such pairs are joined:

1. SimHash fingerprints of the shingles meet in `simhash.links` (BK-trees in shards). The links found, and texts of one
   fingerprint, are verified; that joins most copies. Copies of similarity 0.8 differ in ten bits on average, and in
   more than any radius that shards by bits can serve, so links by fingerprints alone would lose pairs.
2. Sets of that similarity share one of their first n - ceil(0.8 n) + 1 shingles in any common order. Here shingles that
   a sample finds frequent come last, the others in order of hash, so that few unrelated texts meet. Texts meet in
   cells, one for a shingle.
3. Each text has a parity bitmap of its set, four bits or more a shingle: two bitmaps differ in no more bits than the sets in
   shingles, so pairs too far apart go without loss. All other pairs of small cells are verified. A larger
   cell whose texts are all joined already is done. Of the others first a spanning forest between the parts is verified,
   the closest first, and then all pairs that verified links have not joined. A cell of many texts is compared by
   pairs of classes, so that no task holds a whole one.

The sample decides only the order, and the sizes at which cells are split only the dealing: the pairs found are the same.
Equal texts (up to case and white space) are one node from the start.

Defined results: texts without words are all alike; a text with fewer words than a shingle is one shingle; texts are
read whole, whatever their length; a null doc_id never names a component that has another id; each row gets its
line; an empty table gives none; ties in order go by hash; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, known_small, narrow, stored, tidied, tidy, tune
from .simhash import components, fold, links, named, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
NEEDED = 500_000
#: Texts in which frequent shingles are looked for, and how many of these shingles are told apart at most.
SAMPLE, FREQUENT = 10_000, 200_000
#: Texts of a class of a large cell; cells up to FEW have their pairs verified at once.
CLASS, FEW = 256, 8
#: Least bits of a bitmap; comparisons made at once.
BITS, STEP = 256, 500_000


def text_id(text: str | None) -> int:
    """Signed 64-bit hash of the text's words in lower case (A-Z)."""
    h = xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), 7)
    return h - (1 << 64) if h >> 63 else h


class Forest:
    """Links between places that join what they connect, without rings."""

    def __init__(self, n: int):
        self.parent, self.left = list(range(n)), n - 1

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Places of the links that join something new, the closest first."""
        out = []
        for k in np.argsort(d, kind="stable").tolist():
            if not self.left:
                break
            x, y = self.root(int(a[k])), self.root(int(b[k]))
            if x != y:
                self.parent[x] = y
                self.left -= 1
                out.append(k)
        return np.array(out, dtype=np.int64)


def shingle_sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(tid, shingles): sorted distinct hashes of the shingles of the texts that are needed (tid), each once."""
    spark = docs.sparkSession
    needed, few = known_small(needed.distinct(), NEEDED)
    some = spark.sparkContext.broadcast(np.sort(np.array([r.tid for r in needed.toLocalIterator()], dtype=np.int64))) if few else None

    def run(batches):
        for b in batches:
            ids, sets = [], []
            for t in b.column("text").to_pylist():
                tid = text_id(t)
                if some is not None:
                    k = np.searchsorted(some.value, tid)
                    if k == len(some.value) or some.value[k] != tid:
                        continue
                ids.append(tid)
                sets.append(np.unique(np.array(shingle_hashes(t, words), dtype=np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["tid", "shingles"])

    rows = docs.select("text").mapInArrow(tidy(run), "tid long, shingles binary")
    return (rows if few else rows.join(needed, "tid", "left_semi")).dropDuplicates(["tid"])


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) and not len(y):
        return 1.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose shingle sets are similar enough."""

    @F.arrow_udf("double")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([jaccard(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    one = sets.select(F.col("tid").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("tid").alias("b"), F.col("shingles").alias("sb"))
    both = edges.join(one, "a").join(two, "b").select("a", "b", similar.asNondeterministic()("sa", "sb").alias("j"))
    return both.where(F.col("j") >= similarity).select("a", "b")


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are frequent in a sample of docs (text), and how many texts have each by estimate."""
    rows = docs.count()
    most = max(1, rows // SAMPLE)

    def run(batches):
        seen = set()
        for b in batches:
            out = [np.zeros(0, np.uint64)]
            for t in b.column("text").to_pylist():
                if (tid := text_id(t)) not in seen:
                    seen.add(tid)
                    out.append(np.unique(np.array(shingle_hashes(t, words), dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["shingle"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(most)) == 0).select("text").mapInArrow(tidy(run), "shingle long")
    top = some.groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow()
    h, n = top.column("shingle").to_numpy().view(np.uint64), top.column("count").to_numpy() * most
    order = np.argsort(h)
    return h[order], n[order]


def first_shingles(h: np.ndarray, hot: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a text with the sorted shingles h, as many as decide: those that are not frequent, and then the least frequent of the others."""
    size = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
    at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
    known = hot[at] == h if len(hot) else np.zeros(len(h), bool)
    rare = h[~known][:size]
    common = h[known]
    last = np.lexsort((common, counts[at[known]]))[: size - len(rare)] if len(rare) < size else []
    return rare.view(np.int64), common[last].view(np.int64)


def bitmap(h: np.ndarray) -> bytes:
    """The parity of the number of shingles on each bit; a power of two of bits."""
    bits = max(BITS, 1 << (4 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) % 2 == 1).tobytes()


NODES = "doc_id long, tid long, n int, fp long, bits binary, rare array<long>, common array<long>"


def nodes(docs: DataFrame, hot, words: int, similarity: float) -> DataFrame:
    """NODES of every row of docs (doc_id, text): a task gives all but the first two for one of equal texts."""

    def run(batches):
        seen = set()
        for b in batches:
            ids, new, hashes = [], [], []
            for t in b.column("text").to_pylist():
                ids.append(text_id(t))
                new.append(ids[-1] not in seen)
                seen.add(ids[-1])
                hashes.append(np.array(shingle_hashes(t, words) if new[-1] else [], dtype=np.uint64))
            fps = np.concatenate([fold(hashes[k : k + 64]) for k in range(0, len(hashes), 64)]) if hashes else np.zeros(0, np.int64)
            sets = [np.unique(h) for h in hashes]
            firsts = [first_shingles(h, *hot.value, similarity) if len(h) else (h.view(np.int64),) * 2 for h in sets]
            old = ~np.array(new, dtype=bool)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[k]) for f in firsts)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in firsts)]))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(ids, pa.int64()), pa.array(np.array([len(h) for h in sets], np.int32), mask=old), pa.array(fps, mask=old), pa.array([bitmap(h) if len(h) else None for h in sets], pa.binary()), *lists],
                names=["doc_id", "tid", "n", "fp", "bits", "rare", "common"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), NODES)


def whole_cells(batches, least: int):
    """Columns of rows that are sorted by cell, in parts of `least` rows or more that end with a cell."""
    held, many = [], 0
    for b in batches:
        held.append(b)
        many += b.num_rows
        if many >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            cell = t.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut:
                yield t.slice(0, cut)
            held, many = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
            least = max(least, 2 * many)
    if many:
        yield pa.Table.from_batches(held)


def far(n, m, similarity: float):
    """The most shingles in which two sets of n and m can differ."""
    return (1 - similarity) / (1 + similarity) * (n + m) + 1e-6


def meetings(table: DataFrame, similarity: float) -> DataFrame:
    """(cell, a, b): pairs that meet in small cells (cell is null), and the texts a of each larger cell."""

    def run(batches):
        for t in whole_cells(batches, 100_000):
            cell, tid, n = (t.column(c).to_numpy() for c in ("cell", "tid", "n"))
            new = np.append(True, (cell[1:] != cell[:-1]) | (tid[1:] != tid[:-1]))
            cell, tid, n = cell[new], tid[new], n[new].astype(np.int64)
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            sizes = np.diff(np.append(starts, len(cell)))
            pairs = [np.zeros((0, 2), np.int64)]
            for size in range(2, FEW + 1):
                at = starts[sizes == size]
                for i in range(size if len(at) else 0):
                    for j in range(i):
                        ok = np.abs(n[at + i] - n[at + j]) <= far(n[at + i], n[at + j], similarity)
                        pairs.append(np.stack([tid[at + j][ok], tid[at + i][ok]], axis=1))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            large = np.repeat(sizes > FEW, sizes)
            k, m = len(pairs), int(large.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(np.zeros(k, np.int64), cell[large]), mask=np.arange(k + m) < k), pa.array(np.append(pairs[:, 0], tid[large])), pa.array(np.append(pairs[:, 1], np.zeros(m, np.int64)), mask=np.arange(k + m) >= k)],
                names=["cell", "a", "b"],
            )

    rows = table.select(F.explode("rare").alias("cell"), "tid", "n")
    return rows.repartition("cell").sortWithinPartitions("cell", "tid").mapInArrow(tidy(run), "cell long, a long, b long")


def together(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ; the longer one is folded."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose bitmaps (tid, n, bits) let them be similar."""

    @F.arrow_udf("int")
    def apart(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([together(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())

    one, two = (texts.select(F.col("tid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").where(F.abs(F.col("n_a") - F.col("n_b")) <= far(F.col("n_a"), F.col("n_b"), similarity))
    both = both.select("a", "b", "n_a", "n_b", apart.asNondeterministic()("bits_a", "bits_b").alias("d"))
    return both.where(F.col("d") <= far(F.col("n_a"), F.col("n_b"), similarity)).select("a", "b")


def close_pairs(n: np.ndarray, bits: list[bytes], part: np.ndarray, side: np.ndarray, similarity: float):
    """(a, b, bits that differ) of places whose parts differ and whose bitmaps let them be similar; in portions. Of two sides only pairs across are given."""
    side = side if (side != side[0]).any() else np.arange(len(side))
    size = np.array([len(x) for x in bits])
    for width in np.unique(size).tolist():
        at = np.flatnonzero(size == width)
        own = np.frombuffer(b"".join(bits[k] for k in at), np.uint64).reshape(len(at), -1)
        yield from _compare(n, part, side, at, own, at, own, similarity)
        # Similar sets differ by a quarter in size at most, and their bitmaps by one doubling.
        less = np.flatnonzero(size == width // 2)
        if len(less):
            half = own.shape[1] // 2
            yield from _compare(n, part, side, less, np.frombuffer(b"".join(bits[k] for k in less), np.uint64).reshape(len(less), -1), at, own[:, :half] ^ own[:, half:], similarity)


def _compare(n, part, side, x, mine, y, others, similarity: float):
    step = max(1, STEP // len(y))
    for s in range(0, len(x), step):
        i = x[s : s + step]
        d = np.zeros((len(i), len(y)), np.int32)
        for w in range(mine.shape[1]):
            d += np.bitwise_count(mine[s : s + step, w, None] ^ others[None, :, w])
        d = np.maximum(d, np.abs(n[i][:, None] - n[y]))
        ok = (d <= far(n[i][:, None], n[y], similarity)) & (part[i][:, None] != part[y]) & (side[i][:, None] != side[y])
        if x is y:
            ok &= y > i[:, None]
        a, b = np.nonzero(ok)
        yield i[a], y[b], d[a, b]


def crowd_pairs(crowds: DataFrame, similarity: float, spanning: bool) -> DataFrame:
    """(a, b): pairs of a cell of crowds (cell, tid, n, bits, part, side) whose parts differ and whose bitmaps let them be similar; or only a spanning forest of a cell's parts, the closest first."""

    def run(batches):
        for t in whole_cells(batches, 2_000):
            cell, tid, n, part, side = (t.column(c).to_numpy() for c in ("cell", "tid", "n", "part", "side"))
            n, bits = n.astype(np.int64), t.column("bits").to_pylist()
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            found = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
                parts, own = np.unique(part[s:e], return_inverse=True)
                if len(parts) == 1:
                    continue
                held = []
                for a, b, d in close_pairs(n[s:e], bits[s:e], own, side[s:e], similarity):
                    # What joins nothing new among these pairs joins nothing new among more of them.
                    k = Forest(len(parts)).add(own[a], own[b], d) if spanning else slice(None)
                    held.append((a[k], b[k], d[k]))
                if held:
                    a, b, d = (np.concatenate(x) for x in zip(*held, strict=True))
                    k = Forest(len(parts)).add(own[a], own[b], d) if spanning else slice(None)
                    found.append(np.stack([tid[s + a[k]], tid[s + b[k]]], axis=1))
                if sum(map(len, found)) > STEP:
                    yield pairs(found)
                    found = []
            yield pairs(found)

    def pairs(found):
        x = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return crowds.select("cell", "tid", "n", "bits", "part", "side").repartition("cell").sortWithinPartitions("cell", "tid").mapInArrow(tidy(run), "a long, b long").distinct()


def open_cells(crowds: DataFrame, texts: DataFrame, root: DataFrame) -> DataFrame:
    """(cell, tid, n, bits, part, side): the rows of crowds (cell, tid) in cells whose texts are not joined yet. Cells of over CLASS texts are dealt as pairs of classes (the sides)."""
    parts = root.select(F.col("node").alias("tid"), F.col("root").alias("part"))
    rows = stored(crowds.join(parts, "tid", "left").select("cell", "tid", F.coalesce("part", "tid").alias("part")), "parts")
    label = rows.groupBy("cell").agg(F.count("*").alias("count"), (F.min("part") < F.max("part")).alias("mixed"))
    k = F.ceil(F.col("count") / CLASS).cast("long")
    own = F.pmod(F.xxhash64("tid"), F.col("k"))
    dealt = by_key(rows, label, "cell").where("mixed").withColumn("k", k)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = dealt.select(F.xxhash64("cell", F.least(own, "other"), F.greatest(own, "other")).alias("cell"), "tid", "part", own.alias("side"))
    return dealt.join(texts.select("tid", "n", "bits"), "tid").select("cell", "tid", "n", "bits", "part", "side")


@tidied
def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id of every row of docs (doc_id, text)."""
    tune(spark)
    table = stored(nodes(docs, spark.sparkContext.broadcast(frequent(docs, words)), words, similarity), "shingles")
    rows = table.count()
    texts = table.groupBy("tid").agg(F.min("doc_id").alias("least"), F.count("*").alias("count"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("bits").alias("bits"))
    texts = stored(narrow(texts, rows), "texts")
    some = texts.where("n > 0").select("tid", "n", "bits")

    def similar(pairs: DataFrame) -> DataFrame:
        edges = stored(narrow(pairs), "candidates")
        if edges.isEmpty():
            return edges
        sets = shingle_sets(docs, edges.select(F.col("a").alias("tid")).unionByName(edges.select(F.col("b").alias("tid"))), words)
        return stored(narrow(verified(edges, stored(sets, "sets"), similarity)), "similar")

    heads = stored(texts.where("n > 0").groupBy("fp").agg(F.min("tid").alias("head"), F.count("*").alias("count")), "heads")
    same = by_key(texts.where("n > 0").select("tid", "fp"), heads, "fp").where("tid <> head").select(F.col("head").alias("a"), F.col("tid").alias("b"))
    head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    near = links(heads.select("fp")).join(head("a"), "a").join(head("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    edges = similar(alike(near.unionByName(same), some, similarity))
    root = stored(components(edges, nodes=rows), "parts")

    met = stored(meetings(table, similarity), "meetings")
    crowds = met.where("cell is not null").select("cell", F.col("a").alias("tid"))
    crowds = stored(crowds.unionByName(table.select(F.explode("common").alias("cell"), "tid")).distinct(), "crowds")
    few = alike(met.where("cell is null").select("a", "b").distinct(), some, similarity)
    for spanning in (True, False):
        more = crowd_pairs(open_cells(crowds, some, root), similarity, spanning)
        more = similar((few.unionByName(more) if spanning else more).distinct())
        if not more.isEmpty():
            edges = edges.unionByName(more)
            root = stored(components(edges, nodes=rows), "parts")
    linked = texts.select("tid", "least").join(root.withColumnRenamed("node", "tid"), "tid")
    label = texts.select("tid", "least", "count").join(named(linked, "tid"), "tid", "left").select("tid", "count", F.coalesce("component_id", "least").alias("component_id"))
    return by_key(table.select("doc_id", "tid"), label, "tid").select("doc_id", "component_id")
