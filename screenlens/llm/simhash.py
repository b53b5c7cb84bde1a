"""SimHash near-dedup with BK-trees over shards of fingerprints.

A fingerprint has bit b set if over half of a text's shingle hashes have it. Equal fingerprints are
merged first. Two fingerprints that differ in at most `radius` bits agree on at least one of
radius + 1 blocks of bits, so each is sent to one shard for each block's value; a shard of more than
`split` fingerprints is cut again by the blocks of its remaining bits, which loses no link either.
A task sorts its shards and builds, for each, BK-trees of at most `tree` nodes: a node's children
are keyed by their Hamming distance to it, and a search follows only the edges within the radius of
the distance measured. Trees are searched where they are built: their number grows with the corpus,
so to broadcast them would have no bound. A task emits no more links than join a shard's parts
(a spanning forest), never all pairs; components are then found by alternating star contractions.

Defined results: a text without words (null, empty) has fingerprint zero, linked like any other; one
with fewer words than a shingle counts as a single shingle; a null doc_id never names a component
that has another id; repeated rows each get their line; texts are read whole, whatever their length; a bit that half of the
hashes have is not set; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, narrow, ranges, stored, tidied, tidy, tune

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Hashes whose bits are counted at once.
STEP = 200_000
#: Edges that a task contracts at once.
CONTRACT = 1_000_000


def shingle_hashes(text: str | None, width: int = SHINGLE) -> list[int]:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    if len(w) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    flat = b" ".join(w)
    hashed, out, start, end = xxhash.xxh64_intdigest, [], 0, sum(map(len, w[:width])) + width - 1
    for first, new in zip(w, w[width:], strict=False):
        out.append(hashed(flat[start:end], SEED))
        start += len(first) + 1
        end += len(new) + 1
    out.append(hashed(flat[start:end], SEED))
    return out


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """Signed 64-bit fingerprints of lists of shingle hashes."""
    ones, n, part, owner = np.zeros((len(hashes), 64), dtype=np.int64), np.array([len(h) for h in hashes], dtype=np.int64), [], []
    size = 0

    def count():
        h = np.concatenate(part)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = 0
        for i, p in zip(owner, part, strict=True):
            ones[i] += bits[at : at + len(p)].sum(0, dtype=np.int32)
            at += len(p)

    for i, h in enumerate(hashes):
        for k in range(0, len(h), STEP):
            part.append(h[k : k + STEP])
            owner.append(i)
            size += len(part[-1])
            if size >= STEP:
                count()
                part, owner, size = [], [], 0
    if part:
        count()
    return np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view("<i8").reshape(-1)


def fingerprints(texts: list[str | None], width: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprints."""
    return np.concatenate([np.zeros(0, np.int64), *(fold([np.array(shingle_hashes(t, width), dtype="<u8") for t in texts[k : k + 64]]) for k in range(0, len(texts), 64))])


def fingerprint_table(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(b.column("text").to_pylist(), width), pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, fp long")


class BKTree:
    """Nodes in the order of their numbers; a node's children are keyed by their distance to it."""

    def __init__(self, values: np.ndarray):
        self.values = values.view(np.uint64) if values.dtype == np.int64 else values
        n = len(values)
        self.children: list[dict[int, int]] = [{} for _ in range(n)]
        todo = [np.arange(n)] if n else []
        while todo:
            group = todo.pop()
            if len(group) == 1:
                continue
            root = int(group[0])
            rest = group[1:]
            d = np.bitwise_count(self.values[rest] ^ self.values[root])
            order = np.argsort(d, kind="stable")
            cut = np.flatnonzero(np.diff(d[order])) + 1
            for same in np.split(order, cut):
                self.children[root][int(d[same[0]])] = int(rest[same[0]])
                todo.append(rest[same])
        self.first = np.cumsum([0, *map(len, self.children)])
        self.edge = np.array([d for c in self.children for d in c], dtype=np.int16)
        self.child = np.array([x for c in self.children for x in c.values()], dtype=np.int64)

    def search(self, queries: np.ndarray, radius: int):
        """(query, node) arrays of all pairs within the radius, level by level; at most about a million pairs are held at once."""
        q = queries.view(np.uint64) if queries.dtype == np.int64 else queries
        if not len(self.values):
            return
        for k in range(0, len(q), max(1, 1_000_000 // len(self.values))):
            who = np.arange(k, min(len(q), k + max(1, 1_000_000 // len(self.values))))
            node = np.zeros(len(who), dtype=np.int64)
            while len(who):
                d = np.bitwise_count(q[who] ^ self.values[node]).astype(np.int16)
                hit = d <= radius
                if hit.any():
                    yield who[hit], node[hit]
                n = self.first[node + 1] - self.first[node]
                e = ranges(self.first[node], n)
                who, d = np.repeat(who, n), np.repeat(d, n)
                near = np.abs(self.edge[e] - d) <= radius
                who, node = who[near], self.child[e[near]]


def forest(values: np.ndarray, radius: int, tree: int) -> list[tuple[int, int]]:
    """Links between places of `values` that join what lies within the radius; none that closes a ring."""
    n = len(values)
    if n == 2:
        return [(0, 1)] if ((int(values[0]) ^ int(values[1])) & (1 << 64) - 1).bit_count() <= radius else []
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for k in range(0, n, tree):
        t = BKTree(values[k : k + tree])
        for who, node in t.search(values[k:], radius):
            for a, b in zip((who[who > node] + k).tolist(), (node[who > node] + k).tolist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[x] = y
                    links.append((a, b))
    return links


def shard_links(shards: DataFrame, radius: int, tree: int) -> DataFrame:
    """(a, b) from rows (shard, fp) that are dealt and sorted by shard."""

    def run(batches):
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(key, fp):
            cut = np.flatnonzero(np.diff(key)) + 1
            ends = np.append(cut, len(key))
            starts = np.append(0, cut)
            a, b = [], []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                part = fp[s:e]
                for x, y in forest(part, radius, tree):
                    a.append(part[x])
                    b.append(part[y])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column("shard").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy()])
            if len(key) and key[0] != key[-1]:  # the last shard may go on in the next batch
                last = int(np.flatnonzero(key != key[-1])[-1]) + 1
                yield links(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield links(key, fp)

    return shards.mapInArrow(tidy(run), "a long, b long")


def blocks(bits: list[int], parts: int) -> list[list[int]]:
    """Runs of the bit places, of as equal length as possible."""
    cut = [len(bits) * k // parts for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def masked(block: list[int]):
    """The fingerprint with the bits of a block alone."""
    m = sum(1 << b for b in block)
    return F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))


def links(fps: DataFrame, radius: int = RADIUS, split: int = 512, tree: int = 4096) -> DataFrame:
    """(a, b): links between the distinct fingerprints of fps (fp) that join all within the radius."""
    cuts = blocks(list(range(64)), radius + 1)
    first = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), masked(c).alias("v")) for k, c in enumerate(cuts)))).alias("s")).select("fp", "s.k", "s.v")
    # At most (radius + 1) * 2^(64 / (radius + 1)) shards can be: that bounds the list of large ones.
    large = first.groupBy("k", "v").count().where(F.col("count") > split).select("k", "v", F.lit(True).alias("large"))
    first = first.join(large, ["k", "v"], "left")
    again = F
    for k, c in enumerate(cuts):
        rest = blocks([b for b in range(64) if b not in c], radius + 1)
        again = again.when(F.col("k") == k, F.array(*(F.struct(F.lit(j).alias("j"), masked(d).alias("w")) for j, d in enumerate(rest, 1))))
    whole = F.array(F.struct(F.lit(0).alias("j"), F.lit(0).cast("long").alias("w")))
    rows = first.select("fp", "k", "v", F.explode(F.when(F.col("large"), again).otherwise(whole)).alias("t")).select("fp", F.xxhash64("k", "v", "t.j", "t.w").alias("shard"))
    # Shards whose hashes collide are merely searched together. They are few bytes and much work: as many tasks as a shuffle has.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shard_links(rows.repartition(tasks, "shard").sortWithinPartitions("shard", "fp"), radius, tree).distinct()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of the edges (a, b), but for the least of a component, to that least node."""
    node, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(node))
    while True:
        m = np.minimum(least[x], least[y])
        new = least.copy()
        for at in (x, y, least[x], least[y]):
            np.minimum.at(new, at, m)
        new = new[new]
        if (new == least).all():
            break
        least = new
    other = least != np.arange(len(node))
    return node[other], node[least[other]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that join the same, fewer of them: each task turns portions of CONTRACT edges into stars."""

    def run(batches):
        held, many = [], 0

        def out():
            a, b = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("a", "b")))
            many += batch.num_rows
            if many >= CONTRACT:
                yield out()
                held, many = [], 0
        if many:
            yield out()

    return edges.mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame, rounds: int = 60, nodes: int | None = None) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches. nodes: how many there are at most.

    Edges that lie in one task become stars there. Large-star and small-star contraction follow in turn; each round is
    written to the shared folder. The rounds grow with the logarithm of a component's size.
    """
    e = narrow(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), nodes)
    e = stored(narrow(contracted(e).distinct(), nodes), "edges")
    mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = stored(narrow(small, nodes), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def named(linked: DataFrame, key: str) -> DataFrame:
    """(key, component_id) of rows (key, root, least): the least of the rows with that root, however many they are."""
    label = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("count"))
    return by_key(linked.select(key, "root"), label, "root").select(key, "component_id")


@tidied
def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text)."""
    tune(spark)
    table = stored(fingerprint_table(docs, width), "fingerprints")
    fps = stored(narrow(table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("count")), table.count()), "distinct")
    root = components(links(fps.select("fp"), radius), nodes=fps.count())
    label = fps.join(named(fps.join(root.withColumnRenamed("node", "fp"), "fp"), "fp"), "fp", "left").select("fp", "count", F.coalesce("component_id", "least").alias("component_id"))
    return by_key(table, label, "fp").select("doc_id", "fp", "component_id")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of `near_duplicates`."""
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
