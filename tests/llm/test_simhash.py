import random

import numpy as np
import xxhash

from screenlens.llm import simhash


def brute_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=3):
    fp = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{fp[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_query(spark, docs):
    rng = random.Random(1)
    base = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 5) for _ in range(60)]
    near = [" ".join([*base[:k], "zz", *base[k + 1 :]]) for k in range(0, 60, 2)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate([" ".join(base).upper(), *near])], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").unionByName(more)
    rows = [(r.doc_id, r.text) for r in all_docs.collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.digest(simhash.near_duplicates(spark, all_docs)).collect()), key=repr)
    assert got == brute(rows)
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_links_of_large_shards(spark):
    """Shards over the split size, trees smaller than a shard, and chains of links."""
    rng = random.Random(2)
    values = {rng.getrandbits(64)}
    while len(values) < 400:
        v = rng.choice(sorted(values))
        values.add(v ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))) & (1 << 64) - 1)
    values |= {rng.getrandbits(20) for _ in range(200)}
    v = sorted(values)
    parent = list(range(len(v)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(v)):
        for j in range(i):
            if (v[i] ^ v[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    fps = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in v], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(fps, 3, split=20, tree=16)).collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in v]
    got, want = {}, {}
    for i, s in enumerate(signed):
        got.setdefault(found.get(s, s), set()).add(s)
        want.setdefault(root(i), set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_tree_finds_all():
    rng = np.random.default_rng(4)
    v = np.unique(rng.integers(0, 1 << 12, 500).astype(np.uint64))
    got = {(int(a), int(b)) for w, n in simhash.BKTree(v).search(v, 2) for a, b in zip(w, n, strict=True)}
    assert got == {(i, j) for i in range(len(v)) for j in range(len(v)) if int(v[i] ^ v[j]).bit_count() <= 2}
