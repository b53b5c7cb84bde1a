import hashlib
import random

import numpy as np
import pytest

from screenlens.llm import induced, suffixdedup


def brute(rows, length):
    """rows (doc_id, text) in order of doc_id, each id once."""
    seen, out = set(), []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(rng, n):
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(10, 60))) for _ in range(6)]
    out = ["x" * 400, "ab" * 300, "x" * 99 + "y" + "x" * 150, "", None, "é" * 49, "\x00" * 250, passages[0], passages[0]]
    while len(out) < n:
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 5))]
        t = "\n".join(parts)
        if rng.random() < 0.3 and len(t) > 50:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice("zé") + t[k + 1 :]
        out.append(rng.choice([t, t, t[: len(t) // 2], t[rng.randrange(20) :]]))
    return out


@pytest.mark.parametrize("length,shard", [(100, 8_000_000), (100, 3000), (33, 3000)])
def test_query(spark, monkeypatch, length, shard):
    rng = random.Random(length + shard)
    table = list(enumerate(made(rng, 80)))
    df = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "'a' as anchor", "1 as doc", "2 as h").repartition(5)
    monkeypatch.setattr(suffixdedup, "SHARD", shard)
    got = sorted(tuple(r) for r in suffixdedup.digest(suffixdedup.dedup(spark, df, length)).collect())
    assert got == brute(table, length)


def test_small_blocks(monkeypatch):
    """Steps 1 and 3 with tiny chunks, run in this process."""
    import pyarrow as pa

    for name, value in (("CHUNK", 300), ("ROWS", 40)):
        monkeypatch.setattr(suffixdedup, name, value)
    monkeypatch.setattr(induced, "BLOCK", 50)
    rng = random.Random(5)
    table = list(enumerate(made(rng, 60)))

    class Frame:
        """Stands for a DataFrame: keeps batches, applies functions."""

        def __init__(self, batches):
            self.batches = batches

        def mapInArrow(self, f, schema):
            return Frame([b for b in f(iter(self.batches)) if b.num_rows])

        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *cols):
            t = pa.Table.from_batches(self.batches).sort_by([(c, "ascending") for c in cols])
            return Frame(t.to_batches(max_chunksize=7))

    docs = Frame([pa.RecordBatch.from_pydict({"doc": [d], "h": [0], "text": pa.array([t], pa.string())}) for d, t in table])
    found = pa.Table.from_batches(suffixdedup.first_contexts(suffixdedup.scan_contexts(docs, 100)).batches).to_pylist()
    raw = {d: (t or "").encode() for d, t in table}
    spans = {d: [] for d in raw}
    own = []
    for r in found:
        if r["kind"] == 1:
            spans[r["doc"]].append((r["start"], r["n"]))
        else:
            own.append(r | {"bytes": raw[r["doc"]][r["start"] : r["start"] + r["n"] + 99]})
    batches = [pa.RecordBatch.from_pylist([{k: r[k] for k in ("doc", "h", "start", "n", "bytes")}]) for r in own]
    for b in suffixdedup.shard_spans(Frame(batches), 100).batches:
        for r in b.to_pylist():
            spans[r["doc"]].append((r["start"], r["n"]))
    got = []
    for d, _ in table:
        kept, removed, n = suffixdedup.cut(raw[d], [x for x, _ in spans[d]], [x for _, x in spans[d]], 100)
        got.append((d, len(raw[d]), removed, n, hashlib.sha256(kept).hexdigest()))
    assert got == brute(table, 100)


def test_hard_tables(spark, docs):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffixdedup.dedup(spark, docs).collect()), key=repr)
    assert len(got) == docs.count()
    plain = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (4, None)}
    # The row without an id comes first; none of its strings is long enough to matter.
    want = [x[:4] for x in brute(sorted(plain.items()), 100)]
    assert [x for x in got if x[0] not in (4, None)] == sorted(want, key=repr)
    long = "abc " * 50 + "def"
    twice = spark.createDataFrame([(1, long), (1, long), (2, long), (None, long)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in suffixdedup.dedup(spark, twice).collect()) == [("1", 203), ("1", 203), ("2", 203), ("None", brute([(0, long)], 100)[0][2])]
    assert suffixdedup.dedup(spark, docs.limit(0)).count() == 0


def test_induced_order(monkeypatch):
    """All suffixes, from the last to the first, with their common prefixes."""
    rng = random.Random(1)
    for trial in range(150):
        k = rng.choice([1, 2, 3, 26])
        strings = [bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 8))]
        strings += strings[:2] if trial % 3 == 0 else []
        cap, limit = rng.choice([5, 20, 100, 200]), rng.choice([0, 100, 1 << 26])
        monkeypatch.setattr(induced, "BLOCK", rng.choice([3, 7, 1 << 20]))
        text, out = induced.mapped(strings), []
        induced.Inducer(text, cap, limit).run(lambda p, v, out=out: out.append((p.copy(), v.copy())))
        pos, lcp = (np.concatenate(x) for x in zip(*out, strict=True))
        raw = text.tobytes()
        assert sorted(pos.tolist()) == list(range(len(raw)))
        for a, b, v in zip(pos, pos[1:], lcp[1:], strict=False):
            x, y = raw[a : a + cap], raw[b : b + cap]
            n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert x >= y and v == n


def test_hot_anchors(spark, monkeypatch):
    """A phrase that stands in every document is split by what stands around it, and the result is the same."""
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    own = lambda n: " ".join(rng.choice(words) for _ in range(n))
    phrase, passage = "a phrase that stands in each and every document here", own(40)
    table = [(i, f"{own(30)} {phrase} {own(30)} {passage if i % 3 == 0 else phrase} {own(20)}") for i in range(120)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffixdedup, "SHARE", 64)
    hot = suffixdedup.hot_anchors(df.selectExpr("doc_id as doc", "0L as h", "text"), 100)
    assert 0 < len(hot) < 64
    got = sorted(tuple(r) for r in suffixdedup.digest(suffixdedup.dedup(spark, df)).collect())
    assert got == brute(table, 100)


def test_shard_larger_than_memory(monkeypatch):
    """A shard is sorted with memory for a fraction of its positions."""
    import tracemalloc

    rng = np.random.default_rng(3)
    words = [rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8).tobytes() for _ in range(3000)]
    parts = [b" ".join(words[k] for k in rng.zipf(1.2, 60) % 3000) for _ in range(4000)]
    parts += parts[:500]
    text = induced.mapped(parts)
    assert len(text) > 1_000_000
    monkeypatch.setattr(induced, "BLOCK", 1 << 12)
    seen = np.zeros(len(text), dtype=bool)
    last = {}
    bad = [0]

    def sink(pos, lcp):
        seen[pos] = True
        # Sorted from the last to the first, up to the depth.
        if "p" in last:
            pos, lcp = np.append(last["p"], pos), np.append(last["l"], lcp)
        a, b = pos[:-1], pos[1:]
        common = sorter.common(a, b)
        x, y = (np.where(p + common < len(text), text[np.minimum(p + common, len(text) - 1)].astype(int), -1) for p in (a, b))
        bad[0] += int(((common < 100) & (x < y)).sum())
        last["p"], last["l"] = pos[-1:], lcp[-1:]

    peak = {}
    for limit in (1 << 30, 1 << 17):
        sorter = induced.Inducer(text, 100, limit=limit)
        seen[:], bad[0] = False, 0
        last.clear()
        tracemalloc.start()
        sorter.run(sink)
        peak[limit] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert seen.all() and not bad[0]
    assert peak[1 << 17] < peak[1 << 30] / 3, peak
