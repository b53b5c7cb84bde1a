import random

from screenlens.llm import neardup
from screenlens.llm.simhash import fingerprints


def sets(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def brute(rows, similarity=0.8):
    """doc_id -> least doc_id of its component; rows (doc_id, text) with distinct ids."""
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(s[i] & s[j])
            if not s[i] and not s[j] or n and n / (len(s[i]) + len(s[j]) - n) >= similarity:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def made(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    out = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 50))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(rng.choice([" ", "\n"]).join(copy))
        if rng.random() < 0.3:
            out.append(" ".join(base).upper())
    out += ["one two", "One  TWO", "one three", "", None, " "]
    return list(enumerate(out))


def test_against_brute_force(spark):
    rows = made(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tid", "2 as fp", "3 as component_id").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, df).collect()}
    want = brute(rows)
    assert all(want[d] == want[c] for d, c in got.items())  # nothing wrong is joined
    pairs = [d for d in want if want[d] != d]
    assert sum(got[d] != d for d in pairs) >= 0.95 * len(pairs) > 20
    assert neardup.near_duplicates(spark, df.limit(0)).count() == 0


def test_hard_rows(spark, docs):
    got = neardup.near_duplicates(spark, docs).collect()
    assert len(got) == docs.count()
    found = {r.doc_id: r.component_id for r in got if r.doc_id not in (4, None)}
    assert found[0] == found[1] == found[2] == found[3] == 0


def test_large_needed_set(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NEEDED", 0)
    rows = made(4)[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert all(want[r.doc_id] == want[r.component_id] for r in neardup.near_duplicates(spark, df).collect())


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, df).collect()}


def prose(rng, words, n):
    return [rng.choice(words) for _ in range(n)]


def test_cut_and_extended_copies(spark):
    """Copies that lack their end or middle, or go on with other prose, are all found."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    texts = []
    for n in (30, 60, 100, 300, 1000, 2000):
        for share in (0.1, 0.13, 0.16, 0.19):
            base, k = prose(rng, words, n), int(n * share)
            texts += [base, base[: n - k], base + prose(rng, words, k)]
            base = prose(rng, words, n)
            texts += [base, base[: n // 2] + base[n // 2 + k :]]
    texts = [" ".join(t) for t in texts]
    want = brute(list(enumerate(texts)))
    assert sum(want[d] != d for d in want) > 50
    assert found(spark, texts) == want


def template(rng, words, n):
    """Texts of one template, 4 % of the words edited in each, some with a close twin."""
    base, out = prose(rng, words, 200), []
    for _ in range(n):
        t = [rng.choice(words) if rng.random() < 0.04 else w for w in base]
        out.append(" ".join(t))
        if rng.random() < 0.4:
            t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    return out


def test_template_with_twins(spark):
    """Candidates that fail verification hide no true pair."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    texts = template(rng, words, 300)
    want = brute(list(enumerate(texts)))
    assert sum(want[d] != d for d in want) > 80
    assert found(spark, texts) == want


def test_same_at_every_size(spark, monkeypatch):
    """Neither the number of texts nor the size of cells and classes decides what is found."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    texts = template(rng, words, 80)
    for n in range(60, 300, 6):
        base = prose(rng, words, n)
        texts += [" ".join(base), " ".join(base[: n - n * 17 // 100])]
    want = brute(list(enumerate(texts)))
    for few, texts_of_class in ((8, 512), (2, 512), (3, 20)):
        monkeypatch.setattr(neardup, "FEW", few, raising=False)
        monkeypatch.setattr(neardup, "CLASS", texts_of_class, raising=False)
        assert found(spark, texts) == want


def test_one_phrase_repeated(spark):
    """Texts whose fingerprints are equal for a repeated word, whatever else they hold."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    texts = []
    for _ in range(20):
        own = prose(rng, words, 90)
        texts += [" ".join(own + ["la"] * 150), " ".join(own[:-5] + ["la"] * 150)]
    assert len({int(x) for x in fingerprints(texts, neardup.WORDS)}) == 1
    want = brute(list(enumerate(texts)))
    assert sum(want[d] != d for d in want) == 20
    assert found(spark, texts) == want
