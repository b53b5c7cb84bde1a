"""Quality rules: text statistics and a learned decision list, with Spark SQL functions alone.

The statistics are Column expressions over arrays, evaluated in the JVM. The decision list comes
from sequential covering on labelled statistics: a rule grows by the threshold condition with the
most information gain on two thirds of the rows, is pruned back on the last third, and is kept if it
is precise enough there; the rows it covers go, and the next rule grows. The list is emitted as one
ordered conditional expression: the name of the first rule that holds, or null.

Learning uses at most about `max_rows` labelled rows, chosen by a hash of doc_id; the statistics and
the list are applied to all whole texts.

Defined results: a null text has no words and every count 0; unlabelled rows, and rows with a null
label, are not learned from; with nothing to learn the list is empty and keeps all; several labels of
a document are one by majority, and none if they tie; of rows that repeat a doc_id one is learned from; conditions of equal
gain go by the order of FEATURES, then by threshold; texts are read whole, whatever their length; an empty table gives an
empty one; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: What the learner may set thresholds on.
FEATURES = ("chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "capital_share", "digit_share", "mark_share", "words_per_line")
MAX_ROWS = 4000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_marks")


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return let(F.btrim(text, F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))


def repeated(w: Column) -> Column:
    """Words in 3-word windows that stand in w twice or more.

    Hashes tell the texts without such windows; for the others the windows themselves, with their
    places, are sorted, so that equal ones are neighbours.
    """
    at = lambda i: F.get(w, i)
    places = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    tail = 10

    def exact(s):
        keys = F.transform(s, lambda x: F.left(x, F.length(x) - F.lit(tail)))

        def found(k):
            same = lambda j: F.get(k, j) == F.get(k, j - 1)
            hit = F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda j: F.coalesce(same(j), F.lit(False)) | F.coalesce(same(j + 1), F.lit(False)))
            return F.sort_array(F.transform(hit, lambda j: F.right(F.get(s, j), F.lit(tail - 1)).cast("int")))

        # A window's words count up to the next window's start.
        return let(let(keys, found), lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda a, j: a + F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - F.get(p, j)), F.lit(3))))

    strings = F.sort_array(F.transform(places, lambda i: F.concat(at(i), F.lit(" "), at(i + 1), F.lit(" "), at(i + 2), F.lit("\t"), F.lpad(i.cast("string"), tail - 1, "0"))))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(F.when(some, let(strings, exact)).otherwise(F.lit(0).cast("long")))


def statistics(text: Column) -> Column:
    """struct of STATS (long)."""
    t = F.coalesce(text, F.lit(""))
    count = lambda c: F.regexp_count(t, F.lit(c))

    def of(w):
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        some = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))
        return let(
            some,
            lambda x: F.struct(
                *(
                    c.cast("long").alias(n)
                    for n, c in zip(STATS, (F.size(w), F.length(F.array_join(w, "")), count(r"[#*$%&|<>]"), x["dup"], repeated(w), x["n"], count("[A-Z]"), count("[0-9]"), count("[!?]")), strict=True)
                )
            ),
        )

    return let(words(t), of)


def features(s: str = "s") -> dict[str, Column]:
    """FEATURES from the statistics struct of that name; 0 for texts without words."""
    c = lambda n: F.col(f"{s}.{n}").cast("double")
    per = lambda a, b: F.round(F.coalesce(c(a) / F.when(c(b) > 0, c(b)), F.lit(0.0)), 6)
    pairs = (("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_capitals", "word_chars"), ("n_digits", "word_chars"), ("n_marks", "n_words"), ("n_words", "n_lines"))
    return {name: per(a, b) for name, (a, b) in zip(FEATURES, pairs, strict=True)}


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, row) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(f"f.{FEATURES[self.feature]}")
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:g}"


def covers(rule: list[Condition], row) -> bool:
    return all(c.holds(row) for c in rule)


def thresholds(values: list[float], most: int = 32) -> list[float]:
    """Middles between neighbouring quantiles that differ."""
    v = sorted(values)
    cut = sorted({v[len(v) * k // most] for k in range(most)} | {v[-1]}) if v else []
    return [round((a + b) / 2, 6) for a, b in zip(cut, cut[1:], strict=False)]


def grow(positive: list, negative: list, longest: int) -> list[Condition]:
    """Add the condition of most gain until no good row is covered."""
    rule: list[Condition] = []
    while negative and len(rule) < longest:
        p, n = len(positive), len(negative)
        before = math.log2(p / (p + n))
        best, gain = None, 0.0
        for f in range(len(FEATURES)):
            for t in thresholds([r[f] for r in positive + negative]):
                pa, na = sum(r[f] > t for r in positive), sum(r[f] > t for r in negative)
                for above, a, b in ((True, pa, na), (False, p - pa, n - na)):
                    if a and a * (math.log2(a / (a + b)) - before) > gain + 1e-12:
                        best, gain = Condition(f, above, t), a * (math.log2(a / (a + b)) - before)
        if best is None:
            break
        rule.append(best)
        positive, negative = ([r for r in x if best.holds(r)] for x in (positive, negative))
    return rule


def prune(rule: list[Condition], positive: list, negative: list) -> tuple[list[Condition], float, int]:
    """The beginning of the rule that is worth most on other rows; its precision there and the rows covered."""
    best, worth, found = rule, -2.0, (0.0, 0)
    for k in range(len(rule), 0, -1):
        p, n = (sum(covers(rule[:k], r) for r in x) for x in (positive, negative))
        v = (p - n) / (p + n) if p + n else -1.0
        if v >= worth:
            best, worth, found = rule[:k], v, (p / (p + n) if p + n else 0.0, p)
    return best, *found


def tightest(rule: list[Condition]) -> list[Condition]:
    """The rule without conditions that a later one of the same feature and direction implies."""
    out: dict[tuple[int, bool], Condition] = {}
    for c in rule:
        out[c.feature, c.above] = c
    return list(out.values())


def learn(rows: list[tuple[bool, tuple]], precision: float = 0.95, longest: int = 4, most: int = 16) -> list[list[Condition]]:
    """Ordered rules for the rows marked true; rows: (mark, features), in a fixed order."""
    rules: list[list[Condition]] = []
    positive, negative = ([r for m, r in rows if m is mark] for mark in (True, False))
    while len(rules) < most:
        if len(positive) < 3:
            break
        parts = [([r for k, r in enumerate(x) if k % 3 < 2], [r for k, r in enumerate(x) if k % 3 == 2]) for x in (positive, negative)]
        rule = grow(parts[0][0], parts[1][0], longest)
        if not rule:
            break
        rule, exact, caught = prune(rule, parts[0][1], parts[1][1])
        if exact < precision or not caught:
            break
        rules.append(tightest(rule))
        positive, negative = ([r for r in x if not covers(rule, r)] for x in (positive, negative))
    return rules


def expression(rules: list[list[Condition]]) -> Column:
    """Text of the first rule that holds for the struct `f`, else null."""
    out = F
    for rule in rules:
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        out = out.when(cond, F.lit(" and ".join(map(str, rule))))
    return F.lit(None).cast("string") if out is F else out


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id, s (statistics), f (features)."""
    s = docs.select("doc_id", statistics(F.col("text")).alias("s"))
    return s.select("doc_id", "s", F.struct(*(c.alias(n) for n, c in features().items())).alias("f"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[list[Condition]]:
    """Rules for bad documents (quality 0) from about `max_rows` labelled rows at most."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.when(F.col("quality") == 0, 0.0).otherwise(1.0)).alias("good")).where("good <> 0.5")
    n = marked.count()
    if not n:
        return []
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, max_rows / n) * (1 << 30))
    sample = F.broadcast(marked.where(drawn))
    texts = docs.select("doc_id", "text").join(sample.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    rows = with_features(texts).select("doc_id", "f").join(sample, "doc_id")
    found = sorted((shuffled(r.doc_id), r.doc_id, r.good < 0.5, tuple(r.f)) for r in rows.select("doc_id", "good", "f").toLocalIterator())
    return learn([(m, f) for _, _, m, f in found])


def shuffled(doc_id: int) -> int:
    """A fixed shuffle, so that growing and pruning rows are alike."""
    return (doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 20


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """doc_id, STATS, FEATURES, base_failed, kept, rule of every row of docs (doc_id, text)."""
    x = with_features(docs).select("doc_id", "s.*", "f", expression(rules).alias("rule"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return x.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).select("doc_id", *STATS, "f.*", "base_failed", "kept", "rule")
