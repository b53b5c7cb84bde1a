"""Text functions against plain Python on texts of many scripts."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from screenlens.functions import lexicon, repair
from screenlens.functions import text as t

WORDS = ["Settings", "Q1", "q4", "+18%", "3.5 k", "80k", "2024", "12", "7", "https://a.b/c", "www.x", "Page", "menu", "Login", "login", "密码", "网络", "É", "naïve", "a-b-c", "...", "\\srv\\x.y", "1.2.3", "Wi-Fi", "�", "ß", "İ", "12345", "-5 %", "v2", "http//x", "10.0.0.1"]
GAPS = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", ""]


def made(n=300):
    rng = random.Random(11)
    out = ["", " ", None, "x" * 2000, "word " * 500, " " * 3000 + "late", "a" + " " * 3000 + "b" * 2000, "ab \n " * 900]
    while len(out) < n:
        out.append("".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.choice([1, 3, 10, 60, 300]))))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(made())), "id int, v string").repartition(3).cache()


def check(table, column, want, skip=()):
    got = {r.id: r.c for r in table.select("id", column.alias("c")).collect()}
    for i, v in enumerate(made()):
        assert got[i] == want(v), (v, got[i])


def flat(v, limit=900):
    s = re.sub(r"\s+", " ", v or "").strip()
    return s if len(s) <= limit else s[: limit - 3].rstrip() + "..."


def unique(values):
    out = {}
    for v in values:
        if v:
            out.setdefault(v.lower(), v)
    return list(out.values())


def test_normalize(table):
    for n in (80, 900):
        check(table, t.normalize(F.col("v"), n), lambda v, n=n: flat(v, n))


def test_labels_and_markers(table):
    word = re.compile("[A-Za-z][A-Za-z0-9-]{2,}")
    check(table, t.readable_labels(F.col("v")), lambda v: unique(w for w in word.findall(flat(v, 1200)) if w.lower() not in lexicon.STOP_LABELS)[:6])
    kinds = (r"\bQ[1-4]\b", r"[+-]?\d+(?:\.\d+)?\s*%", r"\d+(?:\.\d+)?\s*[kmg]\b", r"\b\d{2,4}\b")
    check(table, t.numeric_markers(F.col("v")), lambda v: unique(m.strip() for k in kinds for m in re.findall(k, flat(v, 1200), re.I))[:8])


def test_scores(table):
    def url(v):
        s = flat(v, 240).lower()
        return any(x in s for x in lexicon.URL_TOKENS) or "." in s and ("/" in s or "\\" in s) or s.count(".") >= 2 and " " not in s

    n = lambda p, s: len(re.findall(p, s))

    def quality(v):
        s = flat(v, 240)
        if not s:
            return -1000
        latin, cjk, digits = n("[A-Za-z]", s), n("[一-鿿]", s), n(r"\d", s)
        return len(s) + 4 * (latin + cjk) + 2 * digits - 6 * n(r"[^A-Za-z0-9\s:/._%+\-()一-鿿]", s) + 18 * url(v) - 20 * (latin + cjk <= 1 and digits <= 1)

    check(table, t.url_like(F.col("v")), url)
    check(table, t.line_quality(F.col("v")), quality)
    check(table, t.signal_score(F.col("v")), lambda v: len(flat(v, 1600)) + 9 * n("[A-Za-z][A-Za-z0-9-]{2,}", flat(v, 1600)) + 4 * n("[一-鿿]", flat(v, 1600)) + 2 * n(r"\d", flat(v, 1600)))
    check(table, t.stabilize(F.col("v")), lambda v: re.sub("^(https?)//", r"\1://", flat(v, 240).replace("\\", "/"), flags=re.I))
    check(table, t.signature(F.col("v")), lambda v: repair.sign(v or ""))


def test_lists(spark):
    cases = [([], ""), (["a"], "a"), (["a", " ", "b"], "a and b"), (["a", "b", "c", "d"], "a, b, c, and d"), (None, ""), (["x", None], "x")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "id int, a array<string>")
    assert [r.c for r in df.select("id", t.human_list(F.col("a")).alias("c")).orderBy("id").collect()] == [w for _, w in cases]
    df = spark.createDataFrame([(["A ", "a", "", "b\n b", "B b", None],)], "a array<string>")
    assert df.select(t.dedupe(F.col("a")).alias("c")).first().c == ["A", "b b"]


def test_repair():
    for v, url, want in (("ExampIe l-ogln", False, "Example Login"), ("Type a mesage", False, "Type a message"), ("https//example.com/logln", True, "https://example.com/login"), ("密码 / Password", False, "密码 / Password"), ("输入消息 / Reply", False, "输入消息 / Reply"), ("示例 Login", False, "示例 Login"), ("Log in", False, "Login"), ("", False, ""), ("http:/a.b/x", True, "http://a.b/x"), ("y" * 90, False, "y" * 90)):
        assert repair.repair(v, url) == want
    for v in ("Setings", "Emial", "Usrname", "Dash board", "zzzz", "Messagez"):
        s = repair.sign(v)
        best = max(((difflib.SequenceMatcher(None, s, o).ratio(), -k, c) for k, (c, o) in enumerate(repair.known()) if abs(len(s) - len(o)) <= max(2, len(o) // 3)), default=(0, 0, ""))
        enough = 0.84 if len(s) >= 10 else 0.88 if len(s) >= 7 else 0.9 if len(s) >= 5 else 0.96
        assert repair.common_label(v) == (best[2] if best[0] >= enough else "")
