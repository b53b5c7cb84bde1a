"""Figures on the driver's tables (skipped where they are missing), and texts of great length."""

import collections
import os
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from screenlens.llm import bpe, decontam, html, langid, licenses, linededup, neardup, quality, secrets, simhash, suffixdedup

SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
tables = pytest.mark.skipif(not os.path.isdir(LARGE), reason="no tables")


class Article(HTMLParser):
    """A plain reading of pages whose main text is one article: its text between block tags."""

    BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li div table tr td blockquote pre section".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in self.BLOCKS:
            self.out.append("")
        elif tag == "br":
            self.out[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.out.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.out[-1] += data


def plain(page):
    a = Article()
    a.feed(page or "")
    a.close()
    return "\n".join(x for x in (" ".join(b.split()) for b in a.out) if x)


@tables
def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = html.extract_pages(spark, pages).collect()
    assert len(got) == len(want) > 100 and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)


@tables
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rules = quality.train(docs, labels.where(~held))
    got = quality.judge(docs.join(labels.where(held).select("doc_id"), "doc_id", "left_semi"), rules).join(labels, "doc_id").groupBy("quality", "kept", F.col("rule").isNotNull().alias("ruled"), "base_failed").count().collect()
    n = collections.Counter()
    for r in got:
        n["caught" if r.quality == 0 and not r.kept else "missed" if r.quality == 0 else "right"] += r["count"]
        n["ruled well" if r.quality == 0 else "ruled badly"] += r["count"] * (r.ruled and not r.base_failed)
    assert rules and n["caught"] >= 0.95 * (n["caught"] + n["missed"]) > 50
    assert n["ruled well"] >= 0.95 * (n["ruled well"] + n["ruled badly"]) > 50


@tables
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.where("lang is not null").select("doc_id", "lang").collect()}
    got = [(r.lang_pred, lang[r.doc_id], r.held_out) for r in langid.identify(spark, docs).collect() if r.doc_id in lang]
    held = [a == b for a, b, h in got if h]
    assert sum(held) >= 0.99 * len(held) > 1000


def test_long_texts(spark):
    """A text of 300,000 words in 30,000 lines, its copy, a variant, and one long word: all operators, whole."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(20_000)]
    lines = [" ".join(rng.choice(words) for _ in range(10)) for _ in range(30_000)]
    long, bench = "\n".join(lines), " ".join(lines[20_000].split())
    other = "\n".join(x if k % 400 else "entirely other words in this line of the text here" for k, x in enumerate(lines))
    texts = {1: long, 2: long, 3: other, 4: "x" * 2_000_000, 5: None}
    docs = spark.createDataFrame([(i, t, "en" if t else None) for i, t in texts.items()], "doc_id long, text string, lang string").repartition(3).cache()
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    assert all(r.n_assign == 0 for r in by_id(secrets.scan(spark, docs)).values())
    assert all(r.kind == "none" for r in by_id(licenses.scan(docs)).values())
    got = by_id(suffixdedup.dedup(spark, docs))
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans) == (0, len(long), 1) and got[3].n_removed > 0.8 * len(other) and got[4].n_removed == 2_000_000 - 1 and got[4].n_spans == 1
    got = by_id(simhash.near_duplicates(spark, docs))
    assert got[2].component_id == 1 and got[4].component_id == 4 and got[1].fp == got[2].fp
    got = by_id(neardup.near_duplicates(spark, docs))
    assert got[2].component_id == got[3].component_id == 1 and got[4].component_id == 4
    got = by_id(decontam.scan(spark, docs, spark.createDataFrame([(1, bench)], "item_id long, text string")))
    assert [got[i].n_words for i in texts] == [300_000, 300_000, len(other.split()), 1, 0] and got[1].n_hit == 10 and got[1].n_near == 1 and not got[4].contaminated
    got = by_id(quality.judge(docs, []))
    assert got[1].n_words == 300_000 and got[1].n_repeat_words == repeated(long.split()) and got[4].word_chars == 2_000_000
    assert {r.lang_pred for r in by_id(langid.predict(spark, docs, langid.train(docs))).values()} == {"en", "und"}
    got = by_id(linededup.digest(linededup.dedup(spark, docs)))
    assert got[1].n_lines == 30_000 and got[1].n_dropped == got[2].n_dropped == sum(x in set(lines[k] for k in range(30_000) if k % 400) for x in lines) and got[3].n_dropped == 0
    got = by_id(bpe.code(spark, docs))
    assert len(got[1].ids) == len(got[2].ids) > 4 * 300_000 and got[1].decoded == got[2].decoded


def repeated(w):
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    return len({k + d for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)})


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
