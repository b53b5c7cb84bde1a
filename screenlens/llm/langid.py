"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters with single spaces for everything else; all 1-, 2- and 3-grams
are hashed into BUCKETS counters. The log-probability matrix (BUCKETS x languages, a fixed number
of bytes a language) is broadcast; numpy gathers its rows for all n-grams of a batch and sums them
by text. Only training uses a sample: at most about `max_docs` texts of each language, chosen by a
hash of doc_id; prediction reads every whole text.

Defined results: a text that is null, empty or without letters gets `und` and score 0, as does
every text if nothing can be learned; rows with null text or lang are not learned from; a null
doc_id counts as the empty string; ties go to the language that sorts first; repeated rows are
predicted alike; very long texts are predicted whole, some at a time; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, known_small, release, tidy, tune

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Code points that one numpy step handles.
STEP = 150_000
#: Expected number of training texts of a language, at most.
MAX_DOCS = 2500
UNKNOWN = "und"
SCHEMA = "lang_pred string, score double"


@functools.lru_cache(1)
def tables() -> np.ndarray:
    """For each code point: itself in lower case if it is a letter, else a space."""
    low = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalpha():
            t = s.lower()
            low[c] = ord(t) if len(t) == 1 else c
    return low


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the number of the text of each, and each text's number of letters."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    low = tables()[raw]
    letter = low != 32
    letters = np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    low, owner = low[keep].astype(np.uint64), owner[keep]
    found, of = [], []
    h = np.zeros(len(low), dtype=np.uint64)
    for n in ORDERS:
        m = len(low) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x9E3779B97F4A7C15)) + (low[n - 1 :] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        inside = owner[:m] == owner[n - 1 :]
        found.append((((h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48)) % np.uint64(BUCKETS))[inside].astype(np.int64))
        of.append(owner[:m][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    return np.concatenate(found), np.concatenate(of), letters


def steps(texts: list[str | None], limit: int = STEP):
    """Consecutive texts, about `limit` code points at a time; (first index, texts)."""
    first, size, part = 0, 0, []
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= limit:
            yield first, part
            first, size, part = i + 1, 0, []
    if part:
        yield first, part


@dataclass
class Model:
    """langs in sorted order; logp: BUCKETS x langs; prior: log share of each."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, score
        for first, part in steps(texts):
            feature, owner, letters = grams(part)
            total = np.empty((len(part), len(self.langs)))
            for j in range(len(self.langs)):
                total[:, j] = self.prior[j] + np.bincount(owner, weights=self.logp[j][feature], minlength=len(part))
            best = total.argmax(1)
            p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for i in np.flatnonzero(letters):
                langs[first + i], score[first + i] = self.langs[best[i]], p[i]
        return langs, score


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(lang, n texts, counts as bytes) of each task's rows (lang, text)."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for first, part in steps(b.column("text").to_pylist()):
                feature, owner, letters = grams(part)
                names = langs[first : first + len(part)]
                for lang in set(names):
                    mine = np.fromiter((x == lang for x in names), bool, len(names))
                    total[lang] = total.get(lang, 0) + np.bincount(feature[mine[owner]], minlength=BUCKETS)
                    number[lang] = number.get(lang, 0) + int((letters[mine] > 0).sum())
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([number[k] for k in keys], pa.int64()), pa.array([total[k].astype(np.int32).tobytes() for k in keys], pa.binary())], names=["lang", "n", "counts"])

    return docs.mapInArrow(tidy(count), "lang string, n long, counts binary")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, max_docs: int = MAX_DOCS, tasks: int = 6) -> Model:
    """Learn from rows (doc_id, text, lang) with neither text nor lang null, about `max_docs` of each language."""
    tune(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    share, small = known_small(rows.groupBy("lang").agg((F.lit(float(max_docs)) / F.count("*")).alias("share")), 10_000)
    share = F.broadcast(share) if small else share
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(share, "lang").where(drawn < F.col("share")).select("lang", "text").repartition(tasks)
    total: dict[str, np.ndarray] = {}
    number: dict[str, int] = {}
    for r in bucket_counts(sample).toLocalIterator():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.counts, dtype=np.int32).astype(np.float64)
        number[r.lang] = number.get(r.lang, 0) + r.n
    langs = sorted(k for k, n in number.items() if n)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    counts = np.stack([total[k] for k in langs]) + 0.5
    n = np.array([number[k] for k in langs], dtype=float)
    return Model(langs, np.log(counts / counts.sum(1, keepdims=True)), np.log(n / n.sum()))


def predict_udf(model: Broadcast):
    """Arrow UDF: text to struct<lang_pred, score>."""

    @F.arrow_udf(SCHEMA)
    def predict(text: pa.Array) -> pa.Array:
        forget()
        langs, score = model.value.predict(text.to_pylist())
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict.asNondeterministic()


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    tune(spark)
    udf = predict_udf(spark.sparkContext.broadcast(model))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), udf("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def identify(spark: SparkSession, docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Learn from the rows that are not held out, then predict all."""
    return predict(spark, docs, train(docs.where(~held_out(F.col("doc_id"))), max_docs))
