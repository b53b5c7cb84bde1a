"""Corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes what its predecessor kept. All but the last return the columns of documents.

Defined results: null and empty texts have no language and go in the first stage, as do all texts without letters (the
only ones it rejects: every other text has a likeliest language); very long texts are read whole; an empty table gives an
empty one; repeated rows are copies, of which near-dedup keeps those of the smallest doc_id; columns of documents beyond
those that stages use come through to the last one.

Rows that share a doc_id stay together in the near-dedup and the decontamination: they stay if one of
them is the document that its group keeps, and go if one of them is contaminated. A null doc_id is
an id of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlens.llm import bpe, decontam, langid, linededup, neardup
from screenlens.llm.common import Scratch, fresh, known_small, narrow, stored, tidied, tune

#: The stages' models (a language model, a lexicon) have no SQL form; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


#: Ids that are broadcast at most, of 8 bytes each.
FEW = 500_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't among ids (doc_id). Few ids are broadcast, so that texts need not be shuffled; more meet the documents by join."""
    name = fresh(docs.columns, "_id")
    ids, few = known_small(ids.select(F.col("doc_id").alias(name)).distinct(), FEW)
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(ids[name]), "left_anti")


@tidied
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without letters go."""
    tune(spark)
    predict = langid.predict_udf(spark.sparkContext.broadcast(langid.train(docs)))
    name = fresh(docs.columns, "_language")
    return docs.withColumn(name, predict("text")).where(F.col(f"{name}.lang_pred") != langid.UNKNOWN).select(*docs.columns)


@tidied
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share (but for the last holder's)."""
    return linededup.clean(linededup.dedup(spark, docs), docs.columns)


@tidied
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity 0.8), the document with the smallest doc_id."""
    found = stored(narrow(neardup.near_duplicates(spark, docs), docs.count()), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return without(docs, found.where(~stays).select("doc_id").subtract(found.where(stays).select("doc_id")))


@tidied
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontam.scan(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("contaminated"))


@tidied
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and digests of the ids and of the decoded text."""
    name = fresh(docs.columns, "_code")
    coded = docs.withColumn(name, bpe.udf_for(spark, docs)("text"))
    return coded.select("doc_id", "lang", "source", (F.octet_length(f"{name}.ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col(f"{name}.ids"), 256).alias("ids_sha256"), F.sha2(F.col(f"{name}.decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as whole:
        for name, stage in STAGES:
            before = list(whole.paths)
            with Scratch(spark) as one:
                docs = one.result(stored(stage(spark, docs, sf_dir), name))
            # Once a stage's result is written, its predecessor's goes.
            whole.drop(before)
        return whole.result(docs)
