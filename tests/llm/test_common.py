"""Shared helpers: sizes are known before tables are narrowed, hot keys stay where they are, and files are dealt."""

from pyspark.sql import functions as F

from screenlens.llm import common, linededup


def test_unknown_sizes_are_written_by_many_tasks(spark):
    ids = spark.range(3_000_000).repartition(8)
    table, small = common.known_small(ids, 1000)
    assert not small and len(table.inputFiles()) > 1 and table.count() == 3_000_000
    table, small = common.known_small(spark.range(500).repartition(8), 1000)
    assert small and table.rdd.getNumPartitions() == 1 and table.count() == 500


def test_hot_keys(spark, monkeypatch):
    """The same rows as a plain join, hot keys or not; null keys meet nothing."""
    monkeypatch.setattr(common, "SHARE", 10)
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40).alias("k"), "id")
    label = rows.where("k is not null and k < 30").groupBy("k").agg(F.count("*").alias("count"), F.max("id").alias("top"))
    got = common.by_key(rows, label, "k")
    assert sorted(map(tuple, got.select("k", "id", "top").collect())) == sorted(map(tuple, rows.join(label, "k").select("k", "id", "top").collect()))


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    """2000 documents of many lines make a run of many files, whatever their number."""
    monkeypatch.setattr(linededup, "BUCKET", 10_000)
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: F.concat(F.lit("a line of text that is long enough "), F.col("id").cast("string"), F.lit(" "), k.cast("string"))), "\n")
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(4)
    seen = []
    write = linededup.LineRuns._write

    def spy(self, run):
        name = write(self, run)
        seen.append((self.buckets, len(self.spark.table(name).inputFiles())))
        return name

    monkeypatch.setattr(linededup.LineRuns, "_write", spy)
    got = linededup.dedup(spark, docs)
    assert got.where("n_lines = 50 and n_dropped = 0").count() == 2000
    assert all(b == 10 for b, _ in seen) and seen[-1][1] == 10
