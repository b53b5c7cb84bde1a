import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


TEXTS = [None, "", " ", "\n", "word", "a b c d e f g h i j k l " * 3, "x" * 30_000, "line that repeats over many documents\n" * 5, "Größe ß É İstanbul ΣΑΣ 中文 ２３ ½ é   \x1c <|endoftext|> it's", "<|startoftext|>", "the cat the cat the cat the cat"]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in any column, repeated rows and ids, extra columns with names that operators use themselves."""
    rows = [(i, t, None if i % 3 == 0 else "en", i) for i, t in enumerate(TEXTS)]
    rows += [(None, "line that repeats over many documents\nother", "en", None), (4, "word", "en", 1), (4, "word again", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids long").selectExpr("*", "'x' as spans", "'y' as p", "0 as n_words", "'z' as keys")
