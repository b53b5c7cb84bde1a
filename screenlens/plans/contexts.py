"""Prompt contexts and descriptions for tables of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compose
from .analysis import analyze

SHOWN = 4


def user_contexts(spark: SparkSession, images: DataFrame, by: list[str], pos: str, column: str = "content", question: str | None = None, **how) -> DataFrame:
    """by, context: one prompt context for each group of images (bytes or base64 text, in order of pos).

    Images are ranked and counted before they are analysed: only the first four of a group are.
    Blank ones are left out. A group without images has no row.
    """
    some = images.where(F.col(column).isNotNull() & (F.trim(column) != "" if dict(images.dtypes)[column] == "string" else F.length(column) > 0))
    group = Window.partitionBy(*by)
    ranked = some.withColumns({"_place": F.row_number().over(group.orderBy(pos)), "_total": F.count("*").over(group)}).where(F.col("_place") <= SHOWN)
    return compose.user_context(analyze(spark, ranked, column, **how), by, "_place", question, SHOWN, "_total")


def screen_descriptions(spark: SparkSession, images: DataFrame, column: str = "content", **how) -> DataFrame:
    """images with `description`: one sentence each."""
    r = analyze(spark, images, column, **how)
    return r.withColumn("description", compose.screen_description(F.col("record.caption"), F.col("record.summary"), F.col("record.ocr_text"))).drop("record")
