"""Screens made of the driver's tables, for queries: width, height, text and raw lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_line(text: Column | str, x, y, width, height) -> Column:
    c = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct((text if isinstance(text, Column) else F.lit(text)).alias("text"), c(x).alias("x"), c(y).alias("y"), c(width).alias("width"), c(height).alias("height"))


def with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.array_join(F.transform("lines", lambda v: v["text"]), " "))


def title_of(html: Column) -> Column:
    return normalize(F.regexp_extract(html, "<title>([^<]*)</title>", 1), 80)


def browser_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One browser screen a page: id, width, height, lines, text."""
    lines = F.array(raw_line(F.col("url"), 160, 26, 540, 24), raw_line(title_of(F.col("html")), 460, 182, 220, 24), raw_line("Email", 420, 240, 80, 20), raw_line("Password", 420, 320, 110, 20), raw_line("Sign in", 490, 486, 90, 20))
    return with_text(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit(1280).alias("width"), F.lit(720).alias("height"), lines.alias("lines")))


def chat_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat screen a conversation."""
    t = normalize(F.col("text"), 40)
    wide = F.least(F.length(t) * 8, F.lit(500))
    y = 150 + 50 * F.col("turn")
    line = F.when(F.col("role") == "system", raw_line(t, 560, 38, 200, 24)).when(F.col("role") == "user", raw_line(t, 120, y, wide, 20)).otherwise(raw_line(t, 760, y, wide, 20))
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("v")))).alias("s"))
    lines = F.concat(F.transform("s", lambda s: s["v"]), F.array(raw_line("Type a message", 420, 660, 180, 20)))
    return with_text(said.select(F.col("conv_id").alias("id"), F.lit(1280).alias("width"), F.lit(720).alias("height"), lines.alias("lines")))


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, quarter, revenue) of orders; customers are few beside orders, and Spark sees whether they can be broadcast."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    period = F.year("o_orderdate") * 4 + F.quarter("o_orderdate")
    return joined.groupBy(F.col("c_mktsegment").alias("segment"), period.cast("int").alias("quarter")).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).cast("long").alias("revenue"))


def chart_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chart screen a market segment, 1280 x 800, with the segment's trend."""
    from ..operators.series import direction

    trend = direction(quarterly(spark, sf_dir).withColumn("y", -F.col("revenue")), ["segment"], "quarter", "y", 1.0)
    axes = [raw_line(t, 60, y, 40, 18) for t, y in zip(("80k", "60k", "40k", "20k"), (250, 360, 470, 580), strict=True)] + [raw_line(t, x, 660, 30, 18) for t, x in zip(("Q1", "Q2", "Q3", "Q4"), (260, 470, 680, 890), strict=True)]
    lines = F.array(raw_line(F.concat(F.lit("Revenue Dashboard "), F.col("segment")), 80, 70, 240, 24), *axes)
    visual = F.struct(F.lit(True).alias("chart_like"), F.lit("line").alias("kind"), F.col("trend"), F.lit(1).alias("series_count"), F.struct(F.lit(631).alias("width"), F.lit(341).alias("height")).alias("bbox"))
    return with_text(trend.select(F.col("segment").alias("id"), F.lit(1280).alias("width"), F.lit(800).alias("height"), lines.alias("lines"), visual.cast(schemas.CHART_VISUAL).alias("chart_visual")))


# drawn images

BLUE, GREEN, RED = (0x25, 0x63, 0xEB), (0x10, 0xB9, 0x81), (0xEF, 0x44, 0x44)


def blank(width: int = 1280, height: int = 800) -> np.ndarray:
    a = np.full((height, width, 3), 255, np.uint8)
    a[640:642, 180 : width - 180] = a[180:642, 180:182] = 0x9C
    return a


def bar_image(tops: list[int], colour=GREEN) -> np.ndarray:
    a = blank()
    for x, top in zip((220, 450, 680, 910), tops, strict=True):
        a[top:640, x : x + 90] = colour
    return a


def line_image(points: list[tuple[int, int]], colour=BLUE) -> np.ndarray:
    """A polyline six pixels wide, with dots."""
    a = blank()
    yy, xx = np.mgrid[: a.shape[0], : a.shape[1]]
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        t = np.clip(((xx - x0) * (x1 - x0) + (yy - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2), 0, 1)
        a[(xx - x0 - t * (x1 - x0)) ** 2 + (yy - y0 - t * (y1 - y0)) ** 2 <= 9] = colour
    for x, y in points:
        a[(xx - x) ** 2 + (yy - y) ** 2 <= 100] = colour
    return a


def drawn(spark: SparkSession) -> DataFrame:
    """(name, content): charts, a plain screen, a copy, and what is no image."""
    from ..sources.images import encode_png

    rising, falling = [(260, 560), (470, 430), (680, 300), (890, 220)], [(260, 250), (470, 310), (680, 420), (890, 560)]
    bars = encode_png(bar_image([500, 400, 300, 220]))
    rows = [("bar_up", bars), ("bar_up_copy", bars), ("bar_down", encode_png(bar_image([220, 300, 400, 500], RED))), ("line_up", encode_png(line_image(rising))), ("line_down", encode_png(line_image(falling))), ("plain", encode_png(blank(640, 360 + 300))), ("broken", b"no image"), ("empty", None)]
    return spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in rows], "name string, content binary")
