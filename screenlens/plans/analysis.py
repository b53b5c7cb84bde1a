"""The analysis of a table of images or of screens with lines already read.

Equal images are analysed once: the analysis runs on one row a digest and is joined back. Expensive
providers work only on the rows that need them: a condition around a Python function would not keep rows
away from it, but null bytes do, and they cost no transfer, no second evaluation and no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..conf import Settings
from ..functions.arrow import settled
from ..functions.repair import repair_layout
from ..functions.text import normalize, signal_score
from ..operators import compose
from ..operators.layout import chart_text, layout
from ..operators.lines import merge_lines, normalize_lines
from ..operators.scene import caption_prompt, scene, should_caption, should_retry, with_layout
from ..sources import captions, ocr
from ..sources.images import base64_bytes, inspect, retry_png

UNREADABLE = "Unable to decode the uploaded image."


def compose_records(screens: DataFrame) -> DataFrame:
    """screens (ok, width, height, text, lines, backend, chart_visual, caption, digest, ...) with `record` added.

    Everything here is Column expressions but for one Python call a row, which repairs the layout's labels.
    """
    c = F.col
    w, h, text, caption = c("width"), c("height"), F.coalesce(c("text"), F.lit("")), F.coalesce(c("caption"), F.lit(""))
    like = F.coalesce(c("chart_visual.chart_like"), F.lit(False))
    df = screens.withColumn("_read", settled(layout(c("lines"), w, h, text))).withColumn("_layout", repair_layout("_read"))
    df = df.withColumn("_pre", scene(text, w, h, like))
    df = df.withColumn("_scene", with_layout(F.when(caption == "", c("_pre")).otherwise(scene(text, w, h, like, caption)), c("_layout.kind")))
    df = df.withColumn("_chart", F.when((c("_pre") == "chart") | (c("_scene") == "chart"), chart_text(c("lines"), w, h)))
    good = F.struct(
        F.lit(True).alias("ok"),
        caption.alias("caption"),
        text.alias("ocr_text"),
        compose.visible_text(c("_scene"), c("_layout"), c("_chart"), text).alias("visible_text"),
        compose.summary(c("_scene"), text, w, h, c("_layout"), c("_chart"), c("chart_visual"), caption).alias("summary"),
        c("_scene").alias("scene"),
        c("chart_visual").alias("chart_visual"),
        c("_chart").alias("chart_text"),
        c("_layout").alias("layout"),
        F.coalesce(c("digest"), F.lit("")).alias("digest"),
        F.concat_ws("x", w, h).alias("size"),
        F.coalesce(c("backend"), F.lit("")).alias("ocr_backend"),
        F.lit(False).alias("caption_pending"),
    )
    # Settled: a plan that takes fields of the record must not repeat the expressions behind them.
    return df.withColumn("record", settled(F.when(c("ok"), good).otherwise(failure(UNREADABLE)))).drop("_read", "_layout", "_pre", "_scene", "_chart")


def failure(summary: str):
    """The record of an image that could not be analysed: all fields, empty."""
    kinds = {"chart_visual": schemas.CHART_VISUAL, "chart_text": schemas.CHART_TEXT, "layout": schemas.LAYOUT}
    flags = {"ok", "caption_pending"}
    return F.struct(*((F.lit(False) if f in flags else F.lit(None).cast(kinds[f]) if f in kinds else F.lit(summary if f == "summary" else "")).alias(f) for f in schemas.RECORD))


def read_twice(images: DataFrame, provider: ocr.Provider) -> DataFrame:
    """images (key, content, width, height) with text, lines, backend, retried.

    The second reading gets only images whose first one is poor; its lines are merged in, its text
    replaces the first one if it says more.
    """
    c = F.col
    one = provider(images, "content", False, "_ocr").withColumns(
        {"text": normalize(c("_ocr.text"), 1600), "lines": normalize_lines(c("_ocr.lines"), c("width"), c("height")), "backend": F.coalesce("_ocr.backend", F.lit(""))}
    )
    one = one.withColumn("retried", settled(c("content").isNotNull() & should_retry(c("text"), c("width"), c("height"))))
    poor = one.withColumn("_poor", F.when(c("retried"), c("content"))).withColumn("_png", retry_png("_poor"))
    both = provider(poor, "_png", True, "_again")
    s = F.least(F.lit(2.0), F.lit(2560.0) / F.greatest("width", F.lit(1)), F.lit(1920.0) / F.greatest("height", F.lit(1)))
    grown = lambda n: F.when(s > 1.05, F.greatest(F.lit(1), F.rint(c(n) * s).cast("int"))).otherwise(c(n))
    more = normalize_lines(c("_again.lines"), c("width"), c("height"), grown("width"), grown("height"))
    text, some = normalize(c("_again.text"), 1600), c("retried")
    return both.select(
        *images.columns,
        F.when(some & (signal_score(text) > signal_score(c("text"))), text).otherwise(c("text")).alias("text"),
        F.when(some, merge_lines(c("lines"), more)).otherwise(c("lines")).alias("lines"),
        F.when(some & (F.coalesce("_again.backend", F.lit("")) != ""), c("_again.backend")).otherwise(c("backend")).alias("backend"),
        "retried",
    )


def with_captions(screens: DataFrame, provider: captions.Provider) -> DataFrame:
    """screens with `caption`; the provider works only where a caption would add something."""
    w, h, text = F.col("width"), F.col("height"), F.col("text")
    wanted = screens.withColumn("_wanted", settled(F.when(should_caption(text, w, h, F.col("chart_visual.chart_like")), F.col("content")))).withColumn("_prompt", settled(caption_prompt(text, w, h)))
    return provider(wanted, "_wanted", "_prompt", "_caption").withColumn("caption", normalize(F.col("_caption"), 320)).drop("_wanted", "_prompt", "_caption")


def analyze(spark: SparkSession, images: DataFrame, column: str = "content", provider: ocr.Provider | None = None, captioner: captions.Provider | None = None, dedupe: bool = True) -> DataFrame:
    """All rows of images, with `record` in place of the image. `column`: bytes, or base64 text.

    With `dedupe` an image is analysed once however often it occurs. That takes one shuffle of the images
    by digest; back to their rows come only records. Rows without any bytes fail where they are: they would all have one
    digest. Without `dedupe` there is no shuffle at all.
    """
    others = [c for c in images.columns if c != column]
    raw = base64_bytes(column) if dict(images.dtypes)[column] == "string" else F.col(column)
    keyed = images.select(F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("_row"), raw.alias("content"))
    keyed = keyed.withColumn("key", F.sha2(F.coalesce("content", F.lit(b"")), 256))
    blank = F.coalesce(F.octet_length("content"), F.lit(0)) == 0
    every = keyed
    keyed = every.where(~blank) if dedupe else every
    rows = keyed.select("key", "content").dropDuplicates(["key"]) if dedupe else keyed
    seen = rows.withColumn("_i", inspect("content")).withColumns({n: F.col(f"_i.{n}") for n in ("ok", "width", "height", "chart_visual")})
    seen = seen.withColumn("content", F.when(F.col("ok"), F.col("content"))).drop("_i")
    read = read_twice(seen, provider or ocr.local(Settings.read(spark)))
    read = with_captions(read, captioner) if captioner is not None else read.withColumn("caption", F.lit(""))
    done = compose_records(read.withColumn("digest", F.col("key")))
    if dedupe:
        done = keyed.select("_row", "key").join(done.select("key", "record"), "key", "left").select("_row", "record")
        done = done.unionByName(every.where(blank).select("_row", failure(UNREADABLE).cast(done.schema["record"].dataType).alias("record")))
    return done.select(*(F.col(f"_row.`{c}`") for c in others), "record")


def analyze_screens(screens: DataFrame) -> DataFrame:
    """screens (width, height, text, raw lines; perhaps chart_visual, caption, digest, backend) with `record`: no pixels needed."""
    have = set(screens.columns)
    more = {"ok": F.lit(True), "chart_visual": F.lit(None).cast(schemas.CHART_VISUAL), "caption": F.lit(""), "digest": F.lit(""), "backend": F.lit("")}
    df = screens.withColumns({k: v for k, v in more.items() if k not in have})
    return compose_records(df.withColumn("text", normalize(F.col("text"), 1600)).withColumn("lines", normalize_lines(F.col("lines"), F.col("width"), F.col("height"))))


def capabilities(spark: SparkSession, windows: bool | None = None, tesseract: bool | None = None, caption: bool | None = None) -> DataFrame:
    """One row: what this machine can do."""
    w = ocr.has_windows() if windows is None else windows
    t = ocr.has_tesseract() if tesseract is None else tesseract
    c = captions.has_captions() if caption is None else caption
    return spark.createDataFrame([(w, t, c, w or t, w or t or c)], "windows_ocr boolean, tesseract_ocr boolean, caption boolean, full_analysis boolean, any boolean")


def events(records: DataFrame) -> DataFrame:
    """(stage, data) for each record: what was found by which engine. Times are the engine's own metrics."""
    r = lambda c: F.col(f"record.{c}")
    data = {"ok": r("ok"), "has_ocr": r("ocr_text") != "", "has_caption": r("caption") != "", "ocr_backend": r("ocr_backend"), "caption_pending": r("caption_pending"), "size": r("size")}
    return records.select(F.when(r("ok"), "analysis").otherwise("decode_error").alias("stage"), F.create_map(*(x for k, v in data.items() for x in (F.lit(k), v.cast("string")))).alias("data"))


def write_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Records as Parquet, in folders by scene, so that a reader of one scene reads no other."""
    records.withColumn("scene", F.when(F.col("record.ok"), F.col("record.scene")).otherwise("failed")).write.mode(mode).partitionBy("scene").parquet(path)
