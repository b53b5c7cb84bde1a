"""The analysis over a stream of image files.

A record depends on its image alone, so the plan runs unchanged on a stream; copies of an image that
arrive within the watermark are dropped by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import normalize
from ..operators.lines import normalize_lines
from ..plans.analysis import compose_records
from ..sources.images import inspect


def read_stream(spark: SparkSession, path: str, glob: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)


def analyze_stream(images: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """path, modificationTime, record: the records that need no OCR provider (pixels only), once an image within the watermark."""
    keyed = images.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["digest"])
    seen = keyed.withColumn("_i", inspect("content")).select("path", "modificationTime", "digest", "_i.*")
    return _composed(seen, F.lit(""), F.lit(None).cast(f"array<{schemas.RAW_LINE}>")).select("path", "modificationTime", "record")


def analyze_screen_stream(screens: DataFrame) -> DataFrame:
    """A stream of screens (width, height, text, raw lines, digest, ...) with `record`."""
    return _composed(screens.withColumns({"ok": F.lit(True), "chart_visual": F.lit(None).cast(schemas.CHART_VISUAL)}), F.col("text"), F.col("lines"))


def _composed(df: DataFrame, text, lines) -> DataFrame:
    df = df.withColumns({"text": normalize(text, 1600), "lines": normalize_lines(lines, F.col("width"), F.col("height")), "caption": F.lit(""), "backend": F.lit("")})
    return compose_records(df)
