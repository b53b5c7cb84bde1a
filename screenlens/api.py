"""Single images: the plans for a table with one row, or a few.

These functions serve interactive use; anything larger belongs in the DataFrame plans.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession

from .plans.analysis import analyze, capabilities
from .plans.contexts import screen_descriptions, user_contexts
from .sources.captions import has_captions as has_caption_support
from .sources.ocr import has_tesseract as has_tesseract_ocr_support
from .sources.ocr import has_windows as has_windows_ocr_support

__all__ = ["analyze_image", "build_screen_description", "build_user_image_context", "get_local_image_capabilities", "has_caption_support", "has_local_image_support", "has_tesseract_ocr_support", "has_windows_ocr_support"]


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _plain(v):
    """Rows as dictionaries; absent structures as empty ones."""
    if isinstance(v, Row):
        return {k: _plain(x) for k, x in v.asDict().items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def _layout(layout: dict) -> dict:
    kinds = {"browser": ("kind", "address_bar", "page_title", "field_labels"), "chat": ("kind", "title", "left_messages", "right_messages", "input_hint", "sidebar_labels")}
    return {k: layout[k] for k in kinds.get(layout.get("kind"), ())}


def analyze_image(image_b64: str, **how) -> dict:
    """The record of one base64 image."""
    spark = _session()
    df = spark.createDataFrame([(image_b64 or "",)], "content string")
    record = _plain(analyze(spark, df, **how).first().record)
    record |= {k: record[k] or {} for k in ("chart_visual", "chart_text", "layout")}
    return record | {"layout": _layout(record["layout"])}


def build_user_image_context(images: list[str] | None, *, user_text: str = "", **how) -> str:
    """The prompt context of some base64 images; empty if there are none."""
    rows = [(0, k, (b or "").strip(), user_text or "") for k, b in enumerate(images or [])]
    if not any(r[2] for r in rows):
        return ""
    spark = _session()
    df = spark.createDataFrame(rows, "g int, pos int, content string, question string")
    return user_contexts(spark, df, ["g"], "pos", question="question", **how).first().context


def build_screen_description(image_b64: str, **how) -> str:
    """One sentence on a base64 image."""
    spark = _session()
    df = spark.createDataFrame([(image_b64 or "",)], "content string")
    return screen_descriptions(spark, df, **how).first().description


def get_local_image_capabilities() -> dict:
    return capabilities(_session()).first().asDict()


def has_local_image_support() -> bool:
    """Whether any OCR engine is there; a caption model alone is not enough."""
    return has_windows_ocr_support() or has_tesseract_ocr_support()
