"""Settings: read once on the driver, then closed over.

A setting comes from the session (`screenlens.<name>`), else from the environment
(`SCREENLENS_<NAME>`), else it has its default.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .functions.repair import flat


def flag(value: str | None, default: bool = False) -> bool:
    t = (value or "").strip().lower()
    return t in ("1", "true", "yes", "on") if t else default


def number(value: str | None, default: int, least: int = 1, most: int | None = None) -> int:
    """An integer within bounds; what is none counts as the default."""
    try:
        n = int((value or "").strip())
    except ValueError:
        n = default
    n = max(n, least)
    return n if most is None else min(n, most)


@dataclass(frozen=True)
class Settings:
    ocr_backend: str = "auto"
    ocr_timeout: int = 8
    tesseract_psm: int = 11
    tesseract_lang: str = ""
    caption_blocking: bool = False
    caption_download: bool = False
    caption_model: str = "Salesforce/blip-image-captioning-base"

    @classmethod
    def read(cls, spark: SparkSession | None = None) -> Settings:
        def get(name: str) -> str:
            own = spark.conf.get(f"screenlens.{name}", None) if spark is not None else None
            return own if own is not None else os.environ.get("SCREENLENS_" + name.upper(), "")

        backend = get("ocr_backend").strip().lower()
        return cls(
            backend if backend in ("windows", "tesseract") else "auto",
            number(get("ocr_timeout"), 8, 3, 20),
            number(get("tesseract_psm"), 11, 3, 13),
            flat(get("tesseract_lang"), 48).replace(" ", ""),
            flag(get("caption_blocking")),
            flag(get("caption_download")),
            get("caption_model").strip() or cls.caption_model,
        )
