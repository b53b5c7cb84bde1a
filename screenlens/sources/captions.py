"""Caption providers: add a caption to a table of images.

A provider gets (df, content, prompt, out): names of the columns with bytes and prompt, and of the column
to add. Rows that want no caption come with null bytes.
"""

from __future__ import annotations

import functools
import importlib.util
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import Settings
from ..functions.repair import flat
from .images import decode

Provider = Callable[[DataFrame, str, str, str], DataFrame]


def has_captions() -> bool:
    return all(importlib.util.find_spec(m) is not None for m in ("transformers", "torch"))


def none(df: DataFrame, content: str, prompt: str, out: str) -> DataFrame:
    """No captions."""
    return df.withColumn(out, F.lit(""))


def precomputed(captions: DataFrame) -> Provider:
    """Captions that exist already: a table (key, caption), joined by digest."""
    return lambda df, content, prompt, out: df.join(captions.select("key", F.col("caption").alias(out)), "key", "left").withColumn(out, F.when(F.col(content).isNotNull(), F.col(out)))


@functools.lru_cache(1)
def _model(name: str, download: bool):
    """The model of this worker; a failed load is remembered."""
    try:
        from transformers import BlipForConditionalGeneration, BlipProcessor

        kind = {"local_files_only": not download}
        model = BlipForConditionalGeneration.from_pretrained(name, **kind)
        return BlipProcessor.from_pretrained(name, **kind), model.eval()
    except (ImportError, OSError, ValueError):
        return None


def blip(settings: Settings) -> Provider:
    """A captioning model, loaded once a worker; no model, no caption."""

    @F.arrow_udf("string")
    def run(content: pa.Array, prompt: pa.Array) -> pa.Array:
        loaded = _model(settings.caption_model, settings.caption_download)
        out = []
        for raw, p in zip(content.to_pylist(), prompt.to_pylist(), strict=True):
            pixels = decode(raw) if loaded else None
            if pixels is None:
                out.append("")
                continue
            import torch

            inputs = loaded[0](images=pixels, return_tensors="pt", **({"text": p.strip()} if p and p.strip() else {}))
            with torch.inference_mode():
                made = loaded[1].generate(**inputs, max_new_tokens=64)
            out.append(flat(loaded[0].decode(made[0], skip_special_tokens=True), 320) if len(made) else "")
        return pa.array(out, pa.string())

    return lambda df, content, prompt, out: df.withColumn(out, run.asNondeterministic()(content, prompt))
