"""What kind of screen it is, and what else is worth trying on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import CJK, WORD, count, has_any, keyword_hits, let, low_signal, normalize, numeric_markers, readable_labels


def large(width: Column, height: Column) -> Column:
    return (width >= 900) & (height >= 500)


def scene(text: Column, width: Column, height: Column, chart_like: Column | None = None, caption: Column | None = None) -> Column:
    """chart, settings, browser, chat, document, ui or image."""
    chart = F.coalesce(chart_like, F.lit(False)) if chart_like is not None else F.lit(False)
    blank = lambda c: F.when(normalize(c, 3) != "", c)
    whole = text if caption is None else F.concat_ws(" ", blank(caption), blank(text))
    big = large(width, height)

    def decide(t: Column) -> Column:
        def by_markers(m: Column) -> Column:
            charted = (keyword_hits(t, lexicon.CHART) >= 1) & ((F.size(m) >= 3) | F.exists(m, lambda v: F.startswith(v, F.lit("q"))) | F.contains(t, F.lit("dashboard")))
            return (
                F.when(charted | chart, "chart")
                .when(keyword_hits(t, lexicon.SETTINGS) >= 2, "settings")
                .when(keyword_hits(t, lexicon.BROWSER) >= 2, "browser")
                .when(keyword_hits(t, lexicon.CHAT) >= 2, "chat")
                .when(big & ((count(t, WORD) >= 18) | (count(t, CJK) >= 32)), "document")
                .when(big, "ui")
                .otherwise("image")
            )

        return F.when(t == "", F.when(chart, "chart").when(big, "ui").otherwise("image")).otherwise(let(numeric_markers(t, 8), by_markers))

    return let(F.lower(normalize(whole, 1600)), decide)


def with_layout(scene: Column, kind: Column) -> Column:
    """A general scene gives way to the layout's."""
    return F.when(scene.isin("ui", "document") & F.coalesce(kind, F.lit("")).isin("browser", "chat"), kind).otherwise(scene)


def should_retry(text: Column, width: Column, height: Column) -> Column:
    """Whether a second reading of the image is worth its time."""
    return let(
        normalize(text, 1200),
        lambda t: F.when(low_signal(t), True).when(~large(width, height), False).when(F.length(t) >= 96, False).otherwise(F.size(readable_labels(t, 8)) < 6),
    )


def should_caption(text: Column, width: Column, height: Column, chart_like: Column | None = None) -> Column:
    """Whether a caption would add something."""
    return let(
        normalize(text, 1200),
        lambda t: F.when(t == "", True).when(low_signal(t), True).when(scene(t, width, height, chart_like).isin("chart", "browser", "chat"), True).otherwise(large(width, height) & (F.length(t) < 64) & (count(t, WORD) <= 7)),
    )


def caption_prompt(text: Column, width: Column, height: Column) -> Column:
    return let(
        F.lower(normalize(text, 600)),
        lambda t: F.when(has_any(t, lexicon.SETTINGS), "a computer settings screen showing")
        .when(has_any(t, lexicon.CHART), "a dashboard or chart showing")
        .when(has_any(t, lexicon.BROWSER), "a browser window showing")
        .when(has_any(t, lexicon.CHAT), "a chat window showing")
        .when(large(width, height), "a desktop app window showing")
        .otherwise("a screenshot of"),
    )
