"""Layout of a screen from its lines: browser, chat, chart labels.

Higher-order functions over one row's lines: no shuffle. Picks take the first of equals, which the
place in the list (as last part of the key) makes certain. Fractions of the size are truncated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas
from ..functions import lexicon
from ..functions.text import count, dedupe, first_spellings, has_any, keyword_hits, let, normalize, stabilize, strings, url_like

LETTERS = r"[A-Za-z一-鿿]"


def part(size: Column, share: float) -> Column:
    return (F.greatest(size.cast("int"), F.lit(1)) * F.lit(share)).cast("int")


def marked(lines: Column) -> Column:
    """Lines with what the conditions need, computed once."""
    return F.transform(
        F.coalesce(lines, F.array().cast(schemas.LINES)),
        lambda v: F.struct(*(v[c].alias(c) for c in ("text", "x", "y", "width", "height", "right", "bottom")), F.lower(v["text"]).alias("low"), url_like(v["text"]).alias("url"), count(v["text"], LETTERS).alias("letters"), F.length(v["text"]).alias("n"), normalize(v["text"], 120).alias("short")),
    )


def zones(w: Column, h: Column) -> dict:
    """Conditions on a marked line, by name; bands overlap on purpose."""
    top = lambda v: v["y"] <= part(h, 0.22)
    body = lambda v: (v["y"] >= part(h, 0.10)) & (v["y"] <= part(h, 0.84))
    bottom = lambda v: v["y"] >= part(h, 0.76)
    address = lambda v: top(v) & (v["url"] | F.contains(v["low"], F.lit("search")))
    left = lambda v: body(v) & (v["x"] <= part(w, 0.42)) & (v["right"] <= part(w, 0.62)) & (v["width"] <= part(w, 0.44))
    right = lambda v: body(v) & (v["x"] >= part(w, 0.48)) & (v["width"] <= part(w, 0.40))
    return {
        "top": top,
        "body": body,
        "bottom": bottom,
        "address": address,
        "page_title": lambda v: ~address(v) & (v["y"] <= part(h, 0.42)) & (v["x"] >= part(w, 0.15)) & (v["x"] <= part(w, 0.82)) & (v["letters"] >= 3) & ~has_any(v["low"], lexicon.TITLE_EXCLUDED),
        "field": lambda v: body(v) & has_any(v["low"], lexicon.FIELD_TOKENS),
        "left": left,
        "left_message": lambda v: left(v) & (v["n"] >= 8),
        "right": right,
        "right_message": lambda v: right(v) & (v["n"] >= 6),
        "input": lambda v: bottom(v) & (v["width"] >= F.greatest(F.lit(40), part(w, 0.05))) & has_any(v["low"], lexicon.INPUT_TOKENS),
        "sidebar": lambda v: body(v) & (v["x"] <= part(w, 0.24)) & (v["width"] <= part(w, 0.22)) & (F.length(normalize(v["text"], 80)) <= 24) & (count(v["text"], r"[A-Za-z0-9一-鿿]+") <= 3),
        "chat_title": lambda v: top(v) & ~v["url"] & (v["n"] <= 40) & (v["x"] >= part(w, 0.25)) & (v["x"] <= part(w, 0.78)) & (v["letters"] >= 2),
        "chart_title": lambda v: (v["y"] <= part(h, 0.24)) & (v["x"] <= part(w, 0.72)) & (v["letters"] >= 4) & ~v["url"],
        "x_axis": lambda v: (v["y"] >= part(h, 0.68)) & (v["x"] >= part(w, 0.12)) & (v["n"] <= 18),
        "y_axis": lambda v: (v["x"] <= part(w, 0.18)) & (v["y"] >= part(h, 0.14)) & (v["y"] <= part(h, 0.86)) & v["text"].rlike(r"(?U)\d"),
        "legend": lambda v: (v["x"] >= part(w, 0.54)) & (v["y"] <= part(h, 0.34)) & ~v["text"].rlike(r"(?U)\A[Qq]?\d+(?:\.\d+)?%?\z"),
    }


def pick(lines: Column, *keys) -> Column:
    """Text of the line with the greatest keys, the first of equals; empty if there is none."""
    keyed = F.transform(lines, lambda v, i: F.struct(*(k(v).alias(f"k{j}") for j, k in enumerate(keys)), (-i).alias("i"), v["text"].alias("text")))
    return F.coalesce(F.array_max(keyed)["text"], F.lit(""))


def texts(lines: Column, limit: int) -> Column:
    return F.transform(F.slice(lines, 1, limit), lambda v: v["text"])


def layout(lines: Column, width: Column, height: Column, text: Column) -> Column:
    """The layout as read (null if none); `functions.repair.repair_layout` then mends its short texts."""
    z = zones(width, height)
    low = F.lower(normalize(text, 1600))
    none, no_list = F.lit(""), strings()

    def of(**values) -> Column:
        fields = {"kind": none, "address_bar": none, "page_title": none, "field_labels": no_list, "title": none, "left_messages": no_list, "right_messages": no_list, "input_hint": none, "sidebar_labels": no_list} | values
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    def browser(s: Column) -> Column:
        title = pick(s["titles"], lambda v: v["n"], lambda v: v["width"])
        fields = let(title, lambda t: texts(F.filter(s["fields"], lambda v: v["short"] != t), 4))
        return of(kind=F.lit("browser"), address_bar=pick(s["addresses"], lambda v: v["width"]), page_title=title, field_labels=fields)

    def chat(s: Column) -> Column:
        messages = lambda c: dedupe(F.transform(texts(s[c], 4), stabilize), 4)
        title = pick(s["chat_titles"], lambda v: -v["y"], lambda v: v["width"])
        return of(kind=F.lit("chat"), title=title, left_messages=messages("lefts"), right_messages=messages("rights"), input_hint=F.coalesce(F.get(s["inputs"], F.lit(0))["text"], none), sidebar_labels=texts(s["sides"], 4))

    def choose(m: Column) -> Column:
        lists = F.struct(*(F.filter(m, z[c]).alias(n) for n, c in (("addresses", "address"), ("titles", "page_title"), ("fields", "field"), ("lefts", "left_message"), ("rights", "right_message"), ("inputs", "input"), ("sides", "sidebar"), ("chat_titles", "chat_title"))))

        def decide(s: Column) -> Column:
            some = lambda c, n=1: F.size(s[c]) >= n
            words = keyword_hits(low, lexicon.CHAT) >= 1
            is_browser = some("addresses") | (F.contains(low, F.lit("browser")) & some("fields"))
            is_chat = (some("inputs") & (some("lefts") | some("rights") | words | some("sides", 2))) | (some("lefts") & some("rights") & (words | some("sides")))
            return F.when(is_browser, browser(s)).when(is_chat, chat(s))

        return let(lists, decide)

    return let(marked(lines), choose)


def chart_text(lines: Column, width: Column, height: Column) -> Column:
    """Title, axis labels and legend of a chart; null if there are none."""
    z = zones(width, height)

    def labels(m: Column, key, limit: int) -> Column:
        ordered = F.array_sort(F.transform(m, lambda v, i: F.struct(*(k.alias(f"k{j}") for j, k in enumerate(key(v))), i.alias("i"), v["text"].alias("text"))))
        return F.slice(first_spellings(F.transform(ordered, lambda k: normalize(k["text"], 80))), 1, limit)

    def of(m: Column) -> Column:
        title = pick(F.filter(m, z["chart_title"]), lambda v: F.least(v["width"], part(width, 0.65)), lambda v: -v["y"], lambda v: v["n"])
        return let(
            title,
            lambda t: F.struct(
                t.alias("title"),
                labels(F.filter(m, z["x_axis"]), lambda v: (v["x"],), 6).alias("x_axis_labels"),
                labels(F.filter(m, z["y_axis"]), lambda v: (v["y"],), 6).alias("y_axis_labels"),
                labels(F.filter(m, lambda v: z["legend"](v) & (v["text"] != t)), lambda v: (v["y"], v["x"]), 4).alias("legend_labels"),
            ),
        )

    some = lambda s: (s["title"] != "") | (F.size(s["x_axis_labels"]) + F.size(s["y_axis_labels"]) + F.size(s["legend_labels"]) > 0)
    return let(let(marked(lines), of), lambda s: F.when(some(s), s))
