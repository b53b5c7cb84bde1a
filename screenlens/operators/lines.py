"""OCR lines: words to lines, normalisation, merging. All of it runs in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import let, line_quality, normalize

FIELDS = ("text", "x", "y", "width", "height", "right", "bottom")


def safe_int(value: Column) -> Column:
    """Anything to an integer; what is no number counts as 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0)).cast("int")


def in_order(lines: Column) -> Column:
    """Stable sort by (y, x)."""
    keyed = F.transform(lines, lambda v, i: F.struct(v["y"].alias("y"), v["x"].alias("x"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda k: k["v"])


def line(text: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    i = lambda c: c.cast("int")
    return F.struct(text.alias("text"), i(x).alias("x"), i(y).alias("y"), i(width).alias("width"), i(height).alias("height"), i(x + width).alias("right"), i(y + height).alias("bottom"))


def normalize_lines(lines: Column, width: Column, height: Column, source_width: Column | None = None, source_height: Column | None = None) -> Column:
    """Raw lines to normalised ones: scaled into the image, clamped, without blanks, sorted."""
    w, h = F.greatest(width.cast("int"), F.lit(1)), F.greatest(height.cast("int"), F.lit(1))
    sx = w / F.greatest(source_width.cast("int"), F.lit(1)).cast("double") if source_width is not None else F.lit(1.0)
    sy = h / F.greatest(source_height.cast("int"), F.lit(1)).cast("double") if source_height is not None else F.lit(1.0)
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    # rint rounds halves to even.
    placed = F.transform(
        F.coalesce(lines, F.array().cast(f"array<{schemas.RAW_LINE}>")),
        lambda v: F.struct(normalize(v["text"], 220).alias("text"), *(F.rint(number(v[n]) * s).alias(n) for n, s in (("x", sx), ("y", sy), ("width", sx), ("height", sy)))),
    )
    # What is no number, or none that fits, drops its line.
    sound = F.filter(placed, lambda v: (v["text"] != "") & (F.greatest(*(F.abs(v[n]) for n in ("x", "y", "width", "height"))) < 2e9))

    def clamp(v: Column) -> Column:
        x = F.greatest(F.lit(0), F.least(w - 1, v["x"].cast("int")))
        y = F.greatest(F.lit(0), F.least(h - 1, v["y"].cast("int")))
        wide = F.when(v["width"] <= 0, F.greatest(F.lit(12), F.length(v["text"]) * 8)).otherwise(v["width"].cast("int"))
        high = F.when(v["height"] <= 0, F.lit(12)).otherwise(v["height"].cast("int"))
        return line(v["text"], x, y, F.greatest(F.lit(1), F.least(w - x, wide)), F.greatest(F.lit(1), F.least(h - y, high)))

    return in_order(F.transform(sound, clamp))


def pair_score(a: Column, b: Column) -> Column:
    """How well two lines match: share of overlap, or closeness of their centres; null if not at all."""
    across = F.greatest(F.lit(0), F.least(a["right"], b["right"]) - F.greatest(a["x"], b["x"]))
    down = F.greatest(F.lit(0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["y"], b["y"]))
    area = F.greatest(a["width"].cast("long") * a["height"], b["width"].cast("long") * b["height"], F.lit(1))
    share = (across.cast("long") * down) / area.cast("double")
    dx = F.abs((a["x"] + a["right"]) - (b["x"] + b["right"])) / 2.0
    dy = F.abs((a["y"] + a["bottom"]) - (b["y"] + b["bottom"])) / 2.0
    near = (dx <= F.greatest(F.lit(24.0), F.greatest(a["width"], b["width"]) * 0.75)) & (dy <= F.greatest(F.lit(16.0), F.greatest(a["height"], b["height"]) * 2.0))
    return F.when(share > 0.12, share).when(near, F.lit(0.1) + F.lit(1.0) / (F.lit(1.0) + dx + dy))


def joined(a: Column, b: Column) -> Column:
    """One line of two: the better reading, the common box."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    right, bottom = F.greatest(a["right"], b["right"]), F.greatest(a["bottom"], b["bottom"])
    return line(F.when(line_quality(b["text"]) > line_quality(a["text"]), b["text"]).otherwise(a["text"]), x, y, right - x, bottom - y)


def merge_lines(first: Column, second: Column) -> Column:
    """Fold the second list into the first: each line joins its best match so far or is added. Later lines may match added ones."""
    empty = F.array().cast(schemas.LINES)

    def step(acc: Column, b: Column) -> Column:
        scores = F.filter(F.transform(acc, lambda a, i: F.struct(pair_score(a, b).alias("score"), (-i).alias("at"))), lambda s: s["score"].isNotNull())
        return let(F.array_max(scores), lambda best: F.when(best.isNull(), F.concat(acc, F.array(b))).otherwise(F.transform(acc, lambda a, i: F.when(i == -best["at"], joined(a, b)).otherwise(a))))

    one, two = F.coalesce(first, empty), F.coalesce(second, empty)
    return in_order(F.aggregate(two, one, step))


#: The columns of an OCR table that tell a word's line, and those that are numbers.
LINE_KEY = ("page_num", "block_num", "par_num", "line_num")
NUMBERS = ("level", "left", "top", "width", "height")


def word(value: Callable[[str], Column], pos: Column) -> Column:
    """One row of an OCR table as a struct that sorts by line and place; value: a column's text by name."""
    n = {c: safe_int(value(c)) for c in NUMBERS}
    own = n["level"] == 4
    return F.struct(
        F.concat_ws("\t", *(F.coalesce(value(c).cast("string"), F.lit("")) for c in LINE_KEY)).alias("key"),
        pos.cast("long").alias("pos"),
        n["level"].alias("level"),
        own.alias("own"),
        n["left"].alias("x"),
        n["top"].alias("y"),
        (n["left"] + F.greatest(n["width"], F.lit(0))).alias("right"),
        (n["top"] + F.greatest(n["height"], F.lit(0))).alias("bottom"),
        F.when(own, "").otherwise(normalize(value("text"), 80)).alias("word"),
    )


def lines_of(words: Column) -> Column:
    """struct<text, lines> of one image's `word` structs: rows of a line are neighbours once sorted.

    A line's box is its own row's (level 4), widened by the rows from the first word on.
    """

    def widened(acc: Column, v: Column) -> Column:
        some = acc["some"] | (v["word"] != "")
        low = lambda c: F.when(v["own"], v[c]).when(some, F.least(acc[c], v[c])).otherwise(acc[c])
        high = lambda c: F.when(v["own"] | some, F.greatest(acc[c], v[c])).otherwise(acc[c])
        return F.struct(low("x").alias("x"), low("y").alias("y"), high("right").alias("right"), high("bottom").alias("bottom"), some.alias("some"))

    def one(rows: Column) -> Column:
        first = F.get(rows, F.lit(0))
        start = F.struct(*(first[c].alias(c) for c in ("x", "y", "right", "bottom")), F.lit(False).alias("some"))
        text = normalize(F.array_join(F.filter(F.transform(rows, lambda v: v["word"]), lambda w: w != ""), " "), 220)

        def placed(b: Column) -> Column:
            x, y = F.greatest(b["x"], F.lit(0)), F.greatest(b["y"], F.lit(0))
            return F.struct(y.alias("y"), x.alias("x"), first["pos"].alias("pos"), line(text, x, y, F.greatest(b["right"], x + 1) - x, F.greatest(b["bottom"], y + 1) - y).alias("v"))

        return let(F.aggregate(rows, start, widened), placed)

    def parted(rows: Column) -> Column:
        begins = F.filter(F.transform(rows, lambda v, i: i), lambda i: (i == 0) | (F.get(rows, i)["key"] != F.get(rows, i - 1)["key"]))
        return let(begins, lambda at: F.transform(at, lambda a, k: one(F.slice(rows, a + 1, F.coalesce(F.get(at, k + 1), F.size(rows)) - a))))

    def whole(ls: Column) -> Column:
        return F.struct(normalize(F.array_join(F.transform(ls, lambda v: v["text"]), " "), 1600).alias("text"), ls.alias("lines"))

    found = let(F.array_sort(F.filter(words, lambda v: v["level"].isin(4, 5))), parted)
    return let(F.transform(F.array_sort(F.filter(found, lambda k: k["v"]["text"] != "")), lambda k: k["v"]), whole)


def words_to_lines(words: DataFrame, by: list[str]) -> DataFrame:
    """Word rows (level, page_num, block_num, par_num, line_num, pos, left, top, width, height, text) to lines.

    `pos` is the row's order within `by`, the image: its rows meet once. Returns by, text and lines of the images that have lines.
    """
    met = words.groupBy(*by).agg(F.collect_list(word(F.col, F.col("pos"))).alias("_words"))
    return met.select(*by, lines_of(F.col("_words")).alias("_o")).where(F.size("_o.lines") > 0).select(*by, "_o.text", "_o.lines")


#: A field of a table with tabs; quotes at its beginning may hold tabs and line breaks, and two quotes are one.
FIELD = r'(?:"(?:[^"]++|"")*+"?[^\t\r\n]*+|[^\t\r\n]*+)'
QUOTED = r'(?s)^"((?:[^"]++|"")*+)"?(.*)$'


def tsv_lines(tsv: Column) -> Column:
    """struct<text, lines> of an OCR table as text: tabs between fields, names in the first row."""

    def cells(record: Column) -> Column:
        plain = lambda f: F.when(F.startswith(f, F.lit('"')), F.concat(F.replace(F.regexp_extract(f, QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_extract(f, QUOTED, 2))).otherwise(f)
        return F.transform(F.regexp_extract_all(F.concat(F.lit("\t"), record), F.lit(rf"\t({FIELD})"), F.lit(1)), plain)

    def table(records: Column) -> Column:
        def of(names: Column) -> Column:
            rows = F.transform(F.slice(records, F.lit(2), F.greatest(F.size(records) - 1, F.lit(0))), cells)
            return lines_of(F.transform(rows, lambda c, i: word(lambda n: F.get(c, F.array_position(names, F.lit(n)).cast("int") - 1), i)))

        return let(cells(F.coalesce(F.get(records, F.lit(0)), F.lit(""))), of)

    records = F.regexp_extract_all(F.coalesce(tsv, F.lit("")), F.lit(rf"({FIELD}(?:\t{FIELD})*+)(?:\r\n|[\r\n]|\z)"), F.lit(1))
    return let(F.filter(records, lambda x: x != ""), table)
