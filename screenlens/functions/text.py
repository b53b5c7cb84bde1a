"""Text functions as Column expressions: all run in the JVM, none in Python.

Lengths and limits count code points. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

#: Unicode white space, spelled out: the engine's own class lacks some of it.
_SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = f"[{_SPACE}]+"
WORD = "[A-Za-z][A-Za-z0-9-]{2,}"
CJK = r"[\u4e00-\u9fff]"
#: Kinds of numeric markers, in order.
MARKERS = (r"(?iU)\bQ[1-4]\b", r"(?iU)[+-]?\d+(?:\.\d+)?\s*%", r"(?iU)\d+(?:\.\d+)?\s*[kmg]\b", r"(?iU)\b\d{2,4}\b")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def normalize(text: Column, limit: int = 900) -> Column:
    """White space collapsed and trimmed; a longer text is cut and gets an ellipsis.

    What the beginning of a long text gives decides the result if it is over the limit already; only
    texts with very much white space are looked at as a whole.
    """
    whole, some = F.coalesce(text, F.lit("")), limit + limit // 4 + 32
    flat = lambda c: F.trim(F.regexp_replace(c, SPACES, " "))
    cut = lambda t: F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))
    full = lambda: let(flat(whole), lambda t: F.when(F.length(t) <= limit, t).otherwise(cut(t)))
    return let(flat(F.substring(whole, 1, some)), lambda t: F.when(F.length(t) > limit, cut(t)).when(F.length(whole) <= some, t).otherwise(full()))


def has_any(text: Column, tokens: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(text, F.lit(t))
    return out


def first_spellings(values: Column) -> Column:
    """The array without empty strings and case-insensitive repeats; order and first spellings stay."""
    return let(F.filter(values, lambda v: v != ""), lambda a: let(F.transform(a, F.lower), lambda low: F.filter(a, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)))


def dedupe(values: Column, limit: int | None = None, chars: int = 240) -> Column:
    """`first_spellings` of the normalised texts, at most `limit`."""
    out = first_spellings(F.transform(F.coalesce(values, strings()), lambda v: normalize(v, chars)))
    return out if limit is None else F.slice(out, 1, limit)


def readable_labels(text: Column, limit: int = 6) -> Column:
    """The first words of three characters or more that are not stop words."""
    found = F.regexp_extract_all(normalize(text, 1200), F.lit(WORD), F.lit(0))
    return F.slice(first_spellings(F.filter(found, lambda w: ~F.lower(w).isin(*lexicon.STOP_LABELS))), 1, limit)


def numeric_markers(text: Column, limit: int = 8) -> Column:
    """Quarters, percentages, numbers with a magnitude, short numbers: kind by kind."""
    return let(normalize(text, 1200), lambda t: F.slice(first_spellings(F.transform(F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in MARKERS)), lambda m: F.trim(m))), 1, limit))


def url_like(text: Column) -> Column:
    def test(t: Column) -> Column:
        dots = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
        return has_any(t, lexicon.URL_TOKENS) | (F.contains(t, F.lit(".")) & (F.contains(t, F.lit("/")) | F.contains(t, F.lit("\\")))) | ((dots >= 2) & ~F.contains(t, F.lit(" ")))

    return let(F.lower(normalize(text, 240)), test)


def stabilize(text: Column) -> Column:
    """Normalised, with forward slashes and the colon of a leading scheme restored."""
    return F.regexp_replace(F.replace(normalize(text, 240), F.lit("\\"), F.lit("/")), "(?i)^(https?)//", "$1://")


def signature(text: Column) -> Column:
    """Letters and digits in lower case, with those that OCR confuses made equal."""
    return F.translate(F.regexp_replace(F.lower(normalize(text, 240)), r"[^a-z0-9\u4e00-\u9fff]+", ""), "ilosb", "11058")


def _score(t: Column) -> Column:
    return F.length(t) + 9 * count(t, WORD) + 4 * count(t, CJK) + 2 * count(t, r"(?U)\d")


def signal_score(text: Column) -> Column:
    """How much readable text there is."""
    return let(normalize(text, 1600), _score)


def low_signal(text: Column) -> Column:
    return let(normalize(text, 1600), lambda t: F.when(t == "", True).when(count(t, CJK) >= 6, False).when((count(t, WORD) >= 5) & (F.length(t) >= 32), False).otherwise(_score(t) < 72))


def line_quality(text: Column) -> Column:
    """How plausible a line's reading is."""

    def score(t: Column) -> Column:
        latin, cjk, digits = count(t, "[A-Za-z]"), count(t, CJK), count(t, r"(?U)\d")
        weird = count(t, rf"[^A-Za-z0-9{_SPACE}:/._%+\-()\u4e00-\u9fff]")
        whole = F.length(t) + 4 * latin + 4 * cjk + 2 * digits - 6 * weird
        return F.when(t == "", -1000).otherwise(whole + F.when(url_like(t), 18).otherwise(0) - F.when((latin + cjk <= 1) & (digits <= 1), 20).otherwise(0))

    return let(normalize(text, 240), score)


def human_list(items: Column) -> Column:
    """`a`, `a and b`, `a, b, and c`; blanks left out."""

    def join(a: Column) -> Column:
        n = F.size(a)
        return F.when(n <= 2, F.array_join(a, " and ")).otherwise(F.concat(F.array_join(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(a, -1)))

    return let(F.filter(F.transform(F.coalesce(items, strings()), lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != ""), lambda a: F.when(F.size(a) == 0, "").otherwise(join(a)))


def keyword_hits(lowered: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the lower-case text contains; nested ones count each."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(lowered, F.lit(w)).cast("int")
    return out


def settings_focus(labels: Column, text: Column) -> Column:
    """What a settings screen is about: at most three topics, in fixed order."""
    joined = F.lower(normalize(F.concat_ws(" ", labels, F.coalesce(text, F.lit(""))), 1200))
    return let(joined, lambda t: F.slice(F.array_compact(F.array(*(F.when(has_any(t, words), F.lit(name)) for name, words in lexicon.FOCUS))), 1, 3))
