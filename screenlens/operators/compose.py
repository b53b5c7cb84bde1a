"""Texts made of a screen's parts: details, visible text, summary, description, prompt context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dedupe, human_list, let, normalize, numeric_markers, readable_labels, settings_focus, stabilize, strings
from .scene import large

#: Summaries that say nothing.
READABLE, NOTHING = "The image contains readable text.", "Unable to extract stable detail from the image."
#: The head of a prompt context.
HEAD = (
    "[LOCAL_IMAGE_CONTEXT]",
    "Below is locally extracted visual context from the user's uploaded images.",
    "Answer directly from this information.",
    "Do not mention OCR, caption models, local analysis, model switching, or any claim that you cannot see images.",
)


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def list_of(c: Column) -> Column:
    return F.coalesce(c, strings())


def one(c: Column) -> Column:
    """A list of the text, or of nothing."""
    return F.when(text_of(c) != "", F.array(c)).otherwise(strings())


def listed(c: Column, limit: int) -> Column:
    return F.array_join(F.slice(F.filter(F.transform(list_of(c), lambda v: F.trim(v)), lambda v: v != ""), 1, limit), ", ")


def note(label: str, value: Column) -> Column:
    """`label: value`, or null if the value is empty."""
    return F.when(value != "", F.concat(F.lit(f"{label}: "), value))


def layout_details(layout: Column) -> Column:
    browser = F.concat_ws("; ", note("page title", stabilize(layout["page_title"])), note("address bar", stabilize(layout["address_bar"])), note("visible controls", listed(layout["field_labels"], 4)))
    left, right = F.size(list_of(layout["left_messages"])) > 0, F.size(list_of(layout["right_messages"])) > 0
    sides = F.when(left & right, "messages appear on both left and right sides").when(left, "messages are visible on the left side")
    chat = F.concat_ws("; ", note("chat title", stabilize(layout["title"])), sides, note("composer", stabilize(layout["input_hint"])), note("sidebar items", listed(layout["sidebar_labels"], 3)))
    return F.when(layout["kind"] == "browser", browser).when(layout["kind"] == "chat", chat).otherwise("")


def chart_details(chart: Column) -> Column:
    return F.concat_ws("; ", note("title", F.trim(text_of(chart["title"]))), note("x-axis", listed(chart["x_axis_labels"], 6)), note("y-axis", listed(chart["y_axis_labels"], 6)), note("legend/annotations", listed(chart["legend_labels"], 4)))


def layout_texts(layout: Column) -> Column:
    browser = dedupe(F.concat(one(layout["page_title"]), one(layout["address_bar"]), list_of(layout["field_labels"])), 10)
    chat = dedupe(F.concat(one(layout["title"]), *(list_of(layout[c]) for c in ("sidebar_labels", "left_messages", "right_messages")), one(layout["input_hint"])), 12)
    return F.when(layout["kind"] == "browser", browser).when(layout["kind"] == "chat", chat).otherwise(strings())


def chart_texts(chart: Column, text: Column) -> Column:
    every = F.concat(one(chart["title"]), *(list_of(chart[c]) for c in ("x_axis_labels", "y_axis_labels", "legend_labels")), numeric_markers(text, 6))
    return F.when(chart.isNull(), strings()).otherwise(dedupe(every, 12))


def visible_text(scene: Column, layout: Column, chart: Column, text: Column) -> Column:
    """The structured texts of a screen; with its labels if the scene is a general one; else the text itself."""
    return let(
        dedupe(F.concat(layout_texts(layout), chart_texts(chart, text)), 12),
        lambda s: F.when(F.size(s) == 0, normalize(text, 1200))
        .when(scene.isin("browser", "chat", "chart"), normalize(F.array_join(s, "; "), 1200))
        .otherwise(normalize(F.array_join(dedupe(F.concat(s, readable_labels(text, 6)), 12), "; "), 1200)),
    )


def summary_labels(scene: Column, layout: Column, chart: Column, fallback: Column) -> Column:
    found = (
        F.when(scene == "browser", dedupe(F.concat(list_of(layout["field_labels"]), one(layout["page_title"])), 6))
        .when(scene == "chat", dedupe(F.concat(list_of(layout["sidebar_labels"]), one(layout["input_hint"]), one(layout["title"])), 6))
        .when(scene == "chart", dedupe(F.concat(one(chart["title"]), list_of(chart["x_axis_labels"]), list_of(chart["legend_labels"])), 6))
    )
    return let(found, lambda a: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a).otherwise(fallback))


def summary(scene: Column, text: Column, width: Column, height: Column, layout: Column, chart: Column, visual: Column, caption: Column | None = None) -> Column:
    """A sentence or a few on what the image shows."""
    cap = normalize(caption, 320) if caption is not None else F.lit("")
    text = text_of(text)

    def body(labels: Column) -> Column:
        named = F.array_join(labels, ", ")
        some = F.size(labels) > 0
        readable = F.when(some, F.concat(F.lit(" Readable labels include: "), named, F.lit("."))).otherwise("")
        details = let(layout_details(layout), lambda d: F.when(d != "", F.concat(F.lit(" Layout details: "), d, F.lit("."))).otherwise(""))
        focus = let(human_list(settings_focus(labels, text)), lambda f: F.when(f != "", F.concat(F.lit(" focused on "), f, F.lit(" options."))).otherwise("."))

        def charted(m: Column) -> Column:
            kind = F.when(visual["kind"] == "line", "This looks like a dashboard featuring a line chart").when(visual["kind"] == "bar", "This looks like a dashboard featuring a bar chart").otherwise("This looks like a dashboard or chart with numeric metrics")
            base = F.concat(
                kind,
                F.when(visual["trend"] == "upward", " with an upward left-to-right trend").when(visual["trend"] == "downward", " with a downward left-to-right trend").otherwise(""),
                F.when(F.exists(m, lambda v: F.startswith(F.lower(v), F.lit("q"))), " arranged by quarter").otherwise(""),
                F.when(F.exists(m, lambda v: F.contains(v, F.lit("%"))), " and a visible growth indicator").otherwise(""),
                F.lit("."),
            )
            told = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c, F.lit(".")))
            return F.trim(F.concat_ws(" ", base, told("Chart text details", chart_details(chart)), told("Readable labels include", named), told("Visible markers include", F.array_join(F.slice(m, 1, 6), ", ")), told("Caption hint", cap)))

        kind = F.when(large(width, height), "interface or screenshot").otherwise("image")
        general = (
            F.when((cap != "") & some, F.concat(cap, F.lit("."), readable))
            .when((cap != "") & (text != ""), F.concat(cap, F.lit(". The image also contains readable text.")))
            .when(cap != "", cap)
            .when(some, F.concat(F.lit("The "), kind, F.lit(" includes readable labels such as "), named, F.lit(".")))
            .when(text != "", READABLE)
            .otherwise(NOTHING)
        )
        return (
            F.when(scene == "settings", F.concat(F.lit("This appears to be a system settings screen"), focus, readable))
            .when(scene == "chart", let(numeric_markers(text, 8), charted))
            .when(scene == "browser", F.concat(F.lit("This appears to be a browser or website page."), details, readable))
            .when(scene == "chat", F.concat(F.lit("This appears to be a chat or messaging interface."), details, readable))
            .when(scene == "document", F.concat(F.lit("This appears to be a text-heavy document or page."), readable))
            .otherwise(general)
        )

    return let(summary_labels(scene, layout, chart, readable_labels(text, 6)), body)


def screen_description(caption: Column, summary: Column, text: Column) -> Column:
    """One sentence for a screen."""
    cap, whole, some = normalize(caption, 180), normalize(summary, 180), normalize(text, 80) != ""
    return (
        F.when((cap != "") & some, F.concat(cap, F.lit(". The screen also contains a substantial amount of readable text.")))
        .when(cap != "", cap)
        .when((whole != "") & ~whole.isin(READABLE, NOTHING), whole)
        .when(some, "The screen appears to be a text-heavy interface.")
        .otherwise(whole)
    )


def context_block(record: Column, number: Column) -> Column:
    """The lines on one image of a prompt context."""
    line = lambda label, c: F.when(c != "", F.concat(F.lit(f"- {label}: "), c))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Image "), number.cast("string"), F.lit(":")),
        line("Scene type", F.trim(text_of(record["scene"]))),
        F.concat(F.lit("- Visual summary: "), F.when(text_of(record["summary"]) != "", record["summary"]).otherwise(NOTHING)),
        line("Layout details", text_of(layout_details(record["layout"]))),
        line("Chart details", chart_details(record["chart_text"])),
        line("Visible text", normalize(record["visible_text"], 1200)),
        line("Image size", F.trim(text_of(record["size"]))),
    )


def user_context(records: DataFrame, by: list[str], pos: str, question: str | None = None, shown: int = 4, total: str | None = None) -> DataFrame:
    """One prompt context for each group of records (column `record`): the first images in full, the rest counted.

    The rank keeps all but the first few records out of the aggregation, so a group of any size is
    folded from `shown` rows and a count. total: a column with the number of images of the group, where
    records has only its first ones.
    """
    ranked = records.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(pos)))
    head = ranked.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col("_n") <= shown, F.struct(F.col("_n"), context_block(F.col("record"), F.col("_n")).alias("block"))))).alias("blocks"),
        F.greatest((F.max(total) if total else F.count("*")) - shown, F.lit(0)).alias("omitted"),
        (F.max(question) if question else F.lit("")).alias("question"),
    )
    asked = normalize(F.col("question"), 400)
    context = F.concat_ws(
        "\n",
        *map(F.lit, HEAD),
        F.when(asked != "", F.concat(F.lit("User question: "), asked)),
        F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"),
        F.when(F.col("omitted") > 0, F.concat(F.col("omitted").cast("string"), F.lit(" additional image(s) were omitted from expansion."))),
    )
    return head.select(*by, context.alias("context"))
