"""All queries of the engine by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas
from . import sqltext as q
from .functions import lexicon, repair
from .functions import text as t
from .functions.arrow import settled
from .operators import compose, lines, series
from .operators import scene as sc
from .operators.layout import chart_text, layout, marked, zones
from .plans import screens
from .plans.analysis import UNREADABLE, analyze, analyze_screens, capabilities, failure
from .plans.screens import table
from .sources import images, ocr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


def bar(a, limit: int | None = None):
    return F.array_join(a if limit is None else F.slice(a, 1, limit), "|")


N1200 = "with n as (select doc_id, text, " + q.norm("text", 1200) + " n from documents)\n"


# scalar text functions


@query(f"select doc_id, {q.norm('text', 900)} t900, {q.norm('text', 80)} t80 from documents")
def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir, t.normalize(F.col("text")).alias("t900"), t.normalize(F.col("text"), 80).alias("t80"))


@query(N1200 + f"select doc_id, {q.joined(q.labels('n'), 6)} labels from n")
def readable_labels(spark, sf_dir):
    return documents(spark, sf_dir, bar(t.readable_labels(F.col("text"))).alias("labels"))


@query(N1200 + f"select lower(l) label, count(*) n from (select unnest(({q.labels('n')})[1:6]) l from n) group by 1 order by n desc, label limit 20")
def label_topk(spark, sf_dir):
    found = documents(spark, sf_dir, F.explode(t.readable_labels(F.col("text"))).alias("l"))
    return found.groupBy(F.lower("l").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(20)


@query(N1200 + f"select doc_id, {q.joined(q.markers('n'), 8)} markers from n")
def numeric_markers(spark, sf_dir):
    return documents(spark, sf_dir, bar(t.numeric_markers(F.col("text"))).alias("markers"))


@query(f"select page_id id, {q.url_like('url')} url, {q.url_like('html')} body from pages")
def url_like(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), t.url_like(F.col("url")).alias("url"), t.url_like(F.col("html")).alias("body"))


@query(f"select doc_id, {q.url_like('text')} flag from documents")
def url_like_documents(spark, sf_dir):
    return documents(spark, sf_dir, t.url_like(F.col("text")).alias("flag"))


@query(f"select page_id, {q.stabilize("replace(url, '://', '//')")} fixed from pages")
def stabilize_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.stabilize(F.replace("url", F.lit("://"), F.lit("//"))).alias("fixed"))


_TURNS = f"with c as (select conv_id, list({q.norm('text', 240)} order by turn, role, text) a from conversations group by conv_id)\n"


@query(_TURNS + f"select conv_id, {q.joined(q.distinct('a'), 4)} texts from c")
def dedupe_texts(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("a"))
    return a.select("conv_id", bar(t.dedupe(F.col("a.text"), 4)).alias("texts"))


_LABELS = N1200 + f", l as (select distinct unnest(({q.labels('n')})[1:6]) label from n)\n"


def labels_of(spark, sf_dir):
    return documents(spark, sf_dir, F.explode(t.readable_labels(F.col("text"))).alias("label")).select("label").distinct()


@query(_LABELS + f"select label, {q.signature('label')} sign from l")
def ui_signature(spark, sf_dir):
    return labels_of(spark, sf_dir).select("label", t.signature(F.col("label")).alias("sign"))


_CANON = ", ".join(f"({k}, '{c}')" for k, c in enumerate(lexicon.CANONICALS))


def noisy(spark):
    """Known labels with letters that OCR confuses."""
    df = spark.createDataFrame([(k, c) for k, c in enumerate(lexicon.CANONICALS)], "pos int, canonical string")
    return df.select("pos", F.translate("canonical", "lios", "1I05").alias("label"))


@query(
    f"with c(pos, canonical) as (values {_CANON}), s as (select {q.signature('canonical')} sign, arg_min(canonical, pos) canonical from c group by 1), "
    + f"n as (select pos, translate(canonical, 'lios', '1I05') label from c) select n.pos, label, s.canonical from n left join s on {q.signature('label')} = s.sign"
)
def canonical_exact(spark, sf_dir):
    return repair.exact_labels(noisy(spark), "label").select("pos", "label", "canonical")


@query(
    "with recursive " + _LABELS.removeprefix("with ").rstrip() + f", n0(pos, canonical) as (values {_CANON}), l0 as (select translate(canonical, 'lios', '1I05') label from n0 union all select label from l),\n"
    + "src as (select label v, false address from l0), " + q.repaired("src") + "\nselect label, w repaired from l0 join repaired on label = v"
)
def ui_repair(spark, sf_dir):
    some = noisy(spark).select("label").unionByName(labels_of(spark, sf_dir))
    return some.select("label", repair.repair_text("label").alias("repaired"))


@query(
    "with recursive e as (select conv_id, coalesce(text, '') v, row_number() over (partition by conv_id order by turn, role, text) i from conversations), src as (select v, false address from e), "
    + q.repaired("src")
    + f",\nc as (select conv_id, list({q.norm('w', 240)} order by i) a from e join repaired using (v) group by 1) select conv_id, {q.joined(q.distinct('a'), 6)} texts from c"
)
def short_text_list(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("a"))
    return a.select("conv_id", bar(repair.repair_texts(F.col("a.text"))).alias("texts"))


@query("with recursive src as (select replace(url, '://', '//') v, true address from pages), " + q.repaired("src") + "\nselect page_id, w repaired from pages join repaired on replace(url, '://', '//') = v")
def url_repair(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", repair.repair_address(F.replace("url", F.lit("://"), F.lit("//"))).alias("repaired"))


@query(f"select doc_id, {q.signal_score('text')}::int score from documents")
def signal_score(spark, sf_dir):
    return documents(spark, sf_dir, t.signal_score(F.col("text")).alias("score"))


@query(f"select doc_id, {q.low_signal('text')} low from documents")
def low_signal(spark, sf_dir):
    return documents(spark, sf_dir, t.low_signal(F.col("text")).alias("low"))


@query(f"select doc_id, {q.line_quality('text')}::int quality from documents")
def line_quality(spark, sf_dir):
    return documents(spark, sf_dir, t.line_quality(F.col("text")).alias("quality"))


@query(
    """with a as (select n_regionkey, list(n_name order by n_name) a from nation group by 1)
select n_regionkey region, case len(a) when 0 then '' when 1 then a[1] when 2 then a[1] || ' and ' || a[2] else array_to_string(a[:-2], ', ') || ', and ' || a[-1] end names,
array_to_string(a[1:2], ' and ') two from a"""
)
def human_list(spark, sf_dir):
    a = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("a"))
    return a.select(F.col("n_regionkey").alias("region"), t.human_list(F.col("a")).alias("names"), t.human_list(F.slice("a", 1, 2)).alias("two"))


_LOW = f"with d as (select doc_id, text, lower({q.norm('text', 1600)}) low from documents)"
_WORDS = {"settings": lexicon.SETTINGS, "chart": lexicon.CHART, "browser": lexicon.BROWSER, "chat": lexicon.CHAT}


@query(_LOW + " select doc_id, " + ", ".join(f"{q.hits('low', w)}::int {n}" for n, w in _WORDS.items()) + " from d")
def keyword_hits(spark, sf_dir):
    d = documents(spark, sf_dir, F.lower(t.normalize(F.col("text"), 1600)).alias("low"))
    return d.select("doc_id", *(t.keyword_hits(F.col("low"), w).alias(n) for n, w in _WORDS.items()))


_SCENE = _LOW + f", e as (select *, {q.norm('low', 1200)} n from d), m as (select *, ({q.markers('n')})[1:8] marks from e), s as (select *, {q.scene('low', 'marks')} scene from m)\n"


@query(_SCENE + "select scene, count(*) n from s group by 1")
def scene_mix(spark, sf_dir):
    return documents(spark, sf_dir, sc.scene(F.col("text"), F.lit(1280), F.lit(720)).alias("scene")).groupBy("scene").agg(F.count("*").alias("n"))


@query(_SCENE + "select doc_id, scene from s")
def scene_documents(spark, sf_dir):
    return documents(spark, sf_dir, sc.scene(F.col("text"), F.lit(1280), F.lit(720)).alias("scene"))


@query(f"select doc_id, {q.prompt('lower(' + q.norm('text', 600) + ')')} prompt from documents")
def caption_prompt(spark, sf_dir):
    return documents(spark, sf_dir, sc.caption_prompt(F.col("text"), F.lit(1280), F.lit(720)).alias("prompt"))


@query(
    N1200
    + f", e as (select *, lower(n) low, {q.norm('lower(n)', 1200)} m0 from n), m as (select *, ({q.markers('m0')})[1:8] marks from e)\n"
    + f"select doc_id, case when n = '' or {q.low_signal('n')} or {q.scene('low', 'marks')} in ('chart', 'browser', 'chat') then true else length(n) < 64 and {q.matches('n', q.WORD)} <= 7 end wanted from m"
)
def caption_gate(spark, sf_dir):
    return documents(spark, sf_dir, sc.should_caption(F.col("text"), F.lit(1280), F.lit(720)).alias("wanted"))


@query(N1200 + f"select doc_id, case when {q.low_signal('n')} then true when length(n) >= 96 then false else len(({q.labels('n')})[1:8]) < 6 end retry, {q.low_signal('n')} small from n")
def retry_gate(spark, sf_dir):
    return documents(spark, sf_dir, sc.should_retry(F.col("text"), F.lit(1280), F.lit(720)).alias("retry"), sc.should_retry(F.col("text"), F.lit(640), F.lit(360)).alias("small"))


_TOPICS = ", ".join(f"case when {q.has_any('low', w)} then '{n}' end" for n, w in lexicon.FOCUS)


@query(
    N1200
    + f", f as (select doc_id, lower({q.norm(f"concat_ws(' ', array_to_string(({q.labels('n')})[1:6], ' '), text)", 1200)}) low from n)\n"
    + f"select doc_id, coalesce(array_to_string((list_filter([{_TOPICS}], lambda x: x is not null))[1:3], '|'), '') focus from f"
)
def settings_focus(spark, sf_dir):
    return documents(spark, sf_dir, bar(t.settings_focus(t.readable_labels(F.col("text")), F.col("text"))).alias("focus"))


# lines


def word_rows(spark, sf_dir):
    """Words of documents as an OCR table: eight a line."""
    w = documents(spark, sf_dir, F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))).alias("pos", "text"))
    row = F.floor(F.col("pos") / 8).cast("int")
    s = lambda c: c.cast("string")
    return w.select(
        "doc_id", "pos", F.lit("5").alias("level"), F.lit("1").alias("page_num"), F.lit("1").alias("block_num"), F.lit("1").alias("par_num"), s(row).alias("line_num"), s(60 + 70 * (F.col("pos") % 8)).alias("left"), s(40 + 24 * row).alias("top"), s(8 * F.length("text")).alias("width"), F.lit("18").alias("height"), "text"
    )


@query(
    rf"""with w0 as (select doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') a from documents), w as (select doc_id, unnest(a) word, unnest(generate_series(0, len(a) - 1)) pos from w0),
v as (select doc_id, pos // 8 line, pos, {q.norm('word', 80)} t, 60 + 70 * (pos % 8) x, 40 + 24 * (pos // 8) y, 8 * length(word) wide from w),
l as (select doc_id, line, min(x) x, min(y) y, max(x + wide) r, string_agg(t, ' ' order by pos) filter (t <> '') s from v group by 1, 2),
m as (select doc_id, line, x, y, r, {q.norm('s', 220)} s from l),
k as (select * from m where s <> '')
select doc_id, count(*) n_lines, sum(r - x)::bigint total_width, max(y + 18)::int lowest, {q.norm("string_agg(s, ' ' order by y, x)", 1600)} text from k group by 1"""
)
def words_to_lines(spark, sf_dir):
    found = lines.words_to_lines(word_rows(spark, sf_dir), ["doc_id"])
    wide = F.aggregate("lines", F.lit(0).cast("long"), lambda a, v: a + v["width"])
    return found.select("doc_id", F.size("lines").cast("long").alias("n_lines"), wide.alias("total_width"), F.array_max(F.transform("lines", lambda v: v["bottom"])).alias("lowest"), "text")


_PAGE_TITLE = q.norm("regexp_extract(html, '<title>([^<]*)</title>', 1)", 80)
_BROWSER = f"""with p as (select page_id id, url, {_PAGE_TITLE} title from pages),
r as (select id, 0 i, url t, 160 x, 26 y, 540 w, 24 h from p union all select id, 1, title, 460, 182, 220, 24 from p union all select id, 2, 'Email', 420, 240, 80, 20 from p
union all select id, 3, 'Password', 420, 320, 110, 20 from p union all select id, 4, 'Sign in', 490, 486, 90, 20 from p)"""
_SHOWN = "text || '@' || x || ',' || y || ',' || width || ',' || height"


def shown(ls):
    return F.array_join(F.transform(ls, lambda v: F.concat(v["text"], F.lit("@"), F.concat_ws(",", v["x"], v["y"], v["width"], v["height"]))), ";")


@query(
    _BROWSER
    + f""", s as (select id, i, {q.norm('t', 220)} text, round_even(x * (1000 / 1280::double), 0)::int x0, round_even(y * (400 / 720::double), 0)::int y0, round_even(w * (1000 / 1280::double), 0)::int w0, round_even(h * (400 / 720::double), 0)::int h0 from r),
c as (select id, i, text, greatest(0, least(999, x0)) x, greatest(0, least(399, y0)) y, w0, h0 from s where text <> ''),
e as (select id, i, text, x, y, greatest(1, least(1000 - x, w0)) width, greatest(1, least(400 - y, h0)) height from c)
select id, string_agg({_SHOWN}, ';' order by y, x, i) lines from e group by 1"""
)
def normalize_lines(spark, sf_dir):
    s = screens.browser_screens(spark, sf_dir)
    return s.select("id", shown(lines.normalize_lines(F.col("lines"), F.lit(1000), F.lit(400), F.col("width"), F.col("height"))).alias("lines"))


_ZONES = {
    "top": "y <= 158",
    "body": "y >= 72 and y <= 604",
    "bottom": "y >= 547",
    "address": "y <= 158 and (u or contains(low, 'search'))",
    "page_title": f"not (y <= 158 and (u or contains(low, 'search'))) and y <= 302 and x >= 192 and x <= 1049 and n3 >= 3 and not {q.has_any('low', lexicon.TITLE_EXCLUDED)}",
    "field": f"y >= 72 and y <= 604 and {q.has_any('low', lexicon.FIELD_TOKENS)}",
    "left_message": "y >= 72 and y <= 604 and x <= 537 and x + w <= 793 and w <= 563 and n >= 8",
    "right_message": "y >= 72 and y <= 604 and x >= 614 and w <= 512 and n >= 6",
    "input": f"y >= 547 and w >= 64 and {q.has_any('low', lexicon.INPUT_TOKENS)}",
    "sidebar": r"y >= 72 and y <= 604 and x <= 307 and w <= 281 and n <= 24 and len(regexp_extract_all(t, '[A-Za-z0-9\x{4e00}-\x{9fff}]+')) <= 3",
    "chat_title": "y <= 158 and not u and n <= 40 and x >= 320 and x <= 998 and n3 >= 2",
    "chart_title": "y <= 172 and x <= 921 and n3 >= 4 and not u",
    "x_axis": "y >= 489 and x >= 153 and n <= 18",
    "y_axis": r"x <= 230 and y >= 100 and y <= 619 and regexp_matches(t, '\p{Nd}')",
    "legend": r"x >= 691 and y <= 244 and not regexp_full_match(t, '[Qq]?\p{Nd}+(?:\.\p{Nd}+)?%?')",
}
_CHAT = f"""with c as (select conv_id id, turn, role, text raw, {q.norm('text', 40)} t from conversations),
r as (select id, turn i, role, raw, t, case role when 'system' then 560 when 'user' then 120 else 760 end x, case role when 'system' then 38 else 150 + 50 * turn end y,
case role when 'system' then 200 else least(length(t) * 8, 500) end w, case role when 'system' then 24 else 20 end h from c
union all select distinct id, 1000000, '', '', 'Type a message', 420, 660, 180, 20 from c)"""


def _zone_sql() -> str:
    # Lines are clamped as their normalisation does it.
    clamp = "greatest(0, least(1279, x)) x, greatest(0, least(719, y)) y"
    return (
        _CHAT
        + f", k as (select id, t, {clamp}, w w0 from r where t <> ''), z as (select id, t, x, y, greatest(1, least(1280 - x, w0)) w, lower(t) low, {q.url_like('t')} u, {q.matches('t', r'[A-Za-z\x{4e00}-\x{9fff}]')} n3, length(t) n from k)\nselect id, "
        + ", ".join(f"count(*) filter ({c})::int \"{n}\"" for n, c in _ZONES.items())
        + " from z group by 1"
    )


@query(_zone_sql())
def zone_counts(spark, sf_dir):
    s = screens.chat_screens(spark, sf_dir)
    m = s.select("id", marked(lines.normalize_lines(F.col("lines"), F.col("width"), F.col("height"))).alias("m"))
    z = zones(F.lit(1280), F.lit(720))
    return m.select("id", *(F.size(F.filter("m", z[n])).alias(n) for n in _ZONES))


@query(
    _BROWSER
    + """, a as (select a.id, a.i i, b.i j, a.x x, a.y y, a.w w, a.h h, b.x + 7 x2, b.y - 3 y2, b.w w2, b.h h2 from r a join r b on a.id = b.id),
o as (select *, greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) * greatest(0, least(y + h, y2 + h2) - greatest(y, y2)) / greatest(w * h, w2 * h2, 1)::double share,
abs((2 * x + w) - (2 * x2 + w2)) / 2.0::double dx, abs((2 * y + h) - (2 * y2 + h2)) / 2.0::double dy from a)
select id, i, j, round(case when share > 0.12::double then share when dx <= greatest(24, greatest(w, w2) * 0.75::double) and dy <= greatest(16, greatest(h, h2) * 2.0::double) then 0.1::double + 1.0::double / (1.0::double + dx + dy) end, 6) score from o"""
)
def line_pair_score(spark, sf_dir):
    """Pairs of one screen's lines with shifted ones, in long form."""
    s = screens.browser_screens(spark, sf_dir)
    # Blank titles stay here: the pairs are of raw boxes.
    of = lambda c, dx, dy: F.transform(c, lambda v: lines.line(v["text"], v["x"] + dx, v["y"] + dy, v["width"], v["height"]))
    a = s.select("id", F.posexplode(of(F.col("lines"), 0, 0)).alias("i", "a"), of(F.col("lines"), 7, -3).alias("bs"))
    return a.select("id", "i", "a", F.posexplode("bs").alias("j", "b")).select("id", "i", "j", F.round(lines.pair_score(F.col("a"), F.col("b")), 6).alias("score"))


# The second reading's lines are folded into the first's one by one; a line carries the quality of its text.
_MERGED = """case when share > 0.12::double then share when dx <= greatest(24, greatest(w, w2) * 0.75::double) and dy <= greatest(16, greatest(h, h2) * 2.0::double) then 0.1::double + 1.0::double / (1.0::double + dx + dy) end"""
_SCORE = (
    _MERGED.replace("share", "(greatest(0, least(a.r, b.r) - greatest(a.x, b.x)) * greatest(0, least(a.d, b.d) - greatest(a.y, b.y)) / greatest((a.r - a.x) * (a.d - a.y), (b.r - b.x) * (b.d - b.y), 1)::double)")
    .replace("dx", "(abs((a.x + a.r) - (b.x + b.r)) / 2.0::double)")
    .replace("dy", "(abs((a.y + a.d) - (b.y + b.d)) / 2.0::double)")
    .replace("greatest(w, w2)", "greatest(a.r - a.x, b.r - b.x)")
    .replace("greatest(h, h2)", "greatest(a.d - a.y, b.d - b.y)")
)


@query(
    _BROWSER.replace("with p as", "with recursive p as")
    + f""", n0 as (select id, 1 side, i, {q.norm('t', 220)} t, x, y, w, h from r union all select id, 2, i, {q.norm("translate(t, '1I0', 'lio')", 220)}, x + 5, y + 60, w, h from r),
n1 as (select id, side, i, t, x, y, least(1280, x + w) r, least(720, y + h) d, {q.line_quality('t')} q from n0 where t <> ''),
n2 as (select id, list({{'t': t, 'x': x, 'y': y, 'r': r, 'd': d, 'q': q}} order by y, x, i) filter (side = 1) one, list({{'t': t, 'x': x, 'y': y, 'r': r, 'd': d, 'q': q}} order by y, x, i) filter (side = 2) two from n1 group by 1),
f as (select id, 1 k, one acc, two from n2 union all
select id, k + 1, case when hit is null then list_append(acc, b) else list_transform(acc, lambda a, i: case when i = hit then {{'t': case when b.q > a.q then b.t else a.t end, 'x': least(a.x, b.x), 'y': least(a.y, b.y), 'r': greatest(a.r, b.r), 'd': greatest(a.d, b.d), 'q': greatest(a.q, b.q)}} else a end) end, two
from (select id, k, acc, two, b, case when list_max(scores) is not null then list_position(scores, list_max(scores)) end hit from (select id, k, acc, two, two[k] b, list_transform(acc, lambda a: {_SCORE.replace("b.", "two[k].")}) scores from f where k <= len(two)))),
g as (select id, unnest(acc) v, unnest(generate_series(1, len(acc))) i from f where k = len(two) + 1)
select id, string_agg(v.t || '@' || v.x || ',' || v.y || ',' || (v.r - v.x) || ',' || (v.d - v.y), ';' order by v.y, v.x, i) lines from g group by 1"""
)
def merge_lines(spark, sf_dir):
    s = screens.browser_screens(spark, sf_dir)
    n = lambda c: lines.normalize_lines(c, F.col("width"), F.col("height"))
    again = F.transform("lines", lambda v: screens.raw_line(F.translate(v["text"], "1I0", "lio"), v["x"] + 5, v["y"] + 60, v["width"], v["height"]))
    return s.select("id", shown(lines.merge_lines(n(F.col("lines")), n(again))).alias("lines"))


# layouts


def normalized(s):
    return s.withColumn("lines", lines.normalize_lines(F.col("lines"), F.col("width"), F.col("height")))


def layouts(s):
    read = normalized(s).select("id", settled(layout(F.col("lines"), F.col("width"), F.col("height"), F.col("text"))).alias("l"), "text")
    return read.select("id", repair.repair_layout("l").alias("l"), "text")


# Browser screens by SQL: labels here are too long or too unlike the known ones for repair to change them, so it is left out.
_PAGE = (
    _BROWSER
    + f""", l as (select id, i, {q.norm('t', 220)} t, x, y, w from r), k as (select *, lower(t) low, {q.url_like('t')} u from l where t <> ''),
pt as (select id, arg_max(t, length(t) * 100000 + w) page_title from k where not (y <= 158 and (u or contains(low, 'search'))) and y <= 302 and x >= 192 and x <= 1049
and {q.matches('t', r'[A-Za-z\x{4e00}-\x{9fff}]')} >= 3 and not {q.has_any('low', lexicon.TITLE_EXCLUDED)} group by 1),
ad as (select id, arg_max({q.stabilize('t')}, w) address_bar from k where y <= 158 and (u or contains(low, 'search')) group by 1),
fi as (select id, (list(t order by y, x, i))[1:4] f from k left join pt using (id) where y >= 72 and y <= 604 and {q.has_any('low', lexicon.FIELD_TOKENS)} and {q.norm('t', 120)} <> coalesce(page_title, '') group by 1),
tx as (select id, {q.norm("string_agg(t0, ' ' order by i)", 1600)} txt from (select id, i, t t0 from r) group by 1),
ly as (select tx.id, txt, coalesce(address_bar, '') address_bar, coalesce(page_title, '') page_title, coalesce(f, []::varchar[]) f from tx left join ad using (id) left join pt using (id) left join fi using (id)),
m0 as (select *, lower(txt) low, {q.norm('lower(txt)', 1200)} m from ly), m1 as (select *, ({q.markers('m')})[1:8] marks from m0), sc as (select *, {q.scene('low', 'marks')} sc0 from m1),
v as (select *, case when sc0 in ('ui', 'document') then 'browser' else sc0 end scene, {q.distinct("list_concat(list_concat([page_title, address_bar], []::varchar[]), f)")} seen, {q.distinct('list_concat(f, [page_title])')} named from sc),
d as (select *, concat_ws('; ', case when page_title <> '' then 'page title: ' || page_title end, case when address_bar <> '' then 'address bar: ' || address_bar end, case when len(f) > 0 then 'visible controls: ' || array_to_string(f[1:4], ', ') end) details from v)
"""
)


@query(_PAGE + "select id, 'browser' kind, address_bar, page_title, array_to_string(f, '|') fields from ly")
def browser_layout(spark, sf_dir):
    x = layouts(screens.browser_screens(spark, sf_dir))
    return x.select("id", "l.kind", "l.address_bar", "l.page_title", bar(F.col("l.field_labels")).alias("fields"))


_MESSAGES = f"""{_CHAT}, k as (select *, {q.stabilize('t')} s from r where t <> '' and y >= 72 and y <= 604 and i < 1000000),
lf as (select id, (list(s order by y, x, i, role, raw))[1:4] a from k where x <= 537 and x + w <= 793 and w <= 563 and length(t) >= 8 group by 1),
rt as (select id, (list(s order by y, x, i, role, raw))[1:4] a from k where x >= 614 and least(w, 1280 - x) <= 512 and length(t) >= 6 group by 1)
select ids.id, {q.joined(q.distinct("coalesce(lf.a, []::varchar[])"), 4)} left_messages, {q.joined(q.distinct("coalesce(rt.a, []::varchar[])"), 4)} right_messages
from (select distinct conv_id id from conversations) ids left join lf using (id) left join rt using (id)"""


@query(_MESSAGES)
def chat_messages(spark, sf_dir):
    s = normalized(screens.chat_screens(spark, sf_dir))
    z = zones(F.lit(1280), F.lit(720))
    m = s.select("id", marked(F.col("lines")).alias("m"))
    texts = lambda n: bar(t.dedupe(F.transform(F.slice(F.filter("m", z[n]), 1, 4), lambda v: t.stabilize(v["text"])), 4))
    return m.select("id", texts("left_message").alias("left_messages"), texts("right_message").alias("right_messages"))


def _talk() -> str:
    """CTEs that end with ly: the layout of each conversation's screen (a browser's if it has an address), short texts repaired."""
    when = {n: f"filter ({c})" for n, c in _ZONES.items()}
    least = lambda order, zone: f"coalesce((list(t order by {order}, ord) {when[zone]})[1], '')"
    return (
        _CHAT.replace("with c as", "with recursive c as")
        + f""", z0 as (select id, i, role, raw, {q.norm('t', 220)} t, greatest(0, least(1279, x)) x, greatest(0, least(719, y)) y, w w0 from r where t <> ''),
z as (select *, greatest(1, least(1280 - x, w0)) w, lower(t) low, {q.url_like('t')} u, {q.matches('t', r'[A-Za-z\x{4e00}-\x{9fff}]')} n3, length(t) n, row_number() over (partition by id order by y, x, i, role, raw) ord from z0),
tx as (select id, {q.norm("string_agg(t, ' ' order by i, role, raw)", 1600)} txt from r group by 1),
b0 as (select id, (list(t order by w desc, ord) {when['address']})[1] address, {least('n desc, w desc', 'page_title')} page_title, list(t order by ord) {when['field']} fields, {least('y, w desc', 'chat_title')} title, {least('0', 'input')} hint,
coalesce(list({q.stabilize('t')} order by ord) {when['left_message']}, []) lefts, coalesce(list({q.stabilize('t')} order by ord) {when['right_message']}, []) rights, coalesce(list(t order by ord) {when['sidebar']}, []) sides from z group by 1),
b1 as (select *, case when address is not null or (contains(lower(txt), 'browser') and fields is not null) then 'browser' else 'chat' end kind from b0 join tx using (id)),
b2 as (select id, txt, kind, case when kind = 'browser' then coalesce(address, '') else '' end address, case when kind = 'browser' then page_title else '' end page_title,
case when kind = 'browser' then (list_filter(coalesce(fields, []), lambda f: {q.norm('f', 120)} <> page_title))[1:4] else [] end fields, case when kind = 'chat' then title else '' end title, case when kind = 'chat' then hint else '' end hint,
case when kind = 'chat' then {q.distinct('lefts[1:4]')} else [] end lefts, case when kind = 'chat' then {q.distinct('rights[1:4]')} else [] end rights, case when kind = 'chat' then sides[1:4] else [] end sides from b1),
el as (select id, 'f' part, unnest(fields) v, unnest(generate_series(1, len(fields))) i from b2 union all select id, 's', unnest(sides), unnest(generate_series(1, len(sides))) from b2),
src as (select address v, true address from b2 union select page_title, false from b2 union select title, false from b2 union select hint, false from b2 union select v, false from el), """
        + q.repaired("src")
        + f""",
fw as (select id, part, list({q.norm('w', 240)} order by i) ws from el join repaired on el.v = repaired.v and not address group by 1, 2), fx as (select id, part, {q.distinct('ws')} a from fw),
ly as (select b2.id, txt, kind, ra.w address_bar, rp.w page_title, coalesce(ff.a, [])[1:4] f, rt.w title, lefts, rights, rh.w hint, coalesce(fs.a, [])[1:4] sides from b2 join repaired ra on ra.v = b2.address and ra.address join repaired rp on rp.v = b2.page_title and not rp.address
join repaired rt on rt.v = b2.title and not rt.address join repaired rh on rh.v = b2.hint and not rh.address left join fx ff on ff.id = b2.id and ff.part = 'f' left join fx fs on fs.id = b2.id and fs.part = 's'),
dt as (select *, case kind when 'browser' then concat_ws('; ', case when page_title <> '' then 'page title: ' || {q.stabilize('page_title')} end, case when address_bar <> '' then 'address bar: ' || {q.stabilize('address_bar')} end, case when len(f) > 0 then 'visible controls: ' || array_to_string(f, ', ') end)
else concat_ws('; ', case when title <> '' then 'chat title: ' || {q.stabilize('title')} end, case when len(lefts) > 0 and len(rights) > 0 then 'messages appear on both left and right sides' when len(lefts) > 0 then 'messages are visible on the left side' end,
case when hint <> '' then 'composer: ' || {q.stabilize('hint')} end, case when len(sides) > 0 then 'sidebar items: ' || array_to_string(sides[1:3], ', ') end) end details from ly)
"""
    )


_TALK = _talk()


@query(_TALK + "select id, kind, title, array_to_string(lefts, '|') left_messages, array_to_string(rights, '|') right_messages, hint input_hint, array_to_string(sides, '|') sidebar from ly")
def chat_layout(spark, sf_dir):
    x = layouts(screens.chat_screens(spark, sf_dir))
    return x.select("id", "l.kind", "l.title", bar(F.col("l.left_messages")).alias("left_messages"), bar(F.col("l.right_messages")).alias("right_messages"), "l.input_hint", bar(F.col("l.sidebar_labels")).alias("sidebar"))


@query("select distinct c_mktsegment id, 'Revenue Dashboard ' || c_mktsegment title, 'Q1|Q2|Q3|Q4' x, '80k|60k|40k|20k' y, '' legend from orders join customer on o_custkey = c_custkey")
def chart_labels(spark, sf_dir):
    x = normalized(screens.chart_screens(spark, sf_dir)).select("id", chart_text(F.col("lines"), F.col("width"), F.col("height")).alias("c"))
    return x.select("id", "c.title", bar(F.col("c.x_axis_labels")).alias("x"), bar(F.col("c.y_axis_labels")).alias("y"), bar(F.col("c.legend_labels")).alias("legend"))


@query("select distinct c_mktsegment id, 'title: Revenue Dashboard ' || c_mktsegment || '; x-axis: Q1, Q2, Q3, Q4; y-axis: 80k, 60k, 40k, 20k' details from orders join customer on o_custkey = c_custkey")
def chart_details(spark, sf_dir):
    x = normalized(screens.chart_screens(spark, sf_dir)).select("id", chart_text(F.col("lines"), F.col("width"), F.col("height")).alias("c"))
    return x.select("id", compose.chart_details(F.col("c")).alias("details"))


@query(
    "with pages0 as (" + _PAGE + "select 'page ' || id id, details from d), talks as (" + _TALK + "select 'talk ' || id id, details from dt) select * from pages0 union all select * from talks"
)
def layout_details(spark, sf_dir):
    parts = [layouts(f(spark, sf_dir)).select(F.concat(F.lit(n), F.col("id").cast("string")).alias("id"), compose.layout_details(F.col("l")).alias("details")) for n, f in (("page ", screens.browser_screens), ("talk ", screens.chat_screens))]
    return parts[0].unionByName(parts[1])


@query(_PAGE + f"select id, {q.norm("array_to_string(seen[1:10], '; ')", 1200)} visible, array_to_string(named[1:6], '|') labels from d")
def visible_text(spark, sf_dir):
    x = layouts(screens.browser_screens(spark, sf_dir))
    none = F.lit(None).cast(schemas.CHART_TEXT)
    return x.select("id", compose.visible_text(F.lit("browser"), F.col("l"), none, F.col("text")).alias("visible"), bar(compose.summary_labels(F.lit("browser"), F.col("l"), none, t.readable_labels(F.col("text")))).alias("labels"))


# records

_QUARTERS = """with r as (select c_mktsegment segment, (year(o_orderdate) * 4 + quarter(o_orderdate))::int q, -round(sum(o_totalprice::decimal(18, 2)))::bigint y from orders join customer on o_custkey = c_custkey group by 1, 2),
d as (select *, y - lag(y) over (partition by segment order by q) d from r),
g as (select segment, arg_min(y, q) a, arg_max(y, q) b, count(*) filter (d > 0) u, count(*) filter (d < 0) w, count(*) n from d group by 1)
select segment, case when n < 2 or abs(b - a) < 1 then '' when b < a and w >= u then 'upward' when b > a and u >= w then 'downward' else '' end trend from g"""


def flat_record(df, *columns):
    keep = [f"record.{c}" for c in ("ok", "scene", "visible_text", "summary", "size")]
    return df.select(*columns, *keep)


_PAGE_SUMMARY = "'This appears to be a browser or website page. Layout details: ' || details || '. Readable labels include: ' || array_to_string(named[1:6], ', ') || '.'"
_PAGE_RECORD = f"true ok, scene, {q.norm("array_to_string(seen[1:10], '; ')", 1200)} visible_text, {_PAGE_SUMMARY} summary, '1280x720' size"


@query(_PAGE + f"select id, {_PAGE_RECORD} from d")
def browser_analysis(spark, sf_dir):
    return flat_record(analyze_screens(screens.browser_screens(spark, sf_dir)), "id")


@query(
    _TALK
    + f""", m0 as (select *, lower(txt) low, {q.norm('lower(txt)', 1200)} m from dt), m1 as (select *, ({q.markers('m')})[1:8] marks from m0), m2 as (select *, {q.scene('low', 'marks')} sc0, {q.norm('txt', 1200)} n from m1),
m3 as (select *, case when sc0 in ('ui', 'document') then kind else sc0 end scene, case kind when 'browser' then ({q.distinct('list_concat([page_title, address_bar], f)')})[1:10] else ({q.distinct('list_concat(list_concat(list_concat(list_concat([title], sides), lefts), rights), [hint])')})[1:12] end seen,
({q.labels('n')})[1:6] readable from m2),
m4 as (select *, ({q.distinct("case scene when 'browser' then list_concat(f, [page_title]) else list_concat(sides, [hint, title]) end")})[1:6] named0 from m3), m5 as (select *, case when len(named0) > 0 then named0 else readable end named from m4)
select id, true ok, scene, {q.norm("array_to_string(seen, '; ')", 1200)} visible_text, case scene when 'browser' then 'This appears to be a browser or website page.' else 'This appears to be a chat or messaging interface.' end
|| case when details <> '' then ' Layout details: ' || details || '.' else '' end || case when len(named) > 0 then ' Readable labels include: ' || array_to_string(named, ', ') || '.' else '' end summary, '1280x720' size from m5"""
)
def chat_analysis(spark, sf_dir):
    return flat_record(analyze_screens(screens.chat_screens(spark, sf_dir)), "id")


@query(
    "with t as (" + _QUARTERS + """)
select segment id, true ok, 'chart' scene, 'Revenue Dashboard ' || segment || '; Q1; Q2; Q3; Q4; 80k; 60k; 40k; 20k' visible_text,
'This looks like a dashboard featuring a line chart' || case when trend = '' then '' else ' with ' || case trend when 'upward' then 'an' else 'a' end || ' ' || trend || ' left-to-right trend' end
|| ' arranged by quarter. Chart text details: title: Revenue Dashboard ' || segment || '; x-axis: Q1, Q2, Q3, Q4; y-axis: 80k, 60k, 40k, 20k. Readable labels include: Revenue Dashboard ' || segment || ', Q1, Q2, Q3, Q4. Visible markers include: Q1, Q2, Q3, Q4, 80k, 60k.' summary,
'1280x800' size from t"""
)
def chart_analysis(spark, sf_dir):
    return flat_record(analyze_screens(screens.chart_screens(spark, sf_dir)), "id")


_NAMED = "array_to_string(labels, ', ')"
_DOC_SUMMARY = (
    _SCENE.rstrip()
    + f", g as (select doc_id, text, {q.norm('text', 1200)} n, scene from s), h as (select *, ({q.labels('n')})[1:6] labels from g)\n"
    + f"select doc_id, case when scene = 'document' then 'This appears to be a text-heavy document or page.' || (case when len(labels) > 0 then ' Readable labels include: ' || {_NAMED} || '.' else '' end) "
    + f"when len(labels) > 0 then 'The interface or screenshot includes readable labels such as ' || {_NAMED} || '.' when text <> '' then 'The image contains readable text.' else 'Unable to extract stable detail from the image.' end summary from h where scene in ('document', 'ui')"
)


@query(_DOC_SUMMARY)
def document_summary(spark, sf_dir):
    """Summaries of documents as screens without lines."""
    d = documents(spark, sf_dir, "text", settled(sc.scene(F.col("text"), F.lit(1280), F.lit(720))).alias("scene")).where(F.col("scene").isin("document", "ui"))
    none = [F.lit(None).cast(k) for k in (schemas.LAYOUT, schemas.CHART_TEXT, schemas.CHART_VISUAL)]
    return d.select("doc_id", compose.summary(F.col("scene"), F.col("text"), F.lit(1280), F.lit(720), *none).alias("summary"))


@query(_PAGE + f"select id, {q.norm(_PAGE_SUMMARY, 180)} description from d")
def screen_description(spark, sf_dir):
    r = analyze_screens(screens.browser_screens(spark, sf_dir))
    return r.select("id", compose.screen_description(F.col("record.caption"), F.col("record.summary"), F.col("record.ocr_text")).alias("description"))


_CONTEXT_HEAD = "\n".join(compose.HEAD).replace("'", "''")


@query(
    _PAGE
    + f""", e as (select id // 10 context_id, id, details, {_PAGE_RECORD} from d), n as (select *, row_number() over (partition by context_id order by id) n, count(*) over (partition by context_id) total from e),
b as (select context_id, total, n, 'Image ' || n || ':' || chr(10) || '- Scene type: ' || scene || chr(10) || '- Visual summary: ' || summary || chr(10) || '- Layout details: ' || details || chr(10) || '- Visible text: ' || visible_text || chr(10) || '- Image size: ' || size s from n where n <= 4)
select context_id, '{_CONTEXT_HEAD}' || chr(10) || 'User question: What is shown?' || chr(10) || string_agg(s, chr(10) order by n) || case when max(total) > 4 then chr(10) || (max(total) - 4) || ' additional image(s) were omitted from expansion.' else '' end context from b group by 1"""
)
def user_context(spark, sf_dir):
    """One prompt context for ten pages each: the first four in full."""
    r = analyze_screens(screens.browser_screens(spark, sf_dir)).withColumn("context_id", F.floor(F.col("id") / 10).cast("long")).withColumn("question", F.lit("What is  shown?"))
    return compose.user_context(r, ["context_id"], "id", "question")


@query(
    """with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn, role, text) n, count(*) over (partition by conv_id) total from conversations)
select conv_id, list(turn order by n) filter (n <= 4) turns, max(greatest(total - 4, 0))::bigint omitted from c group by 1"""
)
def first_images(spark, sf_dir):
    """The first four of each group, the rest counted."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w))
    a = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= 4, F.struct("n", "turn")))).alias("a"), F.greatest(F.count("*") - 4, F.lit(0)).alias("omitted"))
    return a.select("conv_id", F.col("a.turn").alias("turns"), "omitted")


# series

_BINS = "with b as (select date_trunc('hour', ts) h, count(*) n from events group by 1), s as (select row_number() over (order by h) - 1 pos, n from b)\n"


def hours(spark, sf_dir):
    """Events by hour, in order, as one series: a bin is one row after the aggregation."""
    b = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    return series.ranked(b, [], ["h"]).drop("_total")


@query(_BINS.rstrip() + ", a as (select pos, pos - row_number() over (order by pos) run from s where n > 12) select min(pos)::bigint \"start\", max(pos)::bigint \"end\" from a group by run having count(*) >= 2")
def active_segments(spark, sf_dir):
    return series.active_segments(hours(spark, sf_dir), [], "pos", "n", 12, 2)


@query(
    """with d as (select user_id, date_trunc('day', ts) d, count(*) n from events group by 1, 2), s as (select user_id, row_number() over (partition by user_id order by d) - 1 pos, n from d),
a as (select user_id, pos, pos - row_number() over (partition by user_id order by pos) run from s where n > 1)
select user_id, min(pos)::int "start", max(pos)::int "end" from a group by user_id, run having count(*) >= 1"""
)
def active_segments_array(spark, sf_dir):
    """The same over one array a user."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n"))
    a = d.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("a"))
    return a.select("user_id", F.explode(series.segments_of(F.col("a.n"), F.lit(1), F.lit(1))).alias("s")).select("user_id", "s.start", "s.end")


@query(_QUARTERS)
def trend_direction(spark, sf_dir):
    return series.direction(screens.quarterly(spark, sf_dir).withColumn("y", -F.col("revenue")), ["segment"], "quarter", "y", 1.0)


@query(_QUARTERS)
def trend_direction_array(spark, sf_dir):
    a = screens.quarterly(spark, sf_dir).groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("quarter", "revenue"))).alias("a"))
    return a.select("segment", series.direction_of(F.transform("a", lambda v: -v["revenue"]), F.lit(1.0)).alias("trend"))


@query(
    """with b as (select event_type, ntile(8) over (partition by event_type order by ts, event_id) bin, value from events)
select event_type, bin::int bin, count(*) n, round(avg(value), 4) centre from b group by 1, 2"""
)
def equal_bins(spark, sf_dir):
    """Rows are added up in order within a bin: the mean of doubles depends on it."""
    e = series.equal_bins(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"])
    return e.repartition("event_type", "bin").sortWithinPartitions("event_type", "bin", "ts", "event_id").groupBy("event_type", "bin").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("centre"))


# images, OCR, records of failures


@query("select sha256(coalesce(text, '')) digest, min(doc_id) first_id, count(*) copies from documents group by 1")
def digest_dedupe(spark, sf_dir):
    d = documents(spark, sf_dir, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("select doc_id, sha256(coalesce(text, '')) digest, strlen(coalesce(text, '')) bytes from documents")
def base64_input(spark, sf_dir):
    """Bytes that come as data URLs are the bytes themselves."""
    url = F.concat(F.lit("data:image/png;base64,"), F.base64(F.coalesce("text", F.lit("")).cast("binary")))
    d = documents(spark, sf_dir, url.alias("img")).select("doc_id", F.coalesce(images.base64_bytes("img"), F.lit(b"")).alias("content"))
    return d.select("doc_id", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("bytes"))


@query(f"select region.r_regionkey id, false ok, '{UNREADABLE}' summary, '' scene, '' digest, '' size, true no_layout from region")
def failure_rows(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), failure(UNREADABLE).alias("record"))
    return r.select("id", "record.ok", "record.summary", "record.scene", "record.digest", "record.size", F.col("record.layout").isNull().alias("no_layout"))


@query("select false windows_ocr, true tesseract_ocr, false caption, true full_analysis, true \"any\"")
def capability_row(spark, sf_dir):
    return capabilities(spark, windows=False, tesseract=True, caption=False)


@query(
    """with s(w, t) as (values (false, false), (false, true), (true, false), (true, true)), p(preference) as (values ('auto'), ('windows'), ('tesseract'))
select preference, w, t, case when preference <> 'tesseract' and w then 'windows' when preference <> 'windows' and t then 'tesseract' else '' end backend from p, s"""
)
def backend_choice(spark, sf_dir):
    rows = [(p, w, x, ocr.choose_backend(p, w, x)) for p in ("auto", "windows", "tesseract") for w in (False, True) for x in (False, True)]
    return spark.createDataFrame(rows, "preference string, w boolean, t boolean, backend string")


_RETRY = f"""with d as (select doc_id, {q.norm('text', 120)} one from documents), e as (select a.doc_id, a.one, b.one two from d a left join d b on b.doc_id = a.doc_id + 1)
select doc_id, case when {q.signal_score('two')} > {q.signal_score('one')} then coalesce(two, '') else one end best from e"""


@query(_RETRY)
def retry_best_text(spark, sf_dir):
    """Each document's text against the next one's as second reading."""
    one = documents(spark, sf_dir, t.normalize(F.col("text"), 120).alias("one"))
    two = one.select((F.col("doc_id") - 1).alias("doc_id"), F.col("one").alias("two"))
    both = one.join(two, "doc_id", "left").withColumn("two", F.coalesce("two", F.lit("")))
    return both.select("doc_id", F.when(t.signal_score(F.col("two")) > t.signal_score(F.col("one")), F.col("two")).otherwise(F.col("one")).alias("best"))


@query("select doc_id, 1 lines, length(coalesce(text, ''))::int chars, 'plain output' plain from documents")
def words_to_json(spark, sf_dir):
    """A JSON payload of an OCR engine, and one that is none."""
    payload = F.to_json(F.struct(F.col("text"), F.array(screens.raw_line("Email", 1, 2, 3, 4)).alias("lines")))
    d = documents(spark, sf_dir, "text")
    r = d.select("doc_id", ocr.from_json(payload, "windows").alias("good"), ocr.from_json(F.lit("plain output"), "windows").alias("bad"))
    return r.select("doc_id", F.size("good.lines").alias("lines"), F.length("good.text").alias("chars"), F.col("bad.text").alias("plain"))


# What the drawn images are.
_DRAWN = "(values ('bar_up', true, 1280, 800, 'bar', 'upward', 4), ('bar_up_copy', true, 1280, 800, 'bar', 'upward', 4), ('bar_down', true, 1280, 800, 'bar', 'downward', 4), ('line_up', true, 1280, 800, 'line', 'upward', 1), ('line_down', true, 1280, 800, 'line', 'downward', 1), ('plain', true, 640, 660, null, null, null), ('broken', false, 0, 0, null, null, null), ('empty', false, 0, 0, null, null, null)) d(name, ok, width, height, kind, trend, series_count)"


@query(f"select name, ok, width, height from {_DRAWN}")
def decode_image(spark, sf_dir):
    return screens.drawn(spark).select("name", images.inspect("content").alias("i")).select("name", "i.ok", "i.width", "i.height")


@query(f"select name, kind, trend, series_count from {_DRAWN}")
def chart_visual_images(spark, sf_dir):
    return screens.drawn(spark).select("name", images.inspect("content").alias("i")).select("name", "i.chart_visual.kind", "i.chart_visual.trend", "i.chart_visual.series_count")


@query(f"with s as (select *, least(2.0::double, 2560 / width::double, 1920 / height::double) s from {_DRAWN} where ok) select name, ok, round_even(width * s, 0)::int width, round_even(height * s, 0)::int height from s union all select name, false, 0, 0 from {_DRAWN} where not ok")
def retry_image(spark, sf_dir):
    r = screens.drawn(spark).select("name", images.retry_png("content").alias("png"))
    return r.select("name", images.inspect("png").alias("i")).select("name", "i.ok", "i.width", "i.height")


@query(
    f"""select name, ok, case when not ok then '' when kind is null then 'image' else 'chart' end scene, '' visible_text,
case when not ok then '{UNREADABLE}' when kind is null then '{compose.NOTHING}' else 'This looks like a dashboard featuring a ' || kind || ' chart with ' || case trend when 'upward' then 'an ' else 'a ' end || trend || ' left-to-right trend.' end summary,
case when ok then width || 'x' || height else '' end size from {_DRAWN}"""
)
def image_analysis(spark, sf_dir):
    return flat_record(analyze(spark, screens.drawn(spark), provider=ocr.empty), "name")
