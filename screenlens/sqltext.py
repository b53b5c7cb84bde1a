"""DuckDB SQL for the text functions, written on its own: the queries are held against it."""

from __future__ import annotations

from .functions import lexicon

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
WORD = "[A-Za-z][A-Za-z0-9-]{2,}"
CJK = r"[\x{4e00}-\x{9fff}]"
EDGE = r"[^\p{L}\p{N}_]"


def norm(e: str, limit: int = 900) -> str:
    t = f"trim(regexp_replace(coalesce({e}, ''), '{WS}', ' ', 'g'))"
    return f"(case when length({t}) <= {limit} then {t} else rtrim(substr({t}, 1, {limit - 3})) || '...' end)"


def has_any(e: str, tokens) -> str:
    return "(" + " or ".join(f"contains({e}, '{t}')" for t in tokens) + ")"


def hits(e: str, tokens) -> str:
    return "(" + " + ".join(f"contains({e}, '{t}')::int" for t in tokens) + ")"


def matches(e: str, pattern: str) -> str:
    return f"len(regexp_extract_all({e}, '{pattern}'))"


def distinct(a: str) -> str:
    """First spellings of a list, without empty strings."""
    f = f"list_filter({a}, lambda v: v <> '')"
    return f"list_filter({f}, lambda v, i: list_position(list_transform({f}, lambda z: lower(z)), lower(v)) = i)"


def joined(a: str, limit: int, sep: str = "|") -> str:
    return f"coalesce(array_to_string(({a})[1:{limit}], '{sep}'), '')"


def labels(n: str) -> str:
    """Readable labels of a text normalised to 1200."""
    stop = ", ".join(f"'{w}'" for w in lexicon.STOP_LABELS)
    return distinct(f"list_filter(regexp_extract_all({n}, '{WORD}'), lambda w: lower(w) not in ({stop}))")


def markers(n: str) -> str:
    """Numeric markers of a text normalised to 1200. Separators are doubled where matches would share one."""
    twice = rf"regexp_replace({n}, '({EDGE})', '\1\1', 'g')"
    parts = [
        f"regexp_extract_all({twice}, '(?:^|{EDGE})([Qq][1-4])(?:$|{EDGE})', 1)",
        rf"regexp_extract_all({n}, '[+-]?\d+(?:\.\d+)?\s*%')",
        rf"regexp_extract_all({n}, '(\d+(?:\.\d+)?\s*[kKmMgG])(?:$|{EDGE})', 1)",
        rf"regexp_extract_all({twice}, '(?:^|{EDGE})(\d{{2,4}})(?:$|{EDGE})', 1)",
    ]
    every = parts[0]
    for p in parts[1:]:
        every = f"list_concat({every}, {p})"
    return distinct(f"list_transform({every}, lambda m: trim(m))")


def url_like(e: str) -> str:
    t = f"lower({norm(e, 240)})"
    dots = f"(length({t}) - length(replace({t}, '.', '')))"
    return rf"({has_any(t, lexicon.URL_TOKENS)} or (contains({t}, '.') and (contains({t}, '/') or contains({t}, '\'))) or ({dots} >= 2 and not contains({t}, ' ')))"


def stabilize(e: str) -> str:
    return rf"regexp_replace(replace({norm(e, 240)}, '\', '/'), '^(?i)(https?)//', '\1://')"


def signature(e: str) -> str:
    return rf"translate(regexp_replace(lower({norm(e, 240)}), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', '', 'g'), 'ilosb', '11058')"


def score_of(t: str) -> str:
    return rf"(length({t}) + 9 * {matches(t, WORD)} + 4 * {matches(t, CJK)} + 2 * {matches(t, r'\p{Nd}')})"


def signal_score(e: str) -> str:
    return score_of(norm(e, 1600))


def low_signal(e: str) -> str:
    t = norm(e, 1600)
    return f"(case when {t} = '' then true when {matches(t, CJK)} >= 6 then false when {matches(t, WORD)} >= 5 and length({t}) >= 32 then false else {score_of(t)} < 72 end)"


def line_quality(e: str) -> str:
    t = norm(e, 240)
    latin, cjk, digits = matches(t, "[A-Za-z]"), matches(t, CJK), matches(t, r"\p{Nd}")
    weird = matches(t, r"[^A-Za-z0-9\s:/._%+\-()\x{4e00}-\x{9fff}]")
    return f"(case when {t} = '' then -1000 else length({t}) + 4 * {latin} + 4 * {cjk} + 2 * {digits} - 6 * {weird} + (case when {url_like(e)} then 18 else 0 end) - (case when {latin} + {cjk} <= 1 and {digits} <= 1 then 20 else 0 end) end)"


def scene(low: str, marks: str, w: int = 1280, h: int = 720) -> str:
    """Scene from columns: the lower-case text normalised to 1600 and its markers (first 8)."""
    big = "true" if w >= 900 and h >= 500 else "false"
    charted = f"({hits(low, lexicon.CHART)} >= 1 and (len({marks}) >= 3 or len(list_filter({marks}, lambda m: starts_with(m, 'q'))) > 0 or contains({low}, 'dashboard')))"
    return f"""(case when {low} = '' then (case when {big} then 'ui' else 'image' end) when {charted} then 'chart' when {hits(low, lexicon.SETTINGS)} >= 2 then 'settings'
when {hits(low, lexicon.BROWSER)} >= 2 then 'browser' when {hits(low, lexicon.CHAT)} >= 2 then 'chat'
when {big} and ({matches(low, WORD)} >= 18 or {matches(low, CJK)} >= 32) then 'document' when {big} then 'ui' else 'image' end)"""


def prompt(low: str, big: bool = True) -> str:
    return f"""(case when {has_any(low, lexicon.SETTINGS)} then 'a computer settings screen showing' when {has_any(low, lexicon.CHART)} then 'a dashboard or chart showing'
when {has_any(low, lexicon.BROWSER)} then 'a browser window showing' when {has_any(low, lexicon.CHAT)} then 'a chat window showing' else '{'a desktop app window showing' if big else 'a screenshot of'}' end)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: How alike signatures must be, by length.
ENOUGH = "(case when length(s) >= 10 then 0.84::double when length(s) >= 7 then 0.88::double when length(s) >= 5 then 0.9::double else 0.96::double end)"


def known_labels(source: str) -> str:
    """CTEs, to follow `with recursive`, that end with known(x, label) for the texts x of a source.

    Similarity is Ratcliff-Obershelp: the longest common piece (the first in x, then in the label), and the same left and
    right of it. Letters in common bound it from above, which leaves few pairs to take apart.
    """
    values = ", ".join(f"({k}, {quoted(c)})" for k, c in enumerate(lexicon.CANONICALS))
    longest = "list_max(list_filter(range(0, least(length(a) - i + 1, length(b) - j + 1) + 1), lambda n: substr(a, i, n) = substr(b, j, n)))"
    best = f"list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(b) + 1), lambda j: {{'k': {longest}, 'i': -i, 'j': -j}}))))"
    return f"""k0(pos, label) as (values {values}), k1 as (select pos, label, {signature('label')} o from k0), k2 as (select o, arg_min(label, pos) label from k1 group by 1),
k3 as (select distinct x, {signature('x')} s from {source}), k4 as (select k3.*, k2.label same from k3 left join k2 on s = o where s <> ''),
k5 as (select x, s, pos, label, o from k4, k1 where same is null and abs(length(s) - length(o)) <= greatest(2, length(o) // 3)),
k6 as (select * from k5 where 2 * list_sum(list_transform(list_distinct(string_split(s, '')), lambda c: least(length(s) - length(replace(s, c, '')), length(o) - length(replace(o, c, ''))))) / (length(s) + length(o))::double >= {ENOUGH}),
k7 as (select x, pos, s a, o b, 0::bigint k from k6 union all
select x, pos, unnest([substr(a, 1, -m.i - 1), substr(a, -m.i + m.k)]), unnest([substr(b, 1, -m.j - 1), substr(b, -m.j + m.k)]), unnest([m.k, 0]) from (select x, pos, a, b, {best} m from k7 where a <> '' and b <> '') where m.k > 0),
k8 as (select x, pos, 2.0::double * sum(k) / any_value(length(s) + length(o)) ratio, any_value(s) s, any_value(label) label from k7 join k6 using (x, pos) group by 1, 2),
k9 as (select x, label, row_number() over (partition by x order by ratio desc, pos) n from k8 where ratio >= {ENOUGH}),
known as (select x, same label from k4 where same is not null union all select x, label from k9 where n = 1)"""


def repaired(source: str) -> str:
    """CTEs that end with repaired(v, address, w): the texts of source(v, address) with what OCR misread put right."""
    url = r"^((?i)https?://)?([^/\s]+)(/[^?\s#]*)?(.*)$"
    return f"""r0 as (select distinct v, address, {stabilize('v')} t from {source}),
r1 as (select v, address, t, t <> '' and (address or {url_like('t')}) u, not (t = '' or address or {url_like('t')}) and length(t) <= 80 and not (regexp_matches(t, '{CJK}') and regexp_matches(t, '[A-Za-z]')) short from r0),
r2 as (select v, address, case when regexp_matches(t, '^(?i)https?:/([^/]|$)') then lower(regexp_extract(t, '^(?i)https?')) || '://' || regexp_replace(t, '^(?i)https?:/', '') else t end t from r1 where u),
r3 as (select v, address, t, regexp_matches(t, '{url}') fits, regexp_extract(t, '{url}', 1) scheme, regexp_extract(t, '{url}', 2) host, string_split(regexp_extract(t, '{url}', 3), '/') path, regexp_extract(t, '{url}', 4) rest from r2),
r4 as (select v, address, unnest(path) p, unnest(generate_series(1, len(path))) i from r3), r5 as (select v, address, i, trim(p) p, replace(replace(trim(p), '-', ' '), '_', ' ') x from r4),
r6 as (select x from r5 union select t from r1 where short), {known_labels('r6')},
r7 as (select v, address, string_agg(coalesce(replace(lower(label), ' ', ''), p), '/' order by i) path from r5 left join known using (x) group by 1, 2),
repaired as (select v, address, case when fits then scheme || host || r7.path || rest else t end w from r3 join r7 using (v, address)
union all select v, address, coalesce(label, t) from r1 left join known on t = x and short where not u)"""
