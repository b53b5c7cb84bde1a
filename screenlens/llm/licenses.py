"""Licence scan by sentence rules, with Spark SQL functions alone.

A text is cut into sentences at full stops, question and exclamation marks before white space and at lines without letters
or digits; other line breaks only wrap lines. A sentence is normalised (letters a-z and digits, so comment marks at
line starts go) and the known licence sentences are looked for in it, the longest first, at word borders: a notice may
follow a heading or run on into other text. The identifiers found, in order, form a sequence in
which unknown text leaves no gap. The ordered rules are tried one after another: a rule whose
identifiers stand in the sequence one after another names a licence and takes them, so that a
longer licence is seen before a shorter one that it contains.

Defined results: null, empty and other texts without known sentences have an empty sequence, no
licence and kind `none`; known sentences that no rule takes give kind `unknown`; a licence found
several times is named once; of rules that apply to the same identifiers the earlier one wins; texts are read whole,
whatever their length; an empty table gives an empty one; repeated rows are judged each for itself; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and normalised form of the licence sentences, from the public licence texts and SPDX names; * stands for twelve words at most.
SENTENCES = (
    ("apache2-line", "licensed under the apache license version 2 0"),
    ("apache2-line", "licensed under the apache license version 2 0 the license"),
    ("apache2-line", "this project is licensed under the apache license version 2 0"),
    ("apache2-use", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at"),
    ("apache2-asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-line", "released under the mit license"),
    ("mit-line", "licensed under the mit license"),
    ("mit-line", "this project is licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("asis", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc-line", "licensed under the isc license"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd2-line", "licensed under the bsd 2 clause license"),
    ("bsd3-line", "licensed under the bsd 3 clause license"),
    ("gpl2-line", "this work is licensed under the gnu general public license version 2"),
    ("gpl3-line", "this work is licensed under the gnu general public license version 3"),
    ("gpl2-line", "licensed under the gnu general public license version 2"),
    ("gpl3-line", "licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software"),
    ("gpl2-terms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl3-terms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl21-terms", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3-terms", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl3-terms", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl3-line", "licensed under the gnu lesser general public license version 3"),
    ("agpl3-line", "licensed under the gnu affero general public license version 3"),
    ("mpl2-line", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl2-line", "licensed under the mozilla public license version 2 0"),
    ("epl2-line", "licensed under the eclipse public license version 2 0"),
    ("unlicense-line", "this is free and unencumbered software released into the public domain"),
    ("ccby-line", "licensed under cc by 4 0"),
    ("ccbysa-line", "licensed under cc by sa 4 0"),
    ("ccbync-line", "licensed under cc by nc 4 0"),
    ("ccbyncsa-line", "licensed under cc by nc sa 4 0"),
    ("ccbynd-line", "licensed under cc by nd 4 0"),
    ("cc0-line", "licensed under cc0 1 0"),
    ("bsl1-line", "distributed under the boost software license version 1 0"),
    ("zlib-asis", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("reserved", "all rights reserved"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-apache2", "spdx license identifier apache 2 0"),
    ("spdx-bsd2", "spdx license identifier bsd 2 clause"),
    ("spdx-bsd3", "spdx license identifier bsd 3 clause"),
    ("spdx-gpl2", "spdx license identifier gpl 2 0 only"),
    ("spdx-gpl3", "spdx license identifier gpl 3 0 only"),
    ("spdx-gpl2", "spdx license identifier gpl 2 0 or later"),
    ("spdx-gpl3", "spdx license identifier gpl 3 0 or later"),
    ("spdx-mpl2", "spdx license identifier mpl 2 0"),
    ("spdx-isc", "spdx license identifier isc"),
)
#: Licence, kind, sequence of identifiers; earlier rules go first.
RULES = (
    ("Apache-2.0", "permissive", ("apache2-line", "apache2-use", "apache2-copy", "apache2-asis")),
    ("Apache-2.0", "permissive", ("apache2-line",)),
    ("MIT", "permissive", ("mit-grant", "mit-notice", "asis")),
    ("MIT", "permissive", ("mit-grant",)),
    ("MIT", "permissive", ("mit-line",)),
    ("ISC", "permissive", ("isc-grant",)),
    ("ISC", "permissive", ("isc-line",)),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", "permissive", ("bsd3-line",)),
    ("BSD-2-Clause", "permissive", ("bsd2-line",)),
    ("GPL-2.0", "copyleft", ("gpl-free", "gpl2-terms")),
    ("GPL-3.0", "copyleft", ("gpl-free", "gpl3-terms")),
    ("GPL-2.0", "copyleft", ("gpl2-terms",)),
    ("GPL-3.0", "copyleft", ("gpl3-terms",)),
    ("LGPL-2.1", "copyleft", ("gpl-free", "lgpl21-terms")),
    ("LGPL-3.0", "copyleft", ("gpl-free", "lgpl3-terms")),
    ("AGPL-3.0", "copyleft", ("gpl-free", "agpl3-terms")),
    ("LGPL-2.1", "copyleft", ("lgpl21-terms",)),
    ("LGPL-3.0", "copyleft", ("lgpl3-terms",)),
    ("AGPL-3.0", "copyleft", ("agpl3-terms",)),
    ("Zlib", "permissive", ("zlib-asis", "zlib-grant")),
    ("BSL-1.0", "permissive", ("bsl1-line",)),
    ("GPL-2.0", "copyleft", ("gpl2-line",)),
    ("GPL-3.0", "copyleft", ("gpl3-line",)),
    ("LGPL-3.0", "copyleft", ("lgpl3-line",)),
    ("AGPL-3.0", "copyleft", ("agpl3-line",)),
    ("MPL-2.0", "copyleft", ("mpl2-line",)),
    ("EPL-2.0", "copyleft", ("epl2-line",)),
    ("Unlicense", "permissive", ("unlicense-line",)),
    ("CC0-1.0", "permissive", ("cc0-line",)),
    ("CC-BY-4.0", "permissive", ("ccby-line",)),
    ("CC-BY-SA-4.0", "copyleft", ("ccbysa-line",)),
    ("CC-BY-NC-SA-4.0", "restricted", ("ccbyncsa-line",)),
    ("CC-BY-NC-4.0", "restricted", ("ccbync-line",)),
    ("CC-BY-ND-4.0", "restricted", ("ccbynd-line",)),
    ("MIT", "permissive", ("spdx-mit",)),
    ("Apache-2.0", "permissive", ("spdx-apache2",)),
    ("BSD-2-Clause", "permissive", ("spdx-bsd2",)),
    ("BSD-3-Clause", "permissive", ("spdx-bsd3",)),
    ("GPL-2.0", "copyleft", ("spdx-gpl2",)),
    ("GPL-3.0", "copyleft", ("spdx-gpl3",)),
    ("MPL-2.0", "copyleft", ("spdx-mpl2",)),
    ("ISC", "permissive", ("spdx-isc",)),
)
#: The strictest kind comes first.
ORDER = ("restricted", "copyleft", "permissive")
#: Ends of sentences: a stop before white space, or a line that holds no letter or digit.
BREAK = r"[.!?]+[ \t\r\n\f\x0B]+|\n[^A-Za-z0-9\n]*\n"
#: Words of comment marks at line starts.
MARK = r"(?i)(^|\n)[ \t]*(?:dnl|rem)[ \t]+"
#: Every known sentence holds one of these.
CUE = r"(?i)licen[sc]e|permission|redistribut|free software|unencumbered|provided|copyright|rights reserved|warranties"
#: What a * with the blanks after it may be.
ANY = "(?:[a-z0-9]+  ){0,12}"


def normal(sentence: Column) -> Column:
    """Words in lower case, each with a blank on both sides, so that sentences that follow one another share none."""
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(F.concat(F.lit(" "), sentence, F.lit(" ")), "[^A-Za-z0-9]+", "  ")), F.lit(" "))


def spaced(known: str) -> str:
    return f" {known.replace(' ', '  ')} "


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pattern(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def identified(sentence: Column) -> Column:
    """The identifiers of the known sentences in a sentence, in order."""
    out = normal(sentence)
    for i, known in sorted(SENTENCES, key=lambda x: -len(x[1])):
        if "*" in known:
            out = F.regexp_replace(out, spaced(known).replace("*  ", ANY), f" <{i}> ")
        else:
            out = F.replace(out, F.lit(spaced(known)), F.lit(f" <{i}> "))
    return F.regexp_extract_all(out, F.lit("<([a-z0-9-]+)>"), F.lit(1))


def identify(text: Column) -> Column:
    """The text's identifiers, in order."""
    sentences = F.filter(F.split(F.regexp_replace(text, MARK, "$1"), BREAK), lambda s: s.rlike(CUE))
    return F.when(text.rlike(CUE), F.flatten(F.transform(sentences, identified))).otherwise(F.array().cast("array<string>"))


def match(ids: Column) -> Column:
    """struct<rest, licenses, kinds> after all rules."""
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(pattern(i)).alias("p")) for n, k, i in RULES))
    none = F.array().cast("array<string>")
    start = F.struct(F.concat(F.lit(""), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")).alias("rest"), none.alias("licenses"), none.alias("kinds"))

    def step(acc, r):
        hit = F.contains(acc["rest"], r["p"])
        one = lambda x: F.when(hit, F.array(x)).otherwise(none)
        return F.struct(F.when(hit, F.replace(acc["rest"], r["p"], F.lit("|"))).otherwise(acc["rest"]).alias("rest"), F.concat(acc["licenses"], one(r["name"])).alias("licenses"), F.concat(acc["kinds"], one(r["kind"])).alias("kinds"))

    return F.aggregate(rules, start, step)


def result(text: Column) -> Column:
    """struct<n_known, sentence_ids, licenses, kind> of a text."""

    def of(ids):
        def row(m):
            kind = F.coalesce(*(F.when(F.array_contains(m["kinds"], k), F.lit(k)) for k in ORDER), F.lit("unknown"))
            return F.struct(F.size(ids).cast("long").alias("n_known"), F.array_join(ids, ",").alias("sentence_ids"), F.array_join(F.array_distinct(m["licenses"]), ",").alias("licenses"), kind.alias("kind"))

        empty = F.struct(F.lit(0).cast("long").alias("n_known"), F.lit("").alias("sentence_ids"), F.lit("").alias("licenses"), F.lit("none").alias("kind"))
        return F.when(F.size(ids) == 0, empty).otherwise(let(match(ids), row))

    return let(identify(F.coalesce(text, F.lit(""))), of)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known, sentence_ids, licenses, kind of every row of docs (doc_id, text)."""
    return docs.select("doc_id", result(F.col("text")).alias("r")).select("doc_id", "r.*")


def oracle() -> str:
    """The scan as DuckDB SQL over `documents`: all known sentences as one expression with alternatives, matches numbered by place."""
    plain = [(i, k) for i, k in SENTENCES if "*" not in k]
    wild = [(i, k.replace(" ", "  ").replace("*  ", ANY)) for i, k in SENTENCES if "*" in k]
    known = ", ".join(f"('{k.replace(' ', '  ')}', '{i}')" for i, k in plain)
    every = sorted([k.replace(" ", "  ").replace("*  ", ANY) for _, k in SENTENCES], key=len, reverse=True)
    named = " ".join(f"when regexp_full_match(s, '{k}') then '{i}'" for i, k in wild)
    sql = rf"""with known(s, id) as (values {known}),
t as (select row_number() over () r, doc_id, coalesce(text, '') text from documents),
p as (select r, string_split_regex(regexp_replace(text, '{MARK}', '\1', 'g'), '{BREAK}') ss from t where regexp_matches(text, '{CUE}')),
u as (select r, unnest(ss) s, unnest(generate_series(1, len(ss))) i from p),
w as (select r, i, ' ' || lower(regexp_replace(' ' || s || ' ', '[^A-Za-z0-9]+', '  ', 'g')) || ' ' s from u),
m as (select r, i, regexp_extract_all(s, ' ({'|'.join(every)}) ', 1) ms from w),
x as (select r, i, unnest(ms) s, unnest(generate_series(1, len(ms))) j from m),
n as (select r, i, j, case {named} else known.id end id from x left join known using (s)),
q as (select r, count(*) c, string_agg(id, ',' order by i, j) ids, string_agg('<' || id || '>', '' order by i, j) q0 from n group by r)"""
    for k, (_, _, ids) in enumerate(RULES):
        sql += f",\ns{k} as (select *, contains(q{k}, '{pattern(ids)}') m{k}, replace(q{k}, '{pattern(ids)}', '|') q{k + 1} from {'q' if not k else f's{k - 1}'})"
    names = ", ".join(f"case when m{k} and not ({' or '.join(['false', *(f'm{j}' for j in range(k) if RULES[j][0] == n)])}) then '{n}' end" for k, (n, _, _) in enumerate(RULES))
    kinds = " ".join(f"when {' or '.join(f'm{k}' for k, r in enumerate(RULES) if r[1] == o)} then '{o}'" for o in ORDER)
    return sql + f"\nselect doc_id, coalesce(c, 0)::bigint n_known, coalesce(ids, '') sentence_ids, case when c is null then '' else concat_ws(',', {names}) end licenses, case when c is null then 'none' {kinds} else 'unknown' end kind from t left join s{len(RULES) - 1} using (r)"
