"""Operators on hard tables: nulls, empty tables, repeated rows, clashing names; plain versions beside them."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from screenlens.llm import decontam, langid, licenses, linededup, quality, secrets
from screenlens.llm.bpe import tokenizer_path

WORD6 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def ascii_lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# line dedup


def brute_lines(table):
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(list)
    for i, t in table:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(linededup.NO_ID if i is None else i)
    out = []
    for i, t in table:
        own, lines = linededup.NO_ID if i is None else i, (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1000, 0])
def test_line_dedup(spark, docs, most):
    line = "A line that Many hold: É"
    more = spark.createDataFrame([(20 + i, f"own {i}\n  {line.upper() if i % 2 else line}\t\n\n" + "short\n" * i) for i in range(5)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(more)
    table = table.withColumn("row", F.lit(1)).withColumn("kept", F.lit("k")).repartition(3)
    got = linededup.digest(linededup.dedup(spark, table, broadcast_keys=most, fanout=2))
    assert rows(got, *got.columns) == brute_lines([(r.doc_id, r.text) for r in table.collect()])
    assert linededup.dedup(spark, docs.limit(0)).count() == 0


def test_runs(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    batch = lambda *ks: spark.createDataFrame([(k, 0, d) for k, d in ks], "k1 long, k2 long, doc long")
    assert runs.view().count() == 0
    for b in (batch((1, 5), (2, 5)), batch((1, 7)), batch((3, 1), (1, 2))):
        runs.add(b)
    assert [len(x) for x in runs.levels] == [1, 1]
    assert rows(runs.view(), "k1", "n", "doc") == [(1, 3, 7), (2, 1, 5), (3, 1, 1)]
    assert rows(runs.novel(batch((1, 9), (4, 9))), "k1") == [(4,)]
    runs = linededup.LineRuns(spark, fanout=9, enough=2)
    for b in (batch((1, 5), (1, 6), (2, 5)), batch((1, 4), (1, 6), (2, 4), (3, 4)), batch((1, 7), (2, 3))):
        runs.add(b)
    # Key 1 was settled before the second batch, and again held by a later document in the third; key 2 before the third.
    assert [rows(runs._read([p]), "k1", "n", "doc") for p in runs.levels[0]] == [[(1, 2, 6), (2, 1, 5)], [(2, 1, 4), (3, 1, 4)], [(1, 1, 7)]]


# decontamination


def brute_hits(table, items, width=10):
    split = lambda t: WORD6.findall(ascii_lower(t or ""))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            wins[tuple(w[k : k + width])].add("" if i is None else str(i))
    out = []
    for i, t in table:
        w, hit, found = split(t), set(), set()
        for x, names in wins.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= names
        near = set()
        for name, text in items:
            words = split(text)
            for a in range(0, max(len(words) - width, 0) + 1 if words else 0, width):
                if any(set(words[a : a + width]) <= set(w[k : k + 2 * width]) for k in range(len(w))):
                    near.add(name)
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit), len(near)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chars", [10_000_000, 60])
def test_decontamination(spark, docs, chars):
    items = [(1, "a b c D e-f g h i j k l a b"), (2, "the cat the"), (2, "WORD!"), (None, "中文 the"), (3, None), (4, "..."), (10, "l a b c d e f g h i"), (5, "nothing here at all that any document would have")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    got = decontam.scan(spark, docs.repartition(3), bench, block_chars=chars)
    assert rows(got, *got.columns) == brute_hits([(r.doc_id, r.text) for r in docs.collect()], items)
    assert decontam.scan(spark, docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.scan(spark, docs.limit(0), bench).count() == 0


def test_proximity():
    """All places of the rarest word whose other words lie within reach, as by trying every span."""
    import random

    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(40))) for _ in range(30)] + ["", None, "a"]
    s = decontam.Segment.build(list(range(len(texts))), texts)
    for _ in range(60):
        block, reach = [rng.choice("abcdefghijz").encode() for _ in range(rng.randrange(1, 5))], rng.randrange(1, 9)
        got = set(s.owner(s.near(s.numbers(block), reach)).tolist())
        want = {d for d, t in enumerate(texts) if any(set(block) <= set(decontam.words(t)[k : k + reach]) for k in range(len(decontam.words(t))))}
        assert got == want


def test_segments_leave_no_garbage():
    """what a segment needed goes with it, not only when the interpreter looks for rings; else a task holds the words of all its segments."""
    import gc

    gc.collect()
    gc.disable()
    try:
        decontam.Segment.build([1, 2], ["some words and some more", "other words"])
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_index_is_read_and_written_by_segment(spark, monkeypatch):
    """a row group of the index has few segments, however many a task has; and null and negative ids come back."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(decontam, "SEGMENT", 1)
    text = " ".join(f"word{k}" for k in range(100_000))
    docs = spark.createDataFrame([(i, f"{text} {i}") for i in (None, -5, 2**62, 1, 2, 3)], "doc_id long, text string").coalesce(1)
    table = decontam.index(docs)
    sizes = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
    assert sum(m.num_rows for m in sizes) == 6
    assert max(m.row_group(k).num_rows for m in sizes for k in range(m.num_row_groups)) <= 3
    bench = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(50_000, 50_010)))], "item_id long, text string")
    assert rows(decontam.look_up(table, bench), "doc_id", "n_words", "n_hit") == sorted(((i, 100_001, 10) for i in (None, -5, 2**62, 1, 2, 3)), key=repr)


def test_one_index_answers_any_benchmark(spark, docs):
    index = decontam.index(docs)
    for text in ("a b c d e f g h i j", "the cat", "no such words", "WORD"):
        bench = spark.createDataFrame([(1, text)], "item_id long, text string")
        assert rows(decontam.look_up(index, bench), "doc_id", "n_hit", "n_near") == rows(decontam.scan(spark, docs, bench), "doc_id", "n_hit", "n_near")


# language


def test_language(spark, docs):
    en, de = "the house and the tree with this thing of ours ", "der baum und das haus mit diesem ding von uns "
    table = spark.createDataFrame([(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    got = langid.identify(spark, table.unionByName(spark.createDataFrame([(100, "1 2 3", "en"), (101, None, "de"), (None, en, None), (102, de.upper(), None)], table.schema)))
    found = {r.doc_id: r for r in got.collect()}
    assert all(found[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [found[i].lang_pred for i in (100, 101, None, 102)] == ["und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in found.values()) and found[100].score == 0
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items() if i is not None)
    assert langid.identify(spark, docs).count() == docs.count()
    assert rows(langid.identify(spark, docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct(), "lang_pred") == [("und",)]
    assert langid.identify(spark, docs.limit(0)).count() == 0


# secrets


def brute_secrets(t):
    t = t or ""
    kinds = [("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    spans = [(m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, g, least) in enumerate(kinds) for m in re.finditer(p, t) if len(m[g]) >= least]
    return sha(",".join(x[2] for x in sorted(spans)))


SECRETS = ["é API_KEY = 'abc123'", "toKen=abcdef token=abcde password: hunter22, secret=\"a.b-c_d\"", "AKIA" + "B7" * 8 + " " + "0f" * 12 + "g", "AKIAAKIA" * 5, "passwd=" + "9" * 24, "key 8sKq3Vx0zLp9Wm2Rt7Yb4Nc6 and x"]


def test_secrets(spark, docs):
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(SECRETS, 50)), "doc_id long, text string"))
    got = secrets.scan(spark, table)
    assert rows(got, "doc_id", "base_sha256") == sorted(((r.doc_id, brute_secrets(r.text)) for r in table.collect()), key=repr)
    found = {r.doc_id: r for r in got.collect()}
    assert found[55].spans == "random:4:28" and found[52].n_access == 1 and found[52].n_hex == 1
    for clean in ("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855".upper(), "123e4567-e89b-12d3-a456-426614174000", "get_user_account_settings_by_id", "internationalizationHelperFactory", "2024-01-01-2024-12-31-00"):
        assert secrets.random_runs(clean, [], secrets.vocabulary_path()) == [], clean
    assert secrets.scan(spark, docs.limit(0)).count() == 0


def test_random_strings_are_found():
    """Planted random strings of seven alphabets in prose: nine in ten of each kind and length, and nearly all together."""
    import random
    import string

    rng, path = random.Random(2), secrets.vocabulary_path()
    letters, digits = string.ascii_letters, string.digits
    alphabets = {"base62": letters + digits, "base64": letters + digits + "+/", "url": letters + digits + "-_", "base32": string.ascii_uppercase + "234567", "lower": string.ascii_lowercase + digits, "hex": digits + "ABCDEF", "letters": letters}
    caught = total = 0
    for kind, alphabet in alphabets.items():
        for n in (16, 20, 24, 31, 43):
            hits = 0
            for _ in range(100):
                text = f"the value is {''.join(rng.choice(alphabet) for _ in range(n))} and that is it"
                base = [x[:2] for x in secrets.base_spans(text)]
                hits += any(a <= 20 and b >= n + 8 for a, b in base + secrets.random_runs(text, base, path))
            assert hits >= 90, (kind, n, hits)
            caught, total = caught + hits, total + 100
    assert caught >= 0.98 * total


def test_identifiers_are_left_alone():
    names = """getUserAccountSettingsById get_user_account_settings_by_id internationalizationHelperFactory MAX_CONNECTION_TIMEOUT_MS AbstractSingletonProxyFactoryBean
com/example/project/src/main/java/Application README-2024-01-15-final IMG_20240115_123456 2024-01-15T12-30-45Z v1-beta-2024-release kubernetes-dashboard-v2-7 node_modules/react-dom/cjs
ISO-8859-1-encoding HTTP2ServerPushEnabled Donaudampfschifffahrtsgesellschaft DE89370400440532013000 GB82WEST12345698765432 x86_64-unknown-linux-gnu aarch64-apple-darwin20
Windows-10-Pro-64bit-22H2 TensorFlowLite2Converter application/x-www-form-urlencoded en_US_POSIX_UTF8 AES256-SHA384-ECDHE SHA256withRSAEncryption base64EncodedString PROJ-12345-backend-fix
Covid19VaccinationCentre Anticonstitutionnellement S3BucketLifecycleRule EC2InstanceMetadata 978-3-16-148410-0 +49-30-1234567890""".split()
    for name in names:
        assert not secrets.random_runs(f"use {name} here", [], secrets.vocabulary_path()), name


# licences


def test_licenses(spark, docs):
    bsd = [s for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse") for i, s in licenses.SENTENCES if i == k]
    texts = ["Licensed under the Apache License, Version 2.0.", ". ".join(bsd), ". ".join(bsd[:3]), "SPDX-License-Identifier: MIT\nx. All rights reserved.", "All rights reserved", "mit. der. Licensed under CC BY-NC 4.0! Released under the MIT License. Released under the MIT License."]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [(r.licenses, r.kind) for r in got.orderBy("doc_id").collect()] == [("Apache-2.0", "permissive"), ("BSD-3-Clause", "permissive"), ("BSD-2-Clause", "permissive"), ("MIT", "permissive"), ("", "unknown"), ("MIT,CC-BY-NC-4.0", "restricted")]
    assert {r.kind for r in licenses.scan(docs).collect()} == {"none"} and licenses.scan(docs.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD3 = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the Some Body Institute of Something nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
ISC = """Copyright (c) 2019 Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.
"""
APACHE = """Copyright 2022 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU {1}General Public License as published by
the Free Software Foundation{2} either version {3} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def test_published_licenses(spark):
    """Whole published texts: as they are, with their lines joined, and in the comment marks of several languages."""
    bsd2 = BSD3[: BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE") :]
    published = {"MIT": MIT, "BSD-3-Clause": BSD3, "BSD-2-Clause": bsd2, "ISC": ISC, "Apache-2.0": APACHE, "GPL-3.0": GPL.format(":", "", ",", "3"), "GPL-2.0": GPL.format(";", "", ";", "2"), "LGPL-3.0": GPL.format(":", "Lesser ", ",", "3"), "AGPL-3.0": GPL.format(":", "Affero ", ",", "3")}
    marked = lambda t, a, b="": "".join(f"{a}{x}{b}\n" for x in t.split("\n"))
    forms = (lambda t: t, lambda t: " ".join(t.split()), lambda t: t.replace("\n", "\r\n"), lambda t: marked(t, "# ") + "import os\n", lambda t: "/*\n" + marked(t, " * ") + " */\nint main() {}", lambda t: marked(t, "// "), lambda t: marked(t, "dnl "), lambda t: marked(t, "REM "), lambda t: "<!--\n" + t + "-->", lambda t: f"Some prose before\n{t}\nand after " * 40)
    texts = [(n, f(t)) for n, t in published.items() for f in forms]
    got = licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [n for n, _ in texts]
    plain = ["The museum was licensed to sell tea. The permission of the owner was asked.", "No warranty. This program is free of charge software.", "A mit b. apache 2 0", "You may copy the license plate at the garage"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string"))
    assert {(r.licenses, r.kind) for r in got.collect()} == {("", "none")}


def test_licenses_against_sql(spark):
    """The scan equals its SQL on hard texts."""
    import duckdb
    import pyarrow as pa

    line = "Licensed under the MIT license"
    texts = [None, "", MIT, BSD3, APACHE, f"{line}\n{line}\n{line}. {line}", "# SPDX-License-Identifier: Apache-2.0\n# SPDX-License-Identifier: GPL-2.0-or-later", "licensed\u2028under the\x85MIT license", f"dnl {line}\nREM\t{line}", (line + "! words ") * 2000, "x" * 200_000 + " " + line, ISC.upper(), "Neither the name of nor the names of its contributors may be used"]
    table = list(enumerate(texts))
    got = licenses.scan(spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "1 as kind", "2 as r"))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in table], "text": pa.array([t for _, t in table], pa.string())}))
    assert rows(got, *got.columns) == sorted(con.execute(licenses.oracle()).fetchall(), key=repr)


# quality


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(g)
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)})


def test_quality(spark, docs):
    more = ["a b c a b c a b c d", "x y x y x y z # $ |\n\n#\n#\n \n", "a a a a", "one two three one two three", "   \x1c q " * 4]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(more, 70)), "doc_id long, text string"))
    got = quality.judge(table, [])
    assert rows(got, "doc_id", *quality.STATS[:5]) == sorted(((r.doc_id, *brute_quality(r.text)) for r in table.collect()), key=repr)
    assert all(r.kept == (not r.base_failed) and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got.collect())
    assert quality.judge(docs.limit(0), []).count() == 0


def test_rules(spark, docs):
    text = "some clean words that go on and never stop " * 3
    table = spark.createDataFrame([(i, text + str(i) + (" $ % |" * 40 if i % 3 == 0 else "")) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)] + [(None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    rules = quality.train(table, labels)
    assert len(rules) == 1 and len(rules[0]) == 1
    assert quality.judge(table, rules).where("(rule is null) = (doc_id % 3 = 0)").count() == 0
    assert quality.train(docs, labels.limit(0)) == [] and quality.train(docs.limit(0), labels) == []


# pipeline


def test_pipeline(spark, tmp_path, docs):
    """Each stage against plain Python over the same rows."""
    from tokenizers import Tokenizer

    line = "This is a line that a good many documents share"
    base = " ".join(f"w{k}" for k in range(300))
    leak = "one two three four five six seven eight nine ten eleven"
    more = [(200 + i, f"doc number {i} speaks of {i * 7919} things\n{line}") for i in range(4)] + [(300, base), (301, base), (305, base.replace("w150", "v")), (302, "1 2 3"), (303, f"before {leak} after"), (None, "no id here")]
    table = docs.select("doc_id", "text", "lang").where("doc_id <> 4").unionByName(spark.createDataFrame([(i, t, "en") for i, t in more], "doc_id long, text string, lang string"))
    table = table.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = [(r.doc_id, r.text) for r in table.collect()]
    at = [(i, t) for i, t in at if t and any(c.isalpha() for c in t)]
    kept = {(i, s) for i, _, _, s in brute_lines(at)}
    cut = []
    for i, t in at:
        for k in (t, t.replace("\n" + line, ""), "\n".join(x for x in t.split("\n") if len(x) < 20)):
            if (i, sha(k)) in kept:
                cut.append((i, k))
                break
    assert len(cut) == len(at)
    from test_neardup import brute

    number = {k: i for k, (i, _) in enumerate(sorted(cut, key=lambda x: (x[0] is None, x[0] or 0)))}
    least = brute([(k, dict(cut)[i]) for k, i in number.items()])
    stay = {number[k] for k in number if least[k] == k}
    hits = {x[0] for x in brute_hits(cut, [(1, leak)]) if x[-1]}
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted(((i, len(t.encode(x, add_special_tokens=False).ids)) for i, x in cut if i in stay and i not in hits), key=repr)
    assert 301 not in dict(want) and 305 not in dict(want) and 303 not in dict(want) and 300 in dict(want)
    assert rows(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "n_tokens") == want
