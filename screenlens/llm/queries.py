"""The queries of this subpackage over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, html, langid, licenses, linededup, quality, secrets, simhash, suffixdedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spark, _table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(suffixdedup.dedup(spark, _table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(spark, _table(spark, sf_dir, "documents")))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(spark, _table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _table(spark, sf_dir, "labels"))).select("doc_id", *quality.STATS[:5], "base_failed", "kept", "rule")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, _table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup(spark, _table(spark, sf_dir, "documents")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.code(spark, _table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_licenses, op3_suffix_dedup, op4_simhash, op5_html, op6_decontamination, op7_quality, op8_language_id, op9_line_dedup, op10_bpe)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op2_licenses": licenses.oracle(),
    "op6_decontamination": rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select coalesce(item_id::varchar, '') item, regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
q0 as (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) i from b where len(w) > 0),
q as (select distinct item, least(len(w), 10) n, array_to_string(w[i:i + 9], ' ') s from q0),
sizes as (select distinct n from q),
p0 as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from d, sizes where len(w) >= n),
p as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') s from p0),
h as (select p.doc_id, p.i, p.n, q.item from p join q on p.s = q.s and p.n = q.n),
c as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) pos from h) group by 1),
t as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from h group by 1),
b1 as (select row_number() over () r, item, w from b where len(w) > 0),
b2 as (select r, item, w, unnest(generate_series(1, greatest(len(w) - 9, 1), 10)) i from b1),
b3 as (select distinct r, i, item, unnest(w[i:i + 9]) word from b2),
b4 as (select r, i, count(*) k from b3 group by 1, 2),
dw as (select doc_id, unnest(w) word, unnest(generate_series(1, len(w))) pos from d),
x0 as (select doc_id, r, i, item, word, pos from b3 join dw using (word)),
x1 as (select doc_id, r, i, any_value(k) k from x0 join b4 using (r, i) group by 1, 2, 3 having count(distinct word) = any_value(k)),
x2 as (select x0.*, k from x0 join x1 using (doc_id, r, i)),
x3 as (select s.doc_id, s.r, s.i, s.item, s.pos from x2 s join x2 e on s.doc_id = e.doc_id and s.r = e.r and s.i = e.i and e.pos between s.pos and s.pos + 19
group by 1, 2, 3, 4, 5 having count(distinct e.word) = any_value(s.k)),
x4 as (select doc_id, count(distinct item) n_near from x3 group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(n_near, 0)::bigint n_near
from d left join c using (doc_id) left join t using (doc_id) left join x4 using (doc_id)""",
    "op9_line_dedup": rf"""
with l0 as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(ls) line, unnest(generate_series(1, len(ls))) i from l0),
k as (select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) key from l),
g as (select key, max(doc_id) holder from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, g.key is not null and k.doc_id <> g.holder gone from k left join g on k.key = g.key)
select doc_id, count(*)::bigint n_lines, count(*) filter (gone)::bigint n_dropped,
sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256 from m group by doc_id""",
}
