"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import conversations, html_text, jaccard, licenses, line_spread, packing, passages, pii, quality, sentencepieces, simhash, topk, variants
from ledgerlens.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql.strip()
        return f
    return add


@query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


@query("op2_shared_passages")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.shared_passages(read(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "other": "other_doc_id"})


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.token_report(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP4_SQL = f"""
with cut as (
  select row_number() over () as r, doc_id, source, string_split(text, chr(10)) as ls from documents),
lines as (
  select r, doc_id, source, i, ls[i] as line, {_TRIM.format("ls[i]")} as k
  from (select *, unnest(range(1, len(ls) + 1)) as i from cut)),
bad as (
  select k from lines where k <> '' group by k having count(distinct source) >= {line_spread.MIN_SITES})
select doc_id, count(*)::bigint as n_lines, count(bad.k)::bigint as n_removed,
       md5(coalesce(string_agg(line, chr(10) order by i) filter (bad.k is null), '')) as text_md5
from lines left join bad on lines.k = bad.k group by r, doc_id"""


@query("op4_line_spread", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_spread.remove_boilerplate(read(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_lines", "n_removed", F.md5("kept_text").alias("text_md5"))


OP5_SQL = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on c.r <> q.r and len(c.e) = len(q.e) where q.vec_id % 100 = 0)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by r order by score desc, vec_id))::integer as rank from s) where rank <= 10"""


@query("op5_exact_topk", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: DuckDB's \\s differs from the word rule, so words are split by the rule's own characters.
OP8_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (
  select doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (
  select doc_id, i as p, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
a as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) as n from g) where n > 1),
r as (select doc_id, count(distinct q) as n from (select doc_id, unnest([p, p + 1, p + 2]) as q from a) group by 1),
m as (
  select w.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(r.n, 0)::bigint as n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_capitals, len(l) as n_lines
  from w left join r using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 100 * n_symbols > 10 * n_words or word_chars < 2 * n_words or word_chars > 13 * n_words
            or 100 * n_dup_lines > 50 * n_lines or 100 * n_capitals > 50 * word_chars) as kept
from b"""


@query("op8_quality_rules", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_report(read(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("scores")


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(read(spark, sf_dir, "conversations"))


#: crc32 by its table, one byte after the other; near words share a word with one letter hidden, or are one with a letter left out.
OP12_SQL = """
with recursive t as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
runs as (
  select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run
  from documents),
per as (select d, run, count(*) as k, hex(encode(d || ':' || run)) as x from runs group by d, run),
hashed as (
  select run, k, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
                     lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1]))) as h
  from per, t),
w as (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from hashed),
v as (select word, sum(k)::bigint as n from w where length(word) >= 6 group by word having sum(k) >= 5),
place as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
hidden as (select word, n, i, left(word, i - 1) || ' ' || substr(word, i + 1) as h, left(word, i - 1) || substr(word, i + 1) as s from place),
near as (
  select a.word, b.word as near, b.n as near_n from hidden a join hidden b on a.h = b.h and a.word <> b.word
  union select a.word, b.word, b.n from hidden a join v b on a.s = b.word
  union select b.word, a.word, a.n from hidden a join v b on a.s = b.word),
best as (select word, count(*)::bigint as n_near, max(near_n) as top from near group by word),
form as (
  select v.word, v.n, coalesce(b.n_near, 0) as n_near, b.top as form_n,
         (select min(x.near) from near x where x.word = v.word and x.near_n = b.top) as form
  from v left join best b on v.word = b.word),
f as (select word, n, n_near, case when form_n >= 5 * n then form end as form, case when form_n >= 5 * n then form_n end as form_n from form),
chain as (
  select word, word as root, 0 as k from f
  union all select c.word, f.form, c.k + 1 from chain c join f on f.word = c.root where f.form is not null)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n
from f join (select word, arg_max(root, k) as root from chain group by word) c on c.word = f.word"""


@query("op12_spelling_variants", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.vocabulary(variants.tokens(read(spark, sf_dir, "documents"), misspelt=variants.MISSPELT)))


#: Words are split by the rule's own characters; sets of at most one n-gram in common are never paired.
OP13_SQL = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
g as (
  select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i + 3], ' ') end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*)::bigint as n, md5(string_agg(g, chr(10) order by g)) as s from g group by doc_id),
rep as (select s, min(doc_id) as r, min(n) as n from n group by s),
rg as (select r, g from g join rep on g.doc_id = rep.r),
shared as (select a.r as u, b.r as v, count(*) as k from rg a join rg b on a.g = b.g and a.r < b.r group by 1, 2),
link as (select u, v from shared join rep x on x.r = u join rep y on y.r = v where 100 * k >= 85 * (x.n + y.n - k)),
edge as (select u, v from link union select v, u from link),
reach as (select r as node, r as root from rep union select e.u, t.root from edge e join reach t on e.v = t.node),
root as (select node, min(root) as root from reach group by node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(root.root, d.doc_id) as component_id
from d left join n using (doc_id) left join rep on rep.s = n.s left join root on root.node = rep.r"""


@query("op13_jaccard_join", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_classes(read(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "component": "component_id"})
