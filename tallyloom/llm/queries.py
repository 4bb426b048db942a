"""Queries over the whole tables, one for each operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, hmm_scores, license_scan, near_dedup, quality_classifier, quality_rules, secrets, sentencepiece_scan, token_output
from .common import table

WORD_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.sentencepiece_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.windows(rows))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores.lm_scores(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_dedup, op2_secrets, op3_decontaminate, op4_quality_rules, op5_token_output, op6_sentencepiece, op7_chat_format, op8_lm_scores, op9_quality_classifier, op10_licenses)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spans_sql(number: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    select doc_id, {number} as number, '{rule.kind}' as kind, z[1] as s, z[2] as e from (
      select doc_id, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: [
        coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
        coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0),
        length(g[i])]), lambda x: x[3] >= {rule.least})) as z
      from (select doc_id, string_split_regex(t, '{pattern}') as p, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {rule.group}) as g from docs))"""


ORACLE = {
    "op1_near_dedup": rf"""
with recursive words as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACE_WORDS}') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
one as (select min(doc_id) as doc_id, list_sort(s) as s from sets where len(s) > 0 group by list_sort(s)),
copies as (select sets.doc_id, one.doc_id as rep from sets join one on list_sort(sets.s) = one.s),
sh as (select doc_id, unnest(s) as g from one),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join one x on x.doc_id = a join one y on y.doc_id = b where 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from one union select r.a, l.b from reach r join both_ways l on l.a = r.b),
comp as (select a, min(b) as c from reach group by a)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(c.c, s.doc_id) as component_id, coalesce(c.c, s.doc_id) = s.doc_id as kept
from sets s left join copies on copies.doc_id = s.doc_id left join comp c on c.a = copies.rep""",
    "op2_secrets": f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
spans as ({" union all ".join(_spans_sql(i, r) for i, r in enumerate(secrets.RULES))})
select d.doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, number) filter (where number < {len(secrets.BASE_RULES)}), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, number), '') as spans
from docs d left join spans using (doc_id) group by d.doc_id""",
    "op3_decontaminate": rf"""
with dw as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM_WORDS}') as w from documents),
iw as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM_WORDS}') as w from benchmark),
win as (select item_id, i, w[i:i + 12] as q from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from iw where len(w) > 0)),
qw as (select item_id, i, len(q) as n, unnest(q) as word, generate_subscripts(q, 1) as j from win),
pw as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from dw),
near as (select distinct doc_id, item_id from (
  select doc_id, item_id, i, s from (select doc_id, item_id, i, n, j, p - j + d as s from qw join pw using (word), (select unnest([-1, 0, 1]) as d))
  group by doc_id, item_id, i, n, s having count(distinct j) = n)),
exact as (select doc_id, item_id, n, s from (select doc_id, item_id, i, n, p - j as s from qw join pw using (word)) group by doc_id, item_id, i, n, s having count(*) = n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s + 1, s + n + 1)) as p from exact) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names from (select distinct doc_id, item_id from exact) group by doc_id),
close as (select doc_id, count(*) as n_near from near group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(n_near, 0)::bigint as n_near_items
from dw d left join hit using (doc_id) left join items using (doc_id) left join close using (doc_id)""",
    "op4_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{_SPACE_WORDS}') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE_WORDS}')) as lines from d),
g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
n as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 8)) as p from r) group by doc_id),
s as (select w.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines) as n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) as n_lower
  from w left join n using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" or ".join(f"({r.sql})" for r in quality_rules.BASE_RULES)} as base_failed, not ({" or ".join(f"({r.sql})" for r in quality_rules.RULES)}) as kept from s""",
    "op7_chat_format": rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t as (select *, greatest(len(regexp_extract_all(text, '{_SPACE_WORDS}')), 1) as tokens, row_number() over (partition by conv_id order by turn, role, text) as number,
  length({"".join("replace(" for _ in chat_format.ESCAPES)}text{"".join(f", '{a}', '{b}')" for a, b in chat_format.ESCAPES)}) + length({"".join("replace(" for _ in chat_format.ESCAPES)}role{"".join(f", '{a}', '{b}')" for a, b in chat_format.ESCAPES)}) + {len(chat_format.BEGIN + chat_format.MIDDLE + chat_format.END)} as size from c),
sys as (select conv_id, min_by(tokens, number) as tokens, min_by(size, number) as size, min(number) as number from t where role = 'system' group by conv_id),
l as (select t.*, greatest(2, floor(({chat_format.BUDGET - chat_format.HISTORY_TOKENS} - coalesce(sys.tokens, 0)) / 2)) as room from t left join sys using (conv_id)),
p as (select *, coalesce(sum(tokens) over (partition by conv_id order by number rows between unbounded preceding and 1 preceding), 0) as before, (tokens > room)::int as long,
  coalesce(sum((tokens > room)::int) over (partition by conv_id order by number rows between unbounded preceding and 1 preceding), 0) as longs from l),
s as (select *, 2 * longs + long as a, case when long = 1 then 0 else floor(before / room) end as b from p),
f as (select conv_id, a, b, min(number) as first, min(before) as at from s group by all having min(number) > 1),
extra as (select f.conv_id, sum(sys.size) as n from f join sys on sys.conv_id = f.conv_id and sys.number < f.first group by all
  union all select f.conv_id, sum(s.size) from f join s on s.conv_id = f.conv_id and s.number between f.first - {chat_format.HISTORY_TURNS} and f.first - 1 and f.at - s.before <= {chat_format.HISTORY_TOKENS} and s.role <> 'system' group by all),
e as (select conv_id, sum(n) as n from extra group by all)
select t.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by number)) as turns_sha256, coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by number) filter (where role = 'assistant'), '')) as loss_sha256, (sum(size) + coalesce(any_value(e.n), 0))::bigint as formatted_chars
from t left join e using (conv_id) group by t.conv_id""",
}
