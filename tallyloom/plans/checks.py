"""Merges and further gates over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redact as R
from .. import sources as S
from ..operators import gates as Q
from ..operators import merge as M
from ..operators import versions as V
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

BASE = "replace(lower(p_name), ' ', '-')"


@query("""with o as (select c_custkey as old_id, 's' || c_custkey as slug, 'f' || (c_custkey // 2) as file, c_mktsegment as name from customer where c_custkey % 11 <> 0),
n as (select c_custkey as new_id, case when c_custkey % 3 = 0 then 'x' else 's' end || c_custkey as slug, 'f' || (c_custkey // 2) as file, c_mktsegment as name from customer where c_custkey % 7 <> 0),
m1 as (select 'slug' as rule, old_id, new_id from o join n using (slug)),
o1 as (select * from o where old_id not in (select old_id from m1)), n1 as (select * from n where new_id not in (select new_id from m1)),
m2 as (select 'file' as rule, min(o1.old_id) as old_id, min(n1.new_id) as new_id from o1 join n1 using (file) group by file having count(distinct o1.old_id) = 1 and count(distinct n1.new_id) = 1),
o2 as (select * from o1 where old_id not in (select old_id from m2)), n2 as (select * from n1 where new_id not in (select new_id from m2)),
m3 as (select 'name' as rule, min(o2.old_id) as old_id, min(n2.new_id) as new_id from o2 join n2 using (file, name) group by file, name having count(distinct o2.old_id) = 1 and count(distinct n2.new_id) = 1)
select * from m1 union all select * from m2 union all select * from m3""")
def merged_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    file = F.expr("'f' || floor(c_custkey / 2)").alias("file")
    old = rows.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("old_id"), F.expr("'s' || c_custkey").alias("slug"), file, F.col("c_mktsegment").alias("name"))
    new = rows.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("new_id"), F.expr("if(c_custkey % 3 = 0, 'x', 's') || c_custkey").alias("slug"), file, F.col("c_mktsegment").alias("name"))
    return M.identity_cascade(old, new, "old_id", "new_id", [("slug", ["slug"]), ("file", ["file"]), ("name", ["file", "name"])])


@query("""with o as (select s_suppkey, s_name as slug, 'old ' || s_name as title, s_nationkey::varchar as body from supplier where s_suppkey % 5 <> 0),
n as (select s_suppkey, 'new' as slug, case when s_suppkey % 3 > 0 then 'new ' || s_name end as title, case when s_suppkey % 4 = 0 then '' else 'text' end as body from supplier where s_suppkey % 7 <> 0)
select coalesce(o.s_suppkey, n.s_suppkey) as s_suppkey, case when o.s_suppkey is null then n.slug else o.slug end as slug, case when n.s_suppkey is null then o.title else n.title end as title, coalesce(nullif(n.body, ''), o.body, n.body) as body
from o full join n on o.s_suppkey = n.s_suppkey""")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    old = rows.where("s_suppkey % 5 <> 0").selectExpr("s_suppkey", "s_name as slug", "'old ' || s_name as title", "cast(s_nationkey as string) as body")
    new = rows.where("s_suppkey % 7 <> 0").selectExpr("s_suppkey", "'new' as slug", "if(s_suppkey % 3 > 0, 'new ' || s_name, null) as title", "if(s_suppkey % 4 = 0, '', 'text') as body")
    return M.upsert(old, new, "s_suppkey", {"slug": "keep", "title": "overwrite", "body": "fill"})


KNOWN = f"case p_partkey % 4 when 0 then {BASE} || '-' || (1800 + p_size) when 1 then {BASE} || '-' || (1860 + p_size) when 2 then {BASE} || '-' || (1800 + p_size) || '-' || (1860 + p_size) else {BASE} end"


@query(f"""with k as (select distinct {KNOWN} as known from part), b as (select distinct {BASE} as base, 1800 + p_size as y, 1860 + p_size as z from part),
t as (select base || '-' || y || z as slug, unnest([base || '-' || y, base || '-' || z, base || '-' || y || '-' || z, base, string_split(base, '-')[1] || '-' || string_split(base, '-')[-1]]) as c, unnest([1, 2, 3, 4, 5]) as i from b)
select slug, min_by(known, i) as repaired from t left join k on c = known group by slug""")
def repaired_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    refs = part.selectExpr(f"{BASE} || '-' || (1800 + p_size) || (1860 + p_size) as slug")
    return M.repaired_slugs(refs, "slug", part.selectExpr(f"{KNOWN} as known"), "known")


@query("select p_name, count(*)::bigint as n, count_if(p_size % 7 = 0)::bigint as n_undated from part group by 1 having count_if(p_size % 7 = 0) between 1 and count(*) - 1")
def shell_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.shell_duplicates(table(spark, sf_dir, "part"), "p_name", F.col("p_size") % 7 == 0)


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
select doc_id, i::bigint as line, rule from (select doc_id, i, case {" ".join(f"when regexp_matches(x, '{p}') then '{n}'" for n, p in R.PATTERNS)} end as rule from l where not regexp_matches(x, '(?i)license')) where rule is not null""")
def private_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.first_hits(table(spark, sf_dir, "documents"), "doc_id", "text", list(R.PATTERNS), "(?i)license")


@query("select user_id, min(event_id % 40)::bigint as first_version from events where user_id % 2 <> 0 and user_id % 3 <> 0 group by 1")
def undeclared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    keys = events.select("user_id").distinct()
    return Q.undeclared(events.select("user_id", (F.col("event_id") % 40).alias("version")), "user_id", "version", keys.where("user_id % 2 = 0"), keys.where("user_id % 3 = 0"))


@query("""with r as (select c_custkey as k, c_custkey % 2 = 0 as living, case when c_custkey % 6 = 0 then 1900 + c_nationkey end as died, case when c_custkey % 5 = 0 then '1850–1900' else 'b. 1850' end as span from customer)
select 'living_with_death_year' as gate, k::varchar as key, died::varchar as detail, 'high' as severity from r where living and died is not null
union all select 'living_with_closed_lifespan', k::varchar, span, 'high' from r where living and span = '1850–1900'
union all select 'deceased_shown_as_living', k::varchar, span, 'medium' from r where not living and span = 'b. 1850' and died is null""")
def vital_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_custkey % 2 = 0 as living", "if(c_custkey % 6 = 0, 1900 + c_nationkey, null) as died", "if(c_custkey % 5 = 0, '1850–1900', 'b. 1850') as span")
    return Q.vital_status(rows, F.col("k"), F.col("living"), F.col("died"), F.col("span"))


@query(r"""select page_id, url, regexp_matches(url, '^https://[a-z0-9.-]+/[^?#]*$') as canonical, url in (select url from pages where page_id % 2 = 0) as known from pages""")
def quoted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Q.at_least(table(spark, sf_dir, "pages"), 50, "pages")
    return Q.quoted_urls(pages.select("page_id", F.concat(F.lit("see <"), "url", F.lit("> and ("), "url", F.lit(")")).alias("text")), "page_id", "text", pages.where("page_id % 2 = 0"), "url")


@query("""with o as (select c_name, 's' || c_custkey as slug, c_mktsegment as seg from customer where c_custkey % 13 <> 0), n as (select c_name, 's' || (c_custkey + (c_custkey % 17 = 0)::int) as slug, case when c_custkey % 19 = 0 then 'moved' else c_mktsegment end as seg from customer where c_custkey % 23 <> 0)
select c_name, change, changed, change = 'changed' and list_contains(changed, 'slug') as fails from (select coalesce(o.c_name, n.c_name) as c_name, case when o.c_name is null then 'added' when n.c_name is null then 'removed' else 'changed' end as change,
  case when o.c_name is null or n.c_name is null then [] else list_filter([case when o.slug <> n.slug then 'slug' end, case when o.seg <> n.seg then 'seg' end], lambda x: x is not null) end as changed
  from o full join n on o.c_name = n.c_name) where change <> 'changed' or len(changed) > 0""")
def slug_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    old = rows.where("c_custkey % 13 <> 0").selectExpr("c_name", "'s' || c_custkey as slug", "c_mktsegment as seg")
    new = rows.where("c_custkey % 23 <> 0").selectExpr("c_name", "'s' || (c_custkey + if(c_custkey % 17 = 0, 1, 0)) as slug", "if(c_custkey % 19 = 0, 'moved', c_mktsegment) as seg")
    found = V.changes(old, new, "c_name", ["slug", "seg"])
    return found.withColumn("fails", (F.col("change") == "changed") & F.array_contains("changed", "slug"))


@query("""select substr(sha256(gate || '|' || same), 1, 12) as ticket, gate, min(log) as log from (select l_returnflag as gate, 'line ' || l_linenumber || '  failed' as log, 'line 0 failed' as same from lineitem union all select 'other', 'x ' || c_mktsegment, lower('x ' || c_mktsegment) from customer)
where substr(sha256(gate || '|' || same), 1, 12) <> substr(sha256('A|line 0 failed'), 1, 12) group by 1, 2""")
def new_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as gate", "'line ' || l_linenumber || '  failed' as log").union(table(spark, sf_dir, "customer").selectExpr("'other'", "'x ' || c_mktsegment"))
    filed = spark.range(1).select(F.substring(F.sha2(F.lit("A|line 0 failed").cast("binary"), 256), 1, 12).alias("ticket"))
    return S.new_tickets(failures, filed)
