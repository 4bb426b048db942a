"""Keys that have to lead somewhere, what is kept, drift of snapshots, and lines on the living."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import living_rules as L
from ..operators import gates as Q
from ..operators import resolve as E
from ..operators import versions as V
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

NAME = "case doc_id % 4 when 0 then 'Ann Oak (1850–1900).md' when 1 then 'Ann Oak (1950–?) (b. 1950).md' when 2 then 'Ann Oak.md' else 'Ann Oak (b. ~1806, there).md' end"
SAID = "text || chr(10) || case doc_id % 5 when 0 then '**Residence: Elm' when 1 then 'she lives in Elmton' when 2 then 'Married at 12 Elm St' when 3 then 'at 12 Elm St, QLD 4000' else '**Email: none' end"


@query(f"""with l as (select doc_id, unnest(string_split(said, chr(10))) as x, generate_subscripts(string_split(said, chr(10)), 1) as i from (select doc_id, {SAID} as said, {NAME} as name from documents) where not regexp_matches(name, '{L.DEAD_NAME}') or regexp_matches(name, '{L.FORCED}'))
select doc_id, i::bigint as line, rule from (select doc_id, i, case {" ".join(f"when regexp_matches(x, '{p}') then '{n}'" for n, p in L.RULES)} end as rule from l where not regexp_matches(x, '{L.LET_THROUGH}')) where rule is not null""")
def living_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SAID} as said", f"{NAME} as name").where(L.to_check(F.col("name")))
    return Q.first_hits(rows, "doc_id", "said", L.RULES, L.LET_THROUGH)


BRANDED = "p_brand || ' ' || p_name"


@query(f"""with s as (select distinct case when p_partkey % 5 = 0 then {BRANDED} else {BRANDED} || '-' || (1800 + p_size) end as slug from part), k as (select distinct {BRANDED} as key from part union select 'none'),
d as (select regexp_replace(slug, '-[0-9]{{4}}$', '') as base, count(*) as n, min(slug) as one from s where regexp_matches(slug, '-[0-9]{{4}}$') group by 1)
select key, case when s.slug is not null then 'exact' when n = 1 then 'dated' when n > 1 then 'ambiguous' else 'missing' end as how, case when s.slug is not null then s.slug when n = 1 then one end as slug from k left join s on s.slug = key left join d on base = key""")
def manifest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    keys = part.select(F.expr(BRANDED).alias("key")).union(spark.range(1).select(F.lit("none")))
    return E.manifest_keys(keys, "key", part.selectExpr(f"if(p_partkey % 5 = 0, {BRANDED}, {BRANDED} || '-' || (1800 + p_size)) as slug"), "slug")


@query("select l_partkey as ref, list_sort(list(distinct l_orderkey || ':' || l_returnflag)) as contexts from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 3 > 0) group by 1")
def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey as ref", "cast(l_orderkey as string) as at", "l_returnflag")
    return E.unresolved(rows, "ref", ["at", "l_returnflag"], table(spark, sf_dir, "part").where("p_partkey % 3 > 0"), "p_partkey")


@query("""with core as (select c_custkey from customer where c_nationkey = 3), keep as (select c_custkey from core union select c_custkey // 2 from core union select c_custkey from customer where c_custkey % 50 = 0)
select c_custkey, c_custkey in (select c_custkey from keep) as keep from customer""")
def kept_and_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    refs = rows.select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 2).cast("long").alias("dst"))
    return E.kept_and_removed(rows, "c_custkey", F.col("c_nationkey") == 3, refs, "src", "dst", rows.where("c_custkey % 50 = 0"))


@query("""with o as (select s_suppkey, case when s_suppkey % 4 > 0 then s_name end as body from supplier where s_suppkey % 3 > 0), n as (select s_suppkey, case when s_suppkey % 8 > 0 then s_name end as body from supplier where s_suppkey % 5 > 0)
select * from (select coalesce(o.s_suppkey, n.s_suppkey) as s_suppkey, case when o.s_suppkey is null then 'missing' when n.s_suppkey is null then 'stale' when o.body is distinct from n.body then 'differing' end as state from o full join n on o.s_suppkey = n.s_suppkey) where state is not null""")
def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    old = rows.where("s_suppkey % 3 > 0").selectExpr("s_suppkey", "if(s_suppkey % 4 > 0, s_name, null) as body")
    return V.drift(old, rows.where("s_suppkey % 5 > 0").selectExpr("s_suppkey", "if(s_suppkey % 8 > 0, s_name, null) as body"), "s_suppkey", "body")


@query("""with o as (select o_custkey as k, list(distinct o_orderkey::varchar) as e from orders where o_custkey % 7 > 0 group by 1), n as (select o_custkey as k, list(distinct o_orderkey::varchar) as e from orders where o_custkey % 11 > 0 and o_orderkey % 6 > 0 group by 1),
w as (select o.k, case when o.k % 13 = 5 then o.k + 1 else o.k end as now, e from o where o.k % 17 <> 4)
select w.k, 'vanished' as issue, '' as column, [] as entries from w where now not in (select k from n) union all select w.k, 'shrank', 'e', list_sort(list_filter(w.e, lambda x: not list_contains(n.e, x))) from w join n on n.k = w.now where len(list_filter(w.e, lambda x: not list_contains(n.e, x))) > 0
union all select n.k, 'below_minimum', 'e', [] from n where n.k % 3 = 0 and len(n.e) < 9""")
def guarded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    entries = lambda where: orders.where(where).groupBy("k").agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("e"))
    keys = orders.select("k").distinct()
    renames = keys.where("k % 13 = 5").select(F.col("k").alias("from"), (F.col("k") + 1).alias("to"))
    least = keys.where("k % 3 = 0").select("k", F.lit("e").alias("column"), F.lit(9).alias("n"))
    return V.gone_or_short(entries("k % 7 > 0"), entries("k % 11 > 0 and o_orderkey % 6 > 0"), "k", ["e"], keys.where("k % 17 = 4"), renames, least)


@query("with s as (select user_id, max(ts) as ts from events where event_id % 2 = 0 group by 1), a as (select user_id, max(ts) as ts from events where user_id % 3 = 0 group by 1) select coalesce(s.user_id, a.user_id) as user_id, coalesce(a.ts, s.ts) as ts from s full join a on a.user_id = s.user_id")
def advanced_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a run of which the rows of some keys were accepted."""
    events = table(spark, sf_dir, "events")
    last = lambda df: df.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return V.advanced(last(events.where("event_id % 2 = 0")), last(events.where("user_id % 3 = 0")), "user_id", "ts")
