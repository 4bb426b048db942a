"""Joins, grouping, ranking, survivorship, versions and resolution on the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import graph as G
from ..operators import resolve as X
from ..operators import search as S
from ..operators import versions as V
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query


@query("select c_mktsegment as name, count(*)::bigint as n, min(c_acctbal) as least, max(c_acctbal) as most, count_if(c_acctbal < 0)::bigint as n_negative from customer group by 1")
def counts_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"))


@query("select p_name, p_brand, count(*)::bigint as n, min(p_partkey) as first from part group by all having count(*) > 1")
def repeated_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


@query("select upper(substr(p_name, 1, 1)) as letter, list_sort(list(distinct p_name)) as names from part group by 1")
def letter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(T.first_letter(F.col("p_name")).alias("letter")).agg(F.array_sort(F.collect_set("p_name")).alias("names"))


@query("select p_type, list(p_partkey order by p_size, p_partkey) as members from part group by 1")
def ordered_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_sort(F.collect_list(F.struct("p_size", "p_partkey"))).alias("m"))
    return rows.select("p_type", F.transform("m", lambda x: x.p_partkey).alias("members"))


@query("select o_custkey, min(year(o_orderdate))::int as first_year, greatest(max(year(o_orderdate)), max(year(l_shipdate)))::int as last_year from orders join lineitem on l_orderkey = o_orderkey group by 1")
def spans_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("first_year"), F.greatest(F.max(F.year("o_orderdate")), F.max(F.year("shipped"))).alias("last_year"))


@query("select o_custkey, o_orderkey, rank::int as rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 4")
def top_of_each_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", n.alias("rank")).where("rank <= 4")


@query("select p_name, p_brand, p_type, p_partkey, p_size from part qualify row_number() over (partition by p_name, p_brand, p_type order by p_size desc, p_partkey) = 1")
def surviving_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", "p_partkey", "p_size")
    return X.survivors(rows, ["p_name", "p_brand", "p_type"], [F.desc("p_size"), F.asc("p_partkey")])


@query("""with a as (select p_partkey, case when count(*) over (partition by lower(p_name)) > 1 then p_name || ' (' || p_size || ')' else p_name end as t from part)
select p_partkey, case when row_number() over (partition by t order by p_partkey) > 1 then t || '-' || row_number() over (partition by t order by p_partkey) else t end as shown from a""")
def disambiguated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.disambiguated(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_name", "p_partkey", "p_size").select("p_partkey", "shown")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_orderpriority = '1-URGENT')")
def isolated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without any relation of a kind."""
    related = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(related, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def linked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select page_id, count(*)::bigint as n_broken from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as h from pages) where regexp_replace(h, '[?#].*$', '') not in (select regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') from pages) group by 1")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    plain = lambda c: F.regexp_replace(c, "[?#].*$", "")
    built = pages.select(plain(F.regexp_replace("url", "^https?://[^/]+", "")).alias("path")).distinct()
    return pages.select("page_id", F.explode(T.hrefs(F.col("html"))).alias("h")).select("page_id", plain(F.col("h")).alias("path")).join(built, "path", "left_anti").groupBy("page_id").agg(F.count("*").alias("n_broken"))


@query("""with t as (select distinct p_name, string_split(p_name, ' ') as w from part), q as (select distinct s_suppkey, string_split(case s_suppkey % 3 when 0 then 'ring' when 1 then 'red widget' else 'blue thing' end, ' ') as w from supplier)
select s_suppkey, count(*)::bigint as n from q join t on t.w[-1] = q.w[-1] and len(list_filter(q.w, lambda x: not list_contains(t.w, x))) = 0 group by 1""")
def token_subset_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that have all words of a reference; the last word is the key of the join."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().select(F.split("p_name", " ").alias("words"))
    k = F.col("s_suppkey") % 3
    refs = table(spark, sf_dir, "supplier").select("s_suppkey", F.split(F.when(k == 0, "ring").when(k == 1, "red widget").otherwise("blue thing"), " ").alias("asked"))
    both = refs.withColumn("last", F.element_at("asked", -1)).join(names.withColumn("last", F.element_at("words", -1)), "last")
    return both.where(F.size(F.array_except("asked", "words")) == 0).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("select text_hash, n, first from (select md5(text) as text_hash, count(*)::bigint as n, min(doc_id) as first from documents group by 1) where n > 1")
def identical_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("""with u as (select p_name as name, min(p_partkey) as key from part group by 1 having count(distinct p_partkey) = 1) select p_partkey, u.key from part left join u on u.name = p_name""")
def unique_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    right = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("key"))
    return X.unique_join(part.select("p_partkey", F.col("p_name").alias("name")), right, "name", "key").select("p_partkey", "key")


RANGES = [(1995, 1996), (1997, 1999), (2000, 2001)]


@query("select a as first, count(*)::bigint as n, round(sum(o_totalprice), 2) as total from orders join (values (1995, 1996), (1997, 1999), (2000, 2001)) r(a, b) on year(o_orderdate) between a and b group by 1")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame(RANGES, "first int, last int")  # a parameter table
    return table(spark, sf_dir, "orders").join(F.broadcast(ranges), F.year("o_orderdate").between(F.col("first"), F.col("last"))).groupBy("first").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""with a as (select c_custkey, case when c_custkey % 4 = 0 then c_custkey + 1 else c_custkey end as says from customer), b as (select c_custkey as says, c_custkey - c_custkey % 2 as back from customer)
select a.c_custkey, a.says from a where not exists (select 1 from b where b.says = a.says and b.back = a.c_custkey)""")
def one_way_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that a row names and that don't name it as their parent."""
    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer")
    edges = people.select(F.lit("child").alias("kind"), k.alias("src"), F.when(k % 4 == 0, k + 1).otherwise(k).alias("dst")).union(people.select(F.lit("parent"), k, k - k % 2))
    return G.one_way(edges, "child", "parent").select(F.col("src").alias("c_custkey"), F.col("dst").alias("says"))


GATE_SQL = """select c_custkey, case relation when 'parent' then coalesce(birth - other >= 11, true) and coalesce(birth - other <= 60, true) and coalesce(birth <= other_death, true) when 'child' then coalesce(other - birth >= 11, true) and coalesce(other - birth <= 60, true) and coalesce(other <= death, true)
 when 'spouse' then coalesce(abs(birth - other) <= 50, true) when 'sibling' then coalesce(abs(birth - other) <= 40, true) else true end as ok from (
 select c_custkey, ['parent', 'child', 'spouse', 'sibling', 'friend'][c_custkey % 5 + 1] as relation, case when c_custkey % 7 <> 0 then 1800 + c_custkey % 97 end as birth, 1850 + c_custkey % 97 as death, 1800 + c_custkey % 83 as other, case when c_custkey % 3 = 0 then 1840 + c_custkey % 83 end as other_death from customer)"""


@query(GATE_SQL)
def date_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    relation = F.element_at(F.array(*map(F.lit, ["parent", "child", "spouse", "sibling", "friend"])), (k % 5 + 1).cast("int"))
    ok = D.plausible(relation, F.when(k % 7 != 0, k % 97 + 1800), k % 97 + 1850, k % 83 + 1800, F.when(k % 3 == 0, k % 83 + 1840), D.GATES["shared"])
    return table(spark, sf_dir, "customer").select("c_custkey", ok.alias("ok"))


@query("""with p as (select p_partkey as slug, p_name as name, 1800 + p_size as birth from part),
r as (select p_partkey as ref_id, p_name as name, case when p_partkey % 2 = 0 then 1800 + p_size end as year from part),
c as (select ref_id, 0 as pr, 'name_year' as rule, slug, true as ok from r join p using (name) where r.year = p.birth
 union all select ref_id, 1, 'name_near_year', slug, true from r join p using (name) where abs(r.year - p.birth) <= 2
 union all select ref_id, 2, 'name', slug, coalesce(abs(r.year - p.birth) <= 25, true) from r join p using (name)),
g as (select ref_id, pr, rule, count(distinct slug) filter (where ok) as n, min(slug) filter (where ok) as one from c group by all),
b as (select ref_id, min(pr) filter (where n > 0) as pr from g group by ref_id)
select r.ref_id, case when g.n = 1 then g.one end as slug, g.rule, case when g.n = 1 then 'resolved' when g.n > 1 then 'ambiguous' when b.ref_id is not null then 'refused_dates' else 'unresolved' end as status
from r left join b using (ref_id) left join g on g.ref_id = b.ref_id and g.pr = b.pr""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as candidates and as references, by three rules on name and year; the whole cascade is reference_cascade."""
    part = table(spark, sf_dir, "part")
    people = part.select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("name"), (F.col("p_size") + 1800).alias("birth"))
    refs = part.select(F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 1800).alias("year"))
    return X.resolve_by_year(refs, people, [("name_year", 0), ("name_near_year", 2), ("name", None)], 25)


OLD, NEW = "c_custkey % 11 <> 0", "c_custkey % 13 <> 0"


@query("""with o as (select c_custkey, c_mktsegment, c_nationkey from customer where c_custkey % 11 <> 0), n as (select c_custkey, c_mktsegment, case when c_custkey % 17 = 0 then 0 else c_nationkey end as c_nationkey from customer where c_custkey % 13 <> 0)
select coalesce(o.c_custkey, n.c_custkey) as c_custkey, case when o.c_custkey is null then 'added' when n.c_custkey is null then 'removed' else 'changed' end as change, case when o.c_custkey is null or n.c_custkey is null then [] else ['c_nationkey'] end as changed
from o full join n on o.c_custkey = n.c_custkey where o.c_custkey is null or n.c_custkey is null or o.c_nationkey <> n.c_nationkey""")
def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = rows.where(NEW).withColumn("c_nationkey", F.when(F.col("c_custkey") % 17 == 0, 0).otherwise(F.col("c_nationkey")))
    return V.changes(rows.where(OLD), new, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("""select o_custkey, list_sort(list_distinct(list(o_orderkey))) as lost from orders where o_orderkey % 10 = 0 group by 1""")
def lost_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    old = orders.groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("all"))
    new = orders.where("o_orderkey % 10 <> 0").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("all"))
    return V.losses(old, new, "o_custkey", "all")


@query("""with c as (select user_id, max(ts) as ts from events group by 1), s as (select user_id, max(ts) as ts from events where ts < timestamp '2024-01-30' and user_id % 9 <> 0 group by 1) select c.user_id, c.ts from c left join s using (user_id) where s.ts is distinct from c.ts""")
def delta_since_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = lambda df: df.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return V.delta(last(events), last(events.where("ts < timestamp '2024-01-30' and user_id % 9 <> 0")), "user_id", "ts")


@query("""select event_type, count(*) filter (where user_id % 10 <> 0)::bigint as value, count(*)::bigint as floor, count(*) - count(*) filter (where user_id % 10 <> 0) <= greatest(5, 0.1 * count(*)) as ok from events group by 1""")
def ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda df: df.groupBy("event_type").agg(F.count("*").alias("value"))
    events = table(spark, sf_dir, "events")
    return V.ratchet(count(events.where("user_id % 10 <> 0")), count(events), "event_type", 0.1, 5)


@query("with o as (select user_id, max_by(event_type, (ts, event_id)) as s from events where ts < timestamp '2024-01-15' group by 1), n as (select user_id, max_by(event_type, (ts, event_id)) as s from events group by 1) select user_id, o.s as was, n.s as now from o join n using (user_id) where o.s in ('signup', 'view') and n.s = 'purchase'")
def status_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that an earlier version has in one state and the present one in another."""
    events = table(spark, sf_dir, "events")
    last = lambda df: df.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return V.transitions(last(events.where("ts < timestamp '2024-01-15'")), last(events), "user_id", "state", ["signup", "view"], ["purchase"])


@query("select user_id, min(ts) as first_seen, min_by(event_type, (ts, event_id)) as first_type, max_by(event_type, (ts, event_id)) as last_type from events group by 1")
def first_and_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.min_by("event_type", order).alias("first_type"), F.max_by("event_type", order).alias("last_type"))


@query("""with t as (select year(o_orderdate)::int as year, 'order' as what, o_orderkey as key from orders union all select year(l_shipdate)::int, 'ship', l_orderkey from lineitem union all select 1999, 'fixed', 0)
select year, what, key, floor(year / 10) is distinct from lag(floor(year / 10)) over (order by year, what, key) as new_decade from t""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated rows of several tables; the least row of each decade is marked; of equal rows, one."""
    a = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.lit("order").alias("what"), F.col("o_orderkey").alias("key"))
    b = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), F.lit("ship").alias("what"), F.col("l_orderkey").alias("key"))
    rows = a.unionByName(b).unionByName(spark.range(1).select(F.lit(1999).alias("year"), F.lit("fixed").alias("what"), F.lit(0).cast("long").alias("key")))
    row = F.struct("year", "what", "key")
    alike = rows.groupBy("year", "what", "key").agg(F.count("*").alias("n"))
    least = alike.groupBy(F.floor(F.col("year") / 10)).agg(F.min(row).alias("least")).select("least")
    marked = alike.join(F.broadcast(least), row.eqNullSafe(F.col("least")), "left")
    return marked.select("year", "what", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "least").select("year", "what", "key", (F.col("least").isNotNull() & (F.col("i") == 1)).alias("new_decade"))


@query("""select p_partkey, p_name, tier from (select p_partkey, p_name, case when starts_with(lower(p_name), 'ri') then 0 when len(list_filter(string_split(lower(p_name), ' '), lambda w: starts_with(w, 'ri'))) > 0 then 1 when contains(lower(p_name), 'ri') then 2 when list_min(list_transform(string_split(lower(p_name), ' '), lambda w: levenshtein(w, 'ri'))) <= 2 then 3 end as tier from part) where tier is not null order by tier, length(p_name), p_name, p_partkey limit 60""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "ri", 60, "p_partkey")


@query("select p_partkey from part where contains(lower(p_name), 'ring') or contains(lower(p_type), 'large') order by p_partkey limit 20")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("ring") | F.lower("p_type").contains("large")).select("p_partkey").orderBy("p_partkey").limit(20)


@query("select key, max(a)::bigint as in_old, max(b)::bigint as in_new from (select o_custkey as key, 1 as a, 0 as b from orders where o_orderdate < timestamp '1998-01-01' union all select o_custkey, 0, 1 from orders where o_orderdate >= timestamp '1998-01-01') group by key having max(a) <> max(b)")
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    cut = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    old, new = orders.where(cut).select(F.col("o_custkey").alias("key")).distinct(), orders.where(~cut).select(F.col("o_custkey").alias("key")).distinct()
    mark = lambda df, a, b: df.select("key", F.lit(a).cast("long").alias("in_old"), F.lit(b).cast("long").alias("in_new"))
    return mark(old.subtract(new), 1, 0).unionByName(mark(new.subtract(old), 0, 1))


@query("""select date_trunc('month', o_orderdate) as month, avg(o_totalprice) as mean, count(*)::bigint as n, list(o_orderkey order by o_totalprice desc, o_orderkey)[1:10] as top from orders group by 1""")
def monthly_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and counts of a month, and its ten highest rows, which are among the ten highest of a day each."""
    orders = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("month"), F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderkey")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    few = orders.withColumn("n", F.row_number().over(W.partitionBy("month", "day").orderBy(*order))).where("n <= 10")
    top = few.withColumn("n", F.row_number().over(W.partitionBy("month").orderBy(*order))).where("n <= 10")
    top = top.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("n", "o_orderkey"))).alias("t")).select("month", F.transform("t", lambda x: x.o_orderkey).alias("top"))
    return orders.groupBy("month").agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("n")).join(top, "month")


@query("select c_custkey, to_json(struct_pack(c_name := c_name, c_mktsegment := c_mktsegment))::varchar as document from customer")
def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct("c_name", "c_mktsegment")).alias("document"))


@query("select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as before, lead(length(text)) over (partition by conv_id order by turn)::int as next_length from conversations")
def neighbours_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead(F.length("text")).over(w).alias("next_length"))


@query("select least(10, ceil(10 * avg(quality)))::int as grade, coalesce(lang, '-') as lang, count(*)::bigint as n, count_if(toxic = 1)::bigint as n_toxic from labels join documents using (doc_id) group by lang")
def trust_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.least(F.lit(10), F.ceil(10 * F.avg("quality"))).cast("int").alias("grade"), F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
