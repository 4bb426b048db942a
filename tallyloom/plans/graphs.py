"""Graphs and gates. The hierarchy is made of keys: the parent of customer k is k div 3, of order lines their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates as Q
from ..operators import graph as G
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where("c_custkey > 0").select(k.alias("child"), F.floor(k / 3).cast("long").alias("parent"))


TREE = "with recursive p as (select c_custkey as child, c_custkey // 3 as parent from customer where c_custkey > 0)"


@query(f"{TREE}, s as (select a.child as a, b.child as b from p a join p b on a.child % 5 = 0 and b.child = a.child + 1), e(t, f, m) as (select child, parent, 1 from p union all select b, a, 0 from s union all select a, b, 0 from s), g(node, d) as (select 0::bigint, 1 union select e.t, g.d + e.m from g join e on e.f = g.node where g.d < 40) select c_custkey, coalesce(min(d), 99)::int as generation from customer left join g on node = c_custkey group by 1")
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = _parents(spark, sf_dir)
    pairs = parents.where("child % 5 = 0").select(F.col("child").alias("a"), (F.col("child") + 1).alias("b")).join(parents.select(F.col("child").alias("b")), "b", "left_semi").select("a", "b")
    people = table(spark, sf_dir, "customer").select("c_custkey")
    return G.generations(people, "c_custkey", parents, pairs, people.where("c_custkey = 0"))


@query(f"{TREE}, a(src, dst, hops) as (select child, parent, 1 from p union select a.src, p.parent, a.hops + 1 from a join p on p.child = a.dst) select src, dst, min(hops)::int as hops from a group by all")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closure(_parents(spark, sf_dir).select(F.col("child").alias("src"), F.col("parent").alias("dst")), 40)


@query(f"{TREE}, d(root, node, level) as (select c_custkey, c_custkey, 0 from customer union all select d.root, p.child, d.level + 1 from d join p on p.parent = d.node where d.level < 6) select root, count(*)::bigint as n, max(level)::int as depth from d where level > 0 group by 1")
def descendant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all customers, six generations deep."""
    roots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return G.descendant_totals(_parents(spark, sf_dir), roots, 6)


@query("select a.c_custkey as a, b.c_custkey as b from customer a join customer b on a.c_custkey // 3 = b.c_custkey // 3 and a.c_nationkey % 4 = b.c_nationkey % 4 and a.c_custkey < b.c_custkey where a.c_custkey > 2")
def derived_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where("c_custkey > 2").select(k.alias("child"), F.explode(F.array(F.floor(k / 3).cast("long"), (F.col("c_nationkey") % 4 - 10).cast("long"))).alias("parent"))
    return G.siblings(rows, 2)


@query("select sha256(l || ',' || h) as \"group\", child from (select c_custkey as child, least(c_custkey // 3, c_nationkey % 4 - 10)::varchar as l, greatest(c_custkey // 3, c_nationkey % 4 - 10)::varchar as h from customer where c_custkey > 2)")
def sibling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where("c_custkey > 2").select(k.alias("child"), F.explode(F.array(F.floor(k / 3).cast("long"), (F.col("c_nationkey") % 4 - 10).cast("long"))).alias("parent"))
    return G.sibling_groups(rows, 2)


@query("select l_orderkey as child, count(distinct l_suppkey)::bigint as n_parents from lineitem group by 1 having count(distinct l_suppkey) > 2")
def too_many_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.over_cap(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("child"), F.col("l_suppkey").alias("parent")), 2)


@query("select distinct s_suppkey as node, (case when s_suppkey % 10 < 3 then 3 else 2 end)::int as hops from supplier where s_suppkey % 10 < 5")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ten keys, 0 to 2 are a cycle of three, 3 and 4 of two, the rest lead to nothing."""
    k = F.col("s_suppkey")
    d, ten = k % 10, F.floor(k / 10) * 10
    dst = F.when(d < 3, ten + (d + 1) % 3).when(d < 5, ten + 7 - d)
    return G.on_cycle(table(spark, sf_dir, "supplier").select(k.alias("src"), dst.cast("long").alias("dst")).where("dst is not null"), 6)


@query("select c_custkey as src, (case when c_custkey % 16 > 13 then null else c_custkey // 16 * 16 end)::bigint as end from customer where c_custkey % 16 > 0")
def chain_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects k -> k - 1 down to a multiple of 16; the last two of each 16 point at one another."""
    k = F.col("c_custkey")
    dst = F.when(k % 16 == 15, k - 1).when(k % 16 == 14, k + 1).otherwise(k - 1)
    return G.chain_ends(table(spark, sf_dir, "customer").where("c_custkey % 16 > 0").select(k.alias("src"), dst.alias("dst")))


@query("select distinct least(o_custkey % 50, o_orderkey % 50) as src, greatest(o_custkey % 50, o_orderkey % 50) as dst, o_orderstatus as kind from orders where o_custkey % 50 <> o_orderkey % 50")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.undirected(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 50).alias("src"), (F.col("o_orderkey") % 50).alias("dst")))


@query("select distinct l_partkey + 3 as end from lineitem where l_partkey + 3 not in (select p_partkey from part)")
def dangling_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    edges = table(spark, sf_dir, "lineitem").select(F.lit("line").alias("kind"), F.col("l_partkey").alias("src"), (F.col("l_partkey") + 3).alias("dst"))
    return G.dangling(edges, part, "p_partkey")


ISSUES_SQL = """select 'repeated_identity' as gate, p_name || '|' || p_brand as key, count(*)::varchar as detail, 'low' as severity from part group by p_name, p_brand having count(*) > 6
union all select 'negative_balance', c_custkey::varchar, c_mktsegment, 'medium' from customer where c_acctbal < -900
union all select 'shipped_before_order', l_orderkey::varchar, l_linenumber::varchar, 'high' from lineitem join orders on o_orderkey = l_orderkey where l_shipdate < o_orderdate"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n")).where("n > 6")
    poor = table(spark, sf_dir, "customer").where("c_acctbal < -900")
    early = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate < o_orderdate")
    return Q.united([Q.issues(part, "repeated_identity", F.concat_ws("|", "p_name", "p_brand"), F.col("n"), "low"), Q.issues(poor, "negative_balance", F.col("c_custkey"), F.col("c_mktsegment"), "medium"), Q.issues(early, "shipped_before_order", F.col("l_orderkey"), F.col("l_linenumber"), "high")])


@query(ISSUES_SQL)
def gate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@query(f"select h as n_high, m as n_medium, l as n_low, greatest(0, least(10, round(10 - 2 * h - 0.5 * m - 0.05 * l, 2)))::double as score from (select count_if(severity = 'high')::bigint as h, count_if(severity = 'medium')::bigint as m, count_if(severity = 'low')::bigint as l from ({ISSUES_SQL}))")
def gate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.score(_issues(spark, sf_dir))


@query("""select 'coverage' as gate, avg((s_suppkey is not null)::int)::double as share, count(*)::bigint as n from lineitem left join (select s_suppkey from supplier where s_suppkey % 7 <> 0) s on s_suppkey = l_suppkey""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").select("s_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey").join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.agg(F.lit("coverage").alias("gate"), F.avg(F.col("s_suppkey").isNotNull().cast("int")).alias("share"), F.count("*").alias("n"))
