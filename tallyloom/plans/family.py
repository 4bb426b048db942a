"""Repair of a graph of persons that is made from the customers' keys: k's parents are k div 3 and, for some, others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import family as R
from ..operators import graph as G
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

K = "c_custkey"
BORN = f"cast(case when {K} % 8 > 0 then 1800 + ({K} * 13) % 150 end as int)"
PEOPLE = f"select {K} as slug, {BORN} as birth, cast(case when {K} % 3 > 0 then 1800 + ({K} * 13) % 150 + {K} % 80 end as int) as death, {K} % 5 = 0 as is_living, 'S' || ({K} % 4) as surname from customer"
CLAIMS = f"select cast(floor({K} / 3) as bigint) as parent, cast({K} as bigint) as child from customer where {K} > 0 union all select cast({K} as bigint), cast(floor({K} / 3) as bigint) from customer where {K} > 0 and {K} % 6 = 0"
SIBLINGS = f"select cast(floor({K} / 3) as bigint) as a, cast({K} as bigint) as b from customer where {K} > 0 and {K} % 10 = 0"
PARENTS = f"select cast({K} as bigint) as child, cast(floor({K} / 3) as bigint) as parent from customer where {K} > 0 union select cast({K} as bigint), cast(floor({K} / 2) as bigint) from customer where {K} > 0 union select cast({K} as bigint), cast(floor({K} / 5) as bigint) from customer where {K} > 0 and {K} % 2 = 0"


def _rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("family_of_customer")
    return spark.sql(sql.replace("from customer", "from family_of_customer"))


@query(f"""with p as ({PEOPLE}), c as (select distinct parent, child from ({CLAIMS})), s as (select distinct a, b from ({SIBLINGS}))
select c.parent, c.child, case when exists (select 1 from s where a = c.parent and b = c.child) then 'refused_sibling' when y.birth - x.birth not between 11 and 65 then 'refused_gap' when exists (select 1 from c d where d.parent = c.child and d.child = c.parent) and not coalesce(y.birth - x.birth between 13 and 55, false) then 'refused_conflict' else 'kept' end as verdict
from c left join p x on x.slug = c.parent left join p y on y.slug = c.child""")
def parent_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parent_claims(_rows(spark, sf_dir, CLAIMS), _rows(spark, sf_dir, PEOPLE), _rows(spark, sf_dir, SIBLINGS))


@query(f"with p as ({PEOPLE}), e as (select {K} as a, {K} + 7 as b from customer) select a, b from e left join p x on x.slug = a left join p y on y.slug = b where coalesce(abs(x.birth - y.birth) <= 55, true)")
def plausible_spouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.spouse_edges(_rows(spark, sf_dir, f"select {K} as a, {K} + 7 as b from customer"), _rows(spark, sf_dir, PEOPLE))


#: For each use of the gates: least and most years of a parent, of a child, spouse, sibling, years after a parent's death, overlap of lives; none: no limit.
GATE_LIMITS = {"edge": (11, 65, 11, 65, 55, None, None, False), "match": (12, None, -5, 55, 50, None, None, False), "slug": (11, 70, 11, 70, 70, None, 0, True), "render": (10, 60, 10, 60, None, None, 1, False), "verify": (-8, 62, -8, 62, None, None, None, False)}
PAIRS = f"select {K}, split_part('parent,child,spouse,sibling,friend', ',', cast(1 + {K} % 5 as int)) as relation, cast(case when {K} % 7 > 0 then 1800 + {K} % 97 end as int) as birth, cast(case when {K} % 4 > 0 then 1850 + {K} % 97 end as int) as death, cast(1800 + ({K} * 5) % 83 as int) as other, cast(case when {K} % 3 = 0 then 1830 + {K} % 83 end as int) as other_death from customer"


def _gate_sql(name: str) -> str:
    pl, pm, cl, cm, spouse, sibling, after, overlap = GATE_LIMITS[name]
    test = lambda *parts: " and ".join([p for p in parts if p]) or "true"
    some = lambda limit, text: None if limit is None else f"coalesce({text}, true)"
    return f"""select {K}, case relation when 'parent' then {test(some(pl, f'birth - other >= {pl}'), some(pm, f'birth - other <= {pm}'), some(after, f'birth <= other_death + {after}'))}
 when 'child' then {test(some(cl, f'other - birth >= {cl}'), some(cm, f'other - birth <= {cm}'), some(after, f'other <= death + {after}'))}
 when 'spouse' then {test(some(spouse, f'abs(birth - other) <= {spouse}'), 'coalesce(other <= death, true) and coalesce(birth <= other_death, true)' if overlap else None)} when 'sibling' then {test(some(sibling, f'abs(birth - other) <= {sibling}'))} else true end as ok from ({PAIRS})"""


def _gate(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _rows(spark, sf_dir, PAIRS)
        return rows.select(K, D.plausible(F.col("relation"), F.col("birth"), F.col("death"), F.col("other"), F.col("other_death"), D.GATES[name]).alias("ok"))

    return run


for _name in GATE_LIMITS:
    query(_gate_sql(_name), name=f"date_gate_{_name}")(_gate(_name))


@query(f"with p as ({PEOPLE}) select slug, coalesce(1815 + slug % 60 - birth between 12 and 70, true) as ok from p")
def marriage_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, PEOPLE).select("slug", R.marriage_plausible(F.col("birth"), F.col("slug") % 60 + 1815).alias("ok"))


@query(f"""with p as ({PEOPLE}), e as (select x.child, x.parent, c.birth as cb, c.is_living as cl, q.birth as pb, q.is_living as pl from ({PARENTS}) x left join p c on c.slug = x.child left join p q on q.slug = x.parent),
a as (select *, count(*) over w as n, cb is null and pb is null and count(pb) over w > 0 as und, coalesce(pl, false) and not coalesce(cl, true) and cb is not null as liv0, count_if(coalesce(cb - pb between 15 and 45, false)) over w > 0 as sure from e window w as (partition by child)),
b as (select *, liv0 and count_if(liv0) over (partition by child) < n as liv from a), d as (select *, not liv and sure and cb is not null and coalesce(cb - pb not between 15 and 50, true) as odd0 from b),
f as (select *, odd0 and count_if(odd0) over (partition by child) < count_if(not liv) over (partition by child) as odd from d) select child, parent from f where not (n > 2 and (und or liv or odd))""")
def deduplicated_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.deduplicated_parents(_rows(spark, sf_dir, PARENTS), _rows(spark, sf_dir, PEOPLE))


DECLARED = f"select cast({K} as bigint) as child, 'father' as slot, cast(floor({K} / 3) as bigint) as parent from customer where {K} % 2 = 0 union all select cast({K} as bigint), 'mother', cast(floor({K} / 2) as bigint) from customer where {K} % 3 = 0"
SLOT_CLAIMS = f"select cast({K} as bigint) as child, split_part('father,mother,any', ',', cast(1 + {K} % 3 as int)) as slot, cast(floor({K} / split_part('3,4,2,7', ',', cast(1 + cast(floor({K} / 3) as bigint) % 4 as int))) as bigint) as parent from customer"
PARTNERS = f"select cast(floor({K} / 3) as bigint) as a, cast(floor({K} / 7) as bigint) as b from customer where {K} % 4 = 0"


@query(f"""with d as ({DECLARED}), s as (select distinct a, b from ({PARTNERS}) union select b, a from ({PARTNERS})) select c.child, c.slot, c.parent from ({SLOT_CLAIMS.replace("floor(c_custkey / split_part('3,4,2,7', ',', cast(1 + cast(floor(c_custkey / 3) as bigint) % 4 as int)))", "floor(c_custkey / cast(split_part('3,4,2,7', ',', cast(1 + cast(floor(c_custkey / 3) as bigint) % 4 as int)) as int))")}) c
where not exists (select 1 from d where d.child = c.child and d.parent = c.parent) and case c.slot when 'any' then exists (select 1 from d where d.child = c.child) and not exists (select 1 from d join s on s.a = d.parent where d.child = c.child and s.b = c.parent) else exists (select 1 from d where d.child = c.child and d.slot = c.slot) end""")
def contradicted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contradicted(_rows(spark, sf_dir, SLOT_CLAIMS.replace("split_part('3,4,2,7', ',', cast(1 + cast(floor(c_custkey / 3) as bigint) % 4 as int))", "cast(split_part('3,4,2,7', ',', cast(1 + cast(floor(c_custkey / 3) as bigint) % 4 as int)) as int)")), _rows(spark, sf_dir, DECLARED), _rows(spark, sf_dir, PARTNERS))


SURVIVORS = f"select cast({K} as bigint) as slug, cast({K} + 1 as bigint) as survivor from customer where {K} % 9 = 4"


@query(f"select distinct case when parent % 9 = 4 and parent in (select slug from ({SURVIVORS})) then parent + 1 else parent end as parent, case when child % 9 = 4 then child + 1 else child end as child from ({CLAIMS}) where case when parent % 9 = 4 then parent + 1 else parent end <> case when child % 9 = 4 then child + 1 else child end")
def handed_over_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.handed_over(_rows(spark, sf_dir, CLAIMS), _rows(spark, sf_dir, SURVIVORS), ["parent", "child"])


FLAGGED = f"select cast({K} as bigint) as child from customer where {K} % 6 = 1"


@query(f"with f as ({FLAGGED}) select 'parent' as kind, child as a, parent as b from ({PARENTS}) where child not in (select child from f) union all select 'sibling', a, b from ({SIBLINGS}) where a not in (select child from f) and b not in (select child from f) union all select 'disputed', child, parent from ({PARENTS}) where child in (select child from f)")
def unproven_parentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, siblings, disputed = R.unproven(_rows(spark, sf_dir, PARENTS), _rows(spark, sf_dir, SIBLINGS), _rows(spark, sf_dir, FLAGGED))
    row = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    return row(parents, "parent", "child", "parent").union(row(siblings, "sibling", "a", "b")).union(row(disputed.select("child", F.explode("disputed_parent_refs").alias("parent")), "disputed", "child", "parent"))


@query("select p_partkey, [p_name, p_brand] || list_filter([p_type, p_brand, 'Old ' || p_name], lambda x: x not in (p_name, p_brand, case when p_partkey % 2 = 0 then p_type else '' end)) as names from part")
def carried_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.array("p_type", "p_brand", F.concat(F.lit("Old "), "p_name"))
    shown = F.array(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", R.carried(before, F.array("p_name", "p_brand"), shown).alias("names"))


@query(f"with g as (select {K} as slug, cast(1 + {K} % 6 as int) as generation from customer), e as ({PARENTS}), pairs as (select distinct x.parent as slug, y.parent as other from e x join e y using (child) where x.parent <> y.parent), l as (select pairs.slug, min(o.generation) as g from pairs join g s on s.slug = pairs.slug join g o on o.slug = other where o.generation < s.generation and s.generation - o.generation <= 2 group by 1) select g.slug, coalesce(l.g, generation) as generation from g left join l using (slug)")
def aligned_spouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.aligned_spouses(_rows(spark, sf_dir, f"select {K} as slug, cast(1 + {K} % 6 as int) as generation from customer"), _rows(spark, sf_dir, PARENTS))


LINKS = f"select cast(floor({K} / 3) as bigint) as src, cast({K} as bigint) as dst from customer where {K} > 0 and {K} % 7 > 0"


@query(f"with recursive e as ({LINKS}), r(node) as (select 0::bigint union select e.dst from e join r on e.src = r.node) select {K} as node from customer where {K} not in (select node from r)")
def detached_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col(K).alias("node"))
    return R.detached(_rows(spark, sf_dir, LINKS), spark.range(1).select(F.col("id").alias("node")), people)


@query("select distinct l_returnflag as kind, l_partkey as node from lineitem where l_partkey = l_suppkey")
def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.self_loops(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("select o_custkey, case when count(*) >= 10 or count(distinct o_orderpriority) >= 5 then 0 else count(distinct o_orderpriority) end::int as n_parents, case when count(*) >= 10 then 0 else count(*) end::int as n_children, case when count(*) >= 10 then 0 else 1 end::int as n_spouses from orders group by 1")
def pruned_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("parents"), F.collect_list("o_orderkey").alias("children"), F.array(F.lit("x")).alias("spouses"))
    out = R.without_stubs(rows, "parents", "children", ["spouses"])
    return out.select("o_custkey", *[F.size(c).alias(f"n_{c}") for c in ("parents", "children", "spouses")])


EDGES = f"select 'parent' as kind, cast({K} as bigint) as src, cast(floor({K} / 3) as bigint) as dst from customer where {K} > 0 union all select 'child', cast(floor({K} / 3) as bigint), cast({K} as bigint) from customer where {K} > 0 and {K} % 4 > 0 union all select 'spouse', cast({K} as bigint), cast(floor({K} / 3) as bigint) from customer where {K} > 0 and {K} % 10 = 0"
QUARANTINE = f"""with p as ({PEOPLE}), e as (select distinct kind, src, dst from ({EDGES})), j as (select e.*, a.birth as b1, a.death as d1, b.birth as b2, b.death as d2 from e left join p a on a.slug = src left join p b on b.slug = dst),
bad as (select kind, src, dst from j where (kind = 'parent' and not (coalesce(b1 - b2 >= 11, true) and coalesce(b1 - b2 <= 60, true) and coalesce(b1 <= d2, true)) or kind = 'child' and not (coalesce(b2 - b1 >= 11, true) and coalesce(b2 - b1 <= 60, true) and coalesce(b2 <= d1, true))) and not exists (select 1 from e m where m.kind = 'spouse' and (m.src = j.src and m.dst = j.dst or m.src = j.dst and m.dst = j.src))),
back as (select e.* from e join bad on e.src = bad.dst and e.dst = bad.src and e.kind = case bad.kind when 'parent' then 'child' else 'parent' end where (e.kind, e.src, e.dst) not in (select (kind, src, dst) from bad)),
removed as (select *, 'impossible' as reason from bad union all select *, 'reciprocal' from back)"""


@query(f"{QUARANTINE} select * from removed")
def quarantined_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quarantined(_rows(spark, sf_dir, EDGES), _rows(spark, sf_dir, PEOPLE))[1]


@query(f"select distinct kind, src, dst from ({EDGES})")
def restored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What quarantine removed and its journal gives back."""
    kept, removed = R.quarantined(_rows(spark, sf_dir, EDGES), _rows(spark, sf_dir, PEOPLE))
    return R.restored(kept, removed)


@query("with a as (select o_custkey as k, list(distinct o_orderkey % 97) as refs from orders group by 1) select k, list_sort(list_filter(refs, lambda x: x % 7 <> 3)) as refs from a where k % 7 <> 3")
def retired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.col("o_orderkey") % 97).alias("refs"))
    gone = rows.select("k").union(rows.select(F.explode("refs").alias("k"))).distinct().where("k % 7 = 3").withColumn("reason", F.lit("made up for this test of retirement"))
    return R.retired(rows, "k", ["refs"], gone).select("k", F.array_sort("refs").alias("refs"))


@query("with r as (select p_partkey as slug, p_name, p_size % 10 as y from part), g as (select * from r where slug % 5 = 0), c as (select p_name, y, min(slug) as twin from r where slug % 5 > 0 group by 1, 2 having count(*) = 1) select slug as ghost, twin from g left join c using (p_name, y)")
def ghost_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), "p_name", (F.col("p_size") % 10).alias("y"))
    return R.twins(rows.where("slug % 5 = 0"), rows, ["p_name", "y"])


@query(f"with recursive p as ({PEOPLE}), e as (select cast(floor({K} / 3) as bigint) as parent, {K} as child from customer where {K} > 0), r(root, node, surname, depth) as (select slug, slug, surname, 0 from p union all select r.root, e.child, r.surname, r.depth + 1 from r join e on e.parent = r.node join p on p.slug = e.child and p.surname = r.surname) select root, node, min(depth)::int as depth from r where depth > 0 group by 1, 2")
def surname_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _rows(spark, sf_dir, PEOPLE)
    edges = _rows(spark, sf_dir, f"select cast(floor({K} / 3) as bigint) as parent, cast({K} as bigint) as child from customer where {K} > 0")
    return R.line_of(edges, people, people.select(F.col("slug").alias("node")))


@query("select distinct l_partkey as src, l_suppkey as dst from lineitem where l_returnflag = 'A' and exists (select 1 from lineitem m where m.l_returnflag = 'R' and m.l_partkey = lineitem.l_partkey and m.l_suppkey = lineitem.l_suppkey)")
def cross_branch_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "sibling").when(F.col("l_returnflag") == "R", "parent").otherwise("spouse")
    return R.structural_contradictions(table(spark, sf_dir, "lineitem").select(kind.alias("kind"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query(f"with p as ({PEOPLE}) select {K} as parent, {K} * 2 as child, case when c.slug is not null then c.birth else p.birth + 25 end::int as birth, c.slug is null as virtual from customer left join p on p.slug = {K} left join p c on c.slug = {K} * 2")
def virtual_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.virtual_children(_rows(spark, sf_dir, f"select {K} as parent, {K} * 2 as child from customer"), _rows(spark, sf_dir, PEOPLE))


@query(f"select 'parent' as kind, {K} as src, {K} // 3 as dst from customer where {K} > 0 union all select 'spouse', {K}, {K} + 1 from customer where {K} % 2 = 0 union all select 'spouse', {K}, {K} + 5 from customer where {K} % 2 = 0")
def built_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by kind from rows with an array for each relation."""
    rows = _rows(spark, sf_dir, f"select {K}, case when {K} > 0 then array(cast(floor({K} / 3) as bigint)) else array() end as parents, case when {K} % 2 = 0 then array({K} + 1, {K} + 5) else array() end as spouses from customer")
    return G.edges_from_arrays(rows, K, {"parents": "parent", "spouses": "spouse"})


@query(f"select a.child, a.parent from ({CLAIMS}) a join ({CLAIMS}) b on a.child = b.parent and a.parent = b.child where a.child < a.parent group by all")
def two_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.two_cycles(_rows(spark, sf_dir, CLAIMS).distinct()).select("child", "parent")


@query(f"with p as ({PEOPLE}) select slug, case when birth is null then 99 else greatest(1, round((birth - 1760) / 30)::int + 1) end::int as rounded, case when birth is null then 99 else greatest(1, floor((birth - 1760) / 30)::int + 1) end::int as floored from p")
def generations_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, PEOPLE).select("slug", D.generation_by_year(F.col("birth"), 1760).alias("rounded"), G.generations_by_floor(F.col("birth"), 1760).alias("floored"))


@query("with a as (select o_custkey as k, list(distinct o_orderkey % 97) as refs from orders group by 1) select k, list_sort(list_distinct(list_filter(list_transform(refs, lambda x: case when x % 9 = 2 then x + 1 else x end), lambda x: x <> k))) as refs from a where k % 9 <> 2")
def merged_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows merged into their keepers, and what referred to them."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.col("o_orderkey") % 97).alias("refs"))
    gone = rows.select("k").union(rows.select(F.explode("refs").alias("k"))).distinct().where("k % 9 = 2").select(F.col("k").alias("gone"), (F.col("k") + 1).alias("keeper"))
    return R.merged(rows, "k", ["refs"], gone).select("k", F.array_sort("refs").alias("refs"))


@query("select lower(replace(p_name, ' ', '-')) as slug, min(p_name) as name, count(*)::bigint as n, true as is_stub from part where p_partkey % 4 > 0 group by 1")
def stubs_of_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).otherwise(" ").alias("name"))
    return R.stubs(rows, F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("-")), "name")
