"""Trust, completeness, shapes and lists of persons that are made from the customers' columns, and of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import profiles as P
from .family import _rows
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

K = "c_custkey"
LIFE = f"select {K} as k, cast(case when {K} % 6 > 0 then 1480 + ({K} * 17) % 560 end as int) as birth, cast(case when {K} % 4 > 0 then 1500 + ({K} * 11) % 560 end as int) as death, {K} % 3 = 0 as is_living, case when {K} % 5 = 0 then 'short' when {K} % 7 = 0 then 'He was probably a ' || c_mktsegment || ' here.' when {K} % 11 = 0 then 'Born c. 1850, a maker of things.' else 'A maker of ' || c_mktsegment || ' at home.' end as bio, {K} % 13 = 0 as unknown from customer"
DOUBT = P.DOUBT.replace("'", "''")
TRUST = f"case when birth is null or length(trim(coalesce(bio, ''))) < 15 or unknown then 'unverified' when not is_living and death is null then 'partial' when regexp_matches(coalesce(bio, ''), '{DOUBT}') then 'partial' else 'sourced' end"


def _trust():
    return P.trust_class(F.col("birth"), F.col("death"), F.col("is_living"), F.col("bio"), F.col("unknown"))


@query(f"select k, {TRUST} as trust from ({LIFE})")
def trust_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, LIFE).select("k", _trust().alias("trust"))


@query(f"select *, case when unverified > 0.4 * total then 'unverified_high' when partial > 0.5 * total then 'partial_high' end as alert from (select count(*)::bigint as total, count_if(t = 'sourced')::bigint as sourced, count_if(t = 'partial')::bigint as partial, count_if(t = 'unverified')::bigint as unverified from (select {TRUST} as t from ({LIFE})))")
def trust_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trust_report(_rows(spark, sf_dir, LIFE), _trust())


@query(f"select doc_id, regexp_matches(coalesce(text, ''), '{DOUBT}') as uncertain from documents")
def uncertain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.uncertain(F.coalesce("text", F.lit(""))).alias("uncertain"))


@query(f"with r as ({LIFE}) select 'no_birth' as gate, k::varchar as key, '' as detail, 'low' as severity from r where birth is null union all select 'no_death', k::varchar, '', 'low' from r where not is_living and death is null union all select 'no_text', k::varchar, '', 'low' from r where length(bio) < 15 union all select 'too_old_to_live', k::varchar, birth::varchar, 'medium' from r where is_living and birth < 1900")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.completeness(_rows(spark, sf_dir, LIFE), F.col("k"), F.col("birth"), F.col("death"), F.col("is_living"), F.col("bio"))


@query(f"with r as ({LIFE}) select 'birth_out_of_range' as gate, k::varchar as key, birth::varchar as detail, 'high' as severity from r where birth < 1500 or birth > 2030 union all select 'death_out_of_range', k::varchar, death::varchar, 'high' from r where death < 1500 or death > 2030 union all select 'died_before_birth', k::varchar, death::varchar, 'high' from r where death < birth")
def suspect_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.suspect_years(_rows(spark, sf_dir, LIFE), F.col("k"), F.col("birth"), F.col("death"))


@query(f"select k from ({LIFE}) where birth < 1901 and death is not null and k not in (select s_suppkey from supplier)")
def cut_off_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cut_off(_rows(spark, sf_dir, LIFE), "k", F.col("birth"), F.col("death"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))).select("k")


REF = "case p_partkey % 11 when 0 then p_name || ' (1850–1900)' when 1 then '1850 ' || p_name when 2 then p_name || ' (m. 1870)' when 3 then p_name || ' (née Elm)' when 4 then p_name || ' (adopted)' when 5 then p_name || ' (deceased)' when 6 then p_name || ' (3rd wife)' when 7 then replace(p_name, ' ', '-') || '-x' when 8 then '?' || p_name when 9 then upper(p_name) || ' (brother)' else upper(p_name) end"


@query(f"select p_partkey, case when regexp_matches(r, '\\([0-9]{{4}}.*?\\)') then 'name_with_years' when regexp_matches(r, '^[0-9]{{4}}[^0-9]') then 'year_prefix' when contains(r, '(m. ') then 'marriage_date' when contains(r, '(née') then 'nee_format' when contains(r, '(adopt') then 'adoptive' when contains(r, '(deceased') then 'deceased' when regexp_matches(r, '\\([0-9](?:st|nd|rd|th)') then 'parenthetical' when regexp_matches(r, '^[a-z].*-') then 'mangled_slug' when starts_with(r, '?') then 'unknown' when contains(r, ' (brother') then 'metadata_suffix' else 'display_name' end as category from (select p_partkey, {REF} as r from part)")
def reference_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.category(F.expr(REF)).alias("category"))


@query(f"with p as (select {K} as slug, case {K} % 4 when 0 then 'Oak' || c_nationkey when 1 then 'Elm' when 2 then 'Oakelm' else 'Fir' end as surname from customer), o as (select slug, case when contains(lower(surname), 'elm') then 'second' when contains(lower(surname), 'oak') then 'first' end as b from p), s as (select {K} as a, {K} + 1 as b from customer where {K} % 3 = 0), t as (select a, b from s union all select b, a from s) select slug, coalesce(b, (select min(q.b) from t join o q on q.slug = t.b where t.a = o.slug)) as branch from o")
def inferred_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _rows(spark, sf_dir, f"select {K} as slug, case {K} % 4 when 0 then 'Oak' || c_nationkey when 1 then 'Elm' when 2 then 'Oakelm' else 'Fir' end as surname from customer")
    return P.branches(people, _rows(spark, sf_dir, f"select {K} as a, {K} + 1 as b from customer where {K} % 3 = 0"), [("elm", "second"), ("OAK", "first")])


@query("select sum(2)::bigint as entries, count_if(regexp_matches(a, '^[a-z0-9]+(?:-[a-z0-9]+)*$'))::bigint + count_if(regexp_matches(b, '^[a-z0-9]+(?:-[a-z0-9]+)*$'))::bigint as shaped, count_if(regexp_matches(a, '^[a-z0-9]+(?:-[a-z0-9]+)*$') or regexp_matches(b, '^[a-z0-9]+(?:-[a-z0-9]+)*$'))::bigint as rows_with_any from (select replace(p_name, ' ', case when p_partkey % 3 = 0 then '-' else ' ' end) as a, p_brand as b from part)")
def slug_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.when(F.col("p_partkey") % 3 == 0, "-").otherwise(" "))
    return P.slug_shape(table(spark, sf_dir, "part").select(F.array(name).alias("a"), F.array("p_brand").alias("b")), ["a", "b"])


NAME = "p_name || ' ' || p_brand || ' ' || (p_size % 8)"


@query(f"with r as (select p_partkey, {NAME} as name from part), o as (select name, min(p_partkey) as slug from r group by 1 having count(*) = 1) select p_partkey as ref_id, name as ref, slug from r join o using (name) where not regexp_matches(name, '^[a-z0-9]+(?:-[a-z0-9]+)*$')")
def linkable_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(NAME).alias("name"))
    one = part.groupBy("name").agg(F.min("p_partkey").alias("slug"), F.count("*").alias("n")).where("n = 1")
    return P.linkable(part.select(F.col("p_partkey").alias("ref_id"), F.col("name").alias("ref")), part.join(one, "name").select(F.col("p_partkey").alias("ref_id"), "slug"))


@query("select o_custkey, count(distinct o_orderkey % 5)::int as n from orders group by 1")
def photo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "/images/P").otherwise("p"), (F.col("o_orderkey") % 5).cast("string"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(name).alias("images"))
    return P.photo_counts(rows, "o_custkey", "images")


@query("select count(*)::bigint as n_matches, count(distinct o_orderpriority)::bigint as n_names from orders")
def match_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.match_totals(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("matches")), "matches")


@query("select c_custkey from customer where case when c_custkey % 7 = 0 then true else 'f' || c_custkey in (select 'f' || s_suppkey from supplier where s_suppkey % 3 > 0) end")
def rows_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "if(c_custkey % 7 = 0, null, 'f' || c_custkey) as file")
    files = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "'f' || s_suppkey as file")
    return P.without_orphans(rows, "file", files, files.where("s_suppkey % 3 = 0")).select("c_custkey")


@query("select p_partkey from part where p_partkey % 5 > 0 and p_partkey % 7 > 0")
def real_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "if(p_partkey % 5 = 0, 'Redirect of ' || p_name, p_name) as title", "if(p_partkey % 7 = 0, array(p_brand, 'Redirect'), array(p_brand)) as tags")
    return P.not_redirects(rows, "title", "tags").select("p_partkey")


@query("select p_partkey from part where p_partkey % 4 > 1")
def rows_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "if(p_partkey % 4 = 0, null, p_name) as first_name", "if(p_partkey % 4 = 1, ' ', p_brand) as last_name")
    return P.with_required(rows, ["first_name", "last_name"]).select("p_partkey")


@query("select c_custkey from customer where c_mktsegment = 'BUILDING' or c_custkey % 6 = 0")
def primary_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "if(c_custkey % 6 = 0, null, c_mktsegment) as branch")
    return P.of_lineage(rows, "branch", "BUILDING").select("c_custkey")


@query(f"with p as (select {K} as slug, case when {K} % 5 = 0 then 'Ann Elm' else 'Bo Oak' end as name from customer), s as (select {K} as a, {K} + 1 as b from customer), e as (select {K} as child, cast(floor({K} / 2) as bigint) as parent from customer union select {K}, cast(floor({K} / 2) as bigint) + 1 from customer where {K} % 3 = 0), t as (select a, b from s union select b, a from s), core as (select slug from p where contains(name, 'Elm')) select slug from p where slug in (select slug from core) or slug in (select t.b from t join e x on x.parent = t.a join e y on y.parent = t.b and y.child = x.child where t.a in (select slug from core))")
def lineage_with_spouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _rows(spark, sf_dir, f"select {K} as slug, case when {K} % 5 = 0 then 'Ann Elm' else 'Bo Oak' end as name from customer")
    parents = _rows(spark, sf_dir, f"select {K} as child, cast(floor({K} / 2) as bigint) as parent from customer union select {K}, cast(floor({K} / 2) as bigint) + 1 from customer where {K} % 3 = 0")
    return P.lineage_with_spouses(people, "name", "elm", _rows(spark, sf_dir, f"select {K} as a, {K} + 1 as b from customer"), parents).select("slug")


@query(f"select 'recorded' as status, k from ({LIFE}) where birth is not null union all select 'awaiting', k from ({LIFE}) where birth is null union all select 'all', k from ({LIFE})")
def rows_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, LIFE)
    parts = [P.with_status(rows, F.col("birth").isNotNull(), s).select(F.lit(s).alias("status"), "k") for s in ("recorded", "awaiting", "all")]
    return parts[0].union(parts[1]).union(parts[2])


@query("select o_orderkey as k, 'child' as relation, case when c.c_custkey is not null then o_custkey end as slug, coalesce(c.c_name, case when o_orderkey % 2 = 0 then 'plain' end, o_custkey::varchar) as name, o_orderkey % 5 = 0 as withheld from orders left join (select * from customer where c_custkey % 3 > 0) c on c.c_custkey = o_custkey")
def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "array(named_struct('slug', o_custkey, 'plain_name', if(o_orderkey % 2 = 0, 'plain', null), 'withheld', if(o_orderkey % 5 = 0, true, null))) as children")
    people = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"))
    return P.relation_rows(rows, "k", {"children": "child"}, people)


@query("with a as (select distinct p_name as a from part where length(p_name) >= 3), b as (select distinct case when s_suppkey % 2 = 0 then split_part('ring,blue,red b,ol', ',', cast(1 + s_suppkey % 4 as int)) else 'big ' || split_part('red ring,blue bolt', ',', cast(1 + s_suppkey % 2 as int)) || ' x' end as b from supplier) select a, b from a, b where length(b) >= 3 and (contains(a, b) or contains(b, a))")
def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").selectExpr("if(s_suppkey % 2 = 0, split_part('ring,blue,red b,ol', ',', cast(1 + s_suppkey % 4 as int)), 'big ' || split_part('red ring,blue bolt', ',', cast(1 + s_suppkey % 2 as int)) || ' x') as b")
    return P.contained_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("a")), "a", names, "b")


@query("""with n as (select p_partkey as k, [p_name, 'Ann Oak'] as a, [p_name] || case when p_partkey % 2 = 0 then ['Ann Elm'] else [] end as b, case when p_partkey % 3 > 0 then ['Ann Oak'] end as c from part),
l as (select * from (values ('Ann Oak', '1850–1900'), ('Ann Elm', '1850–1900')) t(name, span)), u as (select k, list_distinct(a || b || coalesce(c, [])) as every, a, b, coalesce(c, []) as c from n),
g as (select k, 'a' as source, unnest(list_filter(every, lambda x: not list_contains(a, x))) as name, a as has from u union all select k, 'b', unnest(list_filter(every, lambda x: not list_contains(b, x))), b from u union all select k, 'c', unnest(list_filter(every, lambda x: not list_contains(c, x))), c from u)
select k, source, list_sort(list(distinct name)) as missing from g where not exists (select 1 from l x join l y on x.span = y.span where x.name = g.name and list_contains(g.has, y.name) and split_part(x.name, ' ', 1) = split_part(y.name, ' ', 1)) group by 1, 2""")
def reconciled_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    notes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array("p_name", F.lit("Ann Oak")).alias("a"), F.concat(F.array("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Ann Elm"))).otherwise(none)).alias("b"), F.when(F.col("p_partkey") % 3 > 0, F.array(F.lit("Ann Oak"))).alias("c"))
    spans = spark.createDataFrame([("Ann Oak", "1850–1900"), ("Ann Elm", "1850–1900")], "name string, lifespan string")  # a parameter table
    return P.reconciled(notes, "k", ["a", "b", "c"], spans)


@query("select l_orderkey as k, l_partkey::varchar || ' (step)' as name from lineitem s where l_returnflag = 'R' and not exists (select 1 from lineitem c where c.l_returnflag = 'A' and c.l_orderkey = s.l_orderkey and c.l_partkey = s.l_partkey)")
def steps_without_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    rows = lambda flag, more: lines.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("k"), F.concat(F.col("l_partkey").cast("string"), F.lit(more)).alias("name"))
    return P.step_without_children(rows("R", " (step)"), rows("A", " (b. 1900)"), "k", "name")


@query("select o_orderkey, coalesce(case when o_orderkey % 4 > 0 then o_orderdate end, (select max(o_orderdate) from orders where o_orderkey % 4 > 0)) as lastmod from orders")
def default_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate")).alias("lastmod"))
    return P.dated_by_default(rows, "o_orderkey", "lastmod")


TREE = "'Root ' || p_brand || chr(10) || '  ' || p_name || chr(10) || chr(9) || chr(9) || 'kid of ' || p_name || chr(10) || '    ' || p_type"


@query("with n as (select distinct p_name as name from part union select distinct p_type from part), t as (select p_partkey, 2 as g, p_name as line, 1 as i from part union all select p_partkey, 3, 'kid of ' || p_name, 2 from part union all select p_partkey, 3, p_type, 3 from part union all select p_partkey, 1, 'Root ' || p_brand, 0 from part) select p_partkey, name, min_by(g, i)::int as generation from t join n on contains(lower(line), lower(name)) where list_contains(regexp_split_to_array(lower(line), '[^a-z0-9]+'), regexp_split_to_array(lower(name), '[^a-z0-9]+')[1]) group by 1, 2")
def generations_by_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name")).union(part.select("p_type")).distinct()
    return P.generation_by_indent(part.select("p_partkey", F.expr(TREE).alias("tree")), "p_partkey", "tree", names, "name")


@query("select p_partkey, row_number() over (order by generation, birth nulls last, name, p_partkey)::bigint as place from (select p_partkey, p_size % 3 as generation, case when p_partkey % 4 > 0 then p_size end as birth, p_name as name from part) qualify place <= 50")
def sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty by generation, birth (unknown last) and name."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).alias("generation"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size")).alias("birth"), F.col("p_name").alias("name"))
    first = rows.orderBy("generation", F.col("birth").asc_nulls_last(), "name", "p_partkey").limit(50)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("generation", F.col("birth").isNull().alias("unknown"), "birth", "name", "p_partkey"))).alias("l"))  # fifty rows
    return listed.select(F.posexplode("l").alias("at", "r")).select("r.p_partkey", (F.col("at") + 1).cast("long").alias("place"))


@query("select c_custkey, c_name from customer")
def public_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns of a list, as far as there are such."""
    rows, listed = table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_photo"]
    return rows.select(*[c for c in listed if c in rows.columns])


@query("select lower(strip_accents(p_name || ' É' || p_brand)) as key, count(*)::bigint as n from part group by 1")
def folded_name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.lower(T.folded(F.concat("p_name", F.lit(" É"), "p_brand"))).alias("key")).agg(F.count("*").alias("n"))
