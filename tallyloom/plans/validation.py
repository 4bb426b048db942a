"""Reports over rows and edges made from the customers' columns, canaries, and lists of members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import gates as Q
from ..operators import pages as P
from ..operators import resolve as X
from ..operators import search as S
from .family import _rows
from .people import CASCADE_SQL, _cascade
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

K = "c_custkey"
ROWS = f"select 's' || case when {K} % 50 = 7 then {K} + 1 else {K} end as slug, {K} - {K} % 40 % 2 * (case when {K} % 40 = 1 then 1 else 0 end) as id, c_mktsegment || ' ' || cast(floor({K} / 20) as bigint) as name, cast(case when {K} % 6 > 0 then 1490 + {K} % 60 * 9 end as int) as birth, cast(case when {K} % 4 > 0 then 1500 + {K} % 70 * 8 end as int) as death from customer"
EDGES = f"select 'parent' as kind, 's' || {K} as src, 's' || cast(floor({K} / 3) as bigint) as dst from customer union all select 'child', 's' || cast(floor({K} / 3) as bigint), 's' || {K} from customer where {K} % 5 > 0 union all select 'parent', 's' || cast(floor({K} / 3) as bigint), 's' || {K} from customer where {K} % 30 = 4"


@query(f"""with r as ({ROWS}), e as ({EDGES}), p as (select distinct src, dst from e where kind = 'parent')
select 'repeated_slug' as gate, slug as key, count(*)::varchar as detail, 'high' as severity from r group by slug having count(*) > 1 union all select 'repeated_id', id::varchar, count(*)::varchar, 'high' from r group by id having count(*) > 1
union all select 'repeated_name', lower(name) || '|' || birth, count(*)::varchar, 'low' from r where birth is not null group by lower(name), birth having count(*) > 1
union all select 'suspect_year', slug, concat_ws('–', birth, death), 'high' from r where birth < 1500 or birth > 2030 or death < 1500 or death > 2030 or death < birth
union all select 'self_reference', src, kind, 'high' from e where src = dst union all select 'two_cycle', a.src, a.dst, 'high' from p a join p b on a.src = b.dst and a.dst = b.src where a.src < a.dst
union all select 'impossible_parent', p.src, p.dst, 'high' from p join r c on c.slug = p.src join r q on q.slug = p.dst where q.birth >= c.birth
union all select 'not_returned', src, dst, 'low' from p where not exists (select 1 from e where kind = 'child' and e.src = p.dst and e.dst = p.src)""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validation(_rows(spark, sf_dir, ROWS), _rows(spark, sf_dir, EDGES))


@query(f"with r as ({ROWS}), f as (select 's' || {K} as src, case when {K} % 2 = 0 then c_mktsegment || ' ' || ({K} % 5) else 's' || ({K} + 2) end as ref from customer), o as (select lower(name) as k, min(slug) as slug from r group by 1 having count(distinct slug) = 1) select src, ref, slug from f join o on k = lower(ref) where ref not in (select slug from r) and src <> slug")
def references_to_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _rows(spark, sf_dir, f"select 's' || {K} as src, case when {K} % 2 = 0 then c_mktsegment || ' ' || ({K} % 5) else 's' || ({K} + 2) end as ref from customer")
    return Q.should_link(refs, _rows(spark, sf_dir, ROWS))


@query(f"select case when {K} % 3 = 0 then 'ann' else 'bo' end || '-x-' || case when {K} % 2 = 0 then 'oak' else 'elm' end || '-1850' as \"from\", 'ann-oak-' || {K} as \"to\" from customer where {K} % 3 > 0 and {K} % 2 = 1 and {K} between 1000 and 9999 or {K} % 3 > 0 and {K} not between 1000 and 9999")
def wrong_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, f"select 'ann-oak-' || {K} as slug, case when {K} % 3 = 0 then 'ann' else 'bo' end || '-x-' || case when {K} % 2 = 0 then 'oak' else 'elm' end || '-1850' as `from`, 'ann-oak-' || {K} as `to` from customer")
    return Q.wrong_redirects(rows.select("from", "to"), rows)


@query(f"with e as (select ref_id, case when ref_id % 9 = 0 then null when ref_id % 9 = 1 then 'nobody' else slug end as slug from ({CASCADE_SQL})) select ref_id, e.slug as expected, f.slug as found from e join ({CASCADE_SQL}) f using (ref_id) where e.slug is distinct from f.slug")
def cascade_canaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose outcome is known beforehand, and those that came out otherwise."""
    found = _cascade(spark, sf_dir)
    expected = found.select("ref_id", F.when(F.col("ref_id") % 9 == 0, None).when(F.col("ref_id") % 9 == 1, "nobody").otherwise(F.col("slug")).alias("slug"))
    return Q.canaries(found, "ref_id", "slug", expected)


@query("select p_partkey, '(' || (1800 + p_size) || '–1900)' as stated, '(' || (1801 + p_size) || ' - 1900)' as said from part where p_partkey % 3 = 0")
def lifespan_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_name || ' (' || (1800 + p_size) || '–1900)' as title", "'On ' || p_name || ' (' || (1800 + p_size + if(p_partkey % 3 = 0, 1, 0)) || ' - 1900), and x (1700–1720).' as said")
    return P.lifespan_drift(rows, "p_partkey", F.col("title"), F.col("said"), F.col("p_name"))


@query("select p_partkey, case when p_partkey % 2 = 0 then [p_brand] else [] end as only_listed, case when p_partkey % 3 = 0 then [p_type] else [] end as only_told from (select p_partkey, lower(p_brand) as p_brand, lower(p_type) as p_type from part) where p_partkey % 2 = 0 or p_partkey % 3 = 0")
def child_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    listed = F.concat(F.array("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand")).otherwise(none))
    told = F.concat(F.array(F.upper("p_name")), F.when(F.col("p_partkey") % 3 == 0, F.array("p_type")).otherwise(none))
    return P.child_lists(table(spark, sf_dir, "part"), "p_partkey", listed, told)


@query("select coalesce(a, b) as k, case when b is null then 'built' else 'announced' end as missing from (select p_partkey as a from part where p_partkey % 3 > 0) x full join (select p_partkey as b from part where p_partkey % 4 > 0) y on a = b where a is null or b is null")
def announced_and_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return P.announced_and_built(part.where("k % 3 > 0"), part.where("k % 4 > 0"), "k")


@query("select p_brand, case when p_partkey % 8 = 0 then 'Unknown' when y < 1800 then 'Before 1800' else (y // 10 * 10) || 's' end as decade, list(p_name || '|' || p_partkey order by case when p_partkey % 8 > 0 then y end nulls last, p_name, p_partkey) as members from (select *, 1780 + p_size as y from part) group by 1, 2")
def decade_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("p_partkey") % 8 > 0, F.col("p_size") + 1780)
    rows = table(spark, sf_dir, "part").groupBy("p_brand", D.decade(year).alias("decade")).agg(F.array_sort(F.collect_list(F.struct(year.isNull().alias("unknown"), year.alias("year"), "p_name", "p_partkey"))).alias("m"))
    return rows.select("p_brand", "decade", F.transform("m", lambda x: F.concat_ws("|", x.p_name, x.p_partkey.cast("string"))).alias("members"))


@query("select p_brand, list_sort(list(distinct w)) as words from (select p_brand, unnest(string_split(p_name, ' ')) as w from part) where w not in ('ring') group by 1")
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct entries of all arrays of a group, without stop words; each distinct entry is collected once."""
    words = table(spark, sf_dir, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w")).where("w <> 'ring'").distinct()
    return words.groupBy("p_brand").agg(F.array_sort(F.collect_list("w")).alias("words"))


@query("select distinct upper(substr(trim(p_name), 1, 1)) as letter from part")
def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(T.first_letter(F.col("p_name")).alias("letter")).distinct()


@query("select p_name, p_size, slug from (select p_name, p_size, p_partkey, replace(p_name, ' ', '-') || case when p_partkey % 3 = 0 then '-' || (1800 + p_size) else '' end as slug from part) qualify row_number() over (partition by p_name, p_size order by regexp_matches(slug, '-[0-9]{4}$') desc, p_partkey, slug) = 1")
def preferred_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_name", "p_size", "p_partkey", "replace(p_name, ' ', '-') || if(p_partkey % 3 = 0, '-' || (1800 + p_size), '') as slug")
    return X.preferred_rows(rows, ["p_name", "p_size"], "slug", "p_partkey").select("p_name", "p_size", "slug")


@query("with r as (select p_partkey, case when p_partkey % 10 > 0 then p_brand end as file, case when p_partkey % 3 > 0 then p_size end as birth, case when p_partkey % 4 > 0 then 3 else 99 end as generation, p_partkey % 2 = 0 as deceased, p_name as text from part) select p_partkey, file from r where file is null union all select p_partkey, file from (select * from r where file is not null qualify row_number() over (partition by file order by birth is not null desc, generation <> 99 desc, deceased desc, length(text) desc, p_partkey) = 1)")
def same_source_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "if(p_partkey % 10 > 0, p_brand, null) as file", "if(p_partkey % 3 > 0, p_size, null) as birth", "if(p_partkey % 4 > 0, 3, 99) as generation", "p_partkey % 2 = 0 as deceased", "p_name as text")
    return X.same_source_survivors(rows, "file", "p_partkey", "birth", "generation", "deceased", "text").select("p_partkey", "file")


TWINS = "select 'n' || (p_partkey % 40) || case when p_partkey % 3 > 0 then '-' || (1800 + p_size) else '-x' || p_partkey end as slug, p_name as name, cast(case when p_partkey % 5 > 0 then 1800 + p_size % 20 end as int) as birth, cast(case when p_partkey % 4 > 0 then 1860 + p_size % 10 end as int) as death, case when p_partkey % 2 = 0 then 'a,b' when p_partkey % 7 > 0 then p_brand else '' end as kin from part"


@query(f"""with r as ({TWINS}) select 'root_death' as kind, regexp_replace(slug, '-[0-9]{{4}}$', '') || '|' || death as key, list_sort(list(distinct slug)) as slugs from r where death is not null group by 2 having count(distinct birth) > 1 and count(distinct slug) > 1
union all select 'name_years', lower(name) || '|' || birth || '|' || death, list_sort(list(distinct slug)) from r where birth is not null and death is not null group by 2 having count(distinct slug) > 1
union all select 'undated', lower(name) || '|' || kin, list_sort(list(distinct slug)) from r where birth is null and kin <> '' group by 2 having count(distinct slug) > 1""")
def possible_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("twins_of_part")
    rows = spark.sql(TWINS.replace("from part", "from twins_of_part")).withColumn("parents", F.filter(F.split("kin", ","), lambda x: x != ""))
    return X.repeated_identities(rows)


@query("""with r as (select p_partkey, replace(p_name, ' ', '-') as bare, case when p_partkey % 3 = 0 then 1800 + p_size end as birth, case when p_partkey % 3 = 1 and p_partkey % 2 = 0 then 1900 + p_size end as death, case when p_partkey % 5 = 0 then p_brand || ' X' end as middle from part),
s as (select *, case when count(*) over (partition by bare) > 1 then bare || '-' || coalesce(birth::varchar, death::varchar, nullif(regexp_replace(lower(coalesce(middle, '')), '[^a-z0-9]+', '-', 'g'), ''), 'undated') else bare end as s from r)
select p_partkey, case when row_number() over w > 1 then s || '-' || row_number() over w else s end as slug from s window w as (partition by s order by p_partkey)""")
def distinct_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "replace(p_name, ' ', '-') as bare", "if(p_partkey % 3 = 0, 1800 + p_size, null) as birth", "if(p_partkey % 3 = 1 and p_partkey % 2 = 0, 1900 + p_size, null) as death", "if(p_partkey % 5 = 0, p_brand || ' X', null) as middle")
    return X.distinct_slugs(rows, "bare", "birth", "death", "middle", "p_partkey").select("p_partkey", "slug")


@query("""with w as (select p_partkey, p_name, p_brand, string_split(lower(p_name), ' ') as w from part), t as (select *, case when starts_with(lower(p_name), 'bo') then 0 when len(list_filter(w, lambda x: starts_with(x, 'bo'))) > 0 then 1 when contains(lower(p_name), 'bo') then 2 when list_min(list_transform(w, lambda x: levenshtein(x, 'bo'))) <= 2 then 3 end as tier, len(w) - coalesce(list_position(list_transform(w, lambda x: starts_with(x, 'bo')), true), 0) as place from w)
select p_partkey, p_name, tier from t where tier is not null order by tier, p_brand <> 'Brand#11', place, length(p_name), p_name, p_partkey limit 60""")
def ranked_by_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return S.ranked(rows, "p_name", "bo", F.col("p_brand") == "Brand#11", "p_partkey").select("p_partkey", "p_name", "tier")


@query("select min_by(o_orderkey, (o_orderdate, o_orderkey)) as oldest, max_by(o_orderkey, (o_orderdate, o_orderkey)) as newest from orders")
def oldest_and_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").agg(F.min_by("o_orderkey", order).alias("oldest"), F.max_by("o_orderkey", order).alias("newest"))


@query("select count(*)::bigint as total, count_if(o_orderstatus = 'F')::bigint as sourced, count_if(o_orderstatus = 'O')::bigint as partial, count_if(o_orderstatus = 'P')::bigint as unverified from orders")
def totals_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k, name: F.count_if(F.col("o_orderstatus") == k).alias(name)
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), n("F", "sourced"), n("O", "partial"), n("P", "unverified"))


@query("select a as first, o_orderkey, place::int as place from (select a, o_orderkey, row_number() over (partition by a order by o_orderdate, o_orderkey) as place from orders join (values (1995, 1996), (1997, 1999), (2000, 2001)) r(a, b) on year(o_orderdate) between a and b) where place <= 4")
def first_of_each_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four rows of each range; the rows of a range are reduced before they meet."""
    ranges = spark.createDataFrame([(1995, 1996), (1997, 1999), (2000, 2001)], "first int, last int")  # a parameter table
    rows = table(spark, sf_dir, "orders").join(F.broadcast(ranges), F.year("o_orderdate").between(F.col("first"), F.col("last")))
    day = F.row_number().over(W.partitionBy("first", F.to_date("o_orderdate")).orderBy("o_orderdate", "o_orderkey"))
    few = rows.withColumn("_n", day).where("_n <= 4")  # four of each day, of which the first four days decide
    place = F.row_number().over(W.partitionBy("first").orderBy("o_orderdate", "o_orderkey"))
    return few.withColumn("place", place).where("place <= 4").select("first", "o_orderkey", "place")


@query("select url from (select distinct '/p/' || (c_custkey % 200) as url from customer) where url not in (select '/p/' || s_suppkey from supplier where s_suppkey % 3 > 0) and url not in (select '/p/' || p_partkey from part where p_partkey % 7 = 0) and url not in ('/p/5')")
def lost_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected places that are neither built nor redirected, withheld ones apart."""
    url = lambda name, key, where: table(spark, sf_dir, name).where(where).select(F.concat(F.lit("/p/"), F.col(key).cast("string")).alias("url"))
    expected = table(spark, sf_dir, "customer").select(F.concat(F.lit("/p/"), (F.col("c_custkey") % 200).cast("string")).alias("url"))
    real, stubs, withheld = url("supplier", "s_suppkey", "s_suppkey % 3 > 0"), url("part", "p_partkey", "p_partkey % 7 = 0"), spark.range(1).select(F.lit("/p/5").alias("url"))
    return expected.subtract(real).subtract(stubs).subtract(withheld)


DAY = "case o_orderkey % 6 when 0 then '1890-02-31' when 1 then '05 march 1890' when 2 then 'c. 1890' when 3 then '1890' when 4 then '32 May 1900' else '1900-' || month(o_orderdate) || '-' || (1 + o_orderkey % 28) end"


@query("select o_orderkey, case o_orderkey % 6 when 0 then '31 February 1890' when 1 then '5 March 1890' when 5 then (1 + o_orderkey % 28) || ' ' || monthname(o_orderdate) || ' 1900' end as day from orders")
def shown_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", D.date_shown(F.expr(DAY)).alias("day"))


SPAN = "case p_partkey % 6 when 0 then '~' || (1800 + p_size) || '–1900' when 1 then 'b. ' || (1800 + p_size) when 2 then 'd. 1900' when 3 then '' || (1800 + p_size) when 4 then 'Dates unknown' else '? – 1900' end"


@query("select p_partkey, case p_partkey % 6 when 0 then '~' || (1800 + p_size) when 1 then '' || (1800 + p_size) when 3 then '' || (1800 + p_size) end as birth, case when p_partkey % 6 in (0, 2, 5) then '1900' end as death from part")
def split_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", D.split_display(F.expr(SPAN)).alias("s")).select("p_partkey", "s.*")


@query("select p_partkey, case when p_partkey % 4 = 0 then 1700 when p_partkey % 4 = 1 then 1800 + p_size when p_partkey % 4 = 2 then 1800 + p_size end::int as birth from part")
def births_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.expr("p_name || case p_partkey % 4 when 1 then ' (b. ' || (1800 + p_size) || ')' when 2 then ' (' || (1800 + p_size) || '–?)' when 3 then ' (m. 1870)' else ' (1850–1900)' end")
    return table(spark, sf_dir, "part").select("p_partkey", D.birth_of(F.when(F.col("p_partkey") % 4 == 0, 1700), title).alias("birth"))


@query(r"select page_id, length(regexp_replace(html, '[\x{2600}-\x{27BF}]', '', 'g'))::int as n from (select page_id, html || case when page_id % 2 = 0 then '☀ ✓' else '' end as html from pages)")
def symbols_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat("html", F.when(F.col("page_id") % 2 == 0, "☀ ✓").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.without_symbols(html, r"[☀-➿]")).alias("n"))
