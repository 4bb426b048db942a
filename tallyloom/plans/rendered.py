"""Gates over rendered pages and stated years, on pages and rows made from the test tables' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query


@query("""with r as (select c_custkey as k, case when c_custkey % 4 = 0 then '~' else '' end || (1800 + c_nationkey) as birth, case when c_custkey % 5 = 0 then 'unknown' when c_custkey % 5 = 1 then null else '1900' end as death from customer)
select 'year_not_digits' as gate, k::varchar as key, 'birth=' || birth as detail, 'medium' as severity from r where k % 4 = 0 union all select 'year_not_digits', k::varchar, 'death=unknown', 'medium' from r where k % 5 = 0""")
def year_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "if(c_custkey % 4 = 0, '~', '') || (1800 + c_nationkey) as birth", "case c_custkey % 5 when 0 then 'unknown' when 1 then null else '1900' end as death")
    return P.year_hygiene(rows, "c_custkey", ["birth", "death"])


YEARS = "select c_custkey as k, 1800 + c_nationkey as b, case when c_custkey % 6 > 0 then 1815 + c_custkey % 60 end as d, c_custkey % 60 as age, 1810 + c_custkey % 40 as m, case when c_custkey % 9 > 0 then 1790 + c_custkey % 50 end as p from customer"


@query(f"""with r as ({YEARS}) select 'age_differs' as gate, k::varchar as key, age::varchar as detail, 'medium' as severity from r where abs(d - b - age) > 1
union all select 'parent_died_before_birth', k::varchar, p::varchar, 'high' from r where p < b union all select 'married_too_young', k::varchar, m::varchar, 'medium' from r where m < b + 12 union all select 'died_before_birth', k::varchar, d::varchar, 'high' from r where d < b""")
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer_years")
    rows = spark.sql(YEARS.replace("from customer", "from customer_years"))
    return P.self_consistency(rows, "k", F.col("b"), F.col("d"), F.col("age"), F.col("m"), F.col("p"))


@query("select p_name, p_size, list_sort(list(distinct p_partkey)) as keys from part where p_size % 10 > 0 group by all having count(distinct p_partkey) > 1")
def claimed_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.claimed_lifespans(table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "if(p_size % 10 > 0, p_size, null) as p_size"), "p_partkey", "p_name", "p_size")


@query("select c_custkey from customer where c_custkey % 3 = c_custkey % 5 and c_custkey % 4 <> c_custkey % 3 and c_custkey % 7 > 0 and c_custkey % 11 > 0")
def phantom_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "'Kid  S' || (c_custkey % 3) as name", "if(c_custkey % 11 = 0, 'S9', 'Dad S' || (c_custkey % 4)) as father", "if(c_custkey % 7 = 0, null, 'Mum s' || (c_custkey % 5)) as mother")
    return P.phantom_children(rows, F.col("name"), F.col("father"), F.col("mother")).select("c_custkey")


@query("""with s as (select page_id, page_id + 1 + (page_id % 14 = 0)::int as t from pages where page_id % 2 = 0),
r as (select page_id, page_id % 4 <> 0 as noindex, page_id % 5 <> 0 as canonical, t in (select page_id from pages where page_id % 3 <> 0) as target_known, t in (select page_id from s) as target_is_stub from s)
select * from r where not (noindex and canonical and target_known) or target_is_stub""")
def redirect_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "'/p/' || page_id as url", "html as own")
    html = """own || if(page_id % 4 <> 0, '<meta name="robots" content="noindex">', '') || '<link rel="canonical" href="' || if(page_id % 5 = 0, '', 'https://example.org') || url || '">'
      || '<meta http-equiv="refresh" content="0; url=/p/' || (page_id + 1 + if(page_id % 14 = 0, 1, 0)) || '">'"""
    return P.redirect_health(pages.where("page_id % 2 = 0").selectExpr("*", f"{html} as html"), "page_id", "url", "html", pages.where("page_id % 3 <> 0"), "url")


@query("""select page_id, 'Nan Q' || repeat('x', 4) || ' Elm' as name, page_id % 3 = 0 as linked from pages where page_id % 3 < 2 and page_id % 5 > 0 and (page_id % 3 = 0 or page_id % 2 = 0)""")
def withheld_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "case page_id % 3 when 0 then '<p><a href=\"/x\">Nan Qxxxx Elm</a>' when 1 then '<p>nan  qxxxx elm' else '<p>Nan Qxxxx' end || ' Al Ox</p>'"
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", f"if(page_id % 5 = 0, '<meta name=\"robots\" content=\"noindex\">', '') || html || {said} as html")
    names = spark.createDataFrame([("Nan Qxxxx Elm",), ("Al Ox",), ("Nan",)], "name string")
    return P.withheld_leaks(pages, "page_id", "html", F.col("page_id") % 2 == 1, names, "name")


@query("""with r as (select page_id, case page_id % 4 when 0 then 'resolved' when 1 then 'withheld' when 2 then 'contradicted' else 'resolved' end as status, page_id % 3 as shown from pages)
select page_id, status, case when status = 'resolved' then case when shown = 0 then 'ok' else 'not_linked' end when status = 'withheld' then case when shown = 2 then 'missing' when shown = 0 then 'linked' else 'ok' end else 'unresolved' end as verdict from r""")
def rendered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "html || case page_id % 3 when 0 then '<a href=\"/a\">Ann Oak</a>' when 1 then '<a href=\"/b\">more</a> Ann Oak' else '<b>none</b>' end as html")
    refs = pages.selectExpr("page_id", "'Ann Oak' as name", "case page_id % 4 when 1 then 'withheld' when 2 then 'contradicted' else 'resolved' end as status")
    return P.rendered_references(refs, pages, "page_id", "html", "name", "status").select("page_id", "status", "verdict")


@query("""select url, case when page_id % 4 > 0 then '2026-01-0' || (1 + page_id % 3) end as stated, '2026-01-0' || (1 + page_id % 2) as lastmod from (select page_id, '/p/' || page_id as url from pages) where page_id % 4 = 0 or page_id % 3 <> page_id % 2""")
def stale_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = """if(page_id % 4 > 0, '<script type="application/ld+json">{"@type": "Page", "dateModified": "2026-01-0' || (1 + page_id % 3) || 'T08:00:00Z"}</script>', '<p>none</p>')"""
    pages = table(spark, sf_dir, "pages").selectExpr("'/p/' || page_id as url", f"html || {block} as html", "to_timestamp('2026-01-0' || (1 + page_id % 2)) as lastmod")
    return P.stale_stamps(pages, "url", "html", pages, "url", "lastmod")


@query(r"""with c as (select doc_id, text, substr(text, 1, 175) as cut, length(text) <= 175 as whole from documents where length(text) > 160),
e as (select *, 175 - length(regexp_extract(reverse(cut), '^[^.!?]*')) as s, 175 - length(regexp_extract(reverse(cut), '^[^,;:]*')) as k, 175 - length(regexp_extract(reverse(cut), '^\S*')) as b from c),
d as (select doc_id, case when whole then text when s > 105 then substr(cut, 1, s) when k > 105 then regexp_replace(substr(cut, 1, k), '[\s,;:]+$', '') || '…' when b > 105 then regexp_replace(substr(cut, 1, b), '[\s,;:]+$', '') || '…' else regexp_replace(cut, '[\s,;:]+$', '') || '…' end as said from e)
select doc_id, length(said) as length from d where length(said) > 160""")
def descriptions_over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of descriptions of up to 175 characters that the library makes of whole texts, as pages show them."""
    shown = T.clamp(F.col("text"), 175)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        shown = F.replace(shown, F.lit(char), F.lit(entity))
    return P.over_budget(table(spark, sf_dir, "documents").select("doc_id", shown.alias("said")), "doc_id", "said")


@query("""select page_id, strpos(lower(h), '<h1')::int as h1, strpos(lower(h), '<h2')::int as h2 from (select page_id, case page_id % 3 when 0 then replace(replace(html, '<h1>', '<h2>'), '</h1>', '</h2>') when 1 then replace(html, '<h1>', '<h2>b</h2><H1 id="a">') else replace(html, '</h1>', '</h1><h2>b</h2>') end as h from pages) where strpos(lower(h), '<h1') = 0 or (strpos(lower(h), '<h2') > 0 and strpos(lower(h), '<h2') < strpos(lower(h), '<h1'))""")
def heading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", """case page_id % 3 when 0 then replace(replace(html, '<h1>', '<h2>'), '</h1>', '</h2>') when 1 then replace(html, '<h1>', '<h2>b</h2><H1 id="a">') else replace(html, '</h1>', '</h1><h2>b</h2>') end as html""")
    return P.heading_order(pages, "page_id", "html")


@query("""select p_partkey, list_filter([case when p_partkey % 3 = 0 then 'sitemap' end, case when p_partkey % 4 = 0 then 'page' end], lambda x: x is not null) as missing from part where p_partkey % 3 = 0 or p_partkey % 4 = 0""")
def undeclared_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")
    return P.undeclared_photos(part, {"sitemap": part.where("p_partkey % 3 > 0"), "page": part.where("p_partkey % 4 > 0")}, ["p_partkey"])


@query("""select c_custkey from customer where c_custkey % 2 = 0 and not ((c_custkey % 3 = 0 or (c_custkey % 5 = 0 and c_custkey % 4 > 0)) and (c_custkey % 7 > 0 or c_custkey % 9 > 0))""")
def missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "if(c_custkey % 3 = 0, 'A', ' ') as level", "c_custkey % 5 = 0 as single", "if(c_custkey % 4 > 0, 'register', null) as source", "c_custkey % 7 = 0 as provisional", "if(c_custkey % 9 > 0, 'seen', '') as receipt")
    return P.missing_evidence(rows, rows.where("c_custkey % 2 = 0"), "c_custkey", F.col("level"), F.col("single"), F.col("source"), F.col("provisional"), [F.col("receipt"), F.col("c_custkey")]).select("c_custkey")


SNAPSHOTS = {"same": "select * from customer", "other": "select c_custkey, c_name, c_nationkey, c_acctbal, case when c_custkey = 3 then 'moved' else c_mktsegment end as c_mktsegment from customer", "empty": "select * from customer where false"}


@query(" union all ".join(f"select '{name}' as case_name, case when not exists ({sql}) then 'missing' when exists (({sql}) except all select * from customer) or exists (select * from customer except all ({sql})) then 'stale' else 'fresh' end as state" for name, sql in SNAPSHOTS.items()))
def snapshot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    customer.createOrReplaceTempView("snapshot_of_customer")
    parts = [P.snapshot_state(spark.sql(sql.replace("from customer", "from snapshot_of_customer")).repartition(3, "c_name"), customer).select(F.lit(name).alias("case_name"), "state") for name, sql in SNAPSHOTS.items()]
    return parts[0].union(parts[1]).union(parts[2])
