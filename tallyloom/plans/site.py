"""Gates over the pages table's own html, to which some fragments are added, and over texts made from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates as Q
from ..operators import site as S
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|nav)\b.*?</(?:script|style|nav)>', ' ', 'g'), '(?i)<h[1-6][^>]*>', chr(10) || '# ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""


def _pages(spark: SparkSession, sf_dir: str, html: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(html).alias("html"))


LINKS = "'see [[' || p_name || '|x]] and [[' || p_type || ' note]], [[Elm ' || p_partkey || ']], [[image a]], [[' || split_part(p_name, ' ', 2) || ']]'"
TITLES = "select distinct upper(p_name) as title from part where p_partkey % 2 = 0 union select distinct 'old ' || p_type || ' note' from part where p_partkey % 3 = 0"


@query(f"""with t as ({TITLES}), l as (select distinct p_partkey, unnest([p_name, p_type || ' note', 'Elm ' || p_partkey, 'image a', split_part(p_name, ' ', 2)]) as target from part),
w as (select title, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '') as tw from t), a as (select *, list_filter(regexp_split_to_array(lower(target), '[^a-z0-9]+'), lambda x: x <> '') as lw from l where lower(target) not in (select lower(title) from t))
select p_partkey, target, case when starts_with(target, 'image') then 'exempt' when (select count(*) from w where tw[-1] = lw[-1] and len(list_filter(lw, lambda x: not list_contains(tw, x))) = 0) = 1 then 'subset' else 'broken' end as verdict from a""")
def body_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    titles = part.where("p_partkey % 2 = 0").select(F.upper("p_name").alias("title")).union(part.where("p_partkey % 3 = 0").select(F.concat(F.lit("old "), "p_type", F.lit(" note")))).distinct()
    return S.body_links(part.select("p_partkey", F.expr(LINKS).alias("text")), "p_partkey", "text", titles, ["^image"])


NAME = "p_name || ' ' || p_brand || ' ' || (p_size % 8)"


@query(f"with r as (select p_partkey, {NAME} as name from part), o as (select name, min(p_partkey) as slug from r group by 1 having count(*) = 1) select p_partkey as cell, slug from r join o using (name) where p_partkey % 3 > 0")
def unlinked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(NAME).alias("name"))
    one = part.groupBy("name").agg(F.min("p_partkey").alias("slug"), F.count("*").alias("n"))
    matches = part.join(one, "name").select(F.col("p_partkey").alias("cell"), "slug", F.when(F.col("n") == 1, "match").otherwise("ambiguous").alias("verdict"))
    cells = part.select(F.col("p_partkey").alias("cell"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("[["), "name", F.lit("]]"))).otherwise(F.col("name")).alias("text"))
    return S.unlinked_cells(cells, matches)


@query("""with n as (select distinct p_partkey % 500 as file from part where p_partkey % 3 > 0), r as (select case when s_suppkey % 9 > 0 then s_suppkey % 400 end as file from supplier union all select c_custkey from customer where c_custkey % 10 = 0)
select 'unpublished' as gate, file::varchar as key, '' as detail, 'medium' as severity from n where file not in (select file from r where file is not null) union all select 'orphan', file::varchar, '', 'high' from (select distinct file from r where file is not null) where file not in (select file from n) union all select 'repeated_file', file::varchar, count(*)::varchar, 'high' from r where file is not null group by file having count(*) > 1""")
def source_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select((F.col("p_partkey") % 500).alias("file"))
    rows = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 9 > 0, F.col("s_suppkey") % 400).alias("file")).union(table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select("c_custkey"))
    return S.source_parity(notes, rows, "file")


@query("select 'p/' || p_partkey || '.jpg' as file, case when sha256(p_name) in (select sha256(p_name) from part where p_size % 2 = 0) then 'known' when p_partkey % 2 = 0 then 'differs' else 'unknown' end as state from part")
def photo_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sha = F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256")
    name = F.concat(F.col("p_partkey").cast("string"), F.lit(".jpg"))
    public = part.select(F.concat(F.lit("p/"), name).alias("file"), sha)
    source = part.where("p_size % 2 = 0").select(F.lit("x").alias("file"), sha).union(part.where("p_partkey % 2 = 0").select(F.concat(F.lit("v/a/"), name), F.lit("other")))
    return S.photo_parity(public, source)


@query("select md5(p_name) as md5, list_sort(list('f' || p_partkey)) as files, case when count_if(p_partkey % 5 = 0) > 0 then list_sort(coalesce(list('f' || p_partkey) filter (where p_partkey % 5 > 0), [])) else [] end as dead from part group by p_name having count(*) > 1")
def identical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file"), F.md5(F.col("p_name").cast("binary")).alias("md5"))
    return S.identical_files(rows, rows.where("p_partkey % 5 = 0"))


@query("select page_id, 'a/X.jpg' as image from pages where page_id % 3 > 0 union all select page_id, 'y.jpg' from pages")
def photos_not_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir, """replace(html, '</h1>', '</h1>' || case page_id % 3 when 0 then '<img class="f" src="/i/x.jpg">' when 1 then '<img src="/i/x.jpg" class="avatar">' else '' end)""")
    rows = pages.select("page_id", F.array(F.lit("a/X.jpg"), F.lit("y.jpg")).alias("images"))
    return S.photos_not_shown(rows, "page_id", "images", pages, "html")


HTML = """case when page_id % 4 = 0 then replace(html, '</h1>', '</h1><table><tr><td> — </td><td>a</td></tr></table>') when page_id % 4 = 1 then replace(html, '<article>', '<article id="undated">Working note: none') else replace(html, '</nav>', '<a href="/The">again</a></nav>') end"""


@query(rf"""with h as (select page_id, {HTML} as html from pages), v as (select page_id, html, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g') as text, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href="([^"]*)"', 1)) as x from h)
select 'repeated_nav_link' as gate, page_id::varchar as key, x as detail, 'low' as severity from v group by page_id, x having count(*) > 1
union all select 'dash_cell', page_id::varchar, '', 'low' from h where regexp_matches(html, '<td> — </td>') union all select 'banned_label', page_id::varchar, 'Working note', 'medium' from h where contains(regexp_replace(html, '<[^>]*>', ' ', 'g'), 'Working note') union all select 'missing_anchor', page_id::varchar, 'undated', 'medium' from h where not contains(html, 'id="undated"')""")
def presentation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.presentation(_pages(spark, sf_dir, HTML), "page_id", "html", ["Working note"], ["undated"])


@query("select page_id from pages where contains(html, '<!-- ad 1') and page_id % 3 > 0")
def unfenced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose comment claims an exclusion (here: those of some of the pages' own comments) without a robots tag."""
    pages = _pages(spark, sf_dir, """case when page_id % 3 = 0 then replace(html, '<head>', '<head><meta name="robots" content="noindex">') else html end""")
    return S.unfenced(Q.at_least(pages, 50, "pages"), "page_id", "html", "<!-- ad 1")


@query(rf"select url, trim(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) as title, {TEXT} as text from pages where page_id % 5 > 0 and page_id % 7 > 0 and url not in (select url from pages where page_id % 11 = 0)")
def corpus_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir, """case when page_id % 5 = 0 then replace(html, '<head>', '<head><meta name="robots" content="noindex">') when page_id % 7 = 0 then replace(html, '<head>', '<head><meta http-equiv="refresh" content="0">') else html end""")
    return S.corpus(pages, "url", "html", pages.where("page_id % 11 = 0").select("url"))


@query("select page_id from pages where page_id % 4 <> 1")
def indexable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = F.when(F.col("page_id") % 4 == 0, F.array(F.struct(F.lit(False).alias("withheld")))).when(F.col("page_id") % 4 == 1, F.array(F.struct(F.lit(None).cast("boolean").alias("withheld")), F.struct(F.lit(True).alias("withheld"))))
    return S.indexable(table(spark, sf_dir, "pages"), "url", relations).select("page_id")


SITEMAP = """with d as (select url, case when page_id % 3 > 0 then timestamp '2026-01-01 10:00:00' + interval (page_id) day end as lastmod from pages), i as (select url, unnest(case when page_id % 2 = 0 then ['b&' || page_id, 'a'] else [] end) as image from pages)
select url, lastmod, coalesce((select list_sort(list(distinct image)) from i where i.url = p.url), []) as images from (select distinct url from pages where not regexp_matches(url, '/fr/')) p left join (select url, any_value(lastmod) as lastmod from d where lastmod is not null group by 1) using (url)"""


def _sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    dates = pages.where("page_id % 3 > 0").groupBy("url").agg(F.min("page_id").alias("page_id")).selectExpr("url", "timestamp '2026-01-01 10:00:00' + make_interval(0, 0, 0, cast(page_id as int)) as lastmod")
    images = pages.where("page_id % 2 = 0").select("url", F.explode(F.array(F.concat(F.lit("b&"), F.col("page_id").cast("string")), F.lit("a"))).alias("image"))
    return S.sitemap_rows(pages, "url", "/fr/", dates, images)


@query(SITEMAP.replace("any_value(lastmod)", "min(lastmod)"))
def sitemap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sitemap(spark, sf_dir)


@query(f"""select '<url><loc>' || replace(url, '&', '&amp;') || '</loc>' || coalesce('<lastmod>' || strftime(lastmod, '%Y-%m-%dT%H:%M:%SZ') || '</lastmod>', '') || array_to_string(list_transform(images, lambda x: '<image:image><image:loc>' || replace(x, '&', '&amp;') || '</image:loc></image:image>'), '') || '</url>' as entry from ({SITEMAP.replace("any_value(lastmod)", "min(lastmod)")})""")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sitemap_xml(_sitemap(spark, sf_dir), "url")


@query("select p_partkey, 'There are ' || (select count(*) from customer) || ' people and 3 others in ' || p_size as text from part")
def healed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").selectExpr("p_partkey", "'There are 1,2' || p_size || ' people and 3 others in ' || p_size as text")
    return S.healed_count(texts, "text", "(There are )", table(spark, sf_dir, "customer").agg(F.count("*").alias("n")))


@query("select page_id, s as status, case when s in (404, 410) then 'dead' when s < 400 then 'ok' else 'unchecked' end as verdict from (select page_id, case page_id % 6 when 0 then 200 when 1 then 404 when 2 then 410 when 3 then 503 when 4 then 301 end as s from pages)")
def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr("case page_id % 6 when 0 then 200 when 1 then 404 when 2 then 410 when 3 then 503 when 4 then 301 end").alias("status"))
    return S.classified_status(rows, "page_id", "status")


@query("select * from (values (0, 'none', 'passed', 0::bigint), (1, 'poor', 'issues', (select count(*) from customer where c_acctbal < 0)), (2, 'broken', 'failed', -1::bigint), (3, 'early', 'issues', (select count(*) from lineitem join orders on o_orderkey = l_orderkey where l_shipdate < o_orderdate)), (4, 'publish', 'blocked', 0::bigint)) t(place, stage, state, n_issues)")
def nightly_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates in order; one that fails or finds something doesn't keep the next from running."""
    customer, orders, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))

    def broken() -> DataFrame:
        raise ValueError("no source has rows")

    early = lambda: lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate < o_orderdate")
    return S.pipeline_run(spark, [("none", True, lambda: customer.where("false")), ("poor", False, lambda: customer.where("c_acctbal < 0")), ("broken", False, broken), ("early", True, early)])


@query("select page_id, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)))::int as n_links from pages")
def links_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.array_distinct(T.hrefs(F.col("html")))).alias("n_links"))
