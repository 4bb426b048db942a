"""Parsing, normalising and redacting text, on documents, pages, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import redact as R
from ..functions import text as T
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

NOTE = "'[[' || p_brand || '|' || p_name || ']] and [[' || p_type || ']], see [[' || p_name || ' (' || p_size || ')]]'"
RELATIONS = "'Parents: ' || p_name || ' (x, y), ' || p_type || ' | Child: [[' || p_brand || '|b]], ' || p_name || ' | none'"
LINES = r"regexp_matches(x, '(?i)address|phone|@')"


def _parts(spark: SparkSession, sf_dir: str, expr: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(expr).alias(name))


@query(f"select p_partkey, list_transform(regexp_extract_all({NOTE}, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1), lambda x: trim(x)) as targets from part")
def wikilink_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, NOTE, "note").select("p_partkey", T.wikilinks(F.col("note")).alias("targets"))


@query("select p_partkey, p_name || ' and ' || p_type || ', see ' || p_name || ' (' || p_size || ')' as shown from part")
def wikilink_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, NOTE, "note").select("p_partkey", T.without_wikilinks(F.col("note")).alias("shown"))


@query("""select p_partkey, 'parents' as type, unnest([p_name || ' (x, y)', p_type]) as name from part union all
select p_partkey, 'child', unnest([case when true then 'b' end, p_name]) from part""")
def relationship_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, RELATIONS, "raw").select("p_partkey", F.inline(T.relationships(F.col("raw"))))
    return rows.select("p_partkey", "type", F.explode("names").alias("name"))


@query("select p_partkey, [p_name, '[[a|b]]', 'x|y', p_size::varchar] as cells from part")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("| "), "p_name", F.lit(r" | [[a|b]] | x\|y | "), F.col("p_size").cast("string"), F.lit(" |"))
    return table(spark, sf_dir, "part").select("p_partkey", T.table_cells(line).alias("cells"))


@query("select p_partkey, p_name as title, p_size as born, 'Text of ' || p_brand as body from part")
def front_matter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\nborn: "), F.col("p_size").cast("string"), F.lit("\n---\nText of "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.front_matter(raw)["title"].alias("title"), T.front_matter(raw)["born"].cast("int").alias("born"), T.body(raw).alias("body"))


@query("select c_custkey, trim(regexp_replace(lower(c_name || ' of ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') as slug from customer")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.slugify(F.concat("c_name", F.lit(" of "), "c_mktsegment")).alias("slug"))


@query("select doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-') as slug from documents")
def folded_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.slugify(F.col("text"), fold=True).alias("slug"))


YEARS = "case o_orderkey % 5 when 0 then '~' || year(o_orderdate) when 1 then 'c. ' || year(o_orderdate) when 2 then 'approx ' || year(o_orderdate) when 3 then 'unknown' else cast(year(o_orderdate) as {}) end"


@query("select o_orderkey, case when o_orderkey % 5 <> 3 then year(o_orderdate)::int end as year, o_orderkey % 5 < 3 as approximate from orders")
def coerced_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(YEARS.format("string")).alias("raw"))
    return rows.select("o_orderkey", D.year_of(F.col("raw")).alias("year"), D.is_approximate(F.col("raw")).alias("approximate"))


@query("select o_orderkey, case when o_orderkey % 3 < 2 then o_orderdate::date end as day from orders")
def normalised_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.concat(F.lit("c. "), F.year("o_orderdate").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.date_of(raw).alias("day"))


SPAN = "case p_partkey % 6 when 0 then p_name || ' (' || (1800 + p_size) || '–' || (1860 + p_size) || ')' when 1 then p_name || ' (b. ' || (1800 + p_size) || ')' when 2 then p_name || ' (bap. ' || (1800 + p_size) || ')' when 3 then p_name || ' (d. ' || (1860 + p_size) || ')' when 4 then p_name || ' (m. 1871)' else p_name end"


@query("""select p_partkey, case when p_partkey % 6 in (0, 1, 2) then 1800 + p_size end as birth, case when p_partkey % 6 in (0, 3) then 1860 + p_size end as death, p_name as name from part""")
def reference_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, SPAN, "ref")
    return rows.select("p_partkey", D.span_years(F.col("ref")).alias("y"), D.bare_name(F.col("ref")).alias("name")).select("p_partkey", "y.birth", "y.death", "name")


@query("""select c_custkey, case when c_custkey % 4 = 0 then 'b. ' || (1900 + c_nationkey) when c_custkey % 4 = 1 then (1900 + c_nationkey) || '–' || (1960 + c_nationkey) when c_custkey % 4 = 2 then 'd. ' || (1960 + c_nationkey) else 'Dates unknown' end as lifespan from customer""")
def lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    birth, death = F.when(k < 2, F.col("c_nationkey") + 1900), F.when((k == 1) | (k == 2), F.col("c_nationkey") + 1960)
    return table(spark, sf_dir, "customer").select("c_custkey", D.lifespan(birth, death, k == 0).alias("lifespan"))


@query(r"""select doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#+ .*$', '', 'g'), '[|*_`]', ' ', 'g'), '\s+', ' ', 'g')), 1, 500) as summary from documents""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query(r"""with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|nav)\b.*?</(?:script|style|nav)>', ' ', 'g'), '(?i)<h[1-6][^>]*>', chr(10) || '# ', 'g'), '<[^>]+>', ' ', 'g') as t from pages)
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as text from a""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(r"select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) as title, strpos(html, '<h1') > 0 and (strpos(html, '<h2') = 0 or strpos(html, '<h1') < strpos(html, '<h2')) as headings_in_order from pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    h1, h2 = F.locate("<h1", F.col("html")), F.locate("<h2", F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), ((h1 > 0) & ((h2 == 0) | (h1 < h2))).alias("headings_in_order"))


@query(r"""with c as (select doc_id, text, substr(text, 1, 160) as cut from documents),
e as (select *, 160 - length(regexp_extract(reverse(cut), '^[^.!?]*')) as s, 160 - length(regexp_extract(reverse(cut), '^[^,;:]*')) as k, 160 - length(regexp_extract(reverse(cut), '^\S*')) as b from c)
select doc_id, case when length(text) <= 160 then text when s > 96 then substr(cut, 1, s) when k > 96 then regexp_replace(substr(cut, 1, k), '[\s,;:]+$', '') || '…' when b > 96 then regexp_replace(substr(cut, 1, b), '[\s,;:]+$', '') || '…' else regexp_replace(cut, '[\s,;:]+$', '') || '…' end as description from e""")
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clamp(F.col("text")).alias("description"))


def _replaced(text: str, patterns=R.PATTERNS) -> str:
    for name, pattern in patterns:
        text = f"regexp_replace({text}, '{pattern}', '[{name}]', 'g')"
    return text


@query(f"select doc_id, {_replaced('text')} as text from documents")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.placeholders(F.col("text")).alias("text"))


@query("select doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::bigint as n_{n}" for n, p in R.PATTERNS) + " from documents")
def private_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *R.counts(F.col("text")))


@query(f"select doc_id, case when doc_id % 2 = 0 then {_replaced('text')} else {_replaced('text', [p for p in R.PATTERNS if p[0] != 'street'])} end as text from documents")
def redacted_when_living(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.for_living(F.col("text"), F.col("doc_id") % 2 == 0).alias("text"))


@query("select p_partkey, 'Intro of ' || p_name || chr(10) || '## Life' || chr(10) || p_type || chr(10) as text from part")
def allowed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Intro of "), "p_name", F.lit("\n## Life\n"), "p_type", F.lit("\n## Address\n"), "p_brand", F.lit("\n"))
    return table(spark, sf_dir, "part").select("p_partkey", T.sections(raw, ["life", "sources"]).alias("text"))


@query(f"select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: not ({LINES})), chr(10)) as text from documents")
def dropped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.without_lines(F.col("text"), r"(?i)address|phone|@").alias("text"))


@query("select p_partkey, replace(replace('by ' || p_name || ' and ' || p_type, 'blue bolt', 'a private person'), 'bolt', 'a private person') as text from part")
def withheld_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "'by ' || p_name || ' and ' || p_type", "t").select("p_partkey", R.names_scrubbed(F.col("t"), ["bolt", "blue bolt"]).alias("text"))


@query("""select doc_id, n::bigint as line, x as found from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as n from documents), (select unnest(regexp_extract_all(l, '(?i)\\b(?:password|secret|license)\\b')) as x)""")
def forbidden_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "l"))
    return lines.select("doc_id", (F.col("n") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("l", F.lit(r"(?i)\b(?:password|secret|license)\b"), F.lit(0))).alias("found"))


@query("select event_id, 'k' as path, json_extract_string(props, '$.k') as value from events")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))


@query("select p_partkey, key from (select p_partkey, unnest(list_distinct([p_name || ' (' || p_brand || ')/' || p_type, p_name || ' /' || p_type, p_name, p_type])) as key from part)")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "p_name || ' (' || p_brand || ')/' || p_type", "name").select("p_partkey", F.explode(T.name_keys(F.col("name"))).alias("key"))


@query(r"select doc_id, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, regexp_matches(text, '(?i)\b(?:uncertain|probably|unknown)\b') as uncertain from documents")
def symbols_and_doubt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.col("text").rlike(r"(?i)\b(?:uncertain|probably|unknown)\b").alias("uncertain"))


@query("select p_partkey, case when shown = '' then 'b. ' || year else shown end as display from (select p_partkey, 1800 + p_size as year, case when p_partkey % 2 = 0 then '' else p_name end as shown from part)")
def healed_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.healed(shown, F.col("p_size") + 1800).alias("display"))


@query("select c_custkey, md5(c_name) as md5, substr(sha256(c_name || '|' || c_mktsegment), 1, 12) as mark from customer")
def content_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5(F.col("c_name").cast("binary")).alias("md5"), T.fingerprint([F.col("c_name"), F.col("c_mktsegment")]).alias("mark"))


@query("""select event_type as spelling, case event_type when 'signup' then 'parent' when 'view' then 'sibling' when 'click' then 'sibling' when 'purchase' then 'spouse' end as kind, count(*)::bigint as n from events group by 1, 2""")
def mapped_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"signup": "parent", "view": "sibling", "Click ": "sibling", "purchase": "spouse"}
    rows = T.mapped(table(spark, sf_dir, "events"), "event_type", kinds, "kind")
    return rows.groupBy(F.col("event_type").alias("spelling"), "kind").agg(F.count("*").alias("n"))


#: Spellings of relations and the kinds of edges that they make.
KINDS = {"parent": "father mother parent", "child": "son daughter child", "spouse": "husband wife spouse partner", "sibling": "brother sister sibling half-brother half-sister", "step": "step-father step-mother step-parent step-son step-daughter step-child step-brother step-sister", "derived": "grandfather grandmother grandparent grandson granddaughter grandchild uncle aunt nephew niece cousin"}
SPELLINGS = {f"{word}{more}": kind for kind, words in KINDS.items() for word in words.split() for more in ("", "s")} | {"children": "child", "wives": "spouse", "step-children": "step", "grandchildren": "derived", "nieces and nephews": "derived"}
SAID = "split_part('Father,mothers,Sons,daughter,CHILDREN,wives, Husband,half-sister,Step-children,Nieces and nephews,friend,uncles', ',', cast(1 + p_partkey % 12 as int))"


@query("select p_partkey, split_part('parent,parent,child,child,child,spouse,spouse,sibling,step,derived,,derived', ',', 1 + p_partkey % 12) as kind from part")
def edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.mapped(table(spark, sf_dir, "part").select("p_partkey", F.expr(SAID).alias("said")), "said", SPELLINGS, "kind")
    return rows.select("p_partkey", F.coalesce("kind", F.lit("")).alias("kind"))


@query("select p_partkey, path, value from (select p_partkey, '$.name' as path, p_name as value from part union all select p_partkey, '$.tags[0]', p_brand from part union all select p_partkey, '$.tags[1].of', p_type from part)")
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of nested JSON with its path."""
    raw = F.to_json(F.struct(F.col("p_name").alias("name"), F.array(F.col("p_brand"), F.lit("{}")).alias("tags"), F.col("p_size").alias("n")))
    nested = F.replace(raw, F.lit('"{}"'), F.concat(F.lit('{"of": "'), "p_type", F.lit('", "n": null}')))
    return T.json_strings(table(spark, sf_dir, "part").select("p_partkey", nested.alias("doc")), "p_partkey", "doc")
