"""Parsing of notes that are put together from the parts' columns, in several shapes; the SQL parses the same notes by its own means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import notes as N
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

#: Read by Spark and by DuckDB alike.
HEAD = """'---' || chr(10) || 'title: ' || p_name || chr(10)
 || case p_partkey % 3 when 0 then 'tags: [' || p_brand || ', "' || p_type || '", ]' when 1 then 'tags:' || chr(10) || '  - ' || p_brand || chr(10) || '  - "' || p_type || '"' else 'tags: []' end || chr(10)
 || 'about: made of' || chr(10) || case when p_partkey % 2 = 0 then '  ' || p_type || chr(10) else '' end || 'born: ' || case p_partkey % 5 when 0 then '~' else '' end || (1800 + p_size) || chr(10) || '---' || chr(10)"""
BODY = """'# ' || p_name || chr(10) || chr(10) || case p_partkey % 4 when 0 then '**Role:** ' || p_type || chr(10) when 1 then '- **Occupation:** maker of ' || p_name || chr(10) else '' end
 || '| Relation | Name |' || chr(10) || '|---|---|' || chr(10) || '| **Father** | [[' || p_brand || '|Dad]] (1850) |' || chr(10) || '| Mother | ' || p_name || ' — died young |' || chr(10)
 || '| Step-mother | [[' || p_type || ']], [[' || p_brand || ']] |' || chr(10) || '| Sons | [[' || p_name || ']] and [[' || p_brand || '|b]] |' || chr(10)
 || '**Step children:** ' || p_name || ', ' || p_type || chr(10) || chr(10)
 || case p_partkey % 3 when 0 then '![[a' || p_size || '.jpg|Photo of ' || p_name || '. Later.]]' || chr(10) || '*taken at ' || p_brand || '*' || chr(10) when 1 then '![[crest.png]]' || chr(10) || '![[b' || p_size || '.jpg|Portrait showing the shop. Then more]]' || chr(10) else '' end || chr(10)
 || 'TODO: check' || chr(10) || chr(10) || case p_partkey % 3 when 0 then 'Born in ' || (1700 + p_size) || ' (perhaps). Died old.' when 1 then 'A maker, b. ' || (1650 + p_size) || '. Lived long.' else 'no sentence, born ''' || (10 + p_size % 80) || ' here' end || chr(10) || chr(10)
 || '## Children' || chr(10) || case p_partkey % 2 when 0 then '| Name | Born |' || chr(10) || '|---|---|' || chr(10) || '| [[' || p_brand || ']] | 1900 |' || chr(10) || '| ' || p_type || ' | 1902 |' else '- [[' || p_name || '|x]]' || chr(10) || '- [[' || p_type || ']]' end || chr(10) || chr(10)
 || '## Sources' || chr(10) || case p_partkey % 3 when 0 then '- Birth register 1901/22' || chr(10) || '  kept there' || chr(10) || '- census' when 1 then 'Parish register, burial record' || chr(10) || 'birth  certificate 1902/7' else '' end"""
NOTE = f"{HEAD} || {BODY}"
Q = "regexp_extract"
#: DuckDB: the cells of a table row, what a link shows, the targets of links, a label without emphasis.
CELLS = "list_transform(string_split(regexp_replace(trim({}), '^\\||\\|$', '', 'g'), ' | '), lambda c: trim(c))"
SHOWN = r"regexp_replace({}, '\[\[(?:[^\]|]+\|)?([^\]]*)\]\]', '\1', 'g')"
LINKS = r"list_transform(regexp_extract_all({}, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1), lambda z: trim(z))"


def _notes(spark: SparkSession, sf_dir: str, expr: str = NOTE) -> tuple[DataFrame, Column]:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(expr).alias("note")), F.col("note")


def _sql(select: str, expr: str = NOTE, more: str = "") -> str:
    return f"with n as (select p_partkey, {expr} as note from part), l as (select p_partkey, unnest(string_split(note, chr(10))) as x, generate_subscripts(string_split(note, chr(10)), 1) as i from n){more} {select}"


@query(_sql("select p_partkey, trim(string_split(note, '---')[2], chr(10)) as block, length(array_to_string(string_split(note, '---')[3:], '---')) > 0 as has_body from n where len(string_split(note, '---')) >= 3"))
def split_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir)
    return rows.select("p_partkey", N.split_naively(note).alias("s")).where("s is not null").select("p_partkey", F.regexp_replace("s.block", r"^\n+|\n+$", "").alias("block"), (F.length("s.body") > 0).alias("has_body"))


@query(_sql("select p_partkey, 'title' as key, p_name as value from part union all select p_partkey, 'tags', case p_partkey % 3 when 0 then '[' || p_brand || ', \"' || p_type || '\", ]' when 1 then '' else '[]' end from part union all select p_partkey, 'about', 'made of' || case when p_partkey % 2 = 0 then ' ' || p_type else '' end from part union all select p_partkey, 'born', case p_partkey % 5 when 0 then '~' else '' end || (1800 + p_size) from part"))
def note_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir)
    return rows.select("p_partkey", F.explode(N.fields(note)).alias("key", "value"))


@query(_sql(r"select p_partkey, list_filter(list_transform(case when regexp_extract(note, '(?m)^tags:[ \t]*\[(.*)\][ \t]*$', 1) <> '' then string_split(regexp_extract(note, '(?m)^tags:[ \t]*\[(.*)\][ \t]*$', 1), ',') else regexp_extract_all(regexp_extract(note, '(?m)^tags:[ \t]*\n((?:[ \t]+- .*\n)+)', 1), '(?m)^[ \t]+- (.*)$', 1) end, lambda x: trim(trim(x), '\"')), lambda x: x <> '') as tags from n"))
def note_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir)
    return rows.select("p_partkey", N.list_field(note, "tags").alias("tags"))


@query(_sql(r"select p_partkey, i::int as line, regexp_extract(x, '^([A-Za-z_][\w-]*):', 1) as key, trim(regexp_replace(x, '^[^:]*:', '')) as value from l join (select p_partkey, min(i) filter (where x = '---' and i > 1) as last from l group by 1) using (p_partkey) where i > 1 and i < last and regexp_matches(x, '^[A-Za-z_][\w-]*:')"))
def field_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir)
    return rows.select("p_partkey", F.inline(N.fields_with_lines(note)))


@query(_sql(rf"select p_partkey, list(c order by i) as cells from (select p_partkey, i, {CELLS.format('x')} as c from l where starts_with(x, '|')) where regexp_replace(lower(c[1]), '[*:]', '', 'g') in ('father', 'mother') group by 1"))
def labelled_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir)
    return rows.select("p_partkey", N.labelled_rows(note, ["Father", "Mother"]).alias("cells")).where("size(cells) > 0")


RAW = "'Parents: ' || p_name || ', [[' || p_brand || '|a]] | Son: ' || p_type || ',  | Daughters : x (b, c) | none'"


@query(f"with r as (select p_partkey, unnest(list_filter(string_split({RAW}, '|'), lambda p: contains(p, ':'))) as p from part) select p_partkey, trim(split_part(p, ':', 1)) as type, list_filter(list_transform(string_split(split_part(p, ':', 2), ','), lambda x: trim(x)), lambda x: x <> '') as names from r")
def naive_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(N.relations_naive(F.expr(RAW))))


@query(rf"""with t as (select p_partkey, unnest(['parent', 'son', 'wife']) as type, {RAW.replace("|a]]", "]]")} as raw from part),
n as (select p_partkey, type, list_filter(list_transform(string_split(case type when 'parent' then regexp_extract(raw, '(?i)(?:^|\|)\s*parents?\s*:([^|]*)', 1) when 'son' then regexp_extract(raw, '(?i)(?:^|\|)\s*sons?\s*:([^|]*)', 1) else '' end, ','), lambda x: trim({SHOWN.format("x")})), lambda x: x <> '') as names from t) select * from n where len(names) > 0""")
def relations_of_known_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(RAW.replace("|a]]", "]]"))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(N.relations_of_types(raw, ["parent", "son", "wife"])))


@query("select p_partkey, case p_partkey % 6 when 0 then 'child' when 1 then 'child' when 2 then 'cousin' when 3 then 'spouse' when 4 then 'parent' else 'child' end as kind from part")
def folded_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("Sons", " daughter", "Cousins", "WIFE", "Fathers ", "Children"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", N.folded_type(said).alias("kind"))


@query(_sql(rf"""select p_partkey, bucket, list_distinct(flatten(list(names order by i))) as names from (
 select p_partkey, i, case regexp_replace(lower({CELLS.format('x')}[1]), '[*:]', '', 'g') when 'father' then 'parents' when 'mother' then 'parents' when 'sons' then 'children' end as bucket, {LINKS.format("array_to_string(" + CELLS.format('x') + "[2:], ' ')")} as names from l where starts_with(x, '|')) where bucket is not null and len(names) > 0 group by 1, 2""").replace("list_distinct(flatten(list(names order by i)))", "list_sort(list_distinct(flatten(list(names))))"))
def links_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir)
    found = rows.select("p_partkey", F.inline(N.bucketed_links(note, {"Father": "parents", "Mother": "parents", "Sons": "children"})))
    return found.select("p_partkey", "bucket", F.array_sort("names").alias("names"))


@query("select p_partkey, 'step-mother' as type, [p_type, p_brand] as names from part union all select p_partkey, 'step-children', [p_name, p_type] from part")
def step_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir)
    return rows.select("p_partkey", F.inline(N.step_relations(note)))


TABLE = "'| Relation | Name |' || chr(10) || '|---|---|' || chr(10) || '| **Father** | [[' || p_brand || '|Dad]] (1850) |' || chr(10) || '| Mother | ' || p_name || ' — died young |' || chr(10) || case when p_partkey % 2 = 0 then '| Aunt | ' || p_type || ' (of here) |' else '' end"


@query(_sql(rf"select p_partkey, regexp_replace(lower(c[1]), '[*:]', '', 'g') as type, trim(regexp_replace(regexp_replace({SHOWN.format('c[2]')}, '\s*\([^)]*[0-9][^)]*\)', '', 'g'), '\s+—.*$', '')) as name from (select p_partkey, {CELLS.format('x')} as c, x from l) where starts_with(x, '| ') and not starts_with(x, '| Rel')", TABLE))
def relation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir, TABLE)
    return rows.select("p_partkey", F.inline(N.relation_table(note)))


@query(_sql(rf"select p_partkey, case when p_partkey % 2 = 0 then list_transform(regexp_extract_all(s, '(?m)^\| (.*) \| [0-9]+ \|$', 1), lambda c: {SHOWN.format('c')}) else {LINKS.format('s')} end as names from (select p_partkey, split_part(split_part(note, '## Children', 2), '## Sources', 1) as s from n)"))
def children_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir)
    return rows.select("p_partkey", N.children_of(note).alias("names"))


@query(_sql(r"select p_partkey, nullif(trim(regexp_extract(note, '(?m)^(?:- )?\*\*(?:Role|Occupation):\*\*(.*)$', 1)), '') as role from n"))
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir)
    return rows.select("p_partkey", N.role_of(note).alias("role"))


@query(_sql(r"""select p_partkey, case when y between 1700 and 1980 then y end::int as year from (select p_partkey, coalesce(try_cast(nullif(regexp_extract(note, '(?i)born in ([0-9]{4})', 1), '') as int), try_cast(nullif(regexp_extract(note, '\bb\. ([0-9]{4})', 1), '') as int), try_cast(nullif(regexp_extract(note, 'born ''([0-9]{2})\b', 1), '') as int) + 1900) as y from n)""", BODY))
def estimated_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir, BODY)
    return rows.select("p_partkey", N.birth_estimate(note, F.lit(1980)).alias("year"))


@query("select p_partkey, p_name || case p_partkey % 3 when 0 then ' (' || (1800 + p_size) || ')' when 1 then ' (d.' || (1860 + p_size) || ')' else '' end as id from part")
def person_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 3, F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", N.person_id(F.col("p_name"), F.when(k == 0, n + 1800), F.when(k < 2, n + 1860)).alias("id"))


@query(_sql(r"""select p_partkey, 'a' || p_size || '.jpg' as src, 'Photo of ' || p_name || '. Later.' as alt, 'taken at ' || p_brand as caption from part where p_partkey % 3 = 0 union all select p_partkey, 'crest.png', '', '' from part where p_partkey % 3 = 1 union all select p_partkey, 'b' || p_size || '.jpg', 'Portrait showing the shop. Then more', '' from part where p_partkey % 3 = 1"""))
def embedded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir)
    return rows.select("p_partkey", F.inline(N.images(note)))


@query(_sql(r"select p_partkey, list_filter(regexp_extract_all(note, '!\[\[([^\]|]+)', 1), lambda s: not contains(s, 'crest'))[1] as src from n"))
def portraits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir)
    return rows.select("p_partkey", N.portrait(N.images(note), "(?i)crest|logo").alias("src"))


@query(r"select o_orderkey, try_cast(nullif(regexp_extract(t, '-?[0-9]{3,4}', 0), '') as int) as year from (select o_orderkey, case o_orderkey % 4 when 0 then 'about ' || year(o_orderdate) when 1 then '-' || (o_orderkey % 900 + 100) when 2 then 'none 12' else year(o_orderdate) || '-' || (1 + month(o_orderdate)) end as t from orders)")
def tolerant_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("case o_orderkey % 4 when 0 then 'about ' || year(o_orderdate) when 1 then '-' || (o_orderkey % 900 + 100) when 2 then 'none 12' else year(o_orderdate) || '-' || (1 + month(o_orderdate)) end")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.tolerant_year(said).alias("year"))


@query("select l_orderkey, l_linenumber, case when p_size >= l_linenumber * 5 then p_size - l_linenumber * 5 end::int as age from lineitem join part on p_partkey = l_partkey")
def ages_at_death(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select("l_orderkey", "l_linenumber", N.age_at_death(F.col("l_linenumber") * 5, F.col("p_size")).alias("age"))


@query(r"select p_partkey, upper(substr(t, 1, 1)) || substr(t, 2) as label from (select p_partkey, trim(regexp_replace(regexp_replace(case p_partkey % 3 when 0 then 'probable ' when 1 then 'Possible  unproven ' else '' end || p_name, '(?i)\b(?:probable|possible|unproven)\b', ' ', 'g'), '\s+', ' ', 'g')) as t from part)")
def type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.type_label(F.expr("case p_partkey % 3 when 0 then 'probable ' when 1 then 'Possible  unproven ' else '' end || p_name")).alias("label"))


SAID = "'Farmer at ' || case p_partkey % 3 when 0 then 'Elm Town, QLD and Oak, NSW, then Oak, NSW' when 1 then 'Ash, XYZ' else 'Yew, NSWX; Fir Hill, NSW' end"


@query(rf"select p_partkey, list_distinct(regexp_extract_all({SAID}, '\b([A-Z][a-z]+(?: [A-Z][a-z]+)*, (?:QLD|NSW))\b', 1)) as places from part where p_partkey % 3 > 0 union all select p_partkey, ['Elm Town, QLD', 'Oak, NSW'] from part where p_partkey % 3 = 0")
def suggested_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.places(F.expr(SAID), ["QLD", "NSW"]).alias("places"))


ALT = "case p_partkey % 4 when 0 then 'A photo of ' || p_name || '.' when 1 then 'Portrait showing [[' || p_brand || '|the shop]] at noon. More.' when 2 then repeat(p_name || ' and ', 20) || 'end' else '' end"


@query(rf"""select p_partkey, case when regexp_replace(lower(b), '[^a-z0-9 ]', '', 'g') = p_name then '' when length(f) > 160 then regexp_replace(substr(f, 1, 160), '\s+\S*$', '') || '…' else f end as caption from (
select *, regexp_replace(regexp_replace(b, '(?s)([.!?])\s.*$', '\1'), '[.\s]+$', '') as f from (select p_partkey, p_name, trim(regexp_replace({SHOWN.format(ALT)}, '(?i)^(?:a )?(?:photo|portrait) (?:of|showing) ', '')) as b from part))""")
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.caption(F.expr(ALT), F.col("p_name")).alias("caption"))


@query("select p_partkey, (case p_partkey % 3 when 0 then 4 when 1 then 6 else 0 end)::int as n, case p_partkey % 3 when 0 then ['birth record', 'census'] when 1 then ['parish register', 'cemetery record'] else [] end as kinds from part".replace("then 6", "then 5"))
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir)
    return rows.select("p_partkey", N.citations(note).alias("c")).select("p_partkey", "c.n", "c.kinds")


@query("select p_partkey, case p_partkey % 3 when 0 then 'Died old.' when 1 then 'A maker, b.' else 'no sentence, born ''' || (10 + p_size % 80) || ' here' end as sentence from part".replace("'Died old.'", "'Born in ' || (1700 + p_size) || ' (perhaps).'"))
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, note = _notes(spark, sf_dir, BODY)
    return rows.select("p_partkey", N.first_sentence(F.split(note, "## Children")[0]).alias("sentence"))


@query("select c_custkey, case when c_custkey % 5 = 0 and c_custkey % 3 > 0 and c_custkey % 2 = 1 then (1850 + c_nationkey) || '–' || (1900 + c_nationkey) when c_custkey % 5 = 0 then 'b. ' || (1850 + c_nationkey) when c_custkey % 3 > 0 and c_custkey % 2 = 1 then 'd. ' || (1900 + c_nationkey) else '' end as years from customer")
def title_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    birth, death = F.expr("if(c_custkey % 5 = 0, cast(1850 + c_nationkey as string), '?')"), F.expr("if(c_custkey % 3 > 0, cast(1900 + c_nationkey as string), null)")
    return table(spark, sf_dir, "customer").select("c_custkey", N.title_years(birth, death, F.col("c_custkey") % 2 == 0).alias("years"))


CELL = "'Son of ' || p_brand || ' and [[x|' || p_brand || ']], ' || p_type || ' (' || p_brand || '), not' || p_brand"


@query("select p_partkey, 'Son of [[b-' || p_brand || '|' || p_brand || ']] and [[x|' || p_brand || ']], [[t|' || p_type || ']] ([[b-' || p_brand || '|' || p_brand || ']]), not' || p_brand as text from part")
def linked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.struct(F.col("p_brand").alias("name"), F.concat(F.lit("b-"), "p_brand").alias("page")), F.struct(F.col("p_type").alias("name"), F.lit("t").alias("page")))
    return table(spark, sf_dir, "part").select("p_partkey", N.linked(F.expr(CELL), names).alias("text"))
