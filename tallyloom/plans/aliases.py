"""Aliases, successors of vanished keys, and matches of titles, files and cells, on persons made from the customers' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aliases as A
from .people import BIRTH, DEATH, FIRST, K, LAST, MIDDLE, PEOPLE, _made
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

#: Slugs of several shapes, some of them shared by forms of others.
SLUG = f"lower({FIRST} || '-' || {LAST}) || case {K} % 4 when 0 then '' when 1 then '-' || coalesce(cast({BIRTH} as varchar(9)), 'x') when 2 then '-' || {K} else coalesce('-' || lower({MIDDLE}), '-none') end"
NAMED = f"select {K} as id, {SLUG} as slug, {FIRST} as first_name, {MIDDLE} as middle_name, {LAST} as last_name, {BIRTH} as birth from customer"
FORMS = f"""with p as ({NAMED}), f as (select distinct slug, unnest([lower(first_name || '-' || last_name), lower(first_name || '-' || last_name) || coalesce('-' || birth, ''), lower(first_name || coalesce('-' || middle_name, '') || '-' || last_name), lower(first_name || coalesce('-' || middle_name, '') || '-' || last_name) || coalesce('-' || birth, '')]) as alias from p)"""


@query(f"{FORMS} select alias, case when alias in (select slug from p) or count(distinct slug) > 1 then null else min(slug) end as to, case when alias in (select slug from p) then 'real_page' when count(distinct slug) > 1 then 'ambiguous' else 'emitted' end as verdict from f where alias <> slug group by alias")
def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, NAMED)
    return A.candidates(rows, rows)


ALIASES = f"select 'a' || cast(floor({K} / 2) as bigint) as \"from\", case when {K} % 6 > 0 then 'a' || ({K} + 3) end as \"to\", {K} % 3 as priority from customer"


@query(f"""with a as ({ALIASES}), pages as (select 'a' || {K} as slug from customer where {K} % 4 > 0), w as (select 'a' || {K} as slug from customer where {K} % 13 = 5),
r as (select * from a where "to" is not null and "from" <> "to" and "from" not in (select slug from pages) and "to" in (select slug from pages) and "from" not in (select slug from w) and "to" not in (select slug from w))
select "from", "to", priority from r qualify row_number() over (partition by "from" order by priority, "to") = 1""")
def published_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, ALIASES.replace('"', "`"))
    page = lambda where: _made(spark, sf_dir, f"select 'a' || {K} as slug, {K} as k from customer").where(where).select("slug")
    return A.filtered(rows, page("k % 4 > 0"), page("k % 13 = 5"))


@query(f"""with a as ({ALIASES}), pages as (select 'a' || {K} as slug from customer where {K} % 4 > 0) select "from", "to", "to" in (select slug from pages) as live from a where "to" is not null""")
def alias_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, ALIASES.replace('"', "`")).where("`to` is not null").select("from", "to")
    live, dead = A.to_targets(rows, _made(spark, sf_dir, f"select 'a' || {K} as slug, {K} as k from customer").where("k % 4 > 0"))
    return live.withColumn("live", F.lit(True)).unionByName(dead.withColumn("live", F.lit(False)))


ALIAS_LOG = f"{FORMS}, log as (select alias, min(slug) as slug from f where length(alias) % 3 = 0 group by 1)"


@query(f"""{ALIAS_LOG}, g as (select id, slug, lower(first_name || '-' || last_name) || coalesce('-' || birth, '') as guess, lower(first_name || coalesce('-' || middle_name, '') || '-' || last_name) || coalesce('-' || birth, '') as given from p)
select slug, case when slug = guess or slug = given then 'reachable' when count(*) over (partition by guess) > 1 then 'ambiguous' when exists (select 1 from log join f using (alias, slug) where log.slug = g.slug) then 'covered' when guess in (select slug from p) then 'shadowed' else 'dead' end as class from g""")
def slug_guessability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, NAMED)
    every = A.shapes(rows.withColumn("slug", F.concat(F.lit("\u0000"), "slug"))).select(F.substring("slug", 2, 1000).alias("slug"), "alias")
    log = every.where("length(alias) % 3 = 0").groupBy(F.col("alias").alias("from")).agg(F.min("slug").alias("to"))
    return A.guessability(rows, log)


@query(f"with p as ({NAMED}), d as (select distinct slug, regexp_extract(slug, '^(.*)-[0-9]{{4}}$', 1) as bare from p where regexp_matches(slug, '-[0-9]{{4}}$')) select bare, list_sort(list(slug)) as slugs from d where bare not in (select slug from p) group by 1 having count(*) > 1")
def namesake_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.namesakes(_made(spark, sf_dir, NAMED))


VERSIONED = f"select {K} as k, 's' || {K} as slug, {FIRST} || ' ' || {LAST} as display, 'f' || cast(floor({K} / 2) as bigint) as file, {FIRST} as name from customer"


@query(f"""with o as ({VERSIONED}), n as (select 's' || (k + case when k % 5 = 0 then 100000 else 0 end) as slug, case when k % 10 = 0 then 'x' else display end as display, case when k % 15 = 0 then null else file end as file, name from o),
rem as (select slug, case when k % 35 = 0 then null else 's' || (k + 1) end as "to" from o where k % 25 = 0 or k % 35 = 0), ren as (select slug, 's' || (k + 2) as "to" from o where k % 20 = 5),
one as (select 'display' as c, display as v, min(slug) as slug from n where display is not null group by 2 having count(distinct slug) = 1 union all select 'file', file, min(slug) from n where file is not null group by 2 having count(distinct slug) = 1 union all select 'name', name, min(slug) from n group by 2 having count(distinct slug) = 1)
select o.slug as "from", case when rem.slug is not null then case when rem."to" in (select slug from n) then rem."to" end else coalesce(ren."to", d.slug, f.slug, m.slug) end as "to",
 case when rem.slug is not null then case when rem."to" is null then 'gone' when rem."to" in (select slug from n) then 'removed' else 'unresolved' end when ren."to" is not null then 'declared_rename' when d.slug is not null then 'display' when f.slug is not null then 'file' when m.slug is not null then 'name' else 'unresolved' end as how
from o left join rem on rem.slug = o.slug left join (select * from ren where "to" in (select slug from n)) ren on ren.slug = o.slug left join one d on d.c = 'display' and d.v = o.display left join one f on f.c = 'file' and f.v = o.file left join one m on m.c = 'name' and m.v = o.name where o.slug not in (select slug from n)""")
def successors_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _made(spark, sf_dir, VERSIONED)
    new = old.selectExpr("'s' || (k + if(k % 5 = 0, 100000, 0)) as slug", "if(k % 10 = 0, 'x', display) as display", "if(k % 15 = 0, null, file) as file", "name")
    removed = old.where("k % 25 = 0 or k % 35 = 0").selectExpr("slug", "if(k % 35 = 0, null, 's' || (k + 1)) as to")
    return A.successors(old, new, ["display", "file", "name"], removed, old.where("k % 20 = 5").selectExpr("slug", "'s' || (k + 2) as to"))


TITLE = f"case {K} % 6 when 0 then {FIRST} || ' ' || {LAST} || ' — Family' when 1 then {FIRST} || ' \"Nan\" ' || {LAST} when 2 then {FIRST} || ' ' || {LAST} || '/Elm' || ({K} % 9) when 3 then {FIRST} || ' ' || {LAST} || ', née Yew' when 4 then {FIRST} || ' Zed ' || {LAST} else {FIRST} || ' Oak' || {K} end"
TITLED = f"select 's' || {K} as slug, {TITLE} as title, {BIRTH} as birth from customer"
FILES = f"select {FIRST} || ' ' || case {K} % 5 when 0 then 'Lee ' when 1 then 'May ' else '' end || case when {K} % 7 = 3 then 'Elm' || ({K} % 9) else {LAST} end || case when {K} % 10 = 0 then ' Fir' else '' end || case when {K} % 3 > 0 then ' (' || coalesce(cast({BIRTH} as varchar(9)), '900') || '–' || ({K} % 100 + 1900) || ')' else ' (Mrs Oak' || {K} || ')' end || '.md' as file from customer"


@query(f"""with p as (select slug, title, birth::varchar as year, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\\s+—\\s.*$', ''), '"[^"]*"', ' ', 'g'), ',\\s*née\\s.*$', ''), '\\s+', ' ', 'g'))) as main from ({TITLED})),
k as (select slug, year, main, unnest(list_distinct(case when contains(main, '/') then [main] || list_transform(string_split(string_split(main, ' ')[-1], '/'), lambda t: array_to_string(string_split(main, ' ')[:-2], ' ') || ' ' || t) else [main] end)) as key from p),
f as (select distinct file, lower(trim(regexp_replace(regexp_replace(file, '\\.md$', ''), '\\s*\\([^)]*\\)$', ''))) as name, nullif(regexp_extract(file, '\\(([0-9]{{3,4}})–', 1), '') as fy, lower(regexp_extract(file, '\\(([^)]*)\\)', 1)) as bracket from ({FILES})),
w as (select *, string_split(name, ' ') as fw from f), q as (select distinct slug, year, main, string_split(main, ' ') as w from p),
m as (select slug, file, 1 as r, 'exact' as how from k join w on key = name union select slug, file, 2, 'exact_year' from k join w on key = name and year = fy union select slug, file, 3, 'first_last_year' from k join w on string_split(key, ' ')[1] = fw[1] and string_split(key, ' ')[-1] = fw[-1] and year = fy
 union select slug, file, 4, 'prefix' from q join w on starts_with(name, main || ' ') union select slug, file, 5, 'surname_swap' from q join w on len(w) > 1 and len(fw) = len(w) and fw[:-2] = w[:-2] and name <> main
 union select slug, file, 6, 'bracket' from q join w on len(w) > 1 and len(fw) = len(w) and fw[:-2] = w[:-2] and list_contains(regexp_split_to_array(bracket, '[^a-zé]+'), w[-1]) union select slug, file, 7, 'extra_name' from q join w on fw[1] = w[1] and fw[-1] = w[-1] and abs(len(fw) - len(w)) = 1 and coalesce(year = fy, true)),
u as (select slug, r, how, min(file) as file from m group by 1, 2, 3 having count(distinct file) = 1) select slug, file, how from u qualify row_number() over (partition by slug order by r) = 1""")
def files_of_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.file_matches(_made(spark, sf_dir, TITLED), _made(spark, sf_dir, FILES))


NOTES = f"select {K} as note, {FIRST} || case when {K} % 2 = 0 then '  ' else ' ' end || {LAST} as name, cast(case when {K} % 3 > 0 then {BIRTH} + case when {K} % 5 = 0 then 1 else 0 end end as int) as birth from customer"
WHO = f"select 's' || {K} as slug, {FIRST} || ' ' || case when {K} % 9 = 4 then 'Oak' || ({K} * 2) else {LAST} end as name, {BIRTH} as birth, {DEATH} as death from customer"


@query(f"""with n as (select note, lower(replace(name, '  ', ' ')) as name, birth from ({NOTES})), p as (select slug, lower(name) as name, birth from ({WHO}))
select note, case when a = 1 then s1 when a = 0 and b = 1 then s2 end as slug, case when a = 1 then 'name_birth' when a > 1 then 'ambiguous' when b = 1 then 'name' when b > 1 then 'ambiguous' else 'unknown' end as how from (
select note, count(distinct slug) filter (where p.birth = n.birth) as a, min(slug) filter (where p.birth = n.birth) as s1, count(distinct slug) as b, min(slug) as s2 from n left join p using (name) group by 1)""")
def signed_off_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.signed_off(_made(spark, sf_dir, NOTES), _made(spark, sf_dir, WHO))


CELLS = f"select {K} as cell, {FIRST} || ' ' || {LAST} as name, cast(case when {K} % 4 = 0 then {BIRTH} when {K} % 4 = 1 then 1777 end as int) as birth, cast(case when {K} % 6 = 0 then {DEATH} end as int) as death from customer"


@query(f"""with c as ({CELLS}), p as ({WHO}) select cell, case when f = 1 then one end as slug, case when n = 0 then 'unknown' when f = 0 then 'years_differ' when f = 1 then 'match' else 'ambiguous' end as verdict from (
select cell, count(distinct slug) as n, count(distinct slug) filter (where coalesce(c.birth = p.birth, true) and coalesce(c.death = p.death, true)) as f, min(slug) filter (where coalesce(c.birth = p.birth, true) and coalesce(c.death = p.death, true)) as one from c left join p on lower(p.name) = lower(c.name) group by 1)""")
def matched_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cell_matches(_made(spark, sf_dir, CELLS), _made(spark, sf_dir, WHO))


@query("select coalesce(c_custkey, user_id) as slug, min(ts) as first_date from events left join (select c_custkey - 1 as f, c_custkey from customer where c_custkey % 4 = 3) on f = user_id group by 1")
def first_seen_through_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("slug"), F.col("ts").alias("date"))
    renames = table(spark, sf_dir, "customer").where("c_custkey % 4 = 3").select((F.col("c_custkey") - 1).alias("from"), F.col("c_custkey").alias("to"))
    return A.first_seen(seen, renames)


@query("select p_partkey, p_name, row_number() over (order by length(p_name) desc, p_name, p_partkey)::bigint as place from part")
def longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.longest_first(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")
