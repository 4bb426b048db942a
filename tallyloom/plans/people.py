"""References to persons, and the gates on their dates; persons and references are made from the customers' columns, in the same words for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import cascade as C
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

K = "c_custkey"
FIRST, LAST = f"split_part('Ann,John,Mary,Tom', ',', cast(1 + {K} % 4 as int))", f"'Oak' || cast(floor({K} / 12) as bigint)"
MIDDLE = f"case when {K} % 5 = 0 then 'Lee' when {K} % 5 = 1 then 'May' end"
BIRTH, DEATH = f"cast(case when {K} % 7 > 0 then 1800 + ({K} - {K} % 8) % 90 end as int)", f"cast(case when {K} % 3 > 0 then 1872 + {K} % 90 end as int)"
DISPLAY = f"{FIRST} || ' ' || {LAST} || case when {K} % 11 = 0 then ' (miller)' when {K} % 13 = 0 then ' (' || coalesce(cast({BIRTH} as varchar(9)), '?') || '–1900)' else '' end"
PEOPLE = f"select 's' || {K} as slug, {FIRST} as first_name, {MIDDLE} as middle_name, {LAST} as last_name, {DISPLAY} as display, {BIRTH} as birth, {DEATH} as death from customer"
REF = f"""case {K} % 12 when 0 then 's' || {K} when 1 then {FIRST} || ' ' || {LAST} when 2 then {FIRST} || ' ' || {LAST} || ' (' || coalesce(cast({BIRTH} as varchar(9)), '?') || '–' || coalesce(cast({DEATH} as varchar(9)), '?') || ')'
 when 3 then {FIRST} || '  ' || coalesce({MIDDLE} || ' ', '') || {LAST} || ' (b. ~' || (1801 + ({K} - {K} % 8) % 90) || ', there)' when 4 then {FIRST} || ' ' || {LAST} || ' (miller)' when 5 then {FIRST} || ' ' || {LAST} || ' (m. 18' || (10 + {K} % 80) || ')'
 when 6 then {FIRST} || ' ' || {LAST} || ' (fl. 1898)' when 7 then 'Dr ' || {FIRST} || ' Zed ' || {LAST} when 8 then case when {K} % 8 = 0 then '?' when {K} % 8 = 4 then 'None' end when 9 then {FIRST} || ' ' || {LAST} || ' (bap. ' || (1800 + ({K} - {K} % 8) % 90 + {K} % 3) || ')'
 when 10 then {FIRST} || ' ' || {LAST} || ' (b. & d. ' || (1800 + ({K} - {K} % 8) % 90) || ')' else {FIRST} || ' ' || {LAST} || ' (no profile)' end"""
RELATION = f"split_part('parent,child,spouse,sibling,friend', ',', cast(1 + cast(floor({K} / 5) as bigint) % 5 as int))"
REFS = f"select {K} as ref_id, {REF} as ref, {RELATION} as relation, 's' || ({K} - {K} % 6) as subject, cast(case when {K} % 9 > 0 then 1778 + ({K} * 7) % 130 end as int) as subject_birth, cast(case when {K} % 4 > 0 then 1850 + ({K} * 7) % 130 end as int) as subject_death from customer"

#: The cascade as it works on pairs of references and namesakes, without the counts that the operator takes.
CASCADE_SQL = rf"""with p as ({PEOPLE}), r0 as ({REFS}),
y as (select *, try_cast(nullif(regexp_extract(ref, '(?i)\(m\. *([0-9]{{4}})', 1), '') as int) as marriage, case when regexp_matches(ref, '\(m\.') then null else coalesce(try_cast(nullif(regexp_extract(ref, '\(b\. & d\. ([0-9]{{4}})', 1), '') as int), try_cast(nullif(regexp_extract(ref, '\(([0-9]{{4}})–', 1), '') as int), try_cast(nullif(regexp_extract(ref, '\((?:bap|b)\. ~?([0-9]{{4}})', 1), '') as int)) end as said,
 coalesce(try_cast(nullif(regexp_extract(ref, '–([0-9]{{4}})\)', 1), '') as int), try_cast(nullif(regexp_extract(ref, '& d\. ([0-9]{{4}})', 1), '') as int)) as said_death, lower(trim(regexp_replace(regexp_replace(ref, '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g'))) as bare from r0),
r as (select *, bare <> lower(ref) and not regexp_matches(ref, '  ') or contains(ref, '(') as annotated, ref is null or lower(ref) in ('?', 'none') as nobody, contains(coalesce(ref, ''), 'no profile') as no_profile,
 case when starts_with(bare, 'dr ') then split_part(bare, ' ', 2) || ' ' || split_part(bare, ' ', -1) when contains(bare, ' ') then split_part(bare, ' ', 1) || ' ' || split_part(bare, ' ', -1) end as fl from y),
keys as (select distinct slug, birth, death, unnest([lower(first_name || ' ' || last_name), lower(first_name || ' ' || coalesce(middle_name || ' ', '') || last_name)]) as key from p),
pairs as (select 'bare' as kind, ref_id, k.slug, k.birth, k.death from r join keys k on k.key = r.bare union all select 'fl', ref_id, k.slug, k.birth, k.death from r join keys k on k.key = r.fl where r.fl <> r.bare),
c as (select pairs.*, relation, subject_birth as sb, said,
  (kind = 'fl' or case relation when 'parent' then coalesce(sb - birth >= 11, true) and coalesce(sb - birth <= 60, true) and coalesce(sb <= death, true) when 'child' then coalesce(birth - sb >= 11, true) and coalesce(birth - sb <= 60, true) and coalesce(birth <= subject_death, true) when 'spouse' then coalesce(abs(sb - birth) <= 50, true) when 'sibling' then coalesce(abs(sb - birth) <= 40, true) else true end)
  and coalesce(marriage - birth between 12 and 70, true) as fits from pairs join r using (ref_id), (select 1) where true),
b as (select *, fits and sb is not null and case relation when 'parent' then coalesce(sb - birth >= 12, true) when 'child' then coalesce(birth > sb, true) when 'spouse' then coalesce(abs(sb - birth) <= 30, true) else false end as best, fits and sb is not null and relation = 'spouse' and coalesce(abs(sb - birth) <= 50, true) as far from c),
g as (select kind, ref_id, count(*) as n_all, min(slug) as o_all, count_if(birth is null) as n_un, min(slug) filter (where birth is null) as o_un, count_if(birth = said) as n_same, min(slug) filter (where birth = said) as o_same, count_if(abs(birth - said) <= 2) as n_near, min(slug) filter (where abs(birth - said) <= 2) as o_near,
  count_if(fits) as n_fit, min(slug) filter (where fits) as o_fit, count_if(fits and birth = said) as n_fs, min(slug) filter (where fits and birth = said) as o_fs, count_if(best) as n_best, min(slug) filter (where best) as o_best, count_if(far) as n_far, min(slug) filter (where far) as o_far,
  min(abs(birth - said)) filter (where fits) as drift, case any_value(relation) when 'parent' then max(birth) filter (where best) when 'child' then min(birth) filter (where best) end as ny from b group by 1, 2),
h as (select g.*, (select case when count(*) = 1 then min(slug) end from b where b.kind = g.kind and b.ref_id = g.ref_id and b.best and b.birth = g.ny) as nearest from g),
d as (select lower(display) as key, min(slug) as slug from p where not regexp_matches(display, '[0-9?]–') group by 1 having count(distinct slug) = 1),
s as (select lower(trim(regexp_replace(display, '\([^)]*\)', ''))) || '|' || birth || '–' || coalesce(death::varchar, '?') as key, min(slug) as slug from p where birth is not null group by 1 having count(distinct slug) = 1),
t as (select r.*, a.*, f.n_all as f_all, f.n_fit as f_fit, case when a.n_fit = 1 and relation in ('parent', 'child') and a.drift > 2 or a.n_all > 0 and a.n_fit = 0 then true else false end as refused,
  case when nobody then null
   when exists (select 1 from p where p.slug = r.ref) then ['slug', r.ref]
   when d.slug is not null then ['qualified', d.slug]
   when s.slug is not null then ['lifespan', s.slug]
   when a.n_same = 1 then ['birth_year', a.o_same]
   when coalesce(a.n_same, 0) = 0 and a.n_near = 1 then ['near_birth_year', a.o_near]
   when said is null and marriage is null and annotated and a.n_all = 1 then ['annotation', a.o_all]
   when said is null and marriage is null and annotated and a.n_un = 1 then ['annotation', a.o_un]
   when a.n_fit = 1 and not no_profile and not (relation in ('parent', 'child') and coalesce(a.drift > 2, false)) then ['name', a.o_fit]
   when a.n_fs = 1 then ['stated_year', a.o_fs]
   when a.n_fit > 1 and a.n_best = 1 then ['best', a.o_best]
   when a.n_fit > 1 and a.nearest is not null then ['best', a.nearest]
   when a.n_fit > 1 and a.n_best = 0 and a.n_far = 1 then ['best', a.o_far]
   when coalesce(a.n_all, 0) = 0 and f.n_same = 1 then ['first_last', f.o_same]
   when coalesce(a.n_all, 0) = 0 and f.n_fit = 1 then ['first_last', f.o_fit]
   when coalesce(a.n_all, 0) = 0 and f.n_best = 1 then ['first_last', f.o_best]
   when coalesce(a.n_all, 0) = 0 and f.nearest is not null then ['first_last', f.nearest]
   when coalesce(a.n_all, 0) = 0 and f.n_best = 0 and f.n_far = 1 then ['first_last', f.o_far] end as hit
  from r left join h a on a.kind = 'bare' and a.ref_id = r.ref_id left join h f on f.kind = 'fl' and f.ref_id = r.ref_id left join d on d.key = lower(r.ref) and not regexp_matches(r.ref, '[0-9?]–|fl\.') and annotated left join s on s.key = bare || '|' || said || '–' || coalesce(said_death::varchar, '?'))
select ref_id, case when hit[2] is distinct from subject then hit[2] end as slug, hit[1] as rule, case when nobody then 'placeholder' when hit[2] = subject then 'self' when hit is not null then 'resolved' when no_profile and n_fit = 1 then 'no_profile' when refused then 'refused_dates' when n_fit > 0 or f_fit > 0 then 'ambiguous' else 'unresolved' end as status from t"""


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql from customer, in Spark."""
    select, _ = sql.rsplit(" from customer", 1)
    table(spark, sf_dir, "customer").createOrReplaceTempView("made_from_customer")
    return spark.sql(f"{select} from made_from_customer")


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolved(_made(spark, sf_dir, REFS), _made(spark, sf_dir, PEOPLE))


@query(CASCADE_SQL)
def reference_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference against all persons, by all rules."""
    return _cascade(spark, sf_dir)


def _by_rule(rule: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _cascade(spark, sf_dir).where(F.col("rule") == rule).select("ref_id", "slug", "status")

    return run


for _rule in (r for r in C.RULES if r != "stated_year"):  # the made persons have no two namesakes of a year that their deaths tell apart
    query(f"select ref_id, slug, status from ({CASCADE_SQL}) where rule = '{_rule}'", name=f"resolved_by_{_rule}")(_by_rule(_rule))


@query(f"select status, coalesce(rule, '-') as rule, count(*)::bigint as n from ({CASCADE_SQL}) group by all")
def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).groupBy("status", F.coalesce("rule", F.lit("-")).alias("rule")).agg(F.count("*").alias("n"))


@query(f"select relation, avg((status = 'resolved')::int)::double as share, count(*)::bigint as n from ({CASCADE_SQL}) join ({REFS}) using (ref_id) where status <> 'placeholder' group by 1")
def cascade_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of references that the cascade resolves, by relation; placeholders don't count."""
    found = _cascade(spark, sf_dir).where("status <> 'placeholder'").join(_made(spark, sf_dir, REFS).select("ref_id", "relation"), "ref_id")
    return found.groupBy("relation").agg(F.avg((F.col("status") == "resolved").cast("int")).alias("share"), F.count("*").alias("n"))
