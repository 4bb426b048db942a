"""What may be shown of the living, of minors and of the withheld, on notes made from the parts' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy as P
from .registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

NL = "' || chr(10) || '"
SAID = f"""'Intro of ' || p_name || ', mail ann.oak+x@elm.org or 0412 345 678{NL}**Email:** bo@elm.org{NL}- **Phone:** 08 1234 5678 ,{NL}<!-- seen{NL}by me -->{NL}Lived at 12 Long Elm Street, PO Box ' || (10 + p_size) || ', id 2123 45678 1{NL}{NL}{NL}{NL}end   {NL}'"""
STREET = "regexp_replace({}, '12 Long Elm Street', '', 'g')"


def _parts(spark: SparkSession, sf_dir: str, expr: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("*", F.expr(expr).alias("said"))


@query(f"select p_partkey, 'Intro of ' || p_name || ', mail  or{NL}Lived at ' || case when p_partkey % 2 = 0 then '' else '12 Long Elm Street' end || ', , id{NL}{NL}end' as text from part")
def deleted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, SAID).select("p_partkey", P.deleted(F.col("said"), F.col("p_partkey") % 2 == 0).alias("text"))


@query(rf"select doc_id, len(string_split(text, chr(10)))::bigint as n_lines, (length(text) - length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{P.MAIL}', '', 'g'), '{P.MOBILE}', '', 'g'), '{P.LANDLINE}', '', 'g'), '{P.HEALTH_ID}', '', 'g'), '{P.PO_BOX}', '', 'g')))::bigint as n_private from documents")
def private_values_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters of a text are private values."""
    out = F.col("text")
    for p in (P.MAIL, P.MOBILE, P.LANDLINE, P.HEALTH_ID, P.PO_BOX):
        out = F.regexp_replace(out, p, "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), (F.length("text") - F.length(out)).cast("long").alias("n_private"))


LINE = "case p_partkey % 5 when 0 then 'Photo of ' || p_name || '.  Source: Post by Al (@alox1) on TikTok, today. [Link](https://vt.tiktok.com/z)' when 1 then 'A  plain line ,' || p_name when 2 then 'seen by @' || p_type when 3 then 'See https://www.facebook.com/x for ' || p_name else p_name || ' via Instagram' end"


@query("select p_partkey, case p_partkey % 5 when 0 then 'Photo of ' || p_name || '.' when 1 then 'A  plain line ,' || p_name when 2 then case when regexp_matches(p_type, '^[A-Za-z0-9._]{3,}') then trim('seen by ' || regexp_replace(p_type, '^[A-Za-z0-9._]{3,}', '')) else 'seen by @' || p_type end when 3 then 'See for ' || p_name else p_name end as line from part")
def uncredited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, LINE).select("p_partkey", P.without_credit(F.col("said")).alias("line"))


BODY = f"""'Intro of ' || p_name || '{NL}**Residence:** ' || p_type || '{NL}## Family{NL}| Father | ' || p_brand || ' |{NL}- School: Elm High{NL}## Family Stories{NL}secret{NL}## Marriage — ' || p_type || ' (1900){NL}in church{NL}## Education{NL}taught at ' || p_brand || '{NL}## Photos{NL}seen by @ox12{NL}## Public Role{NL}' || case when p_partkey % 3 = 0 then 'Address: 1 Elm St' else 'Mayor of Elm' end || '{NL}## Notes{NL}hidden{NL}'"""


@query(f"select p_partkey, 'Intro of ' || p_name || '{NL}## Family{NL}| Father | ' || p_brand || ' |{NL}## Marriage — ' || p_type || ' (1900){NL}in church{NL}' || case when p_partkey % 4 = 0 then '## Education{NL}taught at ' || p_brand || '{NL}' else '' end || '## Photos{NL}seen by' as text from part")
def living_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("Education"))).otherwise(F.array().cast("array<string>"))
    return _parts(spark, sf_dir, BODY).select("p_partkey", P.living_body(F.col("said"), allowed).alias("text"))


@query(f"select p_partkey, 'shown' || case when p_partkey % 2 = 0 and p_partkey % 3 > 0 then '{NL}{NL}## Public Role{NL}Mayor of Elm' else '' end as text from part")
def public_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, BODY).select("p_partkey", P.with_public_role(F.lit("shown"), F.col("said"), F.col("p_partkey") % 2 == 0).alias("text"))


@query(f"select p_partkey, replace(replace({BODY}, '## Notes{NL}hidden{NL}', ''), '## Education{NL}taught at ' || p_brand || '{NL}', '') as text from part")
def stripped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, BODY).select("p_partkey", P.without_sections(F.col("said"), ["Notes", "Education"]).alias("text"))


MINOR = f"'Kid ' || p_name || '{NL}**School:** Elm High{NL}- **Address:** 1 Elm St{NL}She attends Yew College here{NL}Likes ' || p_type"


@query(f"with l as (select p_partkey, p_size, unnest(string_split({MINOR}, chr(10))) as x, generate_subscripts(string_split({MINOR}, chr(10)), 1) as i from part) select p_partkey, string_agg(x, chr(10) order by i) as text from l where p_size <= 15 or not regexp_matches(x, 'School|Address|attends.*College') group by 1")
def guarded_minors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, MINOR).select("p_partkey", P.guarded_minor(F.col("said"), F.col("p_size") + 1990, F.lit(2023)).alias("text"))


@query(f"with l as (select p_partkey, unnest(string_split({MINOR}, chr(10))) as x, generate_subscripts(string_split({MINOR}, chr(10)), 1) as i from part) select p_partkey, string_agg(x, chr(10) order by i) as text from l where p_partkey % 3 > 0 or not contains(x, 'Address') group by 1")
def guarded_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, MINOR).select("p_partkey", P.guarded_address(F.col("said"), F.col("p_partkey") % 3 == 0).alias("text"))


@query(r"select doc_id, regexp_replace(regexp_replace(text, '(?i)\bmy (?:mother|father)\b', 'a parent', 'g'), '\bI\b', 'the author', 'g') as text from documents")
def rewritten_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(r"(?i)\bmy (?:mother|father)\b", "a parent"), (r"\bI\b", "the author")]
    return table(spark, sf_dir, "documents").select("doc_id", P.rewritten(F.col("text"), rules).alias("text"))


AUDIT = {"mail": P.MAIL, "phone": r"\b[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}\b", "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"}


@query("select doc_id, list_filter([" + ", ".join(f"case when regexp_matches(t, '{p}') then '{n}' end" for n, p in AUDIT.items()) + r"], lambda x: x is not null) as found from (select doc_id, regexp_replace(regexp_replace(text, 'https?://[^\s)]+', ' ', 'g'), '[A-Za-z0-9._+-]+@example\.(?:com|org)', ' ', 'g') as t from documents)")
def audited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.audited(F.col("text"), [r"https?://[^\s)]+", r"[A-Za-z0-9._+-]+@example\.(?:com|org)"], list(AUDIT.items()))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("found"))


ROLES = "'Father of Al, Bo & Cy Ox and of ' || p_name || '; friend of Bo May Elm, Cy, not Al' || p_type"


@query("select p_partkey, 'Father of a relative whose own record is withheld Ox and of ' || p_name || '; friend of a relative whose own record is withheld, Cy, not Al' || p_type as text from part")
def withheld_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, ROLES).select("p_partkey", P.names_withheld(F.col("said"), ["Al Ox", "Bo Elm", "Cy Ox", "Mono"]).alias("text"))


@query("select l_orderkey, l_linenumber, case when l_returnflag <> 'R' and p_partkey is not null then p_partkey end as slug, case when l_returnflag = 'R' then l_partkey::varchar when p_partkey is null and l_linenumber = 1 then l_partkey || ' (no profile)' when p_partkey is null then l_partkey::varchar end as plain_name, l_returnflag = 'R' as withheld from lineitem left join (select p_partkey from part where p_partkey % 3 > 0) on p_partkey = l_partkey")
def shown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select("p_partkey")
    rows = table(spark, sf_dir, "lineitem").join(known, F.col("l_partkey") == F.col("p_partkey"), "left")
    relation = F.when(F.col("l_linenumber") == 1, "spouse").otherwise("child")
    return rows.select("l_orderkey", "l_linenumber", P.shown_reference(F.col("l_partkey").cast("string"), F.col("p_partkey"), F.col("l_returnflag") == "R", relation).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("select c_custkey from customer where c_custkey not in (select s_suppkey from supplier)")
def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that aren't withheld."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")
