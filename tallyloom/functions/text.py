"""Parsing and normalising text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"


def _folds() -> tuple[str, str]:
    """Letters whose canonical decomposition begins with an ASCII letter, and that letter; parallel strings for translate()."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0x80, 0x2200)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalnum()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _folds()


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def folded(text: Column) -> Column:
    """Letters without their marks, as canonical decomposition has them; letters that don't decompose stay."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), "[\u0300-\u036f]", "")


def slugify(text: Column, fold: bool = False) -> Column:
    low = F.lower(folded(text) if fold else text)
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def wikilinks(text: Column) -> Column:
    """Targets of [[target]] and [[target|shown]], in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x))


def without_wikilinks(text: Column) -> Column:
    """Links as they are shown."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]|]+\|([^\]]*)\]\]", "$1"), r"\[\[([^\]|]+)\]\]", "$1")


def relationships(text: Column) -> Column:
    """'type: a, b | type: c' as an array of (type, names); bars inside [[ ]] and commas inside ( ) don't split."""
    parts = F.filter(F.split(text, r"\|(?![^\[]*\]\])"), lambda p: p.contains(":"))

    def one(p: Column) -> Column:
        names = F.filter(F.transform(F.split(F.regexp_replace(p, "^[^:]*:", ""), r",(?![^(]*\))"), lambda n: F.trim(without_wikilinks(n))), lambda n: n != "")
        return F.struct(F.lower(F.trim(F.regexp_extract(p, "^([^:]*):", 1))).alias("type"), names.alias("names"))

    return F.transform(parts, one)


def table_cells(line: Column) -> Column:
    """Cells of a markdown table row; escaped bars and bars inside [[ ]] belong to a cell."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|(?![^\[]*\]\])"), lambda c: F.trim(F.regexp_replace(c, r"\\\|", "|")))


def front_matter(raw: Column) -> Column:
    """Map of the flat fields between the first two '---' lines; null if there are none."""
    block = F.regexp_extract(raw, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_][\w-]*):", 1).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    return F.when(block != "", F.map_from_entries(pairs))


def body(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles, navigation and tags go, headings get #, common entities are decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</(script|style|nav)>", " ")
    out = F.regexp_replace(out, r"(?i)<h[1-6][^>]*>", "\n# ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


def html_title(html: Column) -> Column:
    return squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def summary(text: Column, most: int = 500) -> Column:
    """Without headings, emphasis, links and bars, cut at most characters."""
    out = F.regexp_replace(text, r"(?m)^#+ .*$", "")
    out = F.regexp_replace(without_wikilinks(out), r"[|*_`]", " ")
    return F.substring(squeeze(out), 1, most)


def clamp(text: Column, most: int = 160) -> Column:
    """text, or as much as fits: up to the last sentence end, else clause end, else blank, that lies beyond 60 % of most."""
    cut = F.substring(text, 1, most)
    back = F.reverse(cut)
    least = int(most * 0.6)

    def end(pattern: str) -> Column:
        return F.length(cut) - F.regexp_instr(back, F.lit(pattern)) + 1

    def ok(pattern: str) -> Column:
        return (F.regexp_instr(back, F.lit(pattern)) > 0) & (end(pattern) > least)

    tail = lambda x: F.concat(F.regexp_replace(x, r"[\s,;:]+$", ""), F.lit("…"))
    shorter = F.when(ok(r"[.!?]"), F.substring(cut, F.lit(1), end(r"[.!?]"))).when(ok(r"[,;:]"), tail(F.substring(cut, F.lit(1), end(r"[,;:]")))).when(ok(r"\s"), tail(F.substring(cut, F.lit(1), end(r"\s")))).otherwise(tail(cut))
    return F.when(F.length(text) <= most, text).otherwise(shorter)


def sections(text: Column, allowed: list[str]) -> Column:
    """Only the part before the first '## ' heading and the sections whose heading is allowed; unknown ones go."""
    parts = F.split(text, r"(?m)^## ")
    keep = F.filter(F.slice(parts, 2, F.size(parts)), lambda p: F.lower(F.trim(F.regexp_extract(p, r"^([^\n]*)", 1))).isin([a.lower() for a in allowed]))
    return F.concat(parts[0], F.array_join(F.transform(keep, lambda p: F.concat(F.lit("## "), p)), ""))


def without_lines(text: Column, pattern: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(pattern)), "\n")


def first_letter(name: Column) -> Column:
    return F.upper(F.substring(F.trim(name), 1, 1))


def name_keys(name: Column) -> Column:
    """Keys under which a name may be looked up: as it is, without brackets, without 'née …', each side of a slash."""
    plain = squeeze(name)
    bare = squeeze(F.regexp_replace(plain, r"\([^)]*\)", ""))
    return F.array_distinct(F.filter(F.concat(F.array(plain, bare, squeeze(F.regexp_replace(bare, r"(?i)\bn[ée]e\b.*$", ""))), F.transform(F.split(bare, "/"), lambda x: F.trim(x))), lambda k: k != ""))


def fingerprint(parts: list[Column], digits: int = 12) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, digits)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def healed(display: Column, year: Column) -> Column:
    """An empty display from its year; one that isn't empty is never changed."""
    return F.when((F.coalesce(F.trim(display), F.lit("")) == "") & year.isNotNull(), F.concat(F.lit("b. "), year.cast("string"))).otherwise(display)


def mapped(rows: DataFrame, column: str, spellings: dict[str, str], name: str) -> DataFrame:
    """rows with a column of that name: what a spelling stands for by a table, case and blanks at the ends apart; null for those that it lacks, to be reported."""
    known = F.create_map(*[F.lit(x) for k, v in spellings.items() for x in (k.strip().lower(), v)])
    return rows.withColumn(name, F.try_element_at(known, F.lower(F.trim(column))))


def without_symbols(html: Column, symbols: str = r"[\u2600-\u27bf]|\p{So}") -> Column:
    return F.regexp_replace(html, symbols, "")


def json_strings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of every string in nested JSON, however deep: each round opens the objects and arrays that the last one found. Text that is no JSON has none."""
    level = rows.select(key, F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("v")).where("v is not null")
    found = None
    while True:
        kind = F.schema_of_variant("v")
        own = level.withColumn("_k", kind)
        part = own.where("_k = 'STRING'").select(key, "path", F.expr("variant_get(v, '$', 'string')").alias("value"))
        found = part if found is None else found.unionByName(part)
        open_ = own.where("_k like 'OBJECT%' or _k like 'ARRAY%'").select(key, F.col("path").alias("_p"), "v")
        if open_.isEmpty():
            return found
        open_.createOrReplaceTempView("_json_level")
        at = F.when(F.col("key").isNotNull(), F.concat("_p", F.lit("."), "key")).otherwise(F.concat("_p", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = rows.sparkSession.sql(f"select l.`{key}`, l._p, e.pos, e.key, e.value from _json_level l, lateral variant_explode(l.v) e").select(key, at.alias("path"), F.col("value").alias("v"))
