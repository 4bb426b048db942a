"""Parsing notes: front matter, tables, relations, images, and what can be read out of their prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Words of a relation's label and the kind that they stand for.
FOLDED_TYPES = {"son": "child", "daughter": "child", "children": "child", "father": "parent", "mother": "parent", "husband": "spouse", "wife": "spouse", "brother": "sibling", "sister": "sibling"}
IMAGE = r"!\[\[([^\]|\n]+)(?:\|([^\]\n]*))?\]\](?:[ \t]*\n[*_]([^*_\n]+)[*_][ \t]*(?:\n|$))?"
#: Patterns of references to records, and kinds of sources in the order in which they are named.
CITATIONS = (r"\b[0-9]{4}/[0-9]{1,6}\b", r"(?i)\b(?:birth|death|marriage) (?:register|certificate|entry)\b", r"(?i)\b(?:cemetery|burial) (?:record|register)\b", r"(?i)\bparish register\b")
SOURCE_KINDS = (("parish register", r"(?i)\bparish register\b"), ("birth record", r"(?i)\bbirth (?:register|certificate|entry)\b"), ("death record", r"(?i)\bdeath (?:register|certificate|entry)\b"), ("marriage record", r"(?i)\bmarriage (?:register|certificate|entry)\b"), ("cemetery record", r"(?i)\b(?:cemetery|burial)\b"), ("census", r"(?i)\bcensus\b"), ("newspaper", r"(?i)\b(?:newspaper|obituar)"))


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def given(text: Column) -> Column:
    """text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def split_naively(raw: Column) -> Column:
    """(block, body) by the first two '---' wherever they stand; null with fewer."""
    parts = F.split(raw, "---", 3)
    return F.when(F.size(parts) >= 3, F.struct(F.trim(F.get(parts, F.lit(1))).alias("block"), F.regexp_replace(F.get(parts, F.lit(2)), r"^\s+|\s+$", "").alias("body")))


def block_of(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(?s)^---\r?\n(.*?)\r?\n---", 1)


def fields(raw: Column) -> Column:
    """Map of the flat fields; a continuation line belongs to the field before it. Of repeated keys the last counts."""
    joined = F.regexp_replace(block_of(raw), r"\r?\n[ \t]+([^\s-])", " $1")
    own = F.filter(lines(joined), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    pairs = F.transform(own, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.key == p.key))
    return F.map_from_entries(last)


def fields_with_lines(raw: Column) -> Column:
    """Array of (line, key, value) of the top-level fields; lines are counted from 1 in the whole note."""
    own = F.transform(lines(block_of(raw)), lambda x, i: F.struct((i + 2).alias("line"), F.regexp_extract(x, r"^([A-Za-z_][\w-]*):", 1).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    return F.filter(own, lambda x: x.key != "")


def unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"""^["']|["']$""", "")


def list_field(raw: Column, key: str) -> Column:
    """The names of a list field, written in one line in brackets or one to a line after dashes."""
    inline = F.regexp_extract(block_of(raw), rf"(?m)^{key}:[ \t]*\[(.*)\][ \t]*$", 1)
    rows = F.regexp_extract(F.concat(block_of(raw), F.lit("\n")), rf"(?m)^{key}:[ \t]*\n((?:[ \t]+- .*\n)+)", 1)
    names = F.when(inline != "", F.split(inline, ",")).otherwise(F.regexp_extract_all(rows, F.lit(r"(?m)^[ \t]+- (.*)$"), F.lit(1)))
    return F.filter(F.transform(names, unquoted), lambda x: x != "")


def table_rows(text: Column) -> Column:
    """Cells of the table rows of a text, without the rules under headings."""
    rows = F.filter(lines(text), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^[\s|:-]+$"))
    return F.transform(rows, T.table_cells)


def plain_label(cell: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(cell, r"[*:]", "")))


def labelled_rows(text: Column, labels: list[str]) -> Column:
    """Rows whose first cell is one of labels, emphasis and colons apart."""
    return F.filter(table_rows(text), lambda r: plain_label(F.get(r, F.lit(0))).isin([x.lower() for x in labels]))


def relations_naive(text: Column) -> Column:
    """'type: a, b | type: c' as (type, names), whatever brackets hold."""
    return F.transform(F.filter(F.split(text, r"\|"), lambda p: p.contains(":")), lambda p: F.struct(F.trim(F.split(p, ":", 2)[0]).alias("type"), F.filter(F.transform(F.split(F.split(p, ":", 2)[1], ","), lambda n: F.trim(n)), lambda n: n != "").alias("names")))


def relations_of_types(text: Column, types: list[str]) -> Column:
    """(type, names) of the first part for each known type, in the order of types."""
    one = lambda t: F.struct(F.lit(t).alias("type"), F.filter(F.transform(F.split(F.regexp_extract(text, rf"(?i)(?:^|\|)\s*{t}s?\s*:([^|]*)", 1), ","), lambda n: F.trim(T.without_wikilinks(n))), lambda n: n != "").alias("names"))
    return F.filter(F.array(*[one(t) for t in types]), lambda x: F.size(x.names) > 0)


def folded_type(label: Column) -> Column:
    """The kind that a label stands for; other labels lose a plural s."""
    low = F.lower(F.trim(label))
    bare = F.regexp_replace(low, "s$", "")
    table = F.create_map(*[F.lit(x) for pair in FOLDED_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, bare), bare)


def bucketed_links(text: Column, buckets: dict[str, str]) -> Column:
    """(bucket, names): the wikilinks in the rows of each label, each once, in the order of the table; buckets: label to bucket."""
    table = F.create_map(*[F.lit(x) for k, v in buckets.items() for x in (k.lower(), v)])
    rows = F.transform(table_rows(text), lambda r: F.struct(F.try_element_at(table, plain_label(F.get(r, F.lit(0)))).alias("bucket"), F.flatten(F.transform(F.slice(r, 2, F.size(r)), T.wikilinks)).alias("names")))

    def one(bucket: str) -> Column:
        own = F.filter(rows, lambda x: x.bucket == bucket)
        return F.struct(F.lit(bucket).alias("bucket"), F.array_distinct(F.flatten(F.transform(own, lambda x: x.names))).alias("names"))

    found = F.array(*[one(b) for b in dict.fromkeys(buckets.values())])
    return F.filter(found, lambda x: F.size(x.names) > 0)


def step_relations(text: Column) -> Column:
    """(type, names) of step relations, from table rows and from '**Step-…:**' lines; without links names are split at commas."""

    def named(label: Column, said: Column) -> Column:
        linked = T.wikilinks(said)
        plain = F.filter(F.transform(F.split(said, ","), lambda n: F.trim(n)), lambda n: n != "")
        return F.struct(F.regexp_replace(plain_label(label), r"\s+", "-").alias("type"), F.when(F.size(linked) > 0, linked).otherwise(plain).alias("names"))

    rows = F.transform(F.filter(table_rows(text), lambda r: plain_label(F.get(r, F.lit(0))).rlike("^step[ -]")), lambda r: named(F.get(r, F.lit(0)), F.get(r, F.lit(1))))
    own = F.filter(lines(text), lambda x: x.rlike(r"(?i)^\s*(?:- )?\*\*step[ -][^*]*\*\*"))
    said = F.transform(own, lambda x: named(F.regexp_extract(x, r"\*\*([^*]*)\*\*", 1), F.regexp_replace(x, r"^[^*]*\*\*[^*]*\*\*:?", "")))
    return F.concat(rows, said)


def relation_table(text: Column) -> Column:
    """(type, name) of the rows under '| Relation | Name |'; dates in brackets and notes after a dash go."""
    rows = F.filter(table_rows(text), lambda r: (F.size(r) >= 2) & (plain_label(F.get(r, F.lit(0))) != "relation"))
    clean = lambda n: F.trim(F.regexp_replace(F.regexp_replace(T.without_wikilinks(n), r"\s*\([^)]*[0-9][^)]*\)", ""), r"\s+[—–].*$", ""))
    return F.when(text.rlike(r"(?im)^\|\s*relation\s*\|\s*name\s*\|"), F.transform(rows, lambda r: F.struct(plain_label(F.get(r, F.lit(0))).alias("type"), clean(F.get(r, F.lit(1))).alias("name")))).otherwise(F.array().cast("array<struct<type:string,name:string>>"))


def section(text: Column, title: str) -> Column:
    """What stands under '## title', up to the next heading of that level."""
    return F.regexp_extract(F.concat(text, F.lit("\n## ")), rf"(?is)(?:^|\n)## {title}[ \t]*\n(.*?)\n?(?=\n## |## $)", 1)


def children_of(text: Column) -> Column:
    """Names in the section on children: a table's first column, else its links."""
    own = section(text, "Children")
    rows = F.transform(table_rows(own), lambda r: F.trim(T.without_wikilinks(F.get(r, F.lit(0)))))
    rows = F.filter(F.slice(rows, 2, F.size(rows)), lambda n: n != "")
    return F.when(F.size(table_rows(own)) > 1, rows).otherwise(T.wikilinks(own))


def role_of(text: Column) -> Column:
    """What the first '**Role:**' or '**Occupation:**' line says; null without one."""
    return given(F.trim(F.regexp_extract(text, r"(?im)^[ \t]*(?:- )?\*\*(?:role|occupation):\*\*[ \t]*([^\n]*)$", 1)))


def birth_estimate(text: Column, latest: Column) -> Column:
    """A year of birth that prose states, by patterns in order; two digits are of the last century. From 1700 to latest, else null."""
    get = lambda p: F.regexp_extract(text, p, 1).try_cast("int")
    found = F.coalesce(get(r"(?i)\bborn (?:in |on |about |c\. ?)?(?:[0-9]{1,2} )?(?:[A-Z][a-z]+ )?([0-9]{4})\b"), get(r"\bb\. ?~?([0-9]{4})\b"), get(r"(?i)\bborn (?:in )?['’]([0-9]{2})\b") + 1900)
    return F.when(found.between(F.lit(1700), latest), found)


def person_id(name: Column, birth: Column, death: Column) -> Column:
    return F.when(birth.isNotNull(), F.concat(name, F.lit(" ("), birth.cast("string"), F.lit(")"))).when(death.isNotNull(), F.concat(name, F.lit(" (d."), death.cast("string"), F.lit(")"))).otherwise(name)


def images(text: Column) -> Column:
    """(src, alt, caption) of '![[file|alt]]'; an italic line right after it is the caption."""
    get = lambda k: F.regexp_extract_all(text, F.lit(IMAGE), F.lit(k))
    rows = F.arrays_zip(get(1).alias("src"), get(2).alias("alt"), get(3).alias("caption"))
    return F.transform(rows, lambda x: F.struct(F.trim(x.src).alias("src"), F.trim(F.coalesce(x.alt, F.lit(""))).alias("alt"), F.trim(F.coalesce(x.caption, F.lit(""))).alias("caption")))


def portrait(found: Column, excluded: str) -> Column:
    """The src of the first image whose src and alt don't match excluded; null if all do."""
    return F.get(F.filter(found, lambda x: ~F.concat_ws(" ", x.src, x.alt).rlike(excluded)), F.lit(0)).src


def tolerant_year(value: Column) -> Column:
    """The first run of three or four digits, with its sign."""
    return given(F.regexp_extract(value.cast("string"), r"-?[0-9]{3,4}", 0)).try_cast("int")


def age_at_death(birth: Column, death: Column) -> Column:
    return F.when(death >= birth, death - birth)


def type_label(label: Column) -> Column:
    """Without words of doubt, the first letter a capital."""
    bare = T.squeeze(F.regexp_replace(label, r"(?i)\b(?:probable|possible|unproven)\b", " "))
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length(bare)))


def places(text: Column, states: list[str]) -> Column:
    """'Place, STATE' as often as text has it, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*, (?:{'|'.join(states)}))\b"), F.lit(1)))


def caption(alt: Column, owner: Column, most: int = 160) -> Column:
    """The first sentence of an image's alt text without 'photo of' and the like; empty if it only names the owner."""
    bare = F.trim(F.regexp_replace(F.trim(T.without_wikilinks(alt)), r"(?i)^(?:a )?(?:photograph|photo|portrait|image|picture) (?:of|showing) ", ""))
    same = lambda x: T.squeeze(F.regexp_replace(F.lower(x), r"[^a-z0-9 ]", ""))
    first = F.regexp_replace(F.regexp_replace(bare, r"(?s)([.!?])\s.*$", "$1"), r"[.\s]+$", "")
    cut = F.substring(first, 1, most)
    words = F.regexp_replace(cut, r"\s+\S*$", "")
    short = F.when(F.length(first) <= most, first).otherwise(F.concat(F.when(F.length(words) > most / 2, words).otherwise(cut), F.lit("…")))
    return F.when(same(bare) == same(owner), "").otherwise(short)


def citations(text: Column) -> Column:
    """(n, kinds): bullets under a heading on sources, or its lines where it has none, plus the distinct matches of CITATIONS; up to three kinds of source."""
    shown = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", " ")
    own = F.filter(lines(F.coalesce(given(section(shown, "Sources")), section(shown, "References"))), lambda x: F.trim(x) != "")
    bullets = F.size(F.filter(own, lambda x: x.rlike(r"^\s*[-*+] ")))
    hits = F.array_distinct(F.concat(*[F.transform(F.regexp_extract_all(shown, F.lit(p), F.lit(0)), lambda x: T.squeeze(F.lower(x))) for p in CITATIONS]))
    kinds = F.slice(F.array_compact(F.array(*[F.when(shown.rlike(p), F.lit(k)) for k, p in SOURCE_KINDS])), 1, 3)
    return F.struct((F.when(bullets > 0, bullets).otherwise(F.size(own)) + F.size(hits)).alias("n"), kinds.alias("kinds"))


def first_sentence(text: Column, editorial: str = r"(?i)^(?:note|todo|see also)\b") -> Column:
    """The first sentence of prose: tables, headings, images and labels apart, blocks without brackets go before those with, whole sentences before fragments."""
    blocks = F.transform(F.split(text, r"\n\s*\n"), lambda b: T.squeeze(F.array_join(F.filter(F.split(b, "\n"), lambda x: ~F.trim(x).rlike(r"^(?:\||#|!\[|\*\*[^*]*:\*\*|- )")), " ")))
    prose = F.filter(blocks, lambda b: (b != "") & ~b.rlike(editorial))
    sentence = F.transform(prose, lambda b: F.when(b.rlike(r"[.!?](?:\s|$)"), F.regexp_extract(b, r"^(.*?[.!?])(?:\s|$)", 1)).otherwise(b))
    whole = F.filter(sentence, lambda s: s.rlike(r"[.!?]$"))
    clean = F.filter(whole, lambda s: ~s.rlike(r"[\[\]()]"))
    return F.coalesce(F.get(clean, F.lit(0)), F.get(whole, F.lit(0)), F.get(sentence, F.lit(0)))


def title_years(birth: Column, death: Column, is_living: Column) -> Column:
    """'b–d', 'b. y', 'd. y' or nothing; a death isn't shown of those who may be living."""
    b, d = F.nullif(birth, F.lit("?")), F.when(~is_living, F.nullif(death, F.lit("?")))
    return F.when(b.isNotNull() & d.isNotNull(), F.concat(b, F.lit("–"), d)).when(b.isNotNull(), F.concat(F.lit("b. "), b)).when(d.isNotNull(), F.concat(F.lit("d. "), d)).otherwise("")


def linked(text: Column, names: Column) -> Column:
    """text with names (array of struct name, page) wrapped as [[page|name]], whole words only and not inside links; longer names first. What is shown stays the same."""
    order = F.array_sort(names, lambda a, b: F.when(F.length(a["name"]) != F.length(b["name"]), F.length(b["name"]) - F.length(a["name"])).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    safe = lambda x: F.regexp_replace(x, r"([\\$])", r"\\$1")
    wrap = lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<![\w\[|])\Q"), x["name"], F.lit(r"\E(?!\w)(?![^\[\n]*\]\])")), F.concat(F.lit("[["), safe(x.page), F.lit("|"), safe(x["name"]), F.lit("]]")))
    return F.aggregate(order, text, wrap)
