"""Aliases of keys and what becomes of keys that vanish: an alias is given only where it can mean one row and no other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def _dash(*parts: Column) -> Column:
    return F.concat_ws("-", *[F.nullif(T.slugify(p), F.lit("")) for p in parts])


def shapes(rows: DataFrame) -> DataFrame:
    """(slug, alias): up to four forms of each row's names (slug, first_name, middle_name, last_name, birth) that aren't its own slug: with and without middle name and year."""
    f, m, last, year = F.col("first_name"), F.coalesce("middle_name", F.lit("")), F.col("last_name"), F.coalesce(F.col("birth").cast("string"), F.lit(""))
    forms = F.array_distinct(F.array(_dash(f, last), _dash(f, last, year), _dash(f, m, last), _dash(f, m, last, year)))
    named = rows.where((T.slugify(f) != "") & (T.slugify(last) != ""))
    return named.select("slug", F.explode(forms).alias("alias")).where("alias <> slug")


def candidates(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(alias, to, verdict): emitted where the alias is one row's alone, else real_page or ambiguous, with a null to. pages: slug."""
    found = shapes(rows).groupBy("alias").agg(F.count_distinct("slug").alias("n"), F.min("slug").alias("one"))
    found = found.join(pages.select(F.col("slug").alias("_page")).distinct(), F.col("alias") == F.col("_page"), "left")
    verdict = F.when(F.col("_page").isNotNull(), "real_page").when(F.col("n") > 1, "ambiguous").otherwise("emitted")
    return found.select("alias", F.when(verdict == "emitted", F.col("one")).alias("to"), verdict.alias("verdict"))


def filtered(aliases: DataFrame, pages: DataFrame, withheld: DataFrame) -> DataFrame:
    """aliases (from, to, priority) that may be published: none from a page or from or to a withheld key, none to itself or to nowhere; of several from one key the first by priority and to."""
    live, secret = pages.select(F.col("slug").alias("_slug")).distinct(), withheld.select(F.col("slug").alias("_slug")).distinct()
    rows = aliases.where("`to` is not null and `from` <> `to`")
    rows = rows.join(live, rows["from"] == live["_slug"], "left_anti").join(live, rows["to"] == live["_slug"], "left_semi")
    rows = rows.join(secret, rows["from"] == secret["_slug"], "left_anti").join(secret, rows["to"] == secret["_slug"], "left_anti")
    first = rows.groupBy("from").agg(F.min(F.struct("priority", "to")).alias("_first"))
    return first.select("from", F.col("_first.to").alias("to"), F.col("_first.priority").alias("priority"))


def to_targets(aliases: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(redirects, dead): aliases (from, to) whose target is a page, and the rest."""
    live = pages.select(F.col("slug").alias("to")).distinct()
    return aliases.join(live, "to", "left_semi").select(*aliases.columns), aliases.join(live, "to", "left_anti").select(*aliases.columns)


def guessability(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(slug, class): how a reader who types names and year fares: reachable, ambiguous (several rows have that form), covered by an alias that leads here, shadowed by another row's slug, or dead. aliases: from, to."""
    f, m, last, year = F.col("first_name"), F.coalesce("middle_name", F.lit("")), F.col("last_name"), F.coalesce(F.col("birth").cast("string"), F.lit(""))
    own = rows.where((T.slugify(f) != "") & (T.slugify(last) != "")).select("slug", _dash(f, last, year).alias("guess"), _dash(f, m, last, year).alias("given"), F.array_distinct(F.array(_dash(f, last, year), _dash(f, last), _dash(f, m, last), _dash(f, m, last, year))).alias("forms"))
    alike = own.groupBy("guess").agg(F.count("*").alias("n"))
    led = own.select("slug", F.explode("forms").alias("form")).join(aliases.select(F.col("from").alias("form"), F.col("to").alias("slug")), ["form", "slug"], "left_semi").select("slug").distinct().withColumn("led", F.lit(True))
    taken = rows.select(F.col("slug").alias("guess")).distinct().withColumn("taken", F.lit(True))
    out = own.join(alike, "guess").join(led, "slug", "left").join(taken, "guess", "left")
    kind = F.when((F.col("slug") == F.col("guess")) | (F.col("slug") == F.col("given")), "reachable").when(F.col("n") > 1, "ambiguous").when(F.col("led"), "covered").when(F.col("taken"), "shadowed").otherwise("dead")
    return out.select("slug", kind.alias("class"))


def namesakes(rows: DataFrame) -> DataFrame:
    """(bare, slugs): dated slugs that share a bare form, two or more, where no row has the bare form itself."""
    dated = rows.select("slug", F.regexp_extract("slug", r"^(.*)-[0-9]{4}$", 1).alias("bare")).where("bare <> ''")
    found = dated.groupBy("bare").agg(F.array_sort(F.collect_set("slug")).alias("slugs")).where("size(slugs) > 1")
    return found.join(rows.select(F.col("slug").alias("bare")), "bare", "left_anti")


def successors(old: DataFrame, new: DataFrame, columns: list[str], removed: DataFrame, renamed: DataFrame) -> DataFrame:
    """(from, to, how) for each slug of old that new lacks.

    Declared removals (slug, to) come first: gone if to is null, removed if it
    is a row of new; then declared renames (slug, to) to a row of new; then the
    one row of new with the same value in one of columns, in order. A null
    value matches nothing. What is left is unresolved, with a null to.
    """
    live = new.select(F.col("slug").alias("_live")).distinct()
    out = old.join(live, old["slug"] == live["_live"], "left_anti").select("slug", *columns)
    out = out.join(removed.select("slug", F.col("to").alias("_gone"), F.lit(True).alias("_removed")), "slug", "left")
    out = out.join(live.withColumnRenamed("_live", "_g"), F.col("_gone") == F.col("_g"), "left")
    out = out.join(renamed.select("slug", F.col("to").alias("_to")).join(live, F.col("_to") == F.col("_live"), "left_semi"), "slug", "left")
    tries = [("declared_rename", F.col("_to"))]
    for c in columns:
        one = new.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_k_{c}")).agg(F.count_distinct("slug").alias("_n"), F.min("slug").alias(f"_by_{c}")).where("_n = 1").drop("_n")
        out = out.join(one, out[c] == F.col(f"_k_{c}"), "left")
        tries.append((c, F.col(f"_by_{c}")))
    hit = F.coalesce(*[F.when(~F.coalesce("_removed", F.lit(False)) & slug.isNotNull(), F.struct(F.lit(how).alias("how"), slug.alias("to"))) for how, slug in tries])
    declared = F.when(F.col("_gone").isNull(), "gone").when(F.col("_g").isNotNull(), "removed").otherwise("unresolved")
    how = F.when(F.col("_removed"), declared).otherwise(F.coalesce(hit["how"], F.lit("unresolved")))
    return out.select(F.col("slug").alias("from"), F.when(F.col("_removed"), F.col("_g")).otherwise(hit["to"]).alias("to"), how.alias("how"))


def complete(found: DataFrame) -> DataFrame:
    """found; any unresolved successor is an error, as a partial set gives false safety."""
    if not found.where("how = 'unresolved'").isEmpty():
        raise ValueError("some keys have no successor")
    return found


def title_keys(title: Column) -> Column:
    """Forms under which a title may be found: without what follows a dash, quotes, brackets and née; each surname of a slash."""
    bare = F.lower(T.squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"\s+[—-]\s.*$", ""), r"[\"“”][^\"“”]*[\"“”]", " "), r"\s*\([^)]*\)", " ")))
    plain = F.trim(F.regexp_replace(bare, r",\s*n[ée]e\s.*$", ""))
    head, tail = F.regexp_replace(plain, r"\s*\S+$", ""), F.split(F.element_at(F.split(plain, " "), -1), "/")
    return F.array_distinct(F.filter(F.concat(F.array(plain), F.when(F.size(tail) > 1, F.transform(tail, lambda t: F.concat_ws(" ", head, t))).otherwise(F.array().cast("array<string>"))), lambda k: k != ""))


def file_matches(people: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, file, how): the one file that stands for a person, by rules in order; several, or none, give nothing.

    people: slug, title, birth. files: file, as 'First Middle Last (1850–1900).md'.
    exact: the same name, one file; exact_year: several, of which one has the
    birth year; first_last_year: first and last name with the year; prefix: the
    file's name goes on after the person's; surname_swap: all but the last word
    agree; bracket: given names agree and a bracket holds the surname;
    extra_name: first and last agree, one name more or less, years don't clash.

    Persons don't meet files but keys, each with the number of its files and one
    of them, so that names that many share make no pairs. The one file of several
    keys is one that all of them have alone.
    """
    name = F.lower(F.trim(F.regexp_replace(F.regexp_replace("file", r"(?i)\.md$", ""), r"\s*\([^)]*\)\s*$", "")))
    f = files.select("file").where("file is not null").distinct()
    f = f.select("file", name.alias("name"), F.nullif(F.regexp_extract("file", r"\(([0-9]{3,4})[–-]", 1), F.lit("")).alias("year"), F.lower(F.concat_ws(" ", F.regexp_extract_all("file", F.lit(r"\(([^)]*)\)"), F.lit(1)))).alias("bracket"))
    f = f.withColumn("words", F.split("name", " "))
    p = people.select("slug", F.col("birth").cast("string").alias("year"), F.posexplode(title_keys(F.col("title"))).alias("at", "name")).withColumn("words", F.split("name", " "))
    main, several, dated = F.col("at") == 0, F.size("words") > 1, F.col("year").isNotNull()
    first, last, given = F.get("words", F.lit(0)), F.element_at("words", -1), F.array_join(F.slice("words", 1, F.size("words") - 1), " ")
    ask = lambda how, *parts: F.struct(F.lit(how).alias("how"), F.array(*parts).alias("key"))
    some = lambda when, asks: F.when(when, asks).otherwise(F.array().cast("array<struct<how:string,key:array<string>>>"))
    extra = lambda more, year: ask("extra_name", first, last, (F.size("words") + more).cast("string"), year)
    year, no_year, any_year = F.concat(F.lit("="), "year"), F.lit("-"), F.lit("*")
    alike, alike_year = F.array(ask("exact", "name")), some(dated, F.array(ask("exact_year", "name", "year"), ask("first_last_year", first, last, "year")))
    heads = F.transform(F.slice(F.sequence(F.lit(1), F.size("words")), 1, F.size("words") - 1), lambda n: ask("prefix", F.array_join(F.slice("words", F.lit(1), n), " ")))
    held = F.transform(F.array_distinct(F.split("bracket", r"[^\p{L}]+")), lambda t: ask("bracket", given, t))
    shown = f.select("file", F.inline(F.concat(alike, alike_year, heads, some(several, held), F.array(extra(0, F.coalesce(year, no_year)), extra(0, any_year)))))
    shown = shown.groupBy("how", "key").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    own = F.concat(some(main, F.array(ask("prefix", "name"))), some(main & several, F.array(ask("bracket", given, last))), some(main & ~dated, F.array(extra(-1, any_year), extra(1, any_year))), some(main & dated, F.array(*[extra(i, y) for i in (-1, 1) for y in (year, no_year)])))
    # Sorted joins: Spark doesn't know how much explode() adds and might broadcast all keys.
    found = p.select("slug", F.inline(F.concat(alike, alike_year, own))).hint("merge").join(shown, ["how", "key"]).select("slug", "how", "n", "file")
    # Of the files with a given name all but those of the person's own name: if one is left, the given name has two names at most. As arrays the given names of files are dealt anew, and Spark can split the persons of one.
    names = f.where(several).groupBy(given.alias("given"), "name").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    names = names.groupBy("given").agg(F.sum("n").alias("n"), F.min(F.struct("name", "n", "file")).alias("lo"), F.max(F.struct("name", "n", "file")).alias("hi")).select(F.array("given").alias("key"), "n", "lo", "hi")
    swap = p.where(main & several).select("slug", "name", F.array(given).alias("key")).hint("merge").join(names, "key")
    minus = F.when(F.col("name") == F.col("lo.name"), F.col("lo.n")).when(F.col("name") == F.col("hi.name"), F.col("hi.n")).otherwise(0)
    swap = swap.select("slug", F.lit("surname_swap").alias("how"), (F.col("n") - minus).alias("n"), F.when(F.col("name") == F.col("lo.name"), F.col("hi.file")).otherwise(F.col("lo.file")).alias("file")).where("n > 0")
    order = ["exact", "exact_year", "first_last_year", "prefix", "surname_swap", "bracket", "extra_name"]
    by = found.unionByName(swap).groupBy("slug", "how").agg(F.max("n").alias("n"), F.min("file").alias("file"), F.max("file").alias("other")).where("n = 1 and file = other")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("how"))
    best = by.groupBy("slug").agg(F.min(F.struct(rank.alias("r"), "how", "file")).alias("b"))
    return best.select("slug", F.col("b.file").alias("file"), F.col("b.how").alias("how"))


def signed_off(notes: DataFrame, people: DataFrame) -> DataFrame:
    """(note, slug, how): notes (note, name, birth) matched by name and birth, else by a name that one row has; ambiguous or unknown ones get no slug. people: slug, name, birth."""
    key = lambda c: F.lower(T.squeeze(F.col(c)))
    dated = people.where("birth is not null").groupBy(key("name").alias("k"), F.col("birth").alias("y")).agg(F.count_distinct("slug").alias("n1"), F.min("slug").alias("s1"))
    named = people.groupBy(key("name").alias("k2")).agg(F.count_distinct("slug").alias("n2"), F.min("slug").alias("s2"))
    rows = notes.withColumn("_k", key("name"))
    rows = rows.join(dated, (F.col("_k") == F.col("k")) & (F.col("birth") == F.col("y")), "left").join(named, F.col("_k") == F.col("k2"), "left")
    how = F.when(F.col("n1") == 1, "name_birth").when(F.coalesce(F.col("n1"), F.lit(0)) > 1, "ambiguous").when(F.col("n2") == 1, "name").when(F.col("n2") > 1, "ambiguous").otherwise("unknown")
    return rows.select("note", F.when(how == "name_birth", F.col("s1")).when(how == "name", F.col("s2")).alias("slug"), how.alias("how"))


def cell_matches(cells: DataFrame, people: DataFrame) -> DataFrame:
    """(cell, slug, verdict): names in cells (cell, name, birth, death) that may be linked: the name is a row's and stated years agree; undated cells of several namesakes are refused. people: slug, name, birth, death."""
    key = lambda c: F.lower(T.squeeze(T.folded(F.col(c))))
    p = people.select("slug", key("name").alias("_k"), F.col("birth").alias("_b"), F.col("death").alias("_d"))
    rows = cells.withColumn("_k", key("name")).join(p, "_k", "left")
    agree = F.coalesce(F.col("birth") == F.col("_b"), F.lit(True)) & F.coalesce(F.col("death") == F.col("_d"), F.lit(True))
    stats = rows.groupBy("cell").agg(F.count_distinct("slug").alias("n"), F.count_distinct(F.when(agree, F.col("slug"))).alias("fits"), F.min(F.when(agree, F.col("slug"))).alias("one"))
    verdict = F.when(F.col("n") == 0, "unknown").when(F.col("fits") == 0, "years_differ").when(F.col("fits") == 1, "match").otherwise("ambiguous")
    return stats.select("cell", F.when(verdict == "match", F.col("one")).alias("slug"), verdict.alias("verdict"))


def first_seen(seen: DataFrame, renames: DataFrame) -> DataFrame:
    """(slug, first_date): the earliest date of a key or of any that became it. seen: slug, date. renames: from, to, already followed to the end (graph.chain_ends)."""
    r = renames.select(F.col("from").alias("_from"), F.col("to").alias("_to"))
    rows = seen.join(r, seen["slug"] == r["_from"], "left").select(F.coalesce("_to", "slug").alias("slug"), "date")
    return rows.groupBy("slug").agg(F.min("date").alias("first_date"))


def longest_first(rows: DataFrame, title: str, key: str) -> DataFrame:
    """rows with place, from 1: longer titles first, as a shorter one may stand inside; equal ones by title and key. Numbered within each length, then over the lengths."""
    n = rows.withColumn("_n", F.length(title))
    counts = n.groupBy("_n").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy(F.desc("_n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # as many rows as there are lengths
    own = F.row_number().over(W.partitionBy("_n").orderBy(title, key))
    return n.join(counts.select("_n", before.alias("_before")), "_n").withColumn("place", F.col("_before") + own).drop("_n", "_before")
