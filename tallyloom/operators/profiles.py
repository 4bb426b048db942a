"""What rows on persons are worth: trust, completeness, shapes of references, and which rows a list keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .gates import issues, united

#: The shape of a slug, words and marks of doubt, categories of references in order (the first pattern that matches decides), and the least length of a text.
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
DOUBT = r"(?i)\b(?:unknown|likely|probably|possibly|suspected|uncertain|unconfirmed|believed|presumably|approx|approximately|unclear|maybe|not sure|no record|not known)\b|\b[0-9]{3,4}\?|\bc\. ?[0-9]{3,4}\b|~ ?[0-9]{3,4}\b|\best[.:]? ?[0-9]{3,4}\b"
CATEGORIES = (("name_with_years", r"\([0-9]{4}.*?\)"), ("year_prefix", r"^[0-9]{4}[^0-9]"), ("marriage_date", r"\(m\. "), ("nee_format", r"\(née"), ("adoptive", r"\(adopt"), ("deceased", r"\(deceased"), ("parenthetical", r"\([0-9](?:st|nd|rd|th)"), ("mangled_slug", r"^[a-z].*-"), ("unknown", r"^\?"), ("metadata_suffix", r" \((?:brother|sister|first marriage|all with)"))
BIO_LEAST = 15


def uncertain(text: Column) -> Column:
    return text.rlike(DOUBT)


def trust_class(birth: Column, death: Column, is_living: Column, bio: Column, unknown_relation: Column) -> Column:
    """unverified without a birth, a text or with a relation that is unknown; partial if a death is missing or the text is in doubt; else sourced."""
    bare = F.length(F.trim(F.coalesce(bio, F.lit("")))) < BIO_LEAST
    return F.when(birth.isNull() | (birth <= 0) | bare | F.coalesce(unknown_relation, F.lit(False)), "unverified").when(~is_living & F.coalesce(death <= 0, F.lit(True)), "partial").when(uncertain(F.coalesce(bio, F.lit(""))), "partial").otherwise("sourced")


def trust_report(rows: DataFrame, trust: Column, most_unverified: float = 0.4, most_partial: float = 0.5) -> DataFrame:
    """One row: counts by class, and the alert that their shares raise, if any."""
    n = lambda k: F.count_if(trust == k).alias(k)
    out = rows.agg(F.count("*").alias("total"), n("sourced"), n("partial"), n("unverified"))
    alert = F.when(F.col("unverified") > most_unverified * F.col("total"), "unverified_high").when(F.col("partial") > most_partial * F.col("total"), "partial_high")
    return out.withColumn("alert", alert)


def completeness(rows: DataFrame, key: Column, birth: Column, death: Column, is_living: Column, bio: Column, before: int = 1900) -> DataFrame:
    """Issues of rows without a birth, without a death though not living, without a text, or living though born before that year."""
    return united([
        issues(rows.where(birth.isNull()), "no_birth", key, F.lit(""), "low"),
        issues(rows.where(~is_living & death.isNull()), "no_death", key, F.lit(""), "low"),
        issues(rows.where(F.length(F.trim(F.coalesce(bio, F.lit("")))) < BIO_LEAST), "no_text", key, F.lit(""), "low"),
        issues(rows.where(is_living & (birth < before)), "too_old_to_live", key, birth, "medium"),
    ])


def category(ref: Column) -> Column:
    out = F
    for name, pattern in CATEGORIES:
        out = out.when(ref.rlike(pattern), name)
    return out.otherwise("display_name")


def branch(surname: Column, slug: Column, rules: list[tuple[str, str]]) -> Column:
    """The branch of the first rule (part of a name, branch) that surname or slug contains."""
    low = F.concat_ws(" ", F.lower(surname), F.lower(slug))
    return F.coalesce(*[F.when(low.contains(part.lower()), F.lit(b)) for part, b in rules])


def branches(people: DataFrame, spouses: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(slug, branch): by name, else the branch of a spouse (a, b) that has one by name, the least of several. people: slug, surname."""
    own = people.select("slug", branch(F.col("surname"), F.col("slug"), rules).alias("branch"))
    both = spouses.select("a", "b").union(spouses.select("b", "a"))
    theirs = both.join(own.where("branch is not null").select(F.col("slug").alias("b"), "branch"), "b").groupBy(F.col("a").alias("slug")).agg(F.min("branch").alias("theirs"))
    return own.join(theirs, "slug", "left").select("slug", F.coalesce("branch", "theirs").alias("branch"))


def slug_shape(rows: DataFrame, arrays: list[str]) -> DataFrame:
    """One row: entries, those that are slug-shaped and the rows with any of these."""
    refs = F.flatten(F.array(*[F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays]))
    shaped = F.filter(refs, lambda x: x.rlike(SLUG))
    return rows.agg(F.sum(F.size(refs)).alias("entries"), F.sum(F.size(shaped)).alias("shaped"), F.count_if(F.size(shaped) > 0).alias("rows_with_any"))


def linkable(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """refs (ref_id, ref) that aren't slug-shaped though the resolver finds their row: (ref_id, ref, slug). resolved: ref_id, slug."""
    return refs.where(~F.col("ref").rlike(SLUG)).join(resolved.where("slug is not null").select("ref_id", "slug"), "ref_id").select("ref_id", "ref", "slug")


def photo_counts(rows: DataFrame, key: str, images: str) -> DataFrame:
    """(key, n): distinct file names of a row's images."""
    names = F.array_distinct(F.filter(F.transform(images, lambda x: F.lower(F.element_at(F.split(x, "/"), -1))), lambda n: n != ""))
    return rows.select(key, F.size(names).alias("n"))


def match_totals(rows: DataFrame, matches: str) -> DataFrame:
    """One row: how many matches (array of names) there are, and how many distinct names."""
    return rows.select(F.explode(matches).alias("name")).agg(F.count("*").alias("n_matches"), F.count_distinct("name").alias("n_names"))


def without_orphans(rows: DataFrame, file: str, sources: DataFrame, stubs: DataFrame) -> DataFrame:
    """rows whose source file is there and no stub; rows without a file stay. sources and stubs: file."""
    known = sources.select(F.col("file").alias("_file")).distinct().join(stubs.select(F.col("file").alias("_file")), "_file", "left_anti")
    return rows.where(F.col(file).isNotNull()).join(known, rows[file] == known["_file"], "left_semi").unionByName(rows.where(F.col(file).isNull()))


def not_redirects(rows: DataFrame, title: str, tags: str) -> DataFrame:
    """Rows that are no redirect stubs by title or tag."""
    return rows.where(~F.coalesce(F.lower(title).contains("redirect"), F.lit(False)) & ~F.coalesce(F.exists(tags, lambda t: F.lower(t) == "redirect"), F.lit(False)))


def with_required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with something in each of columns."""
    out = rows
    for c in columns:
        out = out.where(F.trim(F.col(c).cast("string")) != "")
    return out


def of_lineage(rows: DataFrame, column: str, value: str) -> DataFrame:
    return rows.where((F.col(column) == value) | F.col(column).isNull())


def lineage_with_spouses(people: DataFrame, name: str, part: str, spouses: DataFrame, parents: DataFrame) -> DataFrame:
    """people (slug, ...) whose name contains part, and their spouses (a, b) who share a child (parents: child, parent) with them."""
    core = people.where(F.lower(name).contains(part.lower())).select("slug")
    both = spouses.select("a", "b").union(spouses.select("b", "a")).distinct().join(core.withColumnRenamed("slug", "a"), "a", "left_semi")
    one, two = parents.select("child", F.col("parent").alias("a")), parents.select("child", F.col("parent").alias("b"))
    shared = both.join(one, "a").join(two, ["child", "b"]).select(F.col("b").alias("slug"))
    return people.join(core.union(shared).distinct(), "slug", "left_semi")


def with_status(rows: DataFrame, recorded: Column, status: str) -> DataFrame:
    """status: recorded, awaiting or all."""
    if status not in ("recorded", "awaiting", "all"):
        raise ValueError(f"no status {status}")
    return rows if status == "all" else rows.where(recorded if status == "recorded" else ~recorded)


def suspect_years(rows: DataFrame, key: Column, birth: Column, death: Column, least: int = 1500, most: int = 2030) -> DataFrame:
    """Issues of years outside least to most and of deaths before births."""
    odd = lambda y: (y < least) | (y > most)
    return united([issues(rows.where(odd(birth)), "birth_out_of_range", key, birth, "high"), issues(rows.where(odd(death)), "death_out_of_range", key, death, "high"), issues(rows.where(death < birth), "died_before_birth", key, death, "high")])


def cut_off(rows: DataFrame, key: str, birth: Column, death: Column, checked: DataFrame, before: int = 1901) -> DataFrame:
    """Rows born before that year whose death is known and that haven't been checked."""
    return rows.where((birth < before) & death.isNotNull()).join(checked.select(key), key, "left_anti")


def relation_rows(rows: DataFrame, key: str, arrays: dict[str, str], people: DataFrame) -> DataFrame:
    """(key, relation, slug, name, withheld) of the arrays (column to relation) of struct (slug, plain_name, withheld): names of rows come from people (slug, name), the others are names alone."""
    parts = [rows.select(key, F.lit(kind).alias("relation"), F.inline(column)) for column, kind in arrays.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    known = people.select(F.col("slug").alias("_slug"), F.col("name").alias("_name"))
    out = out.join(known, out["slug"] == known["_slug"], "left")
    return out.select(key, "relation", F.col("_slug").alias("slug"), F.coalesce("_name", "plain_name", F.col("slug").cast("string")).alias("name"), F.coalesce("withheld", F.lit(False)).alias("withheld"))


def contained_names(left: DataFrame, left_name: str, right: DataFrame, right_name: str) -> DataFrame:
    """Pairs (left_name, right_name) of distinct names of which one contains the other, of three characters or more.

    Pairs meet on the first three characters of the contained one, which the
    other has somewhere, so that no name is held against all others.
    """
    a, b = left.select(F.col(left_name).alias("a")).distinct().where("length(a) >= 3"), right.select(F.col(right_name).alias("b")).distinct().where("length(b) >= 3")
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))))
    into = lambda small, big, s, g: small.withColumn("_g", F.substring(s, 1, 3)).join(big.withColumn("_g", grams(F.col(g))), "_g").where(F.contains(F.col(g), F.col(s)))
    both = into(a, b, "a", "b").select("a", "b").union(into(b, a, "b", "a").select("a", "b")).distinct()
    return both.toDF(left_name, right_name) if left_name != right_name else both.toDF("left", "right")


def reconciled(notes: DataFrame, key: str, sources: list[str], lifespans: DataFrame) -> DataFrame:
    """(key, source, missing): names that some of the array columns have and this source lacks.

    A name is explained, and no gap, where the source has a name with the same
    first word and the same lifespan. lifespans: name, lifespan.
    """
    empty = F.array().cast("array<string>")
    union = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.col(s), empty) for s in sources])))
    rows = notes.select(key, union.alias("_all"), *sources)
    lacks = [rows.select(key, F.lit(s).alias("source"), F.explode(F.array_except("_all", F.coalesce(F.col(s), empty))).alias("name"), F.coalesce(F.col(s), empty).alias("_has")) for s in sources]
    gaps = united(lacks)
    own = lifespans.select("name", "lifespan").where("lifespan is not null")
    first = lambda c: F.lower(F.split(F.trim(c), " ")[0])
    other = gaps.select(key, "source", "name", F.explode("_has").alias("_other")).where(first(F.col("_other")) == first(F.col("name")))
    other = other.join(own, "name").join(own.select(F.col("name").alias("_other"), F.col("lifespan").alias("_span")), "_other").where(F.col("lifespan") == F.col("_span")).select(key, "source", "name").distinct()
    return gaps.join(other, [key, "source", "name"], "left_anti").groupBy(key, "source").agg(F.array_sort(F.collect_set("name")).alias("missing"))


def step_without_children(steps: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Step relations (key, name) whose bare name no child relation of the row has."""
    bare = lambda c: F.lower(T.squeeze(F.regexp_replace(F.col(c), r"\([^)]*\)", " ")))
    return steps.withColumn("_n", bare(name)).join(children.select(key, bare(name).alias("_n")), [key, "_n"], "left_anti").drop("_n")


def dated_by_default(rows: DataFrame, key: str, lastmod: str) -> DataFrame:
    """(key, lastmod): a row's own date, else the newest of all."""
    return rows.select(key, F.coalesce(F.col(lastmod), rows.agg(F.max(lastmod)).scalar()).alias(lastmod))


def generation_by_indent(trees: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, name, generation): the depth of the first line of a tree that shows a name; two blanks, or a tab, are a step.

    Lines and names meet on a name's first word. Spark takes lines and words for
    as large as the trees that they are split from, and would broadcast them
    through the driver, so that the join is always a sorted one.
    """
    rows = trees.select(key, F.posexplode(F.split(text, "\n")).alias("_at", "_line"))
    indent = F.regexp_replace(F.regexp_extract("_line", r"^([ \t]*)", 1), "\t", "  ")
    rows = rows.select(key, "_at", "_line", F.floor(F.length(indent) / 2).cast("int").alias("_depth"))
    word = F.explode(F.array_distinct(F.split(F.lower("_line"), r"[^\p{L}\p{N}]+")))
    asked = names.select(F.col(name).alias(name), F.split(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+")[0].alias("_word")).distinct()
    hits = rows.withColumn("_word", word).hint("merge").join(asked, "_word").where(F.contains(F.lower("_line"), F.lower(name)))
    return hits.groupBy(key, name).agg((F.min_by("_depth", "_at") + 1).alias("generation"))
