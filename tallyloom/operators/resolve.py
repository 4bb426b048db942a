"""Free-text references to keys: candidates by rules of falling priority, a date gate, and no guessing among equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve(refs: DataFrame, rules: list[tuple[str, DataFrame]], gate: Column | None = None) -> DataFrame:
    """(ref_id, slug, rule, status) for every row of refs.

    rules: (name, candidates) in order; candidates have ref_id, slug and what
    gate needs. At the first rule that has candidates that pass the gate, one
    distinct slug resolves the reference and several leave it ambiguous; if
    there were candidates and none passed, it is refused_dates.
    """
    parts = [c.select("*", F.lit(i).alias("priority"), F.lit(name).alias("rule"), (F.lit(True) if gate is None else gate).alias("passes")).select("ref_id", "slug", "priority", "rule", "passes") for i, (name, c) in enumerate(rules)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    by_rule = found.groupBy("ref_id", "priority", "rule").agg(F.count_distinct(F.when(F.col("passes"), F.col("slug"))).alias("n"), F.min(F.when(F.col("passes"), F.col("slug"))).alias("one"))
    best = by_rule.groupBy("ref_id").agg(F.min(F.when(F.col("n") > 0, F.struct("priority", "rule", "n", "one"))).alias("b"), F.lit(True).alias("had"))
    out = refs.select("ref_id").join(best, "ref_id", "left")
    status = F.when(F.col("b.n") == 1, "resolved").when(F.col("b.n") > 1, "ambiguous").when(F.col("had"), "refused_dates").otherwise("unresolved")
    return out.select("ref_id", F.when(F.col("b.n") == 1, F.col("b.one")).alias("slug"), F.col("b.rule").alias("rule"), status.alias("status"))


def resolve_by_year(refs: DataFrame, people: DataFrame, rules: list[tuple[str, int | None]], most: int) -> DataFrame:
    """resolve() of refs (ref_id, name, year) by people (slug, name, birth) of the same name; rules: (name, largest gap in years, None for any).

    A gap beyond most doesn't pass. Each distinct name and year is compared with the
    counts of its name's births, so that names that many share don't multiply.
    """
    births = people.groupBy("name", "birth").agg(F.count_distinct("slug").alias("n"), F.min("slug").alias("one"))
    asked = refs.select("name", "year").distinct()
    gap = F.abs(F.col("year") - F.col("birth"))
    counts = []
    for i, (_, widest) in enumerate(rules):
        ok = F.coalesce(gap <= most, F.lit(True)) & (F.lit(True) if widest is None else F.coalesce(gap <= widest, F.lit(False)))
        counts += [F.sum(F.when(ok, F.col("n"))).alias(f"n{i}"), F.min(F.when(ok, F.col("one"))).alias(f"one{i}")]
    found = asked.join(births, "name").groupBy("name", "year").agg(*counts)
    best = F.coalesce(*[F.when(F.col(f"n{i}") > 0, F.struct(F.lit(name).alias("rule"), F.col(f"n{i}").alias("n"), F.col(f"one{i}").alias("one"))) for i, (name, _) in enumerate(rules)])
    found = found.select(F.col("name").alias("_name"), F.col("year").alias("_year"), best.alias("b"), F.lit(True).alias("had"))
    out = refs.join(found, (F.col("name") == F.col("_name")) & F.col("year").eqNullSafe(F.col("_year")), "left")
    status = F.when(F.col("b.n") == 1, "resolved").when(F.col("b.n") > 1, "ambiguous").when(F.col("had"), "refused_dates").otherwise("unresolved")
    return out.select("ref_id", F.when(F.col("b.n") == 1, F.col("b.one")).alias("slug"), F.col("b.rule").alias("rule"), status.alias("status"))


def unique_join(left: DataFrame, right: DataFrame, key: str, take: str) -> DataFrame:
    """left with the right side's `take` where exactly one distinct value has the key, else null."""
    one = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(take).alias(take), F.count_distinct(take).alias("n")).where("n = 1").drop("n")
    return left.join(one, key, "left")


def disambiguated(rows: DataFrame, name: str, key: str, hint: str) -> DataFrame:
    """rows with shown: the name, with (hint) where several rows share it, and -2, -3 … where that doesn't tell them apart."""
    alike = W.partitionBy(F.lower(F.col(name)))
    text = F.when((F.count(F.lit(1)).over(alike) > 1) & F.col(hint).isNotNull(), F.concat(F.col(name), F.lit(" ("), F.col(hint).cast("string"), F.lit(")"))).otherwise(F.col(name))
    rows = rows.withColumn("_text", text)
    n = F.row_number().over(W.partitionBy("_text").orderBy(key))
    return rows.withColumn("shown", F.when(n > 1, F.concat("_text", F.lit("-"), n.cast("string"))).otherwise(F.col("_text"))).drop("_text")


def survivors(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def manifest_keys(refs: DataFrame, key: str, rows: DataFrame, slug: str) -> DataFrame:
    """(key, how, slug): a row's own slug (exact), else the one dated slug with that base (dated); several are ambiguous, none is missing."""
    refs, rows = refs.select(key).distinct(), rows.select(F.col(slug).alias("_slug")).distinct()
    base = F.regexp_extract("_slug", r"^(.*)-\d{4}$", 1)
    dated = rows.select(base.alias("_base"), "_slug").where("_base <> ''").groupBy("_base").agg(F.count("*").alias("_n"), F.min("_slug").alias("_one"))
    out = refs.join(rows, refs[key] == rows["_slug"], "left").join(dated, F.col(key) == F.col("_base"), "left")
    how = F.when(F.col("_slug").isNotNull(), "exact").when(F.col("_n") == 1, "dated").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return out.select(key, how.alias("how"), F.when(how == "exact", F.col("_slug")).when(how == "dated", F.col("_one")).alias("slug"))


def unresolved(refs: DataFrame, ref: str, context: list[str], rows: DataFrame, slug: str) -> DataFrame:
    """(ref, contexts): references that lead to no row, each with where it stands."""
    lost = refs.join(rows.select(F.col(slug).alias(ref)).distinct(), ref, "left_anti").where(F.col(ref).isNotNull())
    return lost.groupBy(ref).agg(F.sort_array(F.collect_set(F.concat_ws(":", *context))).alias("contexts"))


def kept_and_removed(rows: DataFrame, key: str, core: Column, refs: DataFrame, source: str, target: str, listed: DataFrame) -> DataFrame:
    """(key, keep): core rows, the rows that they refer to, and listed ones are kept."""
    inner = rows.where(core).select(key)
    named = refs.join(inner.withColumnRenamed(key, source), source, "left_semi").select(F.col(target).alias(key))
    keep = inner.union(named).union(listed.select(key)).distinct().withColumn("_keep", F.lit(True))
    return rows.select(key).join(keep, key, "left").select(key, F.col("_keep").isNotNull().alias("keep"))


def preferred_rows(rows: DataFrame, keys: list[str], slug: str, place: str) -> DataFrame:
    """One row of each key: the first by place whose slug ends in a year, or the first of all where none does."""
    dated = F.col(slug).rlike(r"-[0-9]{4}$")
    return survivors(rows, keys, [dated.desc(), F.asc(place), F.asc(slug)])


def same_source_survivors(rows: DataFrame, file: str, slug: str, birth: str, generation: str, deceased: str, text: str, unreached: int = 99) -> DataFrame:
    """One row of each source file: with a birth before without, with a real generation, deceased, with the longest text; then by slug. Rows without a file all stay."""
    order = [F.col(birth).isNotNull().desc(), (F.coalesce(F.col(generation), F.lit(unreached)) != unreached).desc(), F.coalesce(F.col(deceased), F.lit(False)).desc(), F.length(F.coalesce(F.col(text), F.lit(""))).desc(), F.asc(slug)]
    return survivors(rows.where(F.col(file).isNotNull()), [file], order).unionByName(rows.where(F.col(file).isNull()))


def repeated_identities(rows: DataFrame) -> DataFrame:
    """(kind, key, slugs) of rows (slug, name, birth, death, parents) that may be one person: root_death, the same slug without its year and the same death but other births; name_years, the same name and years; undated, the same name and the same parents, none of them dated."""
    slugs = F.array_sort(F.collect_set("slug")).alias("slugs")
    row = lambda df, kind: df.where("size(slugs) > 1").select(F.lit(kind).alias("kind"), "key", "slugs")
    root = rows.where("death is not null").groupBy(F.concat_ws("|", F.regexp_replace("slug", r"-[0-9]{4}$", ""), F.col("death").cast("string")).alias("key")).agg(slugs, F.count_distinct("birth").alias("n")).where("n > 1")
    years = rows.where("birth is not null and death is not null").groupBy(F.concat_ws("|", F.lower("name"), F.col("birth").cast("string"), F.col("death").cast("string")).alias("key")).agg(slugs)
    undated = rows.where("birth is null and size(parents) > 0").groupBy(F.concat_ws("|", F.lower("name"), F.array_join(F.array_sort("parents"), ",")).alias("key")).agg(slugs)
    return row(root, "root_death").unionByName(row(years, "name_years")).unionByName(row(undated, "undated"))


def distinct_slugs(rows: DataFrame, bare: str, birth: str, death: str, middle: str, key: str, literal: str = "undated") -> DataFrame:
    """rows with slug: the bare one where it is a row's alone, else with the birth, the death, the middle names or a literal, whichever is there first, and -2, -3 … in the order of key where that still leaves several."""
    several = F.count(F.lit(1)).over(W.partitionBy(bare)) > 1
    more = F.coalesce(F.col(birth).cast("string"), F.col(death).cast("string"), F.nullif(F.regexp_replace(F.lower(F.coalesce(F.col(middle), F.lit(""))), "[^a-z0-9]+", "-"), F.lit("")), F.lit(literal))
    rows = rows.withColumn("_slug", F.when(several, F.concat_ws("-", F.col(bare), more)).otherwise(F.col(bare)))
    n = F.row_number().over(W.partitionBy("_slug").orderBy(key))
    return rows.withColumn("slug", F.when(n > 1, F.concat_ws("-", "_slug", n.cast("string"))).otherwise(F.col("_slug"))).drop("_slug")
