"""References to persons by a cascade of rules; what several persons fit equally well stays unresolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D

#: References that stand for nobody.
PLACEHOLDERS = ("", "?", "???", "none", "none (never married)", "unknown")
#: Words that are no names.
TITLES = ("of", "the", "né", "née", "mrs", "mr", "dr")
#: The largest gap of a birth that is near a stated one; ages at which people marry.
NEAR, MARRY_FROM, MARRY_TO = 2, 12, 70
#: Limits of the choice among namesakes: a parent is so much older, a spouse within the first gap or else the second.
PARENT_LEAST, SPOUSE_NEAR, SPOUSE_FAR = 12, 30, 50
RULES = ("slug", "qualified", "lifespan", "birth_year", "near_birth_year", "annotation", "name", "stated_year", "best", "first_last")


def _words(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"\s+"), lambda w: (w != "") & ~w.isin(*TITLES))


def features(refs: DataFrame) -> DataFrame:
    """refs (ref_id, ref, relation, subject, subject_birth, subject_death) with what the rules compare."""
    clean = F.trim("ref")
    rows = refs.withColumn("clean", clean).withColumn("years", D.ref_years(F.col("clean"))).withColumn("bare", F.lower(D.bare_name(F.regexp_replace("clean", r"(?i)\(n[ée]e [^)]*\)", " "))))
    words = _words(F.col("bare"))
    return rows.select("ref_id", "clean", "relation", "subject", "subject_birth", "subject_death", "bare", F.lower("clean").alias("low"), "years.birth", "years.death", "years.marriage",
        (D.bare_name(F.col("clean")) != F.col("clean")).alias("annotated"), (D.without_lifespan(F.col("clean")) == F.col("clean")).alias("undated_brackets"),
        F.col("clean").rlike(r"(?i)no[- ]profile|do not link").alias("no_profile"), (F.col("clean").isNull() | F.lower("clean").isin(*PLACEHOLDERS)).alias("nobody"),
        F.when(F.size(words) >= 2, F.concat_ws(" ", F.get(words, F.lit(0)), F.element_at(words, -1))).alias("first_last"))


def name_index(people: DataFrame) -> DataFrame:
    """(key, birth, death, n, one): how many persons with the same dates a name has, with and without the middle name, and the least slug."""
    name = lambda *parts: F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " ")))
    keys = F.array_distinct(F.array(name("first_name", "last_name"), name("first_name", "middle_name", "last_name")))
    return people.select(F.explode(keys).alias("key"), "slug", "birth", "death").groupBy("key", "birth", "death").agg(F.count_distinct("slug").alias("n"), F.min("slug").alias("one"))


def only(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """(key, slug) of keys that one slug has."""
    return rows.select(key.alias("_key"), "slug").where("_key is not null").groupBy("_key").agg(F.count_distinct("slug").alias("n"), F.min("slug").alias(name)).where("n = 1").drop("n")


def _chosen(asked: DataFrame, index: DataFrame, key: str, gated: bool) -> DataFrame:
    """Per ref that has namesakes under key: how many there are of each sort and, where it is one, its slug."""
    rows = asked.where(F.col(key).isNotNull()).select("ref_id", key, "relation", "subject_birth", "subject_death", F.col("birth").alias("said"), "marriage").join(index.withColumnRenamed("key", key), key)
    fits = D.plausible(F.col("relation"), F.col("subject_birth"), F.col("subject_death"), F.col("birth"), F.col("death"), D.GATES["shared"]) if gated else F.lit(True)
    age = F.col("marriage") - F.col("birth")
    rows = rows.withColumn("fits", fits & F.coalesce(age.between(MARRY_FROM, MARRY_TO), F.lit(True)))
    gap = F.col("subject_birth") - F.col("birth")
    best = F.when(F.col("relation") == "parent", F.coalesce(gap >= PARENT_LEAST, F.lit(True))).when(F.col("relation") == "child", F.coalesce(gap < 0, F.lit(True))).when(F.col("relation") == "spouse", F.coalesce(F.abs(gap) <= SPOUSE_NEAR, F.lit(True))).otherwise(F.lit(False))
    far = (F.col("relation") == "spouse") & F.coalesce(F.abs(gap) <= SPOUSE_FAR, F.lit(True))
    rows = rows.withColumn("best", F.col("fits") & best & F.col("subject_birth").isNotNull()).withColumn("far", F.col("fits") & far & F.col("subject_birth").isNotNull())
    sorts = {"all": F.lit(True), "undated": F.col("birth").isNull(), "same": F.col("birth") == F.col("said"), "near": F.abs(F.col("birth") - F.col("said")) <= NEAR, "fit": F.col("fits"), "fit_same": F.col("fits") & (F.col("birth") == F.col("said")), "best": F.col("best"), "far": F.col("far")}
    each = lambda s, c: [F.sum(F.when(c, F.col("n"))).alias(f"n_{s}"), F.min(F.when(c, F.col("one"))).alias(f"one_{s}")]
    # a birth year at a time first, so that the nearest year can be told from its equals
    by_year = rows.groupBy("ref_id", "relation", "said", "birth").agg(*[x for s, c in sorts.items() for x in each(s, c)])
    sums = [x for s in sorts for x in (F.sum(f"n_{s}").alias(f"n_{s}"), F.min(f"one_{s}").alias(f"one_{s}"))]
    dated = F.when(F.col("birth").isNotNull() & F.col("n_best").isNotNull(), F.struct(F.when(F.col("relation") == "parent", -F.col("birth")).otherwise(F.col("birth")).alias("y"), F.col("n_best").alias("n"), F.col("one_best").alias("one")))
    out = by_year.groupBy("ref_id").agg(*sums, F.min(dated).alias("nearest"), F.min(F.when(F.col("n_fit") > 0, F.abs(F.col("birth") - F.col("said")))).alias("drift"))
    one = lambda s: F.when(F.col(f"n_{s}") == 1, F.col(f"one_{s}"))
    kin = F.col("nearest.n") == 1
    return out.select("ref_id", *[F.coalesce(f"n_{s}", F.lit(0)).alias(f"{key}_{s}") for s in sorts], *[one(s).alias(f"{key}_one_{s}") for s in sorts], F.when(kin, F.col("nearest.one")).alias(f"{key}_nearest"), F.col("drift").alias(f"{key}_drift"))


def resolved(refs: DataFrame, people: DataFrame) -> DataFrame:
    """(ref_id, slug, rule, status) for every row of refs (ref_id, ref, relation, subject, subject_birth, subject_death).

    people: slug, first_name, middle_name, last_name, display, birth, death. The
    rules, in order: the reference is a slug; it is a display name with a
    qualifier that one person has; name and lifespan are one person's; one of the
    namesakes is born in the stated year, or within two of it; a bracket without
    dates means the one namesake, or the one undated namesake; one namesake fits
    the subject's dates; one that fits is born in the stated year; one is nearest
    by relation; the same for first and last name alone. status: resolved,
    ambiguous, unresolved, refused_dates, no_profile, placeholder, or self where
    a reference leads back to its subject.
    """
    rows = features(refs)
    slugs = people.select(F.col("slug").alias("_slug")).distinct()
    display = F.lower(F.trim("display"))
    qualified = only(people.where(~F.col("display").rlike(r"\(~?[0-9]{3,4}\s*[–-]?[^)]*\)\s*$")), display, "by_display")
    span = lambda birth, death: F.concat(birth.cast("string"), F.lit("–"), F.coalesce(death.cast("string"), F.lit("?")))
    name = F.lower(D.bare_name(F.col("display")))
    dated = only(people.where("birth is not null"), F.concat(name, F.lit("|"), span(F.col("birth"), F.col("death"))), "by_span")
    index = name_index(people)
    rows = rows.join(slugs, rows.clean == slugs["_slug"], "left")
    rows = rows.join(qualified, (rows.low == qualified["_key"]) & rows.undated_brackets & rows.annotated, "left").drop("_key")
    rows = rows.withColumn("_span", F.when(F.col("birth").isNotNull(), F.concat("bare", F.lit("|"), span(F.col("birth"), F.col("death")))))
    rows = rows.join(dated, F.col("_span") == dated["_key"], "left").drop("_key")
    rows = rows.join(_chosen(rows, index, "bare", True), "ref_id", "left")
    rows = rows.join(_chosen(rows.withColumn("first_last", F.when(F.col("first_last") != F.col("bare"), F.col("first_last"))), index, "first_last", False), "ref_id", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    off = F.col("relation").isin("parent", "child") & (F.col("bare_drift") > NEAR)
    refused = (F.col("bare_one_fit").isNotNull() & F.coalesce(off, F.lit(False))) | (has("bare_all") & ~has("bare_fit"))
    free = ~F.col("nobody")
    undated = F.col("birth").isNull() & F.col("marriage").isNull() & F.col("annotated")
    best = lambda key: F.coalesce(F.when(F.col(f"{key}_best") == 1, F.col(f"{key}_one_best")), F.when(F.col("relation").isin("parent", "child"), F.col(f"{key}_nearest")), F.when((F.col(f"{key}_best") == 0) & (F.col(f"{key}_far") == 1), F.col(f"{key}_one_far")))
    tries = [
        ("slug", F.col("_slug")),
        ("qualified", F.col("by_display")),
        ("lifespan", F.col("by_span")),
        ("birth_year", F.col("bare_one_same")),
        ("near_birth_year", F.when(~has("bare_same"), F.col("bare_one_near"))),
        ("annotation", F.when(undated, F.coalesce(F.col("bare_one_all"), F.col("bare_one_undated")))),
        ("name", F.when(~refused & ~F.col("no_profile"), F.col("bare_one_fit"))),
        ("stated_year", F.col("bare_one_fit_same")),
        ("best", F.when(F.col("bare_fit") > 1, best("bare"))),
        ("first_last", F.when(~has("bare_all"), F.coalesce(F.col("first_last_one_same"), F.when(F.col("first_last_fit") == 1, F.col("first_last_one_fit")), best("first_last")))),
    ]
    hit = F.coalesce(*[F.when(free & slug.isNotNull(), F.struct(F.lit(rule).alias("rule"), slug.alias("slug"))) for rule, slug in tries])
    out = rows.select("ref_id", "subject", "nobody", "no_profile", refused.alias("refused"), (has("bare_fit") | has("first_last_fit")).alias("several"), F.coalesce("bare_fit", F.lit(0)).alias("fit"), hit.alias("hit"))
    back = F.coalesce(F.col("hit.slug") == F.col("subject"), F.lit(False))
    status = F.when(F.col("nobody"), "placeholder").when(back, "self").when(F.col("hit").isNotNull(), "resolved").when(F.col("no_profile") & (F.col("fit") == 1), "no_profile").when(F.col("refused"), "refused_dates").when(F.col("several"), "ambiguous").otherwise("unresolved")
    return out.select("ref_id", F.when(~back, F.col("hit.slug")).alias("slug"), F.col("hit.rule").alias("rule"), status.alias("status"))
