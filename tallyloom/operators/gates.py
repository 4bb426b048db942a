"""Quality gates: each gives issues (gate, key, detail, severity); none means that it passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(rows: DataFrame, gate: str, key: Column, detail: Column, severity: str) -> DataFrame:
    return rows.select(F.lit(gate).alias("gate"), key.cast("string").alias("key"), detail.cast("string").alias("detail"), F.lit(severity).alias("severity"))


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def score(found: DataFrame) -> DataFrame:
    """One row: counts by severity and a score of 10 less 2, 0.5 and 0.05 for each, from 0 to 10."""
    n = lambda s: F.count_if(F.col("severity") == s)
    out = found.agg(n("high").alias("n_high"), n("medium").alias("n_medium"), n("low").alias("n_low"))
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.round(F.lit(10.0) - 2 * F.col("n_high") - 0.5 * F.col("n_medium") - 0.05 * F.col("n_low"), 2))))


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """df; an empty input is an error and not a pass."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def at_least(df: DataFrame, n: int, what: str) -> DataFrame:
    """df; fewer than n rows are an error, as a gate that sees too little proves nothing."""
    if df.limit(n).count() < n:
        raise ValueError(f"{what} has fewer than {n} rows")
    return df


def shell_duplicates(rows: DataFrame, key: str, undated: Column) -> DataFrame:
    """(key, n, n_undated): keys of which some rows are dated and some aren't."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(undated).alias("n_undated")).where("n_undated between 1 and n - 1")


def first_hits(rows: DataFrame, key: str, text: str, rules: list[tuple[str, str]], allowed: str | None = None) -> DataFrame:
    """(key, line, rule): the first rule, in order, that each line of text meets; lines that match allowed are skipped."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("_at", "_line"))
    rule = F.coalesce(*[F.when(F.col("_line").rlike(pattern), F.lit(name)) for name, pattern in rules])
    if allowed:
        lines = lines.where(~F.col("_line").rlike(allowed))
    return lines.select(key, (F.col("_at") + 1).cast("long").alias("line"), rule.alias("rule")).where("rule is not null")


def undeclared(versions: DataFrame, key: str, version: str, served: DataFrame, declared: DataFrame) -> DataFrame:
    """(key, first_version): keys of earlier versions that are neither served nor declared."""
    gone = versions.join(served.select(key), key, "left_anti").join(declared.select(key), key, "left_anti")
    return gone.groupBy(key).agg(F.min(version).alias("first_version"))


def vital_status(rows: DataFrame, key: Column, is_living: Column, death_year: Column, lifespan: Column) -> DataFrame:
    """Issues of rows whose labels and dates disagree: living with a death year, living with a closed lifespan, deceased without either and open."""
    closed = lifespan.rlike(r"^\d{4}\s*[–-]\s*\d{4}$")
    return united([
        issues(rows.where(is_living & death_year.isNotNull()), "living_with_death_year", key, death_year, "high"),
        issues(rows.where(is_living & closed), "living_with_closed_lifespan", key, lifespan, "high"),
        issues(rows.where(~is_living & lifespan.startswith("b. ") & death_year.isNull()), "deceased_shown_as_living", key, lifespan, "medium"),
    ])


def quoted_urls(rows: DataFrame, key: str, text: str, known: DataFrame, known_url: str) -> DataFrame:
    """(key, url, canonical, known): the URLs that text quotes; canonical: https, without query or fragment."""
    urls = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[^\s)>\"]+"), F.lit(0)))).alias("url"))
    target = known.select(F.col(known_url).alias("_known")).distinct()
    found = urls.join(target, urls.url == F.col("_known"), "left")
    return found.select(key, "url", F.col("url").rlike(r"^https://[a-z0-9.-]+/[^?#]*$").alias("canonical"), F.col("_known").isNotNull().alias("known"))


#: Checks of which a single issue is fatal.
CRITICAL = ("repeated_slug", "repeated_id", "suspect_year", "self_reference", "two_cycle", "impossible_parent")


def validation(rows: DataFrame, edges: DataFrame, least: int = 1500, most: int = 2030) -> DataFrame:
    """Issues of rows (slug, id, name, birth, death) and edges (kind, src, dst), high for the critical ones: repeated slugs, ids, and names with a birth; suspect years; references to oneself; parents of one's parents; parents born after their child; claims that aren't returned."""
    named = lambda df, gate, key, detail: issues(df, gate, key, detail, "high" if gate in CRITICAL else "low")
    repeated = lambda gate, key: named(rows.where(key.isNotNull()).groupBy(key.cast("string").alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1"), gate, F.col("_k"), F.col("_n"))
    odd = lambda y: (F.col(y) < least) | (F.col(y) > most)
    p = edges.where("kind = 'parent'").select("src", "dst").distinct()
    born = lambda name: rows.select(F.col("slug").alias(name), F.col("birth").alias(f"_{name}"))
    dated = p.join(born("src"), "src").join(born("dst"), "dst")
    back = edges.where("kind = 'child'").select(F.col("src").alias("dst"), F.col("dst").alias("src")).distinct()
    return united([
        repeated("repeated_slug", F.col("slug")), repeated("repeated_id", F.col("id")),
        repeated("repeated_name", F.when(F.col("birth").isNotNull(), F.concat_ws("|", F.lower("name"), F.col("birth").cast("string")))),
        named(rows.where(odd("birth") | odd("death") | (F.col("death") < F.col("birth"))), "suspect_year", F.col("slug"), F.concat_ws("–", F.col("birth").cast("string"), F.col("death").cast("string"))),
        named(edges.where("src = dst"), "self_reference", F.col("src"), F.col("kind")),
        named(p.join(p.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").where("src < dst"), "two_cycle", F.col("src"), F.col("dst")),
        named(dated.where("_dst >= _src"), "impossible_parent", F.col("src"), F.col("dst")),
        named(p.join(back, ["src", "dst"], "left_anti"), "not_returned", F.col("src"), F.col("dst")),
    ])


def should_link(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """refs (src, ref) that are no slug of rows (slug, name) though exactly one row has that name: (src, ref, slug)."""
    low = lambda c: F.lower(F.trim(c))
    free = refs.join(rows.select(F.col("slug").alias("ref")), "ref", "left_anti")
    one = rows.groupBy(low("name").alias("_k")).agg(F.count_distinct("slug").alias("_n"), F.min("slug").alias("slug")).where("_n = 1")
    return free.join(one, low(free.ref) == F.col("_k")).where("src <> slug").select("src", "ref", "slug")


def wrong_redirects(redirects: DataFrame, rows: DataFrame) -> DataFrame:
    """redirects (from, to) whose ends share no first and no last name word, so that they lead to somebody else."""
    words = lambda c: F.split(F.regexp_replace(c, r"-[0-9]{4}$", ""), "-")
    known = redirects.join(rows.select(F.col("slug").alias("to")), "to", "left_semi")
    a, b = words("from"), words("to")
    return known.where((F.get(a, F.lit(0)) != F.get(b, F.lit(0))) & (F.element_at(a, -1) != F.element_at(b, -1))).select("from", "to")


def canaries(found: DataFrame, key: str, value: str, expected: DataFrame) -> DataFrame:
    """(key, expected, found) of the cases in expected (key, value) that came out otherwise; null means that nothing may be found."""
    e = expected.select(key, F.col(value).alias("expected"))
    return e.join(found.select(key, F.col(value).alias("found")), key, "left").where(~F.col("expected").eqNullSafe(F.col("found")))
