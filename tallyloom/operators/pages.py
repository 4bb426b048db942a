"""Gates over rendered pages, stated years and declarations; no rows mean that a gate passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import issues, united
from .versions import fingerprint

NOINDEX = r'(?i)<meta[^>]*name="robots"[^>]*noindex'
JSON_LD = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'


def anchor_texts(html: Column) -> Column:
    """What a page shows inside links, with a bar between two."""
    return F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), " | ")


def visible(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " ")


def year_hygiene(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Issues of year columns that hold text and not only digits."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_p")
    found = rows.select(F.col(key).alias("_k"), pairs).where(~F.trim("_p.value").rlike(r"^\d*$"))
    return issues(found, "year_not_digits", F.col("_k"), F.concat_ws("=", "_p.field", "_p.value"), "medium")


def self_consistency(rows: DataFrame, key: str, birth: Column, death: Column, age: Column, marriage: Column, parent_death: Column, slack: int = 1, least_marriage_age: int = 12) -> DataFrame:
    """Issues of rows whose stated years contradict one another; unknown years contradict nothing."""
    k = F.col(key)
    return united([
        issues(rows.where(F.abs(death - birth - age) > slack), "age_differs", k, age, "medium"),
        issues(rows.where(parent_death < birth), "parent_died_before_birth", k, parent_death, "high"),
        issues(rows.where(marriage < birth + least_marriage_age), "married_too_young", k, marriage, "medium"),
        issues(rows.where(death < birth), "died_before_birth", k, death, "high"),
    ])


def claimed_lifespans(rows: DataFrame, key: str, name: str, lifespan: str) -> DataFrame:
    """(name, lifespan, keys): one name with one lifespan on more than one page."""
    return rows.where(F.col(lifespan).isNotNull()).groupBy(name, lifespan).agg(F.sort_array(F.collect_set(key)).alias("keys")).where("size(keys) > 1")


def phantom_children(rows: DataFrame, name: Column, father: Column, mother: Column) -> DataFrame:
    """Rows with the mother's surname and not the father's; both must be named, the father by two words at least."""
    last = lambda c: F.element_at(F.split(F.lower(F.trim(c)), r"\s+"), -1)
    return rows.where((last(mother) == last(name)) & (last(father) != last(name)) & (F.size(F.split(F.trim(father), r"\s+")) >= 2))


def redirect_health(stubs: DataFrame, key: str, url: str, html: str, built: DataFrame, built_url: str) -> DataFrame:
    """(key, noindex, canonical, target_known, target_is_stub) of redirect pages at fault."""
    target = F.regexp_extract(html, r'(?i)http-equiv="refresh"[^>]*url=([^"]*)"', 1)
    canonical = F.regexp_extract(html, r'(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1)
    rows = stubs.select(F.col(key).alias(key), F.col(html).rlike(NOINDEX).alias("noindex"), canonical.rlike("^https?://").alias("canonical"), target.alias("_target"))
    rows = rows.join(built.select(F.col(built_url).alias("_built")).distinct(), F.col("_target") == F.col("_built"), "left")
    rows = rows.join(stubs.select(F.col(url).alias("_stub")).distinct(), F.col("_target") == F.col("_stub"), "left")
    rows = rows.select(key, "noindex", "canonical", F.col("_built").isNotNull().alias("target_known"), F.col("_stub").isNotNull().alias("target_is_stub"))
    return rows.where("not (noindex and canonical and target_known) or target_is_stub")


def withheld_leaks(pages: DataFrame, key: str, html: str, is_profile: Column, withheld: DataFrame, name: str, least_words: int = 2, least_chars: int = 7) -> DataFrame:
    """(key, name, linked): withheld names on pages that can be indexed; on a profile page only a linked one counts.

    Pages and names meet on the first word of a name, so no page is held against every name.
    """
    names = withheld.select(F.col(name).alias("name")).distinct().where((F.size(F.split(F.trim("name"), r"\s+")) >= least_words) & (F.length("name") >= least_chars))
    names = names.withColumn("_word", F.split(F.lower(F.trim("name")), r"[^\p{L}]+")[0])
    open_ = pages.where(~F.col(html).rlike(NOINDEX))
    word = F.explode(F.array_distinct(F.split(F.lower(visible(F.col(html))), r"[^\p{L}]+")))
    asked = open_.select(F.col(key).alias("_key"), word.alias("_word")).join(names, "_word").select("_key", "name").distinct()
    # only pages that have a first word meet the names again, this time whole
    rows = open_.select(F.col(key).alias(key), is_profile.alias("_profile"), F.lower(visible(F.col(html))).alias("_text"), F.lower(visible(anchor_texts(F.col(html)))).alias("_anchors"))
    rows = rows.join(asked, rows[key] == asked["_key"])
    rows = rows.where(F.contains("_text", F.lower("name"))).select(key, "name", F.contains("_anchors", F.lower("name")).alias("linked"), "_profile")
    return rows.where("linked or not _profile").drop("_profile")


def rendered_references(refs: DataFrame, pages: DataFrame, key: str, html: str, name: str, status: str) -> DataFrame:
    """refs with a verdict: resolved ones must be links, withheld ones must be there and be none, others are unresolved and no failure."""
    rows = refs.join(pages.select(key, F.col(html).alias("_html")), key, "left")
    there, linked = F.coalesce(F.contains(visible(F.col("_html")), F.col(name)), F.lit(False)), F.coalesce(F.contains(visible(anchor_texts(F.col("_html"))), F.col(name)), F.lit(False))
    verdict = F.when(F.col(status) == "resolved", F.when(linked, "ok").otherwise("not_linked"))
    verdict = verdict.when(F.col(status) == "withheld", F.when(~there, "missing").when(linked, "linked").otherwise("ok")).otherwise("unresolved")
    return rows.withColumn("verdict", verdict).drop("_html")


def stale_stamps(pages: DataFrame, url: str, html: str, sitemap: DataFrame, loc: str, lastmod: str) -> DataFrame:
    """(url, stated, lastmod): pages whose structured data states another day than the sitemap, or none."""
    stated = F.substring(F.get_json_object(F.regexp_extract(html, JSON_LD, 1), "$.dateModified"), 1, 10).alias("stated")
    rows = pages.select(F.col(url).alias("url"), stated).join(sitemap.select(F.col(loc).alias("url"), F.date_format(lastmod, "yyyy-MM-dd").alias("lastmod")), "url")
    return rows.where(~F.col("stated").eqNullSafe(F.col("lastmod")))


def over_budget(rows: DataFrame, key: str, text: str, most: int = 160) -> DataFrame:
    """(key, length): descriptions that are too long once the five XML entities are decoded."""
    decoded = F.col(text)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return rows.select(key, F.length(decoded).cast("long").alias("length")).where(F.col("length") > most)


def heading_order(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, h1, h2): pages without an h1, or with an h2 before it; places count from 1, 0 is none."""
    at = lambda tag: F.regexp_instr(html, F.lit(rf"(?i)<{tag}[\s>]"))
    return pages.select(key, at("h1").alias("h1"), at("h2").alias("h2")).where("h1 = 0 or (h2 > 0 and h2 < h1)")


def undeclared_photos(expected: DataFrame, observed: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """(columns, missing): expected rows, and which of the observed sets lack them."""
    rows = expected.select(*columns).distinct()
    for name, seen in observed.items():
        rows = rows.join(seen.select(*columns).distinct().withColumn(f"_{name}", F.lit(True)), columns, "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), F.lit(n)) for n in observed]))
    return rows.select(*columns, missing.alias("missing")).where("size(missing) > 0")


def missing_evidence(rows: DataFrame, changed: DataFrame, key: str, level: Column, single_source: Column, source: Column, provisional: Column, receipts: list[Column]) -> DataFrame:
    """Changed rows without a level and without a named single source, or provisional without all receipts."""
    given = lambda c: F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))
    stamped = given(level) | (F.coalesce(single_source, F.lit(False)) & given(source))
    complete = ~F.coalesce(provisional, F.lit(False))
    whole = F.lit(True)
    for c in receipts:
        whole = whole & given(c)
    return rows.join(changed.select(key).distinct(), key, "left_semi").where(~(stamped & (complete | whole)))


def snapshot_state(snapshot: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row (state): missing, stale or fresh, by the fingerprints of both, whatever their order of rows."""
    one = lambda df, of: df.select(*sorted(fresh.columns)).transform(lambda d: d.agg(fingerprint(d).alias("f"), F.count("*").alias("n"))).withColumn("of", F.lit(of))
    both = one(snapshot, "snapshot").union(one(fresh, "fresh"))
    seen = F.max(F.when(F.col("of") == "snapshot", F.col("n")))
    same = (F.count_distinct("n") == 1) & (F.min("f").eqNullSafe(F.max("f")))
    return both.agg(F.when(seen == 0, "missing").when(same, "fresh").otherwise("stale").alias("state"))


def lifespan_drift(notes: DataFrame, key: str, title: Column, text: Column, name: Column) -> DataFrame:
    """(key, stated, said): a page whose text gives its own name another lifespan than its title does."""
    span = r"\(([0-9]{4})\s*[–-]\s*([0-9]{4})\)"
    own = F.regexp_extract(title, span, 0)
    quoted = F.regexp_extract_all(text, F.concat(F.lit(r"\Q"), name, F.lit(r"\E\s*(\([0-9]{4}\s*[–-]\s*[0-9]{4}\))")), F.lit(1))
    plain = lambda c: F.regexp_replace(c, r"[^0-9]+", "-")
    rows = notes.select(key, own.alias("stated"), F.explode(F.array_distinct(quoted)).alias("said"))
    return rows.where((F.col("stated") != "") & (plain("stated") != plain("said")))


def child_lists(notes: DataFrame, key: str, listed: Column, told: Column) -> DataFrame:
    """(key, only_listed, only_told): pages whose table and prose name other children, by lower-cased name."""
    low = lambda c: F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x))))
    rows = notes.select(key, F.array_sort(F.array_except(low(listed), low(told))).alias("only_listed"), F.array_sort(F.array_except(low(told), low(listed))).alias("only_told"))
    return rows.where("size(only_listed) > 0 or size(only_told) > 0")


def announced_and_built(announced: DataFrame, built: DataFrame, key: str) -> DataFrame:
    """(key, missing): what was announced and isn't built, and what is built unannounced."""
    a, b = announced.select(key).distinct().withColumn("_a", F.lit(True)), built.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full").where("_a is null or _b is null")
    return both.select(key, F.when(F.col("_b").isNull(), "built").otherwise("announced").alias("missing"))
