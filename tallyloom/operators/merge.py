"""Merging a new version of rows into an old one: who is who, which value wins, which keys can be repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut


def identity_cascade(old: DataFrame, new: DataFrame, old_id: str, new_id: str, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """(rule, old_id, new_id): rules name columns that both have; the first that a pair meets decides.

    A rule matches rows that no earlier one has matched, and only where its
    columns tell one row on either side; a null in them matches nothing.
    """
    parts = []
    for rule, columns in rules:

        def single(rows: DataFrame, row_id: str, columns: list[str] = columns) -> DataFrame:
            return rows.dropna(subset=columns).groupBy(columns).agg(F.min(row_id).alias(row_id), F.count("*").alias("_n")).where("_n = 1").drop("_n")

        found = cut(single(old, old_id).join(single(new, new_id), columns).select(F.lit(rule).alias("rule"), old_id, new_id))
        parts.append(found)
        old = old.join(found.select(old_id), old_id, "left_anti")
        new = new.join(found.select(new_id), new_id, "left_anti")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str, policies: dict[str, str]) -> DataFrame:
    """Rows of both by key. For each column "overwrite" takes the new row's value, "keep" the old row's, "fill" the new one unless it is null or empty."""
    o = old.select(F.col(key).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in policies])
    n = new.select(F.col(key).alias("_n"), *[F.col(c).alias(f"_n_{c}") for c in policies])

    def value(c: str, policy: str):
        was, now = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if policy == "overwrite":
            return F.when(F.col("_n").isNotNull(), now).otherwise(was)
        if policy == "keep":
            return F.when(F.col("_o").isNotNull(), was).otherwise(now)
        if policy == "fill":
            return F.when(now.isNull() | (now.cast("string") == ""), F.coalesce(was, now)).otherwise(now)
        raise ValueError(f"no policy {policy}")

    return o.join(n, F.col("_o") == F.col("_n"), "full_outer").select(F.coalesce("_o", "_n").alias(key), *[value(c, p).alias(c) for c, p in policies.items()])


def repaired_slugs(refs: DataFrame, slug: str, known: DataFrame, known_slug: str) -> DataFrame:
    """(slug, repaired): for base-YYYYYYYY the first known one of base-Y1, base-Y2, base-Y1-Y2, base, first-last; null if none is."""
    shape = r"^(.+)-(\d{4})(\d{4})$"
    part = lambda i: F.regexp_extract(slug, shape, i)
    base, born, died = part(1), part(2), part(3)
    names = F.split(base, "-")
    tries = F.array(F.concat_ws("-", base, born), F.concat_ws("-", base, died), F.concat_ws("-", base, born, died), base, F.concat_ws("-", F.get(names, F.lit(0)), F.get(names, F.size(names) - 1)))
    bad = refs.where(F.col(slug).rlike(shape)).select(slug).distinct()
    tried = bad.select(slug, F.posexplode(tries).alias("priority", "candidate"))
    hits = tried.join(known.select(F.col(known_slug).alias("candidate")).distinct(), "candidate", "left_semi")
    best = hits.groupBy(slug).agg(F.min_by("candidate", "priority").alias("repaired"))
    return bad.join(best, slug, "left")
