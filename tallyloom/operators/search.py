"""Ranked search over names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier(name: Column, query: str, most_edits: int = 2) -> Column:
    """0: the name starts with the query; 1: a word of it does; 2: it contains it; 3: a word is within most_edits; null: no match."""
    low, q = F.lower(name), query.lower()
    close = F.exists(F.split(low, " "), lambda w: F.levenshtein(w, F.lit(q), most_edits) >= 0)
    return F.when(low.startswith(q), 0).when(F.exists(F.split(low, " "), lambda w: w.startswith(q)), 1).when(low.contains(q), 2).when(close, 3)


def search(rows: DataFrame, name: str, query: str, most: int = 60, key: str | None = None) -> DataFrame:
    """The best `most` rows with tier, by tier, length and name; a query of less than two characters keeps all in order of name."""
    last = [F.col(key)] if key else []
    if len(query) < 2:
        return rows.withColumn("tier", F.lit(0)).orderBy(name, *last).limit(most)
    return rows.withColumn("tier", tier(F.col(name), query)).where("tier is not null").orderBy("tier", F.length(name), name, *last).limit(most)


def ranked(rows: DataFrame, name: str, query: str, lineage: Column, key: str, most: int = 60, most_edits: int = 2) -> DataFrame:
    """The best `most` rows with tier: by tier, then those of the lineage, then by the place of the word that the query begins (surnames come last, so a later word counts first), length, name and key."""
    words = F.split(F.lower(F.col(name)), " ")
    place = F.size(words) - F.array_position(F.transform(words, lambda w: w.startswith(query.lower())), True)
    out = rows.withColumn("tier", tier(F.col(name), query, most_edits)).where("tier is not null")
    return out.withColumn("_line", F.when(F.coalesce(lineage, F.lit(False)), 0).otherwise(1)).withColumn("_place", place).orderBy("tier", "_line", "_place", F.length(name), name, key).limit(most).drop("_line", "_place")
