"""Old and new versions of a table, floors, and state that advances by runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, changed): added, removed or changed rows and the names of the columns that differ."""
    o = old.select(F.col(key).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    n = new.select(F.col(key).alias("_n"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = o.join(n, F.col("_o") == F.col("_n"), "full_outer")
    names = F.array_compact(F.array(*[F.when(~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.size(names) > 0, "changed")
    return both.select(F.coalesce("_o", "_n").alias(key), change.alias("change"), F.when(change == "changed", names).otherwise(F.array().cast("array<string>")).alias("changed")).where("change is not null")


def losses(old: DataFrame, new: DataFrame, key: str, column: str, declared: DataFrame | None = None) -> DataFrame:
    """(key, lost): entries of an array column that the new version lacks, unless the key is declared."""
    o, n = old.select(key, F.col(column).alias("_o")), new.select(key, F.col(column).alias("_n"))
    out = o.join(n, key, "left").select(key, F.array_sort(F.array_except("_o", F.coalesce("_n", F.array().cast(old.schema[column].dataType)))).alias("lost")).where(F.size("lost") > 0)
    return out if declared is None else out.join(declared.select(key), key, "left_anti")


def delta(current: DataFrame, state: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows of current that are new or have another stamp than the state has."""
    s = state.select(key, F.col(stamp).alias("_was"))
    return current.join(s, key, "left").where(~F.col("_was").eqNullSafe(F.col(stamp)) | F.col("_was").isNull()).drop("_was")


def advanced(state: DataFrame, accepted: DataFrame, key: str, stamp: str) -> DataFrame:
    """The state after a run whose rows were accepted."""
    a = accepted.select(key, F.col(stamp).alias("_now"))
    return state.join(a, key, "full_outer").select(key, F.coalesce("_now", stamp).alias(stamp))


def ratchet(metrics: DataFrame, floors: DataFrame, key: str, slack_share: float = 0.0, slack_least: int = 0) -> DataFrame:
    """(key, value, floor, ok): a value may fall short by slack_share of its floor or slack_least, whichever is more; a missing value is 0."""
    both = floors.select(key, F.col("value").alias("floor")).join(metrics.select(key, "value"), key, "left")
    value = F.coalesce("value", F.lit(0))
    return both.select(key, value.alias("value"), "floor", (F.col("floor") - value <= F.greatest(F.lit(slack_least), F.col("floor") * slack_share)).alias("ok"))


def fingerprint(df: DataFrame) -> Column:
    """An aggregate that tells versions apart, whatever the order of rows."""
    return F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))


def drift(snapshot: DataFrame, live: DataFrame, key: str, content: str) -> DataFrame:
    """(key, state): missing from the snapshot, differing from it, or stale, as only the snapshot has it."""
    old = snapshot.select(key, F.col(content).alias("_old"), F.lit(True).alias("_in_old"))
    new = live.select(key, F.col(content).alias("_new"), F.lit(True).alias("_in_new"))
    state = F.when(F.col("_in_old").isNull(), "missing").when(F.col("_in_new").isNull(), "stale").when(~F.col("_old").eqNullSafe(F.col("_new")), "differing")
    return old.join(new, key, "full").select(key, state.alias("state")).where("state is not null")


def transitions(old: DataFrame, new: DataFrame, key: str, column: str, before: list, after: list) -> DataFrame:
    """(key, was, now): rows of both versions whose column went from one of before to one of after."""
    both = old.select(key, F.col(column).alias("was")).join(new.select(key, F.col(column).alias("now")), key)
    return both.where(F.col("was").isin(before) & F.col("now").isin(after))


def gone_or_short(old: DataFrame, new: DataFrame, key: str, arrays: list[str], declared: DataFrame, renames: DataFrame, least: DataFrame) -> DataFrame:
    """Issues (key, issue, column, entries): vanished rows, arrays that lost entries and arrays below a minimum.

    declared: key; such rows may vanish and lose. renames: from, to, already
    followed to their ends; a row is compared with what it has become. least:
    key, column, n.
    """
    r = renames.select(F.col("from").alias("_from"), F.col("to").alias("_to"))
    was = old.join(r, old[key] == r["_from"], "left").withColumn("_now", F.coalesce("_to", key)).drop("_from", "_to")
    was = was.join(declared.select(key), key, "left_anti")
    now = new.select(F.col(key).alias("_now"), *[F.col(a).alias(f"_new_{a}") for a in arrays], F.lit(True).alias("_there"))
    both = was.join(now, "_now", "left")
    none = F.array().cast("array<string>")
    row = lambda df, issue, column, entries: df.select(F.col(key), F.lit(issue).alias("issue"), F.lit(column).alias("column"), entries.alias("entries"))
    out = row(both.where("_there is null"), "vanished", "", none)
    for a in arrays:
        lost = F.array_sort(F.array_except(F.col(a).cast("array<string>"), F.coalesce(F.col(f"_new_{a}").cast("array<string>"), none)))
        out = out.unionByName(row(both.where("_there").withColumn("_lost", lost).where("size(_lost) > 0"), "shrank", a, F.col("_lost")))
        floor = least.where(F.col("column") == a).select(F.col(key).alias("_k"), "n")
        short = new.join(floor, new[key] == floor["_k"]).where(F.size(F.array_distinct(F.coalesce(F.col(a).cast("array<string>"), none))) < F.col("n"))
        out = out.unionByName(row(short, "below_minimum", a, none))
    return out
