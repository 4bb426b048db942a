"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

#: Far beyond the logarithm of any number of nodes.
MOST_ROUNDS = 60


#: Tasks that share the rows of one node in a join.
SALTS = 8


def spread(rows: DataFrame, of: str, values: DataFrame, key: str) -> DataFrame:
    """rows joined with values, of which each key has one row, on key; the rows of one key are dealt over SALTS tasks by column of, and its value is copied for each."""
    salted = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.hash(of), F.lit(SALTS))).join(salted, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u long, v long); component is the least node that can be reached.

    Null ends, loops and repeated edges count for nothing. A node's neighbours
    are only ever reduced to their minimum, which is combined before the
    shuffle; in the joins that hang neighbours on the minimum a hub's rows are
    dealt over SALTS tasks, and beyond that the join's skew handling splits them.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = written(e, "edges"), None
    for _ in range(MOST_ROUNDS):
        # large-star: every larger neighbour of u is hung on the least of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread(both.where("v > u"), "v", least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: u and its smaller neighbours are hung on the least of them
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread(large, "v", least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e, last = written(small.where("u <> v").distinct(), "edges"), e
        drop(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
