"""Edges of a property graph, and walks over them. Loops end by themselves or at a stated depth; each round is cut off by checkpoint()."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, in the folder that spark.checkpoint.dir names."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return df.checkpoint()


def edges_from_arrays(rows: DataFrame, key: str, arrays: dict[str, str]) -> DataFrame:
    """(kind, src, dst) from array columns; arrays: column to kind."""
    parts = [rows.select(F.lit(kind).alias("kind"), F.col(key).alias("src"), F.explode(column).alias("dst")) for column, kind in arrays.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, the lesser end first, without loops."""
    return edges.where("src <> dst").select("kind", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def dangling(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("end")).distinct()
    return ends.join(nodes.select(F.col(key).alias("end")), "end", "left_anti")


def one_way(edges: DataFrame, kind: str, inverse: str) -> DataFrame:
    """Edges of kind whose other end doesn't say the inverse."""
    back = edges.where(F.col("kind") == inverse).select(F.col("src").alias("b"), F.col("dst").alias("a"))
    own = edges.where(F.col("kind") == kind)
    return own.join(back, (own.src == back.a) & (own.dst == back.b), "left_anti")


def two_cycles(parents: DataFrame) -> DataFrame:
    a, b = parents.select("child", "parent"), parents.select(F.col("child").alias("c2"), F.col("parent").alias("p2"))
    return a.join(b, (a.child == b.p2) & (a.parent == b.c2)).where("child < parent").select("child", "parent")


def siblings(parents: DataFrame, least: int = 2) -> DataFrame:
    """Pairs (a < b) with the same parents, at least so many."""
    sets = parents.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("all")).where(F.size("all") >= least)
    x, y = sets.select(F.col("child").alias("a"), "all"), sets.select(F.col("child").alias("b"), "all")
    return x.join(y, "all").where("a < b").select("a", "b")


def sibling_groups(parents: DataFrame, least: int = 2) -> DataFrame:
    """(group, child): children with the same parents, at least so many, under the hash of these; a row for each child, however large the group."""
    sets = parents.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("all")).where(F.size("all") >= least)
    return sets.select(F.sha2(F.array_join(F.transform("all", lambda x: x.cast("string")), ",").cast("binary"), 256).alias("group"), "child")


def over_cap(parents: DataFrame, most: int = 2) -> DataFrame:
    return parents.groupBy("child").agg(F.count_distinct("parent").alias("n_parents")).where(F.col("n_parents") > most)


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """(src, dst, hops): the least number of hops, up to depth; rounds that reach nothing new end it, so cycles do no harm."""
    frontier = cut(edges.select("src", "dst").distinct().withColumn("hops", F.lit(1)))
    seen, steps = frontier, edges.select(F.col("src").alias("mid"), F.col("dst").alias("next")).distinct()
    for hop in range(2, depth + 1):
        found = frontier.join(steps, frontier.dst == steps.mid).select("src", F.col("next").alias("dst")).distinct().join(seen, ["src", "dst"], "left_anti")
        frontier = cut(found.withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def generations(nodes: DataFrame, key: str, parents: DataFrame, spouses: DataFrame, roots: DataFrame, most: int = 10_000) -> DataFrame:
    """(key, generation): 1 for the roots, one more for a child, the same for a spouse; the least that is reached, 99 for those that aren't. Rounds go on until nothing gets better, in cycles too; more than most are an error."""
    steps = parents.select(F.col("parent").alias("at"), F.col("child").alias("to"), F.lit(1).alias("more")).unionByName(spouses.select(F.col("a").alias("at"), F.col("b").alias("to"), F.lit(0).alias("more"))).unionByName(spouses.select(F.col("b").alias("at"), F.col("a").alias("to"), F.lit(0).alias("more")))
    best = cut(roots.select(F.col(key).alias("at"), F.lit(1).alias("generation")).distinct())
    frontier = best
    for _ in range(most):
        reached = frontier.join(steps, "at").groupBy("to").agg(F.min(F.col("generation") + F.col("more")).alias("g"))
        better = reached.join(best, reached["to"] == best["at"], "left").where("generation is null or g < generation").select(F.col("to").alias("at"), F.col("g").alias("generation"))
        frontier = cut(better)
        if frontier.isEmpty():
            break
        best = cut(best.unionByName(frontier).groupBy("at").agg(F.min("generation").alias("generation")))
    else:
        raise RuntimeError(f"generations did not settle in {most} rounds")
    return nodes.select(key).join(best.withColumnRenamed("at", key), key, "left").select(key, F.coalesce("generation", F.lit(99)).alias("generation"))


def descendant_paths(children: DataFrame, roots: DataFrame, depth: int = 6) -> DataFrame:
    """(root, node, level) for each path, so that a node that two paths reach counts twice."""
    level = cut(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("level")))
    out = level.where("level > 0")
    for n in range(1, depth + 1):
        level = cut(level.join(children, level.node == children.parent).select("root", F.col("child").alias("node"), F.lit(n).alias("level")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def descendant_totals(children: DataFrame, roots: DataFrame, depth: int = 6) -> DataFrame:
    """(root, n, depth) of roots with descendants: the number of descendant_paths and their deepest level, summed upwards, so that each round has a row for each parent at most."""
    level = cut(children.groupBy(F.col("parent").alias("root")).agg(F.count("*").alias("n")))
    out = level.withColumn("depth", F.lit(1))
    for k in range(2, depth + 1):
        level = cut(level.join(children, level.root == children.child).groupBy(F.col("parent").alias("root")).agg(F.sum("n").alias("n")))
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("depth", F.lit(k)))
    totals = out.groupBy("root").agg(F.sum("n").alias("n"), F.max("depth").alias("depth"))
    return totals.join(roots.select(F.col("node").alias("root")), "root", "left_semi")


def chain_ends(links: DataFrame) -> DataFrame:
    """(src, end) of chains src -> dst by pointer doubling; what is on a cycle, or leads to one, has a null end."""
    at, moving = cut(links.groupBy("src").agg(F.min("dst").alias("dst"))), None
    while True:
        ahead = at.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        after = cut(at.join(ahead, "dst", "left").select("src", F.coalesce("next", "dst").alias("dst"), F.col("next").isNotNull().alias("moved")))
        n, at = after.where("moved").count(), after.select("src", "dst")
        if n == 0 or n == moving:  # fewer move each round, until only those that cycles hold
            break
        moving = n
    return after.select("src", F.when(~F.col("moved"), F.col("dst")).alias("end"))


def trimmed(edges: DataFrame) -> DataFrame:
    """edges (src, dst) without those that lead from what nothing leads to, or to what leads nowhere, again and again: cycles and what lies between them."""
    left, before = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct()), None
    while (n := left.count()) and n != before:
        before = n
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
    return left


def on_cycle(edges: DataFrame, depth: int = 40) -> DataFrame:
    """(node, hops): nodes that edges lead back to in up to depth steps, and the least number of steps. Walks are taken among cycles and what lies between them only."""
    return closure(trimmed(edges), depth).where("src = dst").select(F.col("src").alias("node"), "hops")


def generations_by_floor(birth: Column, root: int, years: int = 30) -> Column:
    """An older count: years a generation, rounded down, from 1; 99 without a year."""
    return F.when(birth.isNull(), 99).otherwise(F.greatest(F.lit(1), F.floor((birth - root) / years).cast("int") + 1))
