"""Repair of a graph of persons: claims that are refused, edges that go, and what is put in their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from .graph import cut

#: Reasons for leaving out a row have so many characters.
LEAST_REASON = 20


def _born(edges: DataFrame, people: DataFrame, column: str, name: str) -> DataFrame:
    return edges.join(people.select(F.col("slug").alias(f"_{name}"), F.col("birth").alias(name)), F.col(column) == F.col(f"_{name}"), "left").drop(f"_{name}")


def parent_claims(claims: DataFrame, people: DataFrame, siblings: DataFrame, least: int = 11, most: int = 65, sure_least: int = 13, sure_most: int = 55) -> DataFrame:
    """(parent, child, verdict) of distinct claims: refused_sibling if the parent names the child as a sibling, refused_gap if the years don't allow it, refused_conflict if the reverse is claimed as well and this direction isn't the only one that is sure, else kept.

    people: slug, birth. siblings: a, b, where a names b.
    """
    rows = _born(_born(claims.select("parent", "child").distinct(), people, "parent", "p_birth"), people, "child", "c_birth")
    named = siblings.select(F.col("a").alias("parent"), F.col("b").alias("child"), F.lit(True).alias("sibling")).distinct()
    back = claims.select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.lit(True).alias("reverse")).distinct()
    rows = rows.join(named, ["parent", "child"], "left").join(back, ["parent", "child"], "left")
    gap = F.col("c_birth") - F.col("p_birth")
    sure = F.coalesce(gap.between(sure_least, sure_most), F.lit(False))
    verdict = F.when(F.col("sibling"), "refused_sibling").when(~gap.between(least, most), "refused_gap").when(F.col("reverse") & ~sure, "refused_conflict").otherwise("kept")
    return rows.select("parent", "child", verdict.alias("verdict"))


def spouse_edges(edges: DataFrame, people: DataFrame, most: int = 55) -> DataFrame:
    """Edges (a, b) of spouses born within most years of one another, or undated."""
    rows = _born(_born(edges, people, "a", "a_birth"), people, "b", "b_birth")
    return rows.where(F.coalesce(F.abs(F.col("a_birth") - F.col("b_birth")) <= most, F.lit(True))).select(*edges.columns)


def marriage_plausible(birth: Column, marriage: Column, least: int = 12, most: int = 70) -> Column:
    return F.coalesce((marriage - birth).between(least, most), F.lit(True))


def contradicted(claims: DataFrame, declared: DataFrame, partners: DataFrame) -> DataFrame:
    """Claims (child, parent, slot) that the child's own record contradicts.

    declared: child, slot, parent, as the child's record says. A claim for a
    named slot is refused if that slot is another's, one for any slot if the
    record names other parents; a claim that the record repeats in any slot
    stands, and so does an unnamed one by a partner (a, b) of a declared parent.
    """
    own = declared.groupBy("child").agg(F.collect_set("parent").alias("all"), F.collect_set(F.when(F.col("slot") == "father", F.col("parent"))).alias("father"), F.collect_set(F.when(F.col("slot") == "mother", F.col("parent"))).alias("mother"))
    both = partners.select("a", "b").union(partners.select("b", "a")).distinct()
    shared = claims.join(declared.select("child", F.col("parent").alias("a")), "child").join(both, "a").where(F.col("parent") == F.col("b")).select("child", "parent", F.lit(True).alias("partner")).distinct()
    rows = claims.join(own, "child").join(shared, ["child", "parent"], "left")
    taken = F.when(F.col("slot") == "father", F.size("father") > 0).when(F.col("slot") == "mother", F.size("mother") > 0).otherwise((F.size("all") > 0) & F.col("partner").isNull())
    return rows.where(~F.array_contains("all", F.col("parent")) & taken).select(*claims.columns)


def handed_over(edges: DataFrame, survivors: DataFrame, columns: list[str]) -> DataFrame:
    """Edges whose ends in columns are replaced by the survivor (slug, survivor) of a superseded row; loops and repeats that come of it go."""
    out = edges
    for c in columns:
        s = survivors.select(F.col("slug").alias("_slug"), F.col("survivor").alias("_to"))
        out = out.join(s, out[c] == s["_slug"], "left").withColumn(c, F.coalesce("_to", c)).drop("_slug", "_to")
    return out.where(F.col(columns[0]) != F.col(columns[1])).select(*edges.columns).distinct()


def deduplicated_parents(parents: DataFrame, people: DataFrame, most: int = 2, young: int = 15, old: int = 45, oldest: int = 50) -> DataFrame:
    """parents (child, parent) without those that can't be: only of children with more than most.

    people: slug, birth, is_living. An undated child keeps its dated parents if it has some; a deceased
    one loses living parents unless all are; where one parent is young to old
    years older, undated ones and those outside young to oldest go. All never go.
    """
    rows = parents.select("child", "parent").distinct()
    rows = rows.join(people.select(F.col("slug").alias("child"), F.col("birth").alias("c_birth"), F.col("is_living").alias("c_living")), "child", "left").join(people.select(F.col("slug").alias("parent"), F.col("birth").alias("p_birth"), F.col("is_living").alias("p_living")), "parent", "left")
    per = W.partitionBy("child")  # as many rows as a child has parents
    gap = F.col("c_birth") - F.col("p_birth")
    n = F.count(F.lit(1)).over(per)
    undated_child = F.col("c_birth").isNull() & F.col("p_birth").isNull() & (F.count("p_birth").over(per) > 0)
    living = F.coalesce(F.col("p_living"), F.lit(False)) & ~F.coalesce(F.col("c_living"), F.lit(True))
    rows = rows.withColumn("over", n > most).withColumn("undated", undated_child).withColumn("dropped", living & F.col("c_birth").isNotNull())
    rows = rows.withColumn("dropped", F.col("dropped") & (F.count_if("dropped").over(per) < n))
    left = ~F.col("dropped")
    rows = rows.withColumn("sure", F.count_if(F.coalesce(gap.between(young, old), F.lit(False))).over(per) > 0)
    rows = rows.withColumn("odd", left & F.col("sure") & F.coalesce(~gap.between(young, oldest), F.lit(True)) & F.col("c_birth").isNotNull())
    rows = rows.withColumn("odd", F.col("odd") & (F.count_if("odd").over(per) < F.count_if(left).over(per)))
    return rows.where(~(F.col("over") & (F.col("undated") | F.col("dropped") | F.col("odd")))).select("child", "parent")


def unproven(parents: DataFrame, siblings: DataFrame, flagged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents, siblings, disputed) for children in flagged (child) whose parentage isn't proven: their parent and sibling edges go, the parents' keys are kept as disputed."""
    f = flagged.select("child").distinct()
    gone = parents.join(f, "child", "left_semi")
    a, b = f.withColumnRenamed("child", "a"), f.withColumnRenamed("child", "b")
    return parents.join(f, "child", "left_anti"), siblings.join(a, "a", "left_anti").join(b, "b", "left_anti"), gone.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("disputed_parent_refs"))


def carried(previous: Column, rebuilt: Column, represented: Column) -> Column:
    """rebuilt and, after it, entries of previous that neither it nor represented has."""
    return F.concat(rebuilt, F.array_except(previous, F.concat(rebuilt, represented)))


def aligned_spouses(generations: DataFrame, parents: DataFrame, most: int = 2) -> DataFrame:
    """(slug, generation): of two parents of a child whose generations are up to most apart the deeper one takes the other's; once, all from the generations as they were."""
    one, two = parents.select("child", F.col("parent").alias("slug")), parents.select("child", F.col("parent").alias("other"))
    pairs = one.join(two, "child").where("slug <> other").select("slug", "other").distinct()
    g = generations.select(F.col("slug").alias("other"), F.col("generation").alias("theirs"))
    near = pairs.join(generations, "slug").join(g, "other").where((F.col("theirs") < F.col("generation")) & (F.col("generation") - F.col("theirs") <= most))
    least = near.groupBy("slug").agg(F.min("theirs").alias("theirs"))
    return generations.join(least, "slug", "left").select("slug", F.coalesce("theirs", "generation").alias("generation"))


def reached(edges: DataFrame, roots: DataFrame, most: int = 1000) -> DataFrame:
    """(node) that roots (node) lead to along edges (src, dst), roots included; each node is expanded once."""
    seen = frontier = cut(roots.select("node").distinct())
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    for _ in range(most):
        frontier = cut(frontier.join(steps, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError(f"paths of more than {most} edges")


def detached(edges: DataFrame, roots: DataFrame, members: DataFrame) -> DataFrame:
    """members (node) that roots don't lead to."""
    return members.select("node").distinct().join(reached(edges, roots), "node", "left_anti")


def self_loops(edges: DataFrame) -> DataFrame:
    """(kind, node) of edges (kind, src, dst) from a node to itself."""
    return edges.where("src = dst").select("kind", F.col("src").alias("node")).distinct()


def without_stubs(rows: DataFrame, parents: str, children: str, others: list[str], most_children: int = 10, most_parents: int = 5) -> DataFrame:
    """Catch-all rows: most_children or more clear all relations, most_parents or more clear the parents."""
    empty = lambda c: F.array().cast(rows.schema[c].dataType)
    all_of, up = F.size(children) >= most_children, F.size(parents) >= most_parents
    out = rows.withColumns({c: F.when(all_of, empty(c)).otherwise(F.col(c)) for c in others})
    return out.withColumns({parents: F.when(all_of | up, empty(parents)).otherwise(F.col(parents)), children: F.when(all_of, empty(children)).otherwise(F.col(children))})


def quarantined(edges: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) of edges (kind, src, dst): dst stands in relation kind to src.

    Parent and child edges that the shared gate refuses go, with their
    reciprocals, unless the two are married. removed has kind, src, dst and
    reason: impossible, or reciprocal; each edge once. restore() is its inverse.
    """
    inverse = F.when(F.col("kind") == "parent", "child").when(F.col("kind") == "child", "parent").otherwise(F.col("kind"))
    rows = edges.select("kind", "src", "dst").distinct()
    dated = rows.join(people.select(F.col("slug").alias("src"), F.col("birth").alias("b1"), F.col("death").alias("d1")), "src", "left").join(people.select(F.col("slug").alias("dst"), F.col("birth").alias("b2"), F.col("death").alias("d2")), "dst", "left")
    bad = dated.where(F.col("kind").isin("parent", "child") & ~D.plausible(F.col("kind"), F.col("b1"), F.col("d1"), F.col("b2"), F.col("d2"), D.GATES["shared"])).select("kind", "src", "dst")
    married = rows.where("kind = 'spouse'").select("src", "dst")
    married = married.union(married.select("dst", "src")).distinct()
    bad = bad.join(married, ["src", "dst"], "left_anti").select("kind", "src", "dst")
    back = bad.select(inverse.alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")).join(rows, ["kind", "src", "dst"], "left_semi").join(bad, ["kind", "src", "dst"], "left_anti")
    removed = cut(bad.withColumn("reason", F.lit("impossible")).unionByName(back.withColumn("reason", F.lit("reciprocal")).select("kind", "src", "dst", "reason")))
    return rows.join(removed, ["kind", "src", "dst"], "left_anti"), removed


def restored(kept: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges as they were before quarantined(); repeated restoring changes nothing."""
    return kept.unionByName(removed.select(*kept.columns)).distinct()


def retired(rows: DataFrame, key: str, arrays: list[str], gone: DataFrame) -> DataFrame:
    """rows without those in gone (key, reason) and without any reference to them; a reason of fewer than LEAST_REASON characters is an error."""
    if not gone.where(F.length(F.trim(F.coalesce("reason", F.lit("")))) < LEAST_REASON).isEmpty():
        raise ValueError(f"every retirement needs a reason of {LEAST_REASON} characters")
    keys = gone.select(F.col(key).alias("_gone")).distinct()
    left = rows.join(keys, rows[key] == keys["_gone"], "left_anti")
    for a in arrays:
        left = _without(left, key, a, keys)
    return left


def _without(rows: DataFrame, key: str, array: str, keys: DataFrame) -> DataFrame:
    hit = rows.select(key, F.explode(array).alias("_ref")).join(keys, F.col("_ref") == F.col("_gone"), "left_semi").groupBy(key).agg(F.collect_set("_ref").alias("_refs"))
    out = rows.join(hit, key, "left")
    return out.withColumn(array, F.when(F.col("_refs").isNull(), F.col(array)).otherwise(F.filter(array, lambda x: ~F.array_contains("_refs", x)))).drop("_refs")


def twins(ghosts: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """(ghost, twin): ghosts (slug and names) and the one clean row with the same names; without exactly one, twin is null."""
    clean = rows.join(ghosts.select(F.col("slug").alias("_g")), rows["slug"] == F.col("_g"), "left_anti").groupBy(*names).agg(F.min("slug").alias("twin"), F.count_distinct("slug").alias("n")).where("n = 1").drop("n")
    return ghosts.select(F.col("slug").alias("ghost"), *names).join(clean, names, "left").select("ghost", "twin")


def line_of(edges: DataFrame, people: DataFrame, root: DataFrame, most: int = 1000) -> DataFrame:
    """(root, node, depth): descendants along edges (parent, child) as long as the surname is the root's; each once, at its least depth. people: slug, surname. root: node."""
    kin = people.select(F.col("slug").alias("node"), "surname")
    level = cut(root.select("node").distinct().join(kin, "node").select(F.col("node").alias("root"), "node", "surname", F.lit(0).alias("depth")))
    seen, steps = level, edges.select(F.col("parent").alias("node"), F.col("child").alias("next")).distinct()
    for depth in range(1, most + 1):
        found = level.select("root", "node", "surname").join(steps, "node").select("root", F.col("next").alias("node"), "surname").join(kin, ["node", "surname"]).distinct()
        level = cut(found.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", "surname", F.lit(depth).alias("depth")))
        if level.isEmpty():
            return seen.where("depth > 0").select("root", "node", "depth")
        seen = cut(seen.unionByName(level))
    raise RuntimeError(f"lines of more than {most} generations")


def structural_contradictions(edges: DataFrame) -> DataFrame:
    """(src, dst): named as a sibling and as a parent or child of the same row."""
    s, o = edges.where("kind = 'sibling'").select("src", "dst").distinct(), edges.where("kind in ('parent', 'child')").select("src", "dst").distinct()
    return s.intersect(o)


def virtual_children(parents: DataFrame, people: DataFrame, years: int = 25) -> DataFrame:
    """(parent, child, birth, virtual): children that no row stands for are born that many years after their parent, as far as that is dated."""
    rows = _born(_born(parents.select("parent", "child"), people, "child", "own"), people, "parent", "p_birth")
    known = people.select(F.col("slug").alias("child"), F.lit(True).alias("known"))
    return rows.join(known, "child", "left").select("parent", "child", F.when(F.col("known"), F.col("own")).otherwise(F.col("p_birth") + years).alias("birth"), F.col("known").isNull().alias("virtual"))


def merged(rows: DataFrame, key: str, arrays: list[str], merges: DataFrame) -> DataFrame:
    """rows without merged ones (gone, keeper); references to them lead to their keepers, each once."""
    left = rows.join(merges.select(F.col("gone").alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")
    for a in arrays:
        m = merges.select(F.col("gone").alias("_ref"), F.col("keeper").alias("_to"))
        refs = left.select(key, F.posexplode(a).alias("_at", "_ref")).join(m, "_ref", "left").select(key, "_at", F.coalesce("_to", "_ref").alias("_ref")).where(F.col("_ref") != F.col(key))
        once = refs.groupBy(key, "_ref").agg(F.min("_at").alias("_at")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_ref"))), lambda x: x["_ref"]).alias("_new"))
        left = left.join(once, key, "left").withColumn(a, F.coalesce("_new", F.array().cast(rows.schema[a].dataType))).drop("_new")
    return left


def stubs(unresolved: DataFrame, slug: Column, name: str) -> DataFrame:
    """(slug, name, n, is_stub): a row for each reference that leads nowhere, with how often it is made."""
    return unresolved.select(slug.alias("slug"), F.trim(name).alias("name")).where("name <> '' and slug <> ''").groupBy("slug").agg(F.min("name").alias("name"), F.count("*").alias("n")).withColumn("is_stub", F.lit(True))

