"""Operators on tiny, invented rows: nulls, ties, ambiguity, seeded defects."""

import pytest
from pyspark.sql import functions as F

from tallyloom import sources
from tallyloom.functions import dates as D
from tallyloom.functions import redact as R
from tallyloom.functions import text as T
from tallyloom.operators import gates, graph, resolve, search, versions


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return frame.select(column).first()[0]


@pytest.mark.parametrize(("raw", "year"), [("~1892", 1892), ("c. 1892", 1892), ("approx 1892", 1892), ("1892", 1892), ("?", None), ("", None)])
def test_year_of(spark, raw, year):
    assert one(spark, D.year_of(F.lit(raw))) == year


@pytest.mark.parametrize(("raw", "day"), [("1892-03-05", "1892-03-05"), ("5 March 1892", "1892-03-05"), ("31 February 1892", None), ("c. 1892", None), ("1892", None)])
def test_date_of(spark, raw, day):
    found = one(spark, D.date_of(F.lit(raw)))
    assert (str(found) if found else None) == day


@pytest.mark.parametrize(("ref", "years"), [("Ann Oak (1850–1900)", (1850, 1900)), ("Ann Oak (b. 1850)", (1850, None)), ("Ann Oak (bap. 1850)", (1850, None)), ("Ann Oak (m. 1871)", (None, None)), ("Ann Oak (miller)", (None, None)), ("Ann Oak", (None, None))])
def test_span_years(spark, ref, years):
    assert tuple(one(spark, D.span_years(F.lit(ref)))) == years


@pytest.mark.parametrize(
    ("relation", "birth", "death", "other", "other_death", "ok"),
    [("parent", 1850, None, 1839, None, True), ("parent", 1850, None, 1840, None, False), ("parent", 1850, None, 1830, 1849, False), ("parent", 1850, None, None, None, True), ("child", 1850, 1880, 1881, None, False), ("spouse", 1850, None, 1900, None, True), ("spouse", 1850, None, 1901, None, False), ("sibling", 1850, None, 1891, None, False), ("friend", 1850, None, 1700, None, True)],
)
def test_gate(spark, relation, birth, death, other, other_death, ok):
    lit = lambda v: F.lit(v).cast("int")
    assert one(spark, D.plausible(F.lit(relation), lit(birth), lit(death), lit(other), lit(other_death), D.GATES["shared"])) is ok


def test_parsing(spark):
    assert one(spark, T.wikilinks(F.lit("[[Ann Oak|Ann]] and [[Bo Elm]]"))) == ["Ann Oak", "Bo Elm"]
    assert one(spark, T.table_cells(F.lit(r"| a | [[x|y]] | p\|q |"))) == ["a", "[[x|y]]", "p|q"]
    assert [tuple(r) for r in one(spark, T.relationships(F.lit("Parents: Ann (a, b), Bo | Child: [[C|c]]")))] == [("parents", ["Ann (a, b)", "Bo"]), ("child", ["c"])]
    assert one(spark, T.slugify(F.lit("  Zoë Élan! "), fold=True)) == "zoe-elan"
    assert one(spark, T.clamp(F.lit("One two three. Four five six seven eight"), 20)) == "One two three."
    assert one(spark, T.sections(F.lit("a\n## Life\nb\n## Home\nc"), ["life"])) == "a\n## Life\nb\n"


def test_redaction_leaves_nothing(spark):
    text = F.lit("mail ann@oak.example or 12 Elm Street, 10.0.0.1")
    assert "@" not in one(spark, R.placeholders(text)) and "10.0.0.1" not in one(spark, R.deleted(text))
    assert "12 Elm Street" in one(spark, R.for_living(text, F.lit(False))) and "12 Elm Street" not in one(spark, R.for_living(text, F.lit(True)))


def test_resolution_doesnt_guess(spark):
    refs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "ref_id long")
    rules = [("year", spark.createDataFrame([(1, "a", True)], "ref_id long, slug string, ok boolean")), ("name", spark.createDataFrame([(1, "b", True), (2, "a", True), (2, "b", True), (3, "a", False)], "ref_id long, slug string, ok boolean"))]
    found = {r.ref_id: (r.slug, r.rule, r.status) for r in resolve.resolve(refs, rules, F.col("ok")).collect()}
    assert found == {1: ("a", "year", "resolved"), 2: (None, "name", "ambiguous"), 3: (None, None, "refused_dates"), 4: (None, None, "unresolved")}


def test_graph_defects_are_found(spark):
    edges = spark.createDataFrame([("parent", 1, 2), ("child", 2, 1), ("parent", 3, 4), ("self", 5, 5)], "kind string, src long, dst long")
    assert [r.src for r in graph.one_way(edges, "parent", "child").collect()] == [3]
    assert graph.undirected(edges).where("src = dst").isEmpty()
    nodes = spark.createDataFrame([(1,), (2,), (3,), (5,)], "id long")
    assert [r.end for r in graph.dangling(edges, nodes, "id").collect()] == [4]
    parents = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (3, 2), (3, 4)], "child long, parent long")
    assert [tuple(r) for r in graph.two_cycles(parents).collect()] == [(1, 2)]
    assert [tuple(r) for r in graph.over_cap(parents).collect()] == [(3, 3)]
    ends = {r.src: r.end for r in graph.chain_ends(spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 7), (9, 7)], "src long, dst long")).collect()}
    assert ends == {1: 3, 2: 3, 7: None, 8: None, 9: None}


def test_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k long, v string")
    assert {(r.k, r.change, tuple(r.changed)) for r in versions.changes(old, new, "k", ["v"]).collect()} == {(2, "changed", ("v",)), (3, "removed", ()), (4, "added", ())}
    assert old.agg(versions.fingerprint(old)).first() == old.orderBy(F.desc("k")).agg(versions.fingerprint(old)).first()


def test_search_order(spark):
    rows = spark.createDataFrame([(1, "Ann Oak"), (2, "Oak Ann"), (3, "Joan"), (4, "Anna"), (5, "Zed")], "id long, name string")
    assert [r.id for r in search.search(rows, "name", "ann", key="id").collect()] == [4, 1, 2]
    assert search.search(rows, "name", "a").count() == 5


def test_gates_fail_closed(spark):
    with pytest.raises(ValueError):
        gates.not_empty(spark.range(0), "input")
    empty = gates.issues(spark.range(0), "g", F.col("id"), F.col("id"), "high")
    assert gates.score(empty).first().score == 10.0


def test_sources(spark, tmp_path):
    (tmp_path / "ann.md").write_text("---\ntitle: Ann Oak\n---\nBody")
    (tmp_path / "index.md").write_text("no")
    row = sources.notes(spark, str(tmp_path)).first()
    assert (row.file, row.fields["title"], row.body) == ("ann.md", "Ann Oak", "Body")
    (tmp_path / "p.json").write_text('{"people": [{"slug": "a"}, {"slug": "b"}]}')
    assert sources.json_rows(spark, str(tmp_path / "p.json"), "slug: string").count() == 2
    (tmp_path / "s.xml").write_text("<urlset><url><loc>u</loc><lastmod>2024-01-02</lastmod></url><url><loc>u</loc></url></urlset>")
    assert sources.sitemap(spark, str(tmp_path / "s.xml")).count() == 1
    assert sources.write(spark.range(3), str(tmp_path / "out")) == 3 and not (tmp_path / "out").exists()
    assert sources.write(spark.range(3), str(tmp_path / "out"), apply=True) == 3


def test_delta_stream_offers_refused_rows_again(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from tallyloom.streaming import delta_stream, file_stream

    seen = []

    def run(checkpoint, accept):
        source = file_stream(spark, str(tmp_path / "in"), "k string, t long")
        delta_stream(source, str(tmp_path / "state"), str(tmp_path / checkpoint), "k", "t", lambda df: seen.append(sorted(map(tuple, df.collect()))) or accept).awaitTermination(60)

    spark.createDataFrame([("a", 1), ("b", 2)], "k string, t long").coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # refused, and refused again
        with pytest.raises(StreamingQueryException, match="Refused"):
            run("one", False)
    run("one", True)
    run("one", True)  # nothing new
    assert seen == [[("a", 1), ("b", 2)]] * 3
    spark.createDataFrame([("b", 3)], "k string, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run("one", True)
    assert seen[3:] == [[("b", 3)]]
    run("two", True)  # another checkpoint sees all files anew and the same state
    run("three", True)
    assert seen[4:] == [[], []]
    assert {(r.k, r.t) for r in spark.read.parquet(str(tmp_path / "state/*")).groupBy("k").agg({"t": "max"}).toDF("k", "t").collect()} == {("a", 1), ("b", 3)}


def test_generations_of_a_long_chain(spark):
    parents = spark.range(1, 201).selectExpr("id as child", "id - 1 as parent")
    none = spark.createDataFrame([], "a long, b long")
    found = graph.generations(spark.range(203).toDF("k"), "k", parents, none, spark.range(1).toDF("k"))
    assert {r.k: r.generation for r in found.collect()} == {k: k + 1 if k < 201 else 99 for k in range(203)}


def test_cycles_in_a_large_tree(spark):
    tree = spark.range(1, 3000).selectExpr("cast(floor(id / 3) as bigint) as src", "id as dst")
    loop = spark.createDataFrame([(5, 1), (2999, 2999), (9001, 9002), (9002, 9003)], "src long, dst long")
    assert sorted(map(tuple, graph.on_cycle(tree.union(loop)).collect())) == [(1, 2), (5, 2), (2999, 1)]


def test_merge_with_nulls_and_ties(spark):
    from tallyloom.operators import merge

    old = spark.createDataFrame([(1, "a", "f"), (2, None, "g"), (3, "c", "h"), (4, "c", "h")], "old_id long, slug string, file string")
    new = spark.createDataFrame([(10, "a", "x"), (20, None, "g"), (30, "c", "h")], "new_id long, slug string, file string")
    found = merge.identity_cascade(old, new, "old_id", "new_id", [("slug", ["slug"]), ("file", ["file"])])
    assert sorted(map(tuple, found.collect())) == [("file", 2, 20), ("slug", 1, 10)]
    refs = spark.createDataFrame([("ann-oak-18501900",), ("bo-elm-18501900",), (None,), ("plain",)], "slug string")
    known = spark.createDataFrame([("ann-oak-1900",), ("ann-oak",), (None,)], "known string")
    assert sorted(map(tuple, merge.repaired_slugs(refs, "slug", known, "known").collect())) == [("ann-oak-18501900", "ann-oak-1900"), ("bo-elm-18501900", None)]
    with pytest.raises(ValueError, match="fewer"):
        gates.at_least(refs, 5, "refs")
