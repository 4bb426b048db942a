"""Page and key operators on tiny, invented rows: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from tallyloom.functions import living_rules
from tallyloom.operators import pages as P
from tallyloom.operators import resolve, versions


def test_nulls_are_no_year_issue_and_blanks_neither(spark):
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "1850"), ("d", "~1850")], "k string, birth string")
    assert [r.key for r in P.year_hygiene(rows, "k", ["birth"]).collect()] == ["d"]


def test_unknown_years_contradict_nothing(spark):
    rows = spark.createDataFrame([(1, 1850, None, None, None, None), (2, 1850, 1849, None, 1861, 1849)], "k int, b int, d int, a int, m int, p int")
    found = P.self_consistency(rows, "k", F.col("b"), F.col("d"), F.col("a"), F.col("m"), F.col("p")).collect()
    assert sorted((r.key, r.gate) for r in found) == [("2", "died_before_birth"), ("2", "married_too_young"), ("2", "parent_died_before_birth")]


def test_withheld_names_only_linked_on_profiles(spark):
    pages = spark.createDataFrame([(1, "<a>Ann  Oak</a>", True), (2, "<b>ann oak</b>", True), (3, "ann <i>oak</i>", False), (4, None, False), (5, '<meta name="robots" content="noindex"> Ann Oak', False)], "k int, html string, profile boolean")
    names = spark.createDataFrame([("Ann Oak",), ("Ann Oak",), (None,), ("Ann",)], "name string")
    found = P.withheld_leaks(pages, "k", "html", F.col("profile"), names, "name").collect()
    assert sorted((r.k, r.linked) for r in found) == [(1, True), (3, False)]


def test_snapshot_state_ignores_order_and_sees_repeats(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    state = lambda a, b: P.snapshot_state(a, b).first().state
    assert state(rows.orderBy(F.desc("k")), rows) == "fresh"
    assert state(rows.union(rows), rows) == "stale"
    assert state(rows.where("false"), rows) == "missing"


def test_redirects_without_a_target_are_at_fault(spark):
    stubs = spark.createDataFrame([(1, "/a", None), (2, "/b", "<p>")], "k int, url string, html string")
    built = spark.createDataFrame([("/c",)], "url string")
    assert sorted(r.k for r in P.redirect_health(stubs, "k", "url", "html", built, "url").collect()) == [1, 2]


def test_manifest_keys(spark):
    rows = spark.createDataFrame([("ann-oak",), ("bob-elm-1850",), ("cy-ash-1850",), ("cy-ash-1860",), (None,)], "slug string")
    keys = spark.createDataFrame([("ann-oak",), ("bob-elm",), ("cy-ash",), ("dee",), (None,)], "key string")
    found = {r.key: (r.how, r.slug) for r in resolve.manifest_keys(keys, "key", rows, "slug").collect()}
    assert found == {"ann-oak": ("exact", "ann-oak"), "bob-elm": ("dated", "bob-elm-1850"), "cy-ash": ("ambiguous", None), "dee": ("missing", None), None: ("missing", None)}


def test_drift_of_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    assert versions.drift(rows, rows, "k", "v").count() == 0
    assert {r.state for r in versions.drift(rows.where("false"), rows, "k", "v").collect()} == {"missing"}


def test_names_that_tell_a_death(spark):
    rows = spark.createDataFrame([("A (1850–1900).md",), ("A (1950–?).md",), ("A.md",), ("A (1965).md",), (None,)], "name string")
    assert [r.name for r in rows.where(living_rules.to_check(F.col("name"))).collect()] == ["A (1950–?).md", "A.md", None]
