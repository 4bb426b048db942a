"""Scans and sinks over small folders."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallyloom import sources as S
from tallyloom.functions import notes as N
from tallyloom.functions import privacy as P
from tallyloom.functions import text as T
from tallyloom.operators import aliases, cascade, family, gates, resolve, site


def test_notes_and_titles(spark, tmp_path):
    for name, text in {"people/Ann Oak (1850–1900).md": "---\ntitle: Ann\nabout: made\n  of wood\n---\n# Ann\nSee [[Bo Elm|Bo]].", "people/index.md": "x", "private/Cy.md": "none", "people/old/Redirect Di.md": "no front matter", "people/e.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r.file: r for r in S.notes(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Ann Oak (1850–1900).md", "Cy.md", "Redirect Di.md"} and rows["Cy.md"].fields is None
    full = spark.createDataFrame([((tmp_path / "people/Ann Oak (1850–1900).md").read_text(),), (None,), ("",), ("--- a",)], "raw string").select(N.fields(F.col("raw")).alias("f")).collect()
    assert full[0].f == {"title": "Ann", "about": "made of wood"}
    assert {r.title for r in S.note_titles(spark, str(tmp_path), ["people"], "(?i)redirect|index").collect()} == {"Ann Oak (1850–1900)"}
    tree = S.trees(spark, str(tmp_path), ["Ann Oak (1850–1900)"]).first()
    assert tree.title == "Ann" and tree.people_refs == ["Bo Elm"] and tree.lines[0] == "# Ann"


def test_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"slug": "a"}, {"slug": None}]))
    (tmp_path / "b.json").write_text(json.dumps({"profiles": [{"slug": "b"}]}))
    (tmp_path / "c.json").write_text("{}")
    assert [r.slug for r in S.json_rows(spark, str(tmp_path / "a.json"), "slug: string").collect()] == ["a", None]
    assert [r.slug for r in S.json_rows(spark, str(tmp_path / "b.json"), "slug: string").collect()] == ["b"]
    with pytest.raises(ValueError, match="no rows"):
        S.json_rows(spark, str(tmp_path / "c.json"), "slug: string")


def test_sitemap_follows_its_index(spark, tmp_path):
    url = lambda loc, day: f"<url><loc>{loc}</loc><lastmod>2026-01-0{day}</lastmod></url>"
    (tmp_path / "one.xml").write_text(f"<urlset>{url('/a', 1)}{url('/b', 2)}</urlset>")
    (tmp_path / "two.xml").write_text(f"<urlset>{url('/a', 3)}<url><loc>/c</loc></url></urlset>")
    (tmp_path / "index.xml").write_text("<sitemapindex>" + "".join(f"<sitemap><loc>{tmp_path}/{n}.xml</loc></sitemap>" for n in ("one", "two")) + "</sitemapindex>")
    got = {r["loc"]: r.lastmod and r.lastmod.day for r in S.sitemap(spark, str(tmp_path / "index.xml")).collect()}
    assert got == {"/a": 3, "/b": 2, "/c": None}


def test_version_log(spark, tmp_path):
    (tmp_path / "log").write_text("commit 2026-03-01 x\n\na.md\nb.md\ncommit 2026-01-05 y\nb.md\n\ncommit no date\nc.md\n")
    assert {r.file: r.first_date for r in S.version_log(spark, str(tmp_path / "log")).collect()} == {"a.md": datetime.date(2026, 3, 1), "b.md": datetime.date(2026, 1, 5)}


def test_files_and_fallback(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    row = S.files(spark, str(tmp_path)).first()
    assert row.md5 == "900150983cd24fb0d6963f7d28e17f72" and row.size == 3
    empty, full = spark.range(0), spark.range(2)
    assert S.first_of(empty, full).count() == 2
    with pytest.raises(ValueError, match="no source"):
        S.first_of(empty)


def test_writes_tell_what_landed(spark, tmp_path):
    rows = spark.createDataFrame([("parent", 1, 2), ("spouse", 2, 3)], "kind string, src long, dst long")
    path = str(tmp_path / "edges")
    assert S.write(rows, path) == 2 and not (tmp_path / "edges").exists()
    assert S.write(rows, path, True, partition_by=("kind",)) == 2 and (tmp_path / "edges/kind=parent").exists()
    assert S.write_journal(rows, str(tmp_path / "journal"), True) == S.write_journal(rows, str(tmp_path / "journal"), True) == 2
    assert spark.read.parquet(str(tmp_path / "journal")).count() == 4
    base = str(tmp_path / "versions")
    assert S.write_version(rows, base, "v1", True) == 2 and S.version_at(spark, base, "v1").count() == 2
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        S.write_version(rows, base, "v1", True)
    meta = S.write_public(rows, ["src", "none", "dst"], {"parents": F.col("kind") == "parent"}, str(tmp_path / "public"), True).first()
    assert (meta.total, meta.parents) == (2, 1) and spark.read.parquet(str(tmp_path / "public/rows")).columns == ["src", "dst"]
    state = spark.createDataFrame([("a", 1), ("b", 2)], "k string, t long")
    after = S.state_after(state, spark.createDataFrame([("b", 5), ("c", 6)], "k string, t long"), "k", "t", base, "s1", True)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, S.version_at(spark, base, "s1").collect())) == [("a", 1), ("b", 5), ("c", 6)]
    new, mark = S.changed(rows, None)
    assert new and S.changed(rows.orderBy(F.desc("src")), mark) == (False, mark) and S.changed(rows.limit(1), mark)[0]
    tickets = S.new_tickets(spark.createDataFrame([("g", "row 12 failed"), ("g", "row  7 failed"), ("h", "x")], "gate string, log string"), spark.createDataFrame([], "ticket string"))
    assert tickets.count() == 2 and S.new_tickets(spark.createDataFrame([("g", "row 1 failed")], "gate string, log string"), tickets.select("ticket")).count() == 0


def test_cascade_on_odd_references(spark):
    people = spark.createDataFrame([("ann-oak", "Ann", None, "Oak", "Ann Oak", 1850, 1900), ("ann-oak-2", "Ann", "Lee", "Oak", "Ann Lee Oak", 1850, 1910), ("ann-oak-3", "Ann", None, "Oak", "Ann Oak", 1860, None), ("bo-elm", "Bo", None, "Elm", "Bo Elm (miller)", None, None)], "slug string, first_name string, middle_name string, last_name string, display string, birth int, death int")
    refs = [(1, "Ann Oak (b. 1850)", "child", None, 1820, None), (2, "Ann Oak (b. 1850)", "parent", None, 1905, None), (3, "Bo Elm (miller)", None, "bo-elm", None, None), (4, None, None, None, None, None), (5, "Mrs Ann Lee Oak", "spouse", None, None, None), (6, "Nobody Here", "child", None, 1800, None), (7, "", None, None, None, None)]
    got = {r.ref_id: (r.slug, r.rule, r.status) for r in cascade.resolved(spark.createDataFrame(refs, "ref_id long, ref string, relation string, subject string, subject_birth int, subject_death int"), people).collect()}
    assert got[1][2] == "ambiguous" and got[2] == ("ann-oak-2", "stated_year", "resolved") and got[3] == (None, "qualified", "self")
    assert got[4][2] == got[7][2] == "placeholder" and got[5][0] is None or got[5][1] == "first_last"
    assert got[6] == (None, None, "unresolved")
    assert cascade.resolved(spark.createDataFrame(refs, "ref_id long, ref string, relation string, subject string, subject_birth int, subject_death int"), people.limit(0)).where("slug is not null").count() == 0


def test_retirement_needs_reasons(spark):
    rows = spark.createDataFrame([("a", ["b", "c"]), ("b", ["a"]), ("c", None)], "k string, refs array<string>")
    with pytest.raises(ValueError, match="reason"):
        family.retired(rows, "k", ["refs"], spark.createDataFrame([("b", "short")], "k string, reason string"))
    left = family.retired(rows, "k", ["refs"], spark.createDataFrame([("b", "a reason that is long enough")], "k string, reason string"))
    assert {r.k: r.refs for r in left.collect()} == {"a": ["c"], "c": None}


def test_successors_must_be_complete(spark):
    old = spark.createDataFrame([("a", "Ann"), ("b", "Bo"), ("c", None)], "slug string, display string")
    new = spark.createDataFrame([("a", "Ann"), ("b2", "Bo"), ("x", None)], "slug string, display string")
    none = spark.createDataFrame([], "slug string, to string")
    found = aliases.successors(old, new, ["display"], none, none)
    assert {r["from"]: (r["to"], r.how) for r in found.collect()} == {"b": ("b2", "display"), "c": (None, "unresolved")}
    with pytest.raises(ValueError, match="successor"):
        aliases.complete(found)


def test_privacy_on_odd_text(spark):
    rows = spark.createDataFrame([(None,), ("",), ("plain ,  text",), ("a\n\n\n\nb",)], "t string")
    shown = [r.s for r in rows.select(P.living_body(F.col("t")).alias("s")).collect()]
    assert shown == [None, "", "plain ,  text", "a\n\nb"]
    assert [r.s for r in rows.select(P.names_withheld(F.col("t"), ["Mono"]).alias("s")).collect()][2] == "plain ,  text"
    assert rows.select(P.deleted(F.col("t"), F.lit(True)).alias("s")).first().s is None


def test_minimum_rows_and_folding(spark):
    with pytest.raises(ValueError, match="fewer"):
        gates.at_least(spark.range(3), 4, "rows")
    assert spark.createDataFrame([("Łódź Šø Ångström é́",)], "t string").select(T.slugify(F.col("t"), fold=True).alias("s")).first().s == "odz-s-angstrom-e"
    assert resolve.survivors(spark.createDataFrame([(1, 2), (1, 1)], "a int, b int"), ["a"], [F.asc("b")]).collect() == [(1, 1)]
    assert site.classified_status(spark.createDataFrame([("u", None), ("v", 200)], "u string, s int"), "u", "s").orderBy("u").first().verdict == "unchecked"
