"""Queries that cover all rows of their tables, against counts that don't come from their SQL."""

import re

from pyspark.sql import functions as F

from tallyloom import plans

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_gate_reports_lines_of_all_parts(spark):
    lines, orders = rows(spark, "lineitem"), rows(spark, "orders")
    early = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate < o_orderdate")
    assert early.where("l_partkey % 50 > 0").count() > 0
    found = plans.queries()["gate_issues"](spark, SF).where("gate = 'shipped_before_order'")
    assert sorted(map(tuple, found.select("key", "detail").collect())) == sorted(map(tuple, early.select(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).collect()))
    assert plans.queries()["gate_score"](spark, SF).first().n_high == early.count()


def test_timeline_has_all_dated_rows(spark):
    orders, lines = rows(spark, "orders"), rows(spark, "lineitem")
    found = plans.queries()["timeline"](spark, SF)
    assert found.count() == orders.count() + lines.count() + 1
    years = orders.select(F.year("o_orderdate").alias("y")).union(lines.select(F.year("l_shipdate"))).union(spark.sql("select 1999"))
    assert found.where("new_decade").count() == years.select(F.floor(F.col("y") / 10)).distinct().count()
    assert found.where("new_decade").agg(F.min("year")).first()[0] == years.agg(F.min("y")).first()[0]


def test_every_part_is_a_reference_and_a_candidate(spark):
    part = rows(spark, "part")
    found = {r.ref_id: r for r in plans.queries()["resolved_references"](spark, SF).collect()}
    assert len(found) == part.count()
    people = [(r.p_partkey, r.p_name, r.p_size) for r in part.collect()]
    for key, name, size in people:
        alike = [k for k, n, s in people if n == name and (s == size if key % 2 == 0 else True)]
        r = found[key]
        assert (r.status, r.slug) == (("resolved", alike[0]) if len(alike) == 1 else ("ambiguous", None)) and r.rule == ("name" if key % 2 else "name_year")


def test_all_customers_with_descendants_are_roots(spark):
    keys = {r.c_custkey for r in rows(spark, "customer").collect()}
    expected = {}
    for key in keys - {0}:
        at, level = key, 0
        while at > 0 and level < 6:
            at, level = at // 3, level + 1
            if at in keys:
                n, depth = expected.get(at, (0, 0))
                expected[at] = n + 1, max(depth, level)
    assert max(expected) > 20
    assert {r.root: (r.n, r.depth) for r in plans.queries()["descendant_counts"](spark, SF).collect()} == expected


def test_slugs_and_descriptions_are_of_whole_texts(spark):
    docs = {r.doc_id: r.text for r in rows(spark, "documents").collect()}
    slugs = {r.doc_id: r.slug for r in plans.queries()["folded_slugs"](spark, SF).collect()}
    assert slugs.keys() == docs.keys() and any(len(x) > 1000 for x in slugs.values())
    plain = {k: v for k, v in docs.items() if v and v.isascii()}
    assert plain and all(slugs[k] == "-".join(re.findall("[a-z0-9]+", v.lower())) for k, v in plain.items())
    over = {r.doc_id: r.length for r in plans.queries()["descriptions_over_budget"](spark, SF).collect()}
    assert over and all(160 < n <= 176 and len(docs[k]) > 160 for k, n in over.items())
