"""What large tables would show: rows that mustn't pass through the driver, and pairs that mustn't be made."""

import random
import re

from tallyloom import plans
from tallyloom.operators import aliases as A
from tallyloom.operators import profiles as P

SF = "/root/testdata/sf0.001"


def test_lines_of_trees_arent_broadcast(spark):
    found = plans.queries()["generations_by_indent"](spark, SF)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    trees = spark.createDataFrame([(1, "Root\n  Ann Oak\n\t\tann oak, ann elm"), (2, "ann elm\n  Zann Oak"), (3, "Ann"), (4, None)], "k int, tree string")
    names = spark.createDataFrame([("Ann Oak",), ("Ann Elm",), ("Tom",), (None,)], "name string")
    assert sorted(map(tuple, P.generation_by_indent(trees, "k", "tree", names, "name").collect())) == [(1, "Ann Elm", 3), (1, "Ann Oak", 2), (2, "Ann Elm", 1)]


def rows_of_joins(plan):
    """Rows that each join of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_of_joins(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return rows_of_joins(plan.plan())
    out = [plan.metrics().apply("numOutputRows").value()] if "Join" in kind else []
    return out + [n for i in range(plan.children().size()) for n in rows_of_joins(plan.children().apply(i))]


def test_namesakes_and_files_make_no_pairs(spark):
    n = 300
    people = spark.range(n).selectExpr("'s' || id as slug", "'Ann Oak' || id as title", "cast(1850 as int) as birth")
    files = spark.range(n).selectExpr("'Ann Elm' || id || '.md' as file").union(spark.range(n).selectExpr("'Ann Lee Yew (Mrs Oak' || id || ').md' as file"))
    found = A.file_matches(people, files)
    assert found.collect() == []
    joins = rows_of_joins(found._jdf.queryExecution().executedPlan())
    assert joins and max(joins) <= 10 * n


def matched(people, files):
    """The files of persons by their rules, each person held against each file."""
    found, order = {}, ["exact", "exact_year", "first_last_year", "prefix", "surname_swap", "bracket", "extra_name"]
    for slug, title, birth in people:
        if not title:
            continue
        main = title.lower().split()
        keys = [main] + ([[*main[:-1], t] for t in main[-1].split("/")] if "/" in main[-1] else [])
        for file in {f for f in files if f}:
            name = re.sub(r"\s*\([^)]*\)$", "", file.removesuffix(".md")).lower().split(" ")
            year = re.search(r"\(([0-9]{3,4})[–-]", file)
            year, held = year and int(year[1]), re.split(r"[^a-z]+", " ".join(re.findall(r"\(([^)]*)\)", file)).lower())
            same, dated, ends = name in keys, birth is not None and birth == year, name[0] == main[0] and name[-1] == main[-1]
            given = min(len(main), len(name)) > 1 and main[:-1] == name[:-1]
            rules = [same, same and dated, dated and any((k[0], k[-1]) == (name[0], name[-1]) for k in keys), len(name) > len(main) and name[: len(main)] == main, given and name != main, given and main[-1] in held, ends and abs(len(name) - len(main)) == 1 and (None in (birth, year) or birth == year)]
            for how in [h for h, ok in zip(order, rules, strict=True) if ok]:
                found.setdefault(slug, {}).setdefault(how, set()).add(file)
    firsts = {slug: next((h for h in order if len(by.get(h, ())) == 1), None) for slug, by in found.items()}
    return sorted((slug, *found[slug][how], how) for slug, how in firsts.items() if how)


def test_files_of_odd_persons(spark):
    draw, hows, several = random.Random(5), set(), 0
    for size in (12, 40, 80, 160):
        name = lambda last: " ".join(x for x in (draw.choice(["Ann", "Tom"]) + draw.choice(["", "", "a", "b", "c"]), draw.choice(["", "", "Lee", "May Fir"]), last) if x)  # noqa: E731, B023
        people = [(f"s{draw.randrange(2 * size)}", draw.choice([None, "", name(""), *[name(draw.choice(["Oak", "Elm", "Yew", "Oak/Elm", "Ash|Yew"])) for _ in range(7)]]), draw.choice([None, 900, 1850, 1851])) for _ in range(2 * size)]
        files = [draw.choice([None, ".md", *[name(draw.choice(["", "Oak", "Elm", "Yew", " Oak", "Ash|Yew"])) + draw.choice(["", " (1850–1900)", " (1851-1900)", " (900–950)", " (Mrs Oak)", " (Yew, Elm) (1850–1900)"]) + ".md" for _ in range(8)]]) for _ in range(size)]
        found = sorted(map(tuple, A.file_matches(spark.createDataFrame(people, "slug string, title string, birth int"), spark.createDataFrame([(f,) for f in files], "file string")).collect()))
        assert found == matched(people, files)
        hows, several = hows | {x[2] for x in found}, several + len(people) - len({x[0] for x in people})
    assert len(hows) == 7 and several > 0
