"""Every registered query against its SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tallyloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.8g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    rows = plans.queries()[name](spark, SF).collect()
    result = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = sorted("|".join(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    got = sorted("|".join(plain(r[c]) for c in sorted(names)) for r in rows)
    assert got == expected


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
