"""Grouping and ordering over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Registry, table

REGISTRY = Registry()


@REGISTRY.query("""
select n_name as nation, case when year(o_orderdate) < 1800 then 'Before 1800' else (year(o_orderdate) // 10 * 10)::varchar || 's' end as decade, count(*)::bigint as n_orders, count(distinct c_custkey)::bigint as n_customers
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all""")
def customers_by_nation_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each group by decade: orders and customers of a nation."""
    year = F.year("o_orderdate")
    decade = F.when(year < 1800, "Before 1800").otherwise(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))
    orders = table(spark, sf_dir, "orders").select("o_custkey", decade.alias("decade"))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("nation", "decade").agg(F.count("*").alias("n_orders"), F.count_distinct("c_custkey").alias("n_customers"))
