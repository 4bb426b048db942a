"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aliases, checks, core, family, graphs, keys, notes, people, private, profiles, relational, rendered, site, textual, validation

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (core, textual, notes, people, relational, graphs, family, aliases, private, profiles, site, validation, checks, rendered, keys)
FLAGSHIP: Query = core.customers_by_nation_decade


def queries() -> dict[str, Query]:
    return {name: q.run for m in MODULES for name, q in m.REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for m in MODULES for name, q in m.REGISTRY.items() if q.sql}
