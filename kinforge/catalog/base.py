"""Registry of runnable queries and the DuckDB text that checks each one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinforge.catalog import duck
from kinforge.fixtures import closure, staged, table, with_fixtures
from kinforge.session import sized_as_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HEAVY = {"fx_civil", "fx_cand", "fx_edge"}
READ_ONCE = {"fx_src", "fx_fact", "fx_town"}


def query(name: str, *inputs: str, sql: str | None = None, stored: bool = True):
    """Register a function of DataFrames. ``inputs`` name the tables it gets; ``sql`` is its check.

    The civil index, candidates, tree edges and slots are read several times by the queries that join them, so
    for those they are staged. Citations, facts and towns are summed up by one reading, of the columns that the sum needs.
    A query that reads its tables once, or few of their columns, is not ``stored``: it derives those columns alone.
    """
    several = stored and HEAVY & set(inputs) and len(inputs) > 1

    def get(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
        return (staged if several and name not in READ_ONCE else table)(spark, sf_dir, name)

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[get(sized_as_rows(spark), sf_dir, n) for n in inputs])

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_fixtures(inputs, sql, *([duck.seats(closure(inputs))] if "fx_seat" in sql else []))
        return fn

    return wrap
