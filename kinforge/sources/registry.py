"""Record sources behind one shape.

A provider is a name, what it can do, and a function from its own table to the shared columns.
Adding a source is adding a provider; nothing else changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARED = ("person_id", "name", "gender", "birth_date", "birth_place")


@dataclass(frozen=True)
class Source:
    name: str
    to_shared: Callable[[DataFrame], DataFrame]
    can: frozenset[str] = field(default_factory=frozenset)


def from_tree(cand: DataFrame) -> DataFrame:
    return cand.select("person_id", F.concat_ws(" ", "given_name", "surname").alias("name"), "gender", "birth_date", "birth_place")


def from_profiles(people: DataFrame) -> DataFrame:
    return people.where("person_id <> ''").select(*SHARED)


def from_civil(civil: DataFrame) -> DataFrame:
    """Births only: the index has no people, just entries."""
    return civil.where("entry_type = 'birth'").select(
        F.concat(F.lit("B"), F.col("entry_id").cast("string")).alias("person_id"), F.concat_ws(" ", "forenames", "surname").alias("name"),
        F.col("year").cast("string").alias("birth_date"), F.col("district").alias("birth_place"))


SOURCES = (
    Source("tree", from_tree, frozenset({"search", "parents", "spouses", "details", "sources"})),
    Source("profiles", from_profiles, frozenset({"search", "parents", "ancestry"})),
    Source("civil", from_civil, frozenset({"confirm_birth", "confirm_death", "confirm_marriage"})),
)


def registered(available: dict[str, DataFrame], needs: str | None = None) -> list[tuple[Source, DataFrame]]:
    """Sources whose table is at hand and that can do what is needed."""
    return [(s, available[s.name]) for s in SOURCES if s.name in available and (needs is None or needs in s.can)]


def source_union(available: dict[str, DataFrame], needs: str | None = None) -> DataFrame:
    out = None
    for s, df in registered(available, needs):
        rows = s.to_shared(df).withColumn("source", F.lit(s.name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.fillna("", list(SHARED))
