"""Literal maps and arrays parsed from one SQL string (cheap to build, folded by Catalyst)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def map_text(pairs: dict) -> str:
    items = []
    for k, v in pairs.items():
        if isinstance(v, (list, tuple)):
            value = "array(" + ", ".join(quoted(x) for x in v) + ")"
        else:
            value = quoted(v) if isinstance(v, str) else str(v)
        items.append(f"{quoted(k)}, {value}")
    return "map(" + ", ".join(items) + ")"


def array_text(items) -> str:
    return "array(" + ", ".join(quoted(x) for x in items) + ")"


def lookup(pairs: dict, key: Column) -> Column:
    """Value of a small fixed map, or null."""
    return F.try_element_at(F.expr(map_text(pairs)), key)


def one_of(items, value: Column) -> Column:
    return value.isin(*list(items))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def behind(parts: Column) -> Column:
    """An array without its first element."""
    return F.filter(parts, lambda _, i: i > 0)


def first_true(cases: list[tuple[Column, object]], otherwise=None) -> Column:
    """Ordered CASE: the first rule that holds wins."""
    expr = None
    for cond, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


@lru_cache(maxsize=None)
def word_pattern(words: tuple[str, ...]) -> str:
    """Whole-word alternation over a list stated in ``values`` (unicode letters count)."""
    return "(^| )(" + "|".join(words) + ")( |$)"
