"""First, best and top-k rows per key, written so that no key is gathered whole.

``first_row`` and ``best_row`` are aggregates: each task keeps one row per key before the
shuffle, so a key holding a third of all rows costs one row per task. ``top_rows`` filters
a rank by a literal, which Spark prunes on the map side (WindowGroupLimit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _as_cols(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def first_row(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    """The whole first row of every key in the given ascending order."""
    keys = _as_cols(keys)
    rest = [c for c in df.columns if c not in keys]
    by = order[0] if len(order) == 1 else F.struct(*order)
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_row"))
    return picked.select(*keys, "_row.*")


def best_row(df: DataFrame, keys, score: str, order: list[Column], at_least=None) -> DataFrame:
    """Highest score; the earliest in ``order`` on a tie; only at or above the threshold."""
    if at_least is not None:
        df = df.where(F.col(score) >= at_least)
    return first_row(df, keys, [-F.col(score), *order])


def top_rows(df: DataFrame, keys, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*_as_cols(keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def runner_up(df: DataFrame, keys, score: str, order: list[Column], value: str) -> DataFrame:
    """Best and second value with their scores and the margin between them."""
    keys = _as_cols(keys)
    two = top_rows(df, keys, [F.desc(score), *order], 2)
    picked = two.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, F.col(value))).alias("best"),
        F.max(F.when(F.col("rank") == 1, F.col(score))).alias("best_score"),
        F.max(F.when(F.col("rank") == 2, F.col(value))).alias("second"),
        F.max(F.when(F.col("rank") == 2, F.col(score))).alias("second_score"),
    )
    return picked.withColumn("margin", F.col("best_score") - F.col("second_score"))


def first_good_enough(df: DataFrame, keys, score: str, rank: str, enough: int) -> DataFrame:
    """The first row in rank order scoring ``enough``, else the first row."""
    return first_row(df, keys, [(F.col(score) < enough).cast("int"), F.col(rank)])


def carry_forward(df: DataFrame, group: str, line: str, value: Column, out: str, chunk_lines: int = 1 << 24) -> DataFrame:
    """Last non-null ``value`` at or before each line of its group.

    Lines are cut into chunks of ``chunk_lines`` line numbers. Inside a chunk the value is
    carried by a window; between chunks only one row per chunk is carried, so a document of
    any length is spread over many tasks.
    """
    tagged = df.withColumn("_chunk", F.floor(F.col(line) / chunk_lines)).withColumn("_value", value)
    inside = Window.partitionBy(group, "_chunk").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    carried = tagged.withColumn("_here", F.last("_value", ignorenulls=True).over(inside))
    closing = tagged.groupBy(group, "_chunk").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(line))).alias("_closing"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    entering = closing.select(group, "_chunk", F.last("_closing", ignorenulls=True).over(before).alias("_entering"))
    joined = carried.join(entering, [group, "_chunk"], "left")
    return joined.withColumn(out, F.coalesce("_here", "_entering")).drop("_chunk", "_value", "_here", "_entering")
