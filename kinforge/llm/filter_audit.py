"""Filter interaction audit: what each filter removes in every order, by Lehmer-rank difference arrays.

Documents are reduced to counts by part and mask, the set of filters they fail; five filters have 32
masks, however many documents there are. The orders of the filters, in lexicographic order, have ranks
0 to 119. The orders that begin with the same letters are neighbours, and the Lehmer code of those letters
gives the first of them; so a mask is removed at a given step in a few intervals of ranks. Its counts are
added where an interval begins and taken off where it ends, and one prefix sum across the ranks gives
every order's totals. No document meets an order.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.llm.common import stored, texts

LETTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What is counted, of all rows and of the labelled ones.
COUNTS = ("n", "good", "toxic")


def first_rank(head: tuple[int, ...], n: int) -> int:
    """The rank of the first of the orders of 0 .. n-1 that begin with ``head``, from its Lehmer code."""
    return sum((x - sum(y < x for y in head[:i])) * factorial(n - 1 - i) for i, x in enumerate(head))


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, lo, hi): a document failing ``mask`` goes at ``step`` in the orders of ranks lo to hi - 1.

    Neighbouring intervals are one. The list depends on the number of filters alone.
    """
    out: list[tuple[int, int, int, int]] = []
    for mask in range(1, 1 << n):
        failed = [i for i in range(n) if mask >> i & 1]
        passed = [i for i in range(n) if not mask >> i & 1]
        for step in range(1, len(passed) + 2):
            last = None
            for head in sorted((*before, f) for before in permutations(passed, step - 1) for f in failed):
                lo = first_rank(head, n)
                if last is not None and last[3] == lo:
                    last = (mask, step, last[2], lo + factorial(n - step))
                    out[-1] = last
                else:
                    last = (mask, step, lo, lo + factorial(n - step))
                    out.append(last)
    return out


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: counts of documents by source and by the filters they fail.

    The five filters: under 200 words; under half of the words distinct; over 2 % of the characters in A-Z;
    a character of ``#$%&*|``; a text that a smaller doc_id has too. Bit i of the mask stands for letter i.
    Equal texts meet by SHA-256, after a sum over equal (text, source, labels), so a text has four rows a
    source at most however often it is copied. Null texts are empty, null sources the empty part; a null
    doc_id counts as smaller than all others and has no label. Rows of equal id and text are all first or
    none. Several labels of a document count as one, with 1 where any has 1.
    """
    words = F.array_remove(F.split("text", SPACES), "")
    read = texts(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    counted = read.select(
        "doc_id", "part", F.sha2("text", 256).alias("text_key"), F.size(words).cast("long").alias("words"), F.size(F.array_distinct(words)).cast("long").alias("distinct"),
        F.length("text").cast("long").alias("chars"), F.length(F.translate("text", UPPER, "")).cast("long").alias("not_upper"), F.col("text").rlike("[#$%&*|]").alias("sign"),
    )
    tests = (F.col("words") < 200, 100 * F.col("distinct") < 50 * F.col("words"), 100 * (F.col("chars") - F.col("not_upper")) > 2 * F.col("chars"), F.col("sign"))
    mask = sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(_any("quality").alias("good"), _any("toxic").alias("toxic"))
    rows = counted.select("doc_id", "part", "text_key", mask.alias("mask")).join(marks, "doc_id", "left")
    same = ("text_key", "part", "mask", "good", "toxic")
    flagged = rows.select("doc_id", *same[:3], *(F.coalesce(c, F.lit(0)).alias(c) for c in same[3:]))
    by_id = flagged.groupBy("doc_id", *same).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    by_text = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.min(order).alias("first"), F.min_by("n", order).alias("n_first"))
    first = F.min("first").over(Window.partitionBy("text_key"))
    passed = F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(F.lit(0))
    copies = 1 << 4
    halves = F.array(F.struct(F.col("mask").alias("mask"), passed.alias("n")), F.struct((F.col("mask") + copies).alias("mask"), (F.col("n") - passed).alias("n")))
    cells = by_text.withColumn("least", first).select("part", "good", "toxic", F.inline(halves)).where("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in COUNTS[1:]))


def _any(name: str) -> Column:
    return F.max(F.coalesce((F.col(name) == 1).cast("int"), F.lit(0)))


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of every order and step, zeros included, from ``failing``'s counts.

    kept: left after this step. removed: gone here. redundant: fails this filter, gone before. unique_fails:
    fails this filter alone. good_lost, toxic_lost: of the removed, those labelled so. shapley: removed by
    this filter, summed over all orders. ``cells`` has one row a part and mask; a part of no document has no
    row, so an empty table gives an empty result.
    """
    n, spark = len(letters), cells.sparkSession
    cells = stored(cells, "filter-cells")  # at most 2 ** n rows a part, read twice
    intervals = spark.createDataFrame(removal_intervals(n), "mask int, step int, lo int, hi int")
    ends = F.array(F.struct(F.col("lo").alias("place"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("place"), F.lit(-1).alias("sign")))
    bounds = cells.join(F.broadcast(intervals), "mask").select("part", "step", F.inline(ends), *COUNTS)  # the intervals depend on n alone
    deltas = bounds.groupBy("part", "step", "place").agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in COUNTS))

    bit = [F.col("mask").bitwiseAND(1 << i) != 0 for i in range(n)]
    only = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    totals = cells.groupBy("part").agg(F.sum("n").alias("total"), F.array(*map(only, bit)).alias("fails"), F.array(*(only(F.col("mask") == 1 << i) for i in range(n))).alias("alone"))
    names = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    grid = totals.select("*", F.posexplode(names).alias("place", "filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    across = Window.partitionBy("part", "step").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = grid.join(deltas, ["part", "step", "place"], "left").select(*grid.columns, *(F.sum(F.coalesce(c, F.lit(0))).over(across).alias(c) for c in COUNTS))

    at = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), 1))
    placed = summed.withColumn("filter", at)
    so_far = Window.partitionBy("part", "place").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"), (F.element_at("fails", F.col("filter")) - F.col("n")).alias("redundant"),
        F.element_at("alone", F.col("filter")).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of ``failing`` in all 120 orders; columns and edge cases as for ``failing`` and ``interactions``."""
    return interactions(failing(docs, labels))
