"""Connected components of a link table by alternating star rounds.

Every round points the neighbours of a node at the smallest node known beside it (first the larger
neighbours, then the smaller ones and the node itself). Rounds are joins and ``min`` aggregates over
links only; no component is ever gathered in one place. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import stored


def _stars(links: DataFrame, larger_only: bool) -> DataFrame:
    """One half round over links (u > v)."""
    if larger_only:
        sides = links.select(F.col("u").alias("n"), F.col("v").alias("m")).union(links.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        sides = links.select(F.col("u").alias("n"), F.col("v").alias("m"))
    least = sides.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("lo", "n").alias("lo"))
    moved = sides.join(least, "n")
    if larger_only:
        moved = moved.where("m > n").select(F.col("m").alias("u"), F.col("lo").alias("v"))
    else:
        moved = moved.select(F.col("m").alias("u"), F.col("lo").alias("v")).union(least.select(F.col("n").alias("u"), F.col("lo").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(u, v)``, where root is the smallest node reachable.

    Nodes are of any orderable type. Self links and null ends are ignored; an empty table gives an
    empty result.
    """
    tidy = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(tidy, "links")
    state = None
    while True:
        now = stored(_stars(_stars(now, True), False), "links")
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
