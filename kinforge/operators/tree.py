"""Tree positions joined to their relatives, and reports over whole trees.

A tree holds each position once, so a tree is at most 2^(g+1) - 1 rows (``assert_unique_slots``)
and windows over one tree stay small however many trees there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions import slots
from kinforge.functions.dates import date_year

JOB, SLOT = "job_id", "asc_no"


def relative(anc: DataFrame, slot: Column, prefix: str, cols: list[str], how: str = "left") -> DataFrame:
    """Join every row to the row at another slot of its own tree."""
    other = anc.select(JOB, F.col(SLOT).alias("_slot"), *[F.col(c).alias(f"{prefix}_{c}") for c in cols])
    return anc.withColumn("_slot", slot).join(other, [JOB, "_slot"], how).drop("_slot")


def with_child(anc: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    return relative(anc, slots.child_of(F.col(SLOT)), "child", cols, how)


def with_spouse(anc: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    return relative(anc, slots.spouse_of(F.col(SLOT)), "spouse", cols, how)


def with_parents(anc: DataFrame, cols: list[str]) -> DataFrame:
    """Both parents beside each row. Parents are pivoted by child first: one join, not two."""
    parents = anc.where(F.col(SLOT) > 1).groupBy(JOB, slots.child_of(F.col(SLOT)).alias(SLOT)).agg(
        *[F.max(F.when(slots.is_father(F.col(SLOT)) == side, F.col(c))).alias(f"{who}_{c}")
          for who, side in (("father", True), ("mother", False)) for c in cols]
    )
    return anc.join(parents, [JOB, SLOT], "left")


def same_generation(anc: DataFrame) -> DataFrame:
    """How many other slots of the generation are filled, and its first and last slot."""
    w = Window.partitionBy(JOB, "gen")
    return anc.select(
        JOB, SLOT, "gen",
        (F.count("*").over(w) - 1).alias("others"), F.min(SLOT).over(w).alias("first_slot"), F.max(SLOT).over(w).alias("last_slot"),
    )


def empty_slots(anc: DataFrame, jobs: DataFrame) -> DataFrame:
    """Unfilled slots whose child is filled, with their role. Both parents of every filled slot are
    the only slots that can qualify, so they are generated from the rows themselves."""
    wanted = anc.select(JOB, F.col(SLOT).alias("child_slot"), F.col("name").alias("child_name"),
                        F.explode(F.array(slots.father_of(F.col(SLOT)), slots.mother_of(F.col(SLOT)))).alias(SLOT))
    wanted = wanted.join(jobs.select(JOB, "generations"), JOB)
    wanted = wanted.where(F.col(SLOT) <= slots.tree_slots(F.col("generations"))).drop("generations")
    return wanted.join(anc.select(JOB, SLOT), [JOB, SLOT], "left_anti").withColumn("role", slots.slot_role(F.col(SLOT)))


def completion(anc: DataFrame, jobs: DataFrame) -> DataFrame:
    """Accepted or customer rows over all slots of the tree."""
    done = anc.groupBy(JOB).agg(F.count_if((F.col("confidence_score") >= 75) | (F.col("confidence_level") == "Customer Data")).alias("accepted"))
    total = slots.tree_slots(F.col("generations"))
    return jobs.join(done, JOB, "left").select(
        JOB, F.coalesce("accepted", F.lit(0)).alias("accepted"), total.alias("slots"),
        F.round(F.coalesce("accepted", F.lit(0)) * 100.0 / total, 2).alias("percent"))


def family_gaps(anc: DataFrame) -> DataFrame:
    """Mean parent-child gap over each generation of children, rounded half up."""
    dated = anc.select(JOB, SLOT, "gen", date_year(F.col("birth_date")).alias("year"))
    pairs = with_child(dated, ["year"], "inner").where(F.col("child_year") > F.col("year"))
    return pairs.groupBy(JOB, (F.col("gen") - 1).alias("child_gen")).agg(
        F.floor(F.avg(F.col("child_year") - F.col("year")) + 0.5).cast("int").alias("mean_gap"), F.count("*").alias("pairs"))


def parent_year_estimate(anc: DataFrame) -> DataFrame:
    """Expected birth year of both parents of every slot: known, else child less the family gap, else 28 / 26."""
    dated = anc.select(JOB, SLOT, "gen", date_year(F.col("birth_date")).alias("year"))
    known = with_parents(dated, ["year"]).where(F.col("year").isNotNull())
    gaps = family_gaps(anc).select(JOB, F.col("child_gen").alias("gen"), "mean_gap")
    out = known.join(gaps, [JOB, "gen"], "left")
    side = F.explode(F.array(
        F.struct(slots.father_of(F.col(SLOT)).alias("parent_slot"), F.col("father_year").alias("known"), F.lit(28).alias("usual")),
        F.struct(slots.mother_of(F.col(SLOT)).alias("parent_slot"), F.col("mother_year").alias("known"), F.lit(26).alias("usual"))))
    return out.select(JOB, SLOT, "year", "mean_gap", side.alias("p")).select(
        JOB, SLOT, "p.parent_slot",
        F.coalesce("p.known", F.col("year") - F.col("mean_gap"), F.col("year") - F.col("p.usual")).alias("expected_year"))


def earlier_same_county(placed: DataFrame) -> DataFrame:
    """Whether a lower slot of the generation names the county this slot lies in.

    ``county`` is where the slot lies; ``stated_county`` is set when the text itself names it.
    """
    w = Window.partitionBy(JOB, "gen", "county").orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    stated = F.coalesce(F.sum(F.col("stated_county").isNotNull().cast("int")).over(w), F.lit(0)) > 0
    return placed.withColumn("earlier_same_county", F.col("county").isNotNull() & stated)


def batches(anc: DataFrame, size: int = 25) -> DataFrame:
    """Consecutive groups of slots for review, labelled by their range."""
    w = Window.partitionBy(JOB).orderBy(SLOT)
    numbered = anc.select(JOB, SLOT, (F.floor((F.row_number().over(w) - 1) / size) + 1).cast("int").alias("batch"))
    by_batch = Window.partitionBy(JOB, "batch")
    label = F.concat(F.lit("asc#"), F.min(SLOT).over(by_batch).cast("string"), F.lit("-"), F.max(SLOT).over(by_batch).cast("string"))
    return numbered.select(JOB, SLOT, "batch", label.alias("label"))


def tree_context(anc: DataFrame) -> DataFrame:
    """Distinct surnames and places (sorted), first and last birth year of each tree."""
    from kinforge.functions.dates import extract_year

    year = extract_year(F.col("birth_date"), "bounded")
    return anc.groupBy(JOB).agg(
        F.array_join(F.array_sort(F.collect_set("surname")), ", ").alias("surnames"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("birth_place") != "", F.col("birth_place")))), "; ").alias("places"),
        F.min(year).alias("year_from"), F.max(year).alias("year_to"))


def subtree(anc: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows at or above any of the given (job, slot) roots."""
    up = roots.select(JOB, F.col(SLOT).alias("_root"))
    at = anc.withColumn("_root", F.explode(F.expr("transform(sequence(0, length(bin(asc_no)) - 1), i -> shiftright(asc_no, i))")))
    return at.join(up, [JOB, "_root"], "left_semi").drop("_root").dropDuplicates([JOB, SLOT])


def assert_unique_slots(anc: DataFrame) -> DataFrame:
    """Fails the job when a tree holds a slot twice; passes the rows through otherwise."""
    n = F.count("*").over(Window.partitionBy(JOB, SLOT))
    return anc.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("slot held twice")).cast("boolean")).otherwise(True)).drop("_n")
