"""Reports over whole trees: file export, fan layout, counts for the operator's screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import names, places, slots
from kinforge.functions.dates import extract_year
from kinforge.operators.tree import JOB, SLOT

# --- fixed values -----------------------------------------------------------------------------
SHOWN_AT = 50
HEADER = ("0 HEAD", "1 SOUR kinforge", "2 VERS 1.0", "1 GEDC", "2 VERS 5.5.1", "2 FORM LINEAGE-LINKED", "1 CHAR UTF-8", "1 SUBM @SUBM1@", "0 @SUBM1@ SUBM", "1 NAME kinforge")
TRAILER = "0 TRLR"


def _line(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _when(cond: Column, *parts) -> Column:
    return F.when(cond, _line(*parts))


def _has(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _emit(df: DataFrame, section: int, lines: Column, *extra: str) -> DataFrame:
    built = df.withColumn("_lines", lines).select(JOB, F.lit(section).alias("section"), SLOT, *extra, "_lines")
    return built.select(JOB, "section", SLOT, *extra, F.posexplode("_lines").alias("line_no", "line"))


def export_lines(anc: DataFrame, jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Family-tree file of every tree as ordered lines: (job, section, slot, line_no, line).

    ``sources`` is (person_id, seq, title, citation, url). The lines of one person come from one
    row, so a tree of any width is written by many tasks; (section, slot, line_no) orders the file.
    """
    shown = anc.where(F.coalesce("confidence_score", F.lit(0)) >= SHOWN_AT)
    slot = F.col(SLOT)
    cited = shown.where(_has("person_id")).select(JOB, SLOT, "person_id").join(sources, "person_id")
    counted = cited.groupBy(JOB, SLOT).agg(F.count("*").alias("n_sources"))
    # A family is known by its pair of slots; it is the child's parents if either parent is shown.
    family_slot = slots.child_of(slot)
    parents_shown = shown.where(slot > 1).select(JOB, family_slot.alias(SLOT)).distinct().withColumn("has_parents", F.lit(True))
    people = shown.join(counted, [JOB, SLOT], "left").join(parents_shown, [JOB, SLOT], "left")
    low = F.when(slots.is_father(slot), slot).otherwise(slot - 1)
    birth, death = _has("birth_date") | _has("birth_place"), _has("death_date")
    n = F.coalesce("n_sources", F.lit(0))
    sex = F.when(F.col("gender") == "Male", "M").when(F.col("gender") == "Female", "F").otherwise("U")
    cites = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.concat(F.lit("1 SOUR @S"), slot.cast("string"), F.lit("_"), i.cast("string"), F.lit("@"))))
    head = F.array(
        _line("0 @I", slot.cast("string"), "@ INDI"), _line("1 NAME ", names.slashed_name(F.col("name"))), _when(_has("gender"), "1 SEX ", sex),
        _when(birth, "1 BIRT"), _when(_has("birth_date"), "2 DATE ", F.upper("birth_date")), _when(_has("birth_place"), "2 PLAC ", F.col("birth_place")),
        _when(death, "1 DEAT"), _when(_has("death_date"), "2 DATE ", F.upper("death_date")),
        _line("1 NOTE Confidence: ", F.col("confidence_score").cast("string"), "% (", F.col("confidence_level"), ") — ", n.cast("string"), " source(s)"))
    tail = F.array(
        _when(slot > 1, "1 FAMS @F", low.cast("string"), "_", (low + 1).cast("string"), "@"),
        _when(F.col("has_parents"), "1 FAMC @F", (slot * 2).cast("string"), "_", (slot * 2 + 1).cast("string"), "@"))
    lines = F.array_compact(F.concat(head, F.coalesce(cites, F.expr("cast(array() as array<string>)")), tail))
    persons = _emit(people, 1, lines)

    fam = shown.where(slot > 1).groupBy(JOB, low.alias("low")).agg(F.max(slots.is_father(slot)).alias("husb"), F.max(~slots.is_father(slot)).alias("wife"))
    kid = shown.select(JOB, (slot * 2).alias("low"), F.lit(True).alias("kid"))
    fam = fam.join(kid, [JOB, "low"], "left")
    lo, hi, ch = F.col("low").cast("string"), (F.col("low") + 1).cast("string"), F.shiftright("low", 1).cast("string")
    fam_lines = F.array_compact(F.array(_line("0 @F", lo, "_", hi, "@ FAM"), _when(F.col("husb"), "1 HUSB @I", lo, "@"), _when(F.col("wife"), "1 WIFE @I", hi, "@"), _when(F.col("kid"), "1 CHIL @I", ch, "@")))
    families = _emit(fam.withColumn(SLOT, F.col("low")), 2, fam_lines)

    i = F.col("seq") - 1
    src_lines = F.array_compact(F.array(
        _line("0 @S", slot.cast("string"), "_", i.cast("string"), "@ SOUR"), _when(_has("title"), "1 TITL ", F.col("title")), _when(_has("citation"), "1 TEXT ", F.col("citation")), _when(_has("url"), "1 _URL ", F.col("url"))))
    # Source lines follow the slot, then the citation's own number.
    src = _emit(cited, 3, src_lines, "seq").withColumn("line_no", F.col("seq") * 10 + F.col("line_no")).drop("seq")

    whole = jobs.withColumn(SLOT, F.lit(0))
    start = _emit(whole, 0, F.array(*[F.lit(h) for h in HEADER], _line("1 FILE ", names.slug(F.col("customer_name")), ".ged")))
    end = _emit(whole, 9, F.array(F.lit(TRAILER)))
    return start.unionByName(persons).unionByName(families).unionByName(src).unionByName(end)


def write_trees(lines: DataFrame, path: str) -> None:
    """One folder per tree; inside it the lines in file order. Trees are spread over tasks by range,
    so a large tree is split between neighbouring files rather than held by one task."""
    key = [JOB, "section", SLOT, "line_no"]
    lines.repartitionByRange(*key).sortWithinPartitions(*key).select(JOB, "line").write.partitionBy(JOB).mode("errorifexists").text(path)


def fan_layout(anc: DataFrame) -> DataFrame:
    """Ring, angles, side and short texts of every slot shown on the fan."""
    shown = anc.where((F.col("confidence_score") >= SHOWN_AT) | (F.col("confidence_level") == "Customer Data"))
    slot, ring = F.col(SLOT), slots.generation(F.col(SLOT))
    width = F.lit(360.0) / F.pow(F.lit(2.0), ring)
    start = F.lit(90.0) + (slot - F.pow(F.lit(2.0), ring)) * width
    born, died = extract_year(F.col("birth_date"), "display"), extract_year(F.col("death_date"), "display")
    return shown.select(
        JOB, SLOT, ring.alias("ring"), start.alias("start_angle"), (start + width).alias("end_angle"), (start + width / 2).alias("mid_angle"), slots.is_paternal(slot).alias("paternal"),
        places.chart_place(F.col("birth_place")).alias("short_place"),
        F.concat_ws(" – ", F.when(born != "", F.concat(F.lit("b."), born)), F.when(died != "", F.concat(F.lit("d."), died))).alias("dates"))


def job_stats(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    return jobs.agg(F.count("*").alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "pending").alias("pending"), F.count_if(s == "running").alias("running"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    a = F.col("action_type")
    return feedback.agg(F.count("*").alias("total"), F.count_if(a == "accept").alias("accepts"), F.count_if(a == "reject").alias("rejects"), F.count_if(a == "correct").alias("corrections"),
                        F.count_if(a == "select_alternative").alias("alternatives"))


def jobs_with_counts(jobs: DataFrame, anc: DataFrame) -> DataFrame:
    n = anc.groupBy(JOB).agg(F.count("*").alias("filled"), F.count_if(F.col("confidence_level") == "Customer Data").alias("given"))
    return jobs.join(n, JOB, "left").select(JOB, "customer_name", "status", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("given", F.lit(0)).alias("given"))


def candidate_summary(cand: DataFrame) -> DataFrame:
    """Per slot: rejected and open candidates, and whether one is selected (ranked first and not rejected)."""
    rejected = F.col("rejection_reason") != ""
    chosen = (F.col("rnk") == 1) & ~rejected
    return cand.groupBy(JOB, SLOT).agg(F.bool_or(chosen).alias("any_selected"), F.count_if(~chosen).alias("unselected"), F.count_if(rejected).alias("rejected"))
