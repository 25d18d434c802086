"""Operator decisions applied to snapshots: old tables and a table of commands in, new tables out.

Parquet has no in-place update, so each change is one join of the commands to the snapshot.
Commands are reduced to one per key first, so a repeated command cannot multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions import evidence, slots
from kinforge.functions.literals import first_true
from kinforge.operators.ranking import first_row
from kinforge.operators.tree import JOB, SLOT

KEY = [JOB, SLOT]
CUSTOMER = "Customer Data"
REJECTED = "Manually rejected by admin"
INFO_FIELDS = ("birth_date", "birth_place", "death_date", "death_place")


def _one_each(commands: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """One row a key. For each field the last value stated wins, by the column ``order``; of equal order the greatest."""
    return commands.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(order, f))).alias(f) for f in fields])


def protected_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or update slots. A customer's row gives way only to another customer's row.

    Of several new rows for a slot one counts: a customer's before others, then the greatest.
    """
    vals = [c for c in old.columns if c not in KEY]
    stated = [v for v in vals if v in new.columns]
    best = F.struct(F.coalesce(F.col("confidence_level") == CUSTOMER, F.lit(False)) if "confidence_level" in stated else F.lit(False), *stated)
    new = new.groupBy(*KEY).agg(F.max(best).alias("_b")).select(*KEY, *[F.col(f"_b.{v}").alias(v) for v in stated])
    o = old.select(*KEY, F.struct(*vals).alias("_o"))
    n = new.select(*KEY, F.struct(*[F.col(v) if v in new.columns else F.lit(None).alias(v) for v in vals]).alias("_n"))
    both = o.join(n, KEY, "full_outer")
    keep = (F.col("_o.confidence_level") == CUSTOMER) & (F.coalesce(F.col("_n.confidence_level"), F.lit("")) != CUSTOMER)
    return both.select(*KEY, *[F.when(keep, F.col(f"_o.{v}")).otherwise(F.coalesce(f"_n.{v}", f"_o.{v}")).alias(v) for v in vals])


def partial_update(old: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Set the given fields where an update states them; other rows and fields stay. ``order`` names the column
    of ``updates`` that tells which of several is the last."""
    fields = [c for c in updates.columns if c not in keys and c != order]
    u = _one_each(updates, keys, fields, order).select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = old.join(u, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])


def delete_cascade(tables: dict[str, DataFrame], jobs: DataFrame) -> dict[str, DataFrame]:
    """Whole trees gone from every table that holds them."""
    gone = jobs.select(JOB).distinct()
    return {name: df.join(gone, JOB, "left_anti") for name, df in tables.items()}


def purge_candidates(cand: DataFrame, jobs: DataFrame, keep_rejected: bool) -> DataFrame:
    gone = jobs.select(JOB).distinct().withColumn("_gone", F.lit(True))
    tagged = cand.join(gone, JOB, "left")
    stays = F.col("_gone").isNull()
    if keep_rejected:
        stays = stays | (F.coalesce("rejection_reason", F.lit("")) != "")
    return tagged.where(stays).drop("_gone")


def _roots_by_tree(roots: DataFrame) -> DataFrame:
    """At most one entry per slot of the tree."""
    return roots.groupBy(JOB).agg(F.collect_set(SLOT).alias("_roots"))


def prune_subtree(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows not at or above any pruned slot of their tree. Works on slots and on candidates alike."""
    tagged = df.join(_roots_by_tree(roots), JOB, "left")
    hit = F.exists("_roots", lambda r: slots.in_subtree(F.col(SLOT), r))
    return tagged.where(~F.coalesce(hit, F.lit(False))).drop("_roots")


def feedback_rows(anc: DataFrame, commands: DataFrame, action: str, corrected: Column | None = None) -> DataFrame:
    """One decision per command that meets a filled slot."""
    from kinforge.functions.dates import extract_year

    at = anc.join(commands.select(*KEY).distinct(), KEY, "left_semi")
    return at.select(*KEY, F.lit(action).alias("action_type"), F.col("surname"), extract_year(F.col("birth_date"), "bounded").alias("birth_year"), F.col("birth_place").alias("location"),
                     (corrected if corrected is not None else F.lit("{}")).alias("corrected"))


def accept(anc: DataFrame, jobs: DataFrame, commands: DataFrame) -> dict[str, DataFrame]:
    """Marks slots accepted, records it, and lists empty parent slots worth researching."""
    marked = partial_update(anc, commands.select(*KEY).distinct().withColumns({"accepted": F.lit(1), "_order": F.lit(0)}), KEY, "_order")
    at = anc.where(F.coalesce("person_id", F.lit("")) != "").join(commands.select(*KEY).distinct(), KEY, "left_semi").join(jobs.select(JOB, "generations"), JOB)
    top = slots.tree_slots(F.col("generations"))
    wanted = at.where(slots.father_of(F.col(SLOT)) <= top).select(JOB, F.explode(F.array(slots.father_of(F.col(SLOT)), slots.mother_of(F.col(SLOT)))).alias(SLOT))
    return {"ancestors": marked, "feedback": feedback_rows(anc, commands, "accept"), "research": wanted.join(anc.select(*KEY), KEY, "left_anti")}


def reject(anc: DataFrame, cand: DataFrame, commands: DataFrame) -> dict[str, DataFrame]:
    """Records the rejection, marks the person rejected for the slot (adding it if unknown), prunes the subtree.

    Candidates above the slot go with it; the rejected candidate itself is kept, so that it stays excluded.
    Candidates and rejected people meet in one shuffle by tree, in which each is told from the others of its slot
    and pruned with it.
    """
    roots = commands.select(*KEY).distinct()
    at = anc.join(roots, KEY, "left_semi").where(F.coalesce("person_id", F.lit("")) != "")
    out_of = at.select(*KEY, "person_id", F.lit(0).alias("rnk"), "given_name", "surname", "gender", "birth_date", "birth_place", F.lit(REJECTED).alias("rejection_reason"), F.lit(1).alias("_out"))
    first = [*KEY, "person_id"]
    rows = cand.select(*first, *[c for c in cand.columns if c not in first], F.lit(0).alias("_out")).unionByName(out_of, allowMissingColumns=True).repartition(JOB)
    same = Window.partitionBy(*first)
    met = rows.withColumns({"_times": F.sum("_out").over(same), "_all": F.count("*").over(same)})
    # A person who is a candidate already is marked, and once for each slot that held them; one who is not is added.
    met = met.where((F.col("_out") == 0) | (F.col("_all") == F.col("_times")))
    met = met.withColumn("rejection_reason", F.when(F.col("_times") > 0, REJECTED).otherwise(F.col("rejection_reason")))
    hit = F.exists("_roots", lambda r: slots.in_subtree(F.col(SLOT), r))
    left = met.join(_roots_by_tree(roots), JOB, "left").where((F.coalesce("rejection_reason", F.lit("")) != "") | ~F.coalesce(hit, F.lit(False)))
    times = F.when(F.col("_out") == 0, F.greatest(F.col("_times"), F.lit(1))).otherwise(1)
    pruned = left.withColumn("_nth", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_out", "_times", "_all", "_roots", "_nth")
    return {"ancestors": prune_subtree(anc, roots), "candidates": pruned, "feedback": feedback_rows(anc, commands, "reject")}


def choose_candidate(anc: DataFrame, cand: DataFrame, commands: DataFrame) -> dict[str, DataFrame]:
    """Puts a stored candidate into a slot; what stood at and above the slot goes. One choice per slot, the first."""
    picked = first_row(commands.join(cand, [*KEY, "person_id"]), KEY, [F.col("rnk")])
    score = F.col("computed_score")
    slot = F.col(SLOT)
    rows = picked.select(
        *KEY, "person_id", F.concat_ws(" ", "given_name", "surname").alias("name"), F.coalesce(slots.expected_gender(slot), F.lit("Unknown")).alias("gender"), "birth_date", "birth_place",
        F.coalesce(score, F.lit(0)).alias("confidence_score"), evidence.candidate_level(score).alias("confidence_level"), F.when(score > 50, 1).otherwise(0).alias("accepted"))
    kept = prune_subtree(anc, picked)
    return {"ancestors": kept.select(*[c for c in rows.columns]).unionByName(rows), "feedback": feedback_rows(anc, picked, "select_alternative")}


def edit_info(anc: DataFrame, edits: DataFrame, order: str) -> DataFrame:
    """Sets changed fields only, lists them, and drops the missing-information marks they resolve.

    ``missing_info`` is a comma-joined list of marks; ``order`` names the column of ``edits`` that tells which of
    several is the last.
    """
    fields = [f for f in INFO_FIELDS if f in anc.columns and f in edits.columns]
    edits = _one_each(edits, KEY, fields, order)
    j = anc.join(edits.select(*KEY, *[F.col(f).alias(f"_new_{f}") for f in fields]), KEY, "left")

    def changed(f):
        return F.col(f"_new_{f}").isNotNull() & ~F.col(f"_new_{f}").eqNullSafe(F.col(f))

    listed = F.concat_ws(",", *[F.when(changed(f), F.lit(f)) for f in fields])
    marks = F.split("missing_info", ",")
    marks = F.when(changed("birth_place") & (F.col("_new_birth_place") != ""), F.array_remove(marks, "location")).otherwise(marks)
    marks = F.when(changed("birth_date") & (F.col("_new_birth_date") != ""), F.array_remove(marks, "date")).otherwise(marks)
    return j.select(*[F.when(changed(c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else (F.array_join(marks, ",").alias(c) if c == "missing_info" else F.col(c)) for c in anc.columns], listed.alias("changed"))


LOG_TYPE = "array<struct<kind: string, field: string, old_value: string, new_value: string, undone: boolean>>"


def _logged(field: Column, old: Column, new: Column) -> Column:
    kind = F.when(field == "confidence_score", "confidence_adjustment").otherwise("field_correction")
    return F.struct(kind.alias("kind"), field.alias("field"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"), F.lit(False).alias("undone"))


def _correctable(anc: DataFrame) -> list[str]:
    return [c for c in anc.columns if c == "confidence_score" or c in INFO_FIELDS]


def _folded(j: DataFrame, anc: DataFrame, commands: str, step) -> DataFrame:
    """Run a slot's commands one after the other over its correctable fields and its log."""
    fields = _correctable(anc)
    state = F.struct(*[F.col(f).cast("string").alias(f) for f in fields], F.col("corrections_log").alias("log"))
    out = j.withColumn("_s", F.aggregate(F.coalesce(commands, F.array().cast(j.schema[commands].dataType)), state, step))

    def put(c):
        if c == "corrections_log":
            return F.col("_s.log").alias(c)
        return F.col(f"_s.{c}").try_cast(anc.schema[c].dataType).alias(c) if c in fields else F.col(c)

    return out.select(*[put(c) for c in anc.columns])


def _put(state: Column, fields: list[str], field: Column, value: Column, does: Column, log: Column) -> Column:
    return F.struct(*[F.when(does & (field == f), value).otherwise(state[f]).alias(f) for f in fields], log.alias("log"))


def apply_suggestion(anc: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Applies the suggestions of a slot in order of field and value, and logs each.

    A confidence suggestion moves the score by the rounded mean.
    """
    fields = _correctable(anc)
    each = F.struct(F.col("field").alias("f"), F.col("value").alias("v"), "adj_a", "adj_b")
    j = anc.join(suggestions.where(F.col("field").isNotNull()).groupBy(*KEY).agg(F.array_sort(F.collect_list(each)).alias("_c")), KEY, "left")

    def step(s, x):
        mean = F.floor((F.coalesce(x["adj_a"], F.lit(0)) + F.coalesce(x["adj_b"], F.lit(0))) / 2.0 + 0.5).cast("int")
        at = F.coalesce(s["confidence_score"].try_cast("int"), F.lit(0)) if "confidence_score" in fields else F.lit(0)
        value = F.when(x["f"] == "confidence_score", F.greatest(F.lit(0), F.least(F.lit(100), at + mean)).cast("string")).otherwise(x["v"])
        old = first_true([(x["f"] == f, s[f]) for f in fields], "")
        return _put(s, fields, x["f"], value, F.lit(True), F.array_append(s["log"], _logged(x["f"], old, value)))

    return _folded(j, anc, "_c", step)


def undo_correction(anc: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Puts old values back, the latest log entry first, and flags the entries; commands for absent or
    undone entries are refused, and repeated ones count once.

    Returns the new slots and the feedback of the commands that were carried out.
    """
    fields = _correctable(anc)
    j = anc.join(commands.where(F.col("log_index") >= 0).groupBy(*KEY).agg(F.sort_array(F.collect_set(F.col("log_index").cast("int")), asc=False).alias("_c")), KEY, "left")

    def step(s, i):
        entry = F.get(s["log"], i)
        does = F.coalesce(~entry["undone"], F.lit(False))
        log = F.when(does, F.transform(s["log"], lambda e, n: F.when(n == i, e.withField("undone", F.lit(True))).otherwise(e))).otherwise(s["log"])
        return _put(s, fields, entry["field"], entry["old_value"], does, log)

    carried = j.select(*KEY, F.explode(F.transform("_c", lambda i: F.get("corrections_log", i))).alias("_e")).where(~F.col("_e.undone"))
    done = carried.select(*KEY, F.lit("reject").alias("action_type"), F.col("_e.new_value").alias("corrected_to"), F.col("_e.old_value").alias("reverted_to"))
    return _folded(j, anc, "_c", step), done
