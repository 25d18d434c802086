"""Two reviewers' opinions joined, matched, reconciled; the payload they review; learning from feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import corrections as C
from kinforge.functions import names, slots
from kinforge.functions.literals import first_true
from kinforge.operators.ranking import top_rows
from kinforge.operators.tree import JOB, SLOT, empty_slots, tree_context
from kinforge.session import materialized

# --- fixed values ---------------------------------------------------------------------------
# Rows shown unless asked otherwise.
GAPS_SHOWN, EVIDENCE_SHOWN, FEEDBACK_SHOWN, RELEVANT_ROWS = 30, 3, 20, 50
RECENT_DAYS, ERA_MARGIN = 30, 50
SAME_NAME, LIKE_NAME, LIKE_PLACE, SAME_ERA, FRESH = 30, 15, 20, 10, 5
# Years fall into spans of 1, 2, 4 ... years; a tree's era is a few whole spans. Longer than any era.
SPANS = 12


def pack_flags(flag: DataFrame) -> DataFrame:
    """Flags of each reviewer as the ordered array a review carries for one slot."""
    item = F.struct("pos", "severity", "suggestion")

    def of(who):
        return F.array_sort(F.collect_list(F.when(F.col("reviewer") == who, item))).alias(f"flags_{who}")

    return flag.groupBy(JOB, SLOT).agg(of("a"), of("b"))


def reviewers_joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every slot either reviewer wrote about, both opinions side by side."""
    return a.join(b, [JOB, SLOT], "full_outer")


def flags_matched(packed: DataFrame) -> DataFrame:
    """Each flag of the first reviewer with the first agreeing flag of the second, then the second's
    unmatched flags. Both arrays sit in the slot's own row, so nothing is joined or paired up."""
    def agrees(x, y):
        return C.corrections_agree(x["suggestion"], y["suggestion"])

    left = F.transform("flags_a", lambda x: F.struct(x.alias("a"), F.get(F.filter("flags_b", lambda y: agrees(x, y)), F.lit(0)).alias("b")))
    no_flag = F.expr("cast(null as struct<pos: int, severity: string, suggestion: string>)")
    alone = F.filter("flags_b", lambda y: ~F.exists("flags_a", lambda x: agrees(x, y)))
    right = F.transform(alone, lambda y: F.struct(no_flag.alias("a"), y.alias("b")))
    return packed.select(JOB, SLOT, F.explode(F.concat(left, right)).alias("m")).select(JOB, SLOT, F.col("m.a").alias("flag_a"), F.col("m.b").alias("flag_b"))


def _open_to_change(anc: DataFrame) -> DataFrame:
    return anc.where((F.col(SLOT) > 1) & (F.col("confidence_level") != "Customer Data"))


def agreed_adjustment(a: Column, b: Column) -> Column:
    """Rounded mean when both point the same way and lie close for their size; else null. Rounds half up."""
    mean = (a + b) / 2.0
    near = first_true([(F.abs(mean) >= 20, 15), (F.abs(mean) >= 10, 8)], 2)
    ok = (a != 0) & (b != 0) & (F.abs(a - b) <= near) & (F.signum(a) == F.signum(b))
    return F.when(ok, F.floor(mean + 0.5).cast("int"))


def adjust_confidence(anc: DataFrame, review: DataFrame) -> DataFrame:
    """Adjustments to apply and to suggest, one row per slot that gets either."""
    both = _open_to_change(anc).join(review, [JOB, SLOT])
    a, b = F.coalesce("adj_a", F.lit(0)), F.coalesce("adj_b", F.lit(0))
    step = agreed_adjustment(a, b)
    old = F.coalesce("confidence_score", F.lit(0))
    new = F.greatest(F.lit(0), F.least(F.lit(100), old + step))
    action = F.when(step.isNotNull(), F.when(new != old, "apply")).when(((a != 0) | (b != 0)) & (F.abs(a - b) > 2), "suggest")
    out = both.select(JOB, SLOT, action.alias("action"), F.lit("confidence_score").alias("field"), old.cast("string").alias("old_value"), F.when(step.isNotNull(), new).cast("string").alias("new_value"), F.lit("both").alias("said_by"))
    return out.where(F.col("action").isNotNull())


def adjust_fields(anc: DataFrame, packed: DataFrame, civil: DataFrame) -> DataFrame:
    """Field corrections: agreed and confirmed by the civil index are applied, the rest suggested.

    ``civil`` is (job, slot, civil_birth, civil_death), the years of matched entries.
    """
    open_rows = _open_to_change(anc).select(JOB, SLOT, "birth_date", "birth_place", "death_date")
    m = flags_matched(packed).join(open_rows, [JOB, SLOT]).join(civil, [JOB, SLOT], "left")
    said = F.coalesce("flag_a.suggestion", "flag_b.suggestion")
    m = m.withColumn("said", said).withColumn("fix", C.parse_correction(F.col("said"))).where(F.col("fix").isNotNull())
    by = first_true([(F.col("flag_a").isNull(), "b"), (F.col("flag_b").isNull(), "a")], "both")
    ok = C.civil_confirms(F.col("said"), F.col("civil_birth"), F.col("civil_death"))
    field = F.col("fix.field")
    old = first_true([(field == "birth_date", F.col("birth_date")), (field == "birth_place", F.col("birth_place")), (field == "death_date", F.col("death_date"))], "")
    action = first_true([((by == "both") & ok, "apply"), (by == "both", "suggest")], "suggest_single")
    return m.select(JOB, SLOT, action.alias("action"), field.alias("field"), old.alias("old_value"), F.col("fix.value").alias("new_value"), by.alias("said_by"))


def consensus(anc: DataFrame, review: DataFrame, packed: DataFrame, civil: DataFrame) -> DataFrame:
    """All decisions; rows with action ``apply`` change the tree, the others wait for the operator."""
    return adjust_confidence(anc, review).unionByName(adjust_fields(anc, packed, civil))


def reviews_store(packed: DataFrame, review: DataFrame) -> DataFrame:
    """Per slot a map from reviewer to what was said."""
    both = packed.join(review, [JOB, SLOT], "full_outer")

    def entry(who):
        has = F.size(f"flags_{who}") > 0
        return F.when(has | (F.coalesce(f"adj_{who}", F.lit(0)) != 0), F.struct(F.lit(who).alias("key"), F.struct(F.coalesce(F.size(f"flags_{who}"), F.lit(0)).alias("flags"), F.coalesce(f"adj_{who}", F.lit(0)).alias("adjustment")).alias("value")))

    return both.select(JOB, SLOT, F.map_from_entries(F.array_compact(F.array(entry("a"), entry("b")))).alias("review"))


def flag_counts(flag: DataFrame) -> DataFrame:
    s = F.col("severity")
    n = flag.groupBy(JOB, SLOT).agg(F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"), F.count_if(s == "confirmation").alias("confirmations"))
    return n.withColumn("worst", first_true([(F.col("errors") > 0, "error"), (F.col("warnings") > 0, "warning"), (F.col("confirmations") > 0, "confirmation")], "none"))


def gaps_merged(flag: DataFrame) -> DataFrame:
    """Both reviewers' texts for each slot in reviewer and position order."""
    said = F.array_sort(F.collect_list(F.struct("reviewer", "pos", "suggestion")))
    return flag.groupBy(JOB, SLOT).agg(F.array_join(F.transform(said, lambda x: F.concat_ws(": ", x["reviewer"], x["suggestion"])), " | ").alias("suggestions"))


def unique_lookups(flag: DataFrame) -> DataFrame:
    """Distinct texts per slot in first-seen order; repeats collapse before they are gathered."""
    once = flag.groupBy(JOB, SLOT, "suggestion").agg(F.min(F.struct("reviewer", "pos")).alias("seen"))
    listed = F.array_sort(F.collect_list(F.struct("seen", "suggestion")))
    return once.groupBy(JOB, SLOT).agg(F.array_join(F.transform(listed, lambda x: x["suggestion"]), " | ").alias("lookups"))


def _spans_of(year: Column) -> Column:
    """The span of every length that a year lies in."""
    return F.array(*(F.concat_ws(":", F.lit(j), F.floor(year / (1 << j))) for j in range(SPANS)))


def _spans_within(lo: Column, hi: Column) -> Column:
    """The fewest spans that make up the years ``lo`` to ``hi``: those inside whose own double is not."""
    found = []
    for j in range(SPANS):
        size = 1 << j
        first, last = F.ceil(lo / size), F.floor((hi + 1) / size) - 1

        def whole(n: Column, size: int = size) -> Column:
            up = F.floor(n / 2)
            return F.when((first <= last) & ((up * 2 * size < lo) | ((up + 1) * 2 * size - 1 > hi)), F.concat_ws(":", F.lit(j), n))  # noqa: B023

        found += [whole(first), whole(last)]
    return F.array_distinct(F.array_compact(F.array(*found)))


def _texts_alike(asked: DataFrame, known: DataFrame) -> DataFrame:
    """t, k: distinct texts of which one holds the other, themselves included, by the starts of their suffixes."""
    inner = lambda name: F.explode(names.parts_inside(F.col(name), 1))
    same = asked.join(known, F.col("t") == F.col("k")).select("t", "k")
    return same.unionByName(asked.select("t", inner("t").alias("k")).join(known, "k").select("t", "k")).unionByName(known.select("k", inner("k").alias("t")).join(asked, "t").select("t", "k")).distinct()


def feedback_index(feedback: DataFrame, keep: int) -> DataFrame:
    """surname, location, span, id, action_type, created_at: the ``keep`` newest decisions of every key.

    A key is a surname or none, a location or none, and a span of birth years or none; blank stands for
    none. More than ``keep`` decisions of one key can never be shown to a tree, so a key however frequent
    holds that many, and each task sends no more of it.
    """
    row = feedback.select("id", "created_at", "action_type", F.lower(F.coalesce("surname", F.lit(""))).alias("s"), F.lower(F.coalesce("location", F.lit(""))).alias("l"), F.col("birth_year").alias("y"))
    either = lambda c: F.explode(F.array_distinct(F.array(F.col(c), F.lit(""))))
    spans = F.array_union(F.array(F.lit("")), F.coalesce(F.when(F.col("y").isNotNull(), _spans_of(F.col("y"))), F.expr("cast(array() as array<string>)")))
    keyed = row.withColumn("surname", either("s")).withColumn("location", either("l")).withColumn("span", F.explode(spans))
    newest = top_rows(keyed, ["surname", "location", "span"], [F.desc("created_at"), F.desc("id")], keep, "nth")
    return newest.select("surname", "location", "span", "id", "action_type", "created_at")


def feedback_relevance(feedback: DataFrame, anc: DataFrame, as_of: Column | None = None, keep: int = RELEVANT_ROWS, latest: int | None = None) -> DataFrame:
    """For every tree the ``keep`` most relevant of all decisions (or of the ``latest``), newest first on a tie.

    A decision counts 30 for a surname of the tree (15 where one holds the other), 20 for a place of the tree
    (one holds the other), 10 for a birth year within fifty of the tree's, 5 for the last thirty days.

    Decisions stand in an index by what can count (``feedback_index``). A tree asks by its surnames and places, or
    by none, and by the spans of its era, or by none. What a key is short of is points alone, so the best of
    a tree are among the newest of its keys, and the most that a decision scores by any key is its score.
    """
    if latest is not None:
        feedback = feedback.orderBy(F.desc("created_at"), F.desc("id")).limit(latest)
    index = materialized(feedback_index(feedback, keep))
    own = anc.select(JOB, F.lower("surname").alias("surname"), F.lower("birth_place").alias("place"))

    def matches(column: str, key: str) -> DataFrame:
        mine = own.select(JOB, F.col(column).alias("t")).where("t <> ''").distinct()
        met = _texts_alike(mine.select("t").distinct(), index.select(F.col(key).alias("k")).where("k <> ''").distinct())
        return mine.join(met, "t").select(JOB, "t", F.col("k").alias(key))

    by_name = matches("surname", "surname").groupBy(JOB, "surname").agg(F.max(F.when(F.col("t") == F.col("surname"), SAME_NAME).otherwise(LIKE_NAME)).alias("name_points"))
    by_place = matches("place", "location").groupBy(JOB, "location").agg(F.lit(LIKE_PLACE).alias("place_points"))
    trees = tree_context(anc).select(JOB, "year_from", "year_to")
    none = lambda name, points: trees.select(JOB, F.lit("").alias(name), F.lit(0).alias(points))
    spans = F.coalesce(F.when(F.col("year_from").isNotNull(), _spans_within(F.col("year_from") - ERA_MARGIN, F.col("year_to") + ERA_MARGIN)), F.expr("cast(array() as array<string>)"))
    era = trees.select(JOB, F.explode(F.array_union(F.array(F.lit("")), spans)).alias("span")).withColumn("era_points", F.when(F.col("span") != "", SAME_ERA).otherwise(0))
    asked = by_name.unionByName(none("surname", "name_points")).join(by_place.unionByName(none("location", "place_points")), JOB).join(era, JOB)
    now = as_of if as_of is not None else feedback.agg(F.max("created_at").alias("now")).scalar()
    fresh = F.when(F.col("created_at") > now - F.expr(f"interval {RECENT_DAYS} days"), FRESH).otherwise(0)

    key = ["surname", "location", "span"]
    points = F.col("name_points") + F.col("place_points") + F.col("era_points") + fresh
    found = asked.join(index, key).select(JOB, "id", "action_type", "created_at", points.alias("points"))
    scored = found.groupBy(JOB, "id", "action_type", "created_at").agg(F.max("points").alias("relevance")).where("relevance > 0")
    return top_rows(scored, JOB, [F.desc("relevance"), F.desc("created_at"), F.desc("id")], keep, "nth").select(JOB, "id", "action_type", "relevance")


def review_payload(anc: DataFrame, jobs: DataFrame, evidence_rows: DataFrame, feedback: DataFrame, gaps_shown: int = GAPS_SHOWN, evidence_shown: int = EVIDENCE_SHOWN, feedback_shown: int = FEEDBACK_SHOWN) -> DataFrame:
    """One JSON document per tree: slots with role and first evidence, gaps, level counts, feedback.

    Everything gathered per tree is bounded: slots by the tree, evidence, gaps and feedback by what is shown.
    """
    shown = top_rows(evidence_rows, "person_id", [F.col("seq")], evidence_shown).groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("evidence"))
    from kinforge.operators.scoring import attach_person

    rows = attach_person(anc, shown).withColumn("role", slots.slot_role(F.col(SLOT)))
    item = F.struct(F.col(SLOT).alias("slot"), "role", "name", "gender", "birth_date", "birth_place", "confidence_score", "confidence_level", "discovery_method", "evidence")
    lv = F.col("confidence_level")
    people = rows.groupBy(JOB).agg(F.array_sort(F.collect_list(item)).alias("slots"), F.count("*").alias("found"), F.count_if(lv == "Customer Data").alias("given"), F.sum(F.coalesce(F.size("evidence"), F.lit(0))).alias("evidence_rows"))
    gaps = empty_slots(anc, jobs).groupBy(JOB).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col(SLOT).alias("slot"), "role", "child_name"))), 1, gaps_shown).alias("gaps"))
    told = feedback_relevance(feedback, anc, keep=max(feedback_shown, 1)).groupBy(JOB).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("neg"), "id", "action_type"))), 1, feedback_shown).alias("feedback"))
    out = jobs.select(JOB, "customer_name", "generations").join(people, JOB).join(gaps, JOB, "left").join(told, JOB, "left")
    doc = F.to_json(F.struct("customer_name", "generations", "slots", "gaps", "feedback", F.struct("found", "given", slots.tree_slots(F.col("generations")).alias("expected")).alias("statistics")))
    return out.select(JOB, "found", "given", "evidence_rows", F.coalesce(F.size("gaps"), F.lit(0)).alias("gaps_shown"), F.get(F.col("gaps"), F.lit(0))["slot"].alias("first_gap"),
                      F.coalesce(F.size("feedback"), F.lit(0)).alias("feedback_shown"), doc.alias("document"))
