"""Evidence points and the confidence of every tree position, all trees at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions import evidence, names, places, slots
from kinforge.functions import values as V
from kinforge.functions.dates import date_year
from kinforge.functions.literals import bind, first_true
from kinforge.operators.gazetteer import place_dimension, proximity, with_place
from kinforge.operators.ranking import first_row
from kinforge.session import materialized
from kinforge.operators.tree import JOB, SLOT, earlier_same_county, with_child

PERSON = "person_id"

# --- fixed values: points -----------------------------------------------------------------
FACTS_MOST, FAMILY_MOST, PLACE_MOST = 33, 23, 17
METHOD_POINTS = {"tree_parents_verified": 8, "direct_search_verified": 8, "tree_parents_unverified": 3}
CHILD_CUSTOMER = 10
CHILD_POINTS = ((90, 8), (75, 6), (50, 3), (0, 1))  # least score of the child, points; the last for any score
SHORT_TITLE_MARKS = {"location": "no place", "date": "no birth year", "records": "no records", "confidence": "low confidence"}


def distinct_sources(src: DataFrame) -> DataFrame:
    """First citation per title, then first per evidence key; the key comes from the kept title.

    Both steps are aggregates, so repeated citations collapse before the shuffle.
    """
    titled = src.withColumn("_title", evidence.normalized_title(F.col("title")))
    once = first_row(titled, [PERSON, "_title"], [F.col("seq")]).drop("_title")
    keyed = once.select("*", F.inline(F.array(evidence.classify_source(F.col("title"))))).drop("sub_type")
    return first_row(keyed, [PERSON, "key"], [F.col("seq")])


def source_summary(src: DataFrame) -> DataFrame:
    """Per person: points (records per category up to its cap), records counted, and the county
    named by the first citation that names one. Three shrinking aggregates, no window."""
    titled = src.withColumn("_title", evidence.normalized_title(F.col("title"))).withColumn(
        "_county", places.cited_county(F.concat_ws(" ", "citation", "title")))
    cited = F.when(F.col("_county").isNotNull(), F.col("seq"))
    once = titled.groupBy(PERSON, "_title").agg(F.min("seq").alias("seq"), F.min_by("title", "seq").alias("title"), F.min(cited).alias("cited"), F.min_by("_county", cited).alias("_county"))
    # inline: the class is worked out once a row, not once for each of its fields.
    once = once.select(PERSON, "seq", "cited", "_county", evidence.lowered(F.col("title")).alias("_low"))
    keyed = once.select(PERSON, "seq", "cited", "_county", F.inline(F.array(evidence.classify_lowered(F.col("_low")))))
    records = keyed.groupBy(PERSON, "key").agg(F.min_by("category", "seq").alias("category"), F.min("cited").alias("cited"), F.min_by("_county", "cited").alias("_county"))
    points, counted = F.lit(0), F.lit(0)
    for name, (pts, cap) in V.CATEGORY_POINTS.items():
        n = F.least(F.count_if(F.col("category") == name), F.lit(cap))
        points, counted = points + n * pts, counted + n
    return records.groupBy(PERSON).agg(points.cast("int").alias("source_points"), counted.cast("int").alias("records"),
                                       F.min_by("_county", "cited").alias("citation_place"))


def source_points(src: DataFrame) -> DataFrame:
    return source_summary(src).select(PERSON, "source_points", "records")


def category_cap(src: DataFrame) -> DataFrame:
    """The citations that count: the first of each category up to its cap, in the order seen."""
    most = max(cap for _, cap in V.CATEGORY_POINTS.values())
    w = Window.partitionBy(PERSON, "category").orderBy("seq")
    ranked = distinct_sources(src).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    kept = ranked.where(F.col("nth") <= evidence.category_cap(F.col("category")))
    return kept.withColumn("weight", evidence.category_points(F.col("category")))


FACT_BUCKETS = ("census", "birth", "marriage", "death", "residence", "baptism", "burial")


def fact_bucket(kind):
    """First rule that fits the fact type wins; a christening counts as a birth."""
    t = F.lower(kind)
    return first_true([(t.contains(b) | t.contains("christening") if b == "birth" else t.contains(b), b) for b in FACT_BUCKETS], "other")


def fact_summary(fact: DataFrame) -> DataFrame:
    """Per person: capped fact points, and the best place on record (birth, baptism, residence,
    burial, census; the first fact of a kind)."""
    # Named first, so the bucket is worked out once a row and not once an aggregate.
    fact = fact.select(PERSON, "seq", "fact_place", fact_bucket(F.col("fact_type")).alias("bucket"), (F.trim("fact_date") != "").alias("has_date"), (F.trim("fact_place") != "").alias("has_place"))
    b, has_date, has_place = F.col("bucket"), F.col("has_date"), F.col("has_place")
    birth = b.isin("birth", "baptism")

    def any_of(cond, pts):
        return F.max(F.when(cond, pts).otherwise(0))

    def two_of(cond):
        return F.least(F.count_if(cond), F.lit(2)) * 3

    total = (any_of(birth & has_date, 5) + any_of(birth & has_place, 5) + any_of((b == "death") & has_date, 3) + any_of((b == "death") & has_place, 3)
             + any_of(b == "marriage", 5) + two_of((b == "residence") & has_place) + two_of((b == "census") & (has_date | has_place)))
    order = ("birth", "baptism", "residence", "burial", "census")
    rank = first_true([(b == k, i) for i, k in enumerate(order)])
    # Kind, then order recorded, as one number: cheaper to compare than a struct.
    order_no = F.when(has_place, rank.cast("bigint") * (1 << 40) + F.col("seq"))
    return fact.groupBy(PERSON).agg(F.least(total, F.lit(FACTS_MOST)).cast("int").alias("fact_points"), F.min_by("fact_place", order_no).alias("fact_place"))


def fact_points(fact: DataFrame) -> DataFrame:
    return fact_summary(fact).select(PERSON, "fact_points")


def attach_person(anc: DataFrame, *summaries: DataFrame) -> DataFrame:
    """Left-join per-person summaries. Slots without a person get a key of their own, so the
    blank id does not send them all to one task."""
    own = F.concat_ws("#", F.lit(""), F.col(JOB).cast("string"), F.col(SLOT).cast("string"))
    out = anc.withColumn("_person", F.when(F.coalesce(PERSON, F.lit("")) != "", F.col(PERSON)).otherwise(own))
    for s in summaries:
        out = out.join(s.withColumnRenamed(PERSON, "_person"), "_person", "left")
    return out.drop("_person")


def source_verify(src: DataFrame) -> DataFrame:
    """Primary citations and undeduplicated points per person."""
    low = src.select(PERSON, evidence.lowered(F.col("title")).alias("_low"))
    return low.select(PERSON, evidence.source_category(F.col("_low")).alias("category")).groupBy(PERSON).agg(
        F.count_if(evidence.is_primary(F.col("category"))).cast("int").alias("primary_count"),
        F.sum(evidence.category_points(F.col("category"))).cast("int").alias("raw_points"), F.count("*").cast("int").alias("citations"))


def _is_customer(level):
    return level == "Customer Data"


def with_places(anc: DataFrame, src: DataFrame, fact: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Adds the best known place, its county, seat and town. Customer rows keep the place they gave."""
    return _placed(attach_person(anc, source_summary(src), fact_summary(fact)), gazetteer)


def _placed(looked_up: DataFrame, gazetteer: DataFrame | None) -> DataFrame:
    given = F.when(F.col("birth_place") != "", F.col("birth_place"))
    found = F.when(~_is_customer(F.col("confidence_level")), F.coalesce("fact_place", "citation_place"))
    # Written once: the dimension and the rows it is joined to both read it.
    placed = materialized(looked_up.withColumn("place", F.coalesce(given, found)))
    dimension = place_dimension(placed.select("place"), gazetteer)
    return with_place(placed, dimension, "place", stated_county="stated_county", town="town", seat="stated_seat").withColumn("county", F.col("seat.county"))


def place_date_points(placed: DataFrame) -> DataFrame:
    """Place and date agreement with the child: county, town, age gap, county seen earlier in the generation.

    ``year`` of the birth date is read here unless the rows bring it."""
    dated = placed if "year" in placed.columns else placed.withColumn("year", date_year(F.col("birth_date")))
    seen = earlier_same_county(dated)
    both = with_child(seen, ["seat", "town", "year", "surname", "confidence_level", "name"])
    prox = proximity(F.col("seat"), F.col("child_seat"))
    town = F.when(F.col("town") == F.col("child_town"), 3).otherwise(0)
    where = first_true([(prox == "same", F.lit(5) + town), (prox == "adjacent", 2), (prox == "distant", -15)], 0)
    gap = F.col("child_year") - F.col("year")
    age = first_true([(gap < 0, -50), ((gap < 15) | (gap > 55), -30), (gap.between(22, 35), 7), (gap.between(18, 45), 5)], 0)
    again = F.when(F.col("earlier_same_county"), 2).otherwise(0)
    has_child = F.col("child_name").isNotNull() & (F.col(SLOT) > 1)
    return both.withColumn("place_points", F.when(has_child, F.least(where + age + again, F.lit(PLACE_MOST))).otherwise(0).cast("int"))


def _method_points(method):
    return first_true([(method == k, v) for k, v in METHOD_POINTS.items()], 0)


def _surname_points(slot, own, childs):
    known = F.coalesce(own, F.lit("")) != ""
    father = F.when(F.lower(own) == F.lower(childs), 5).otherwise(-15)
    return F.when(~known, 0).when(slots.is_father(slot), F.when(F.coalesce(childs, F.lit("")) != "", father).otherwise(0)).otherwise(3)


def _child_class(child_score):
    """Which entry of CHILD_POINTS a child's score falls under; one behind the last if it has none."""
    return first_true([(child_score >= least, i) for i, (least, _) in enumerate(CHILD_POINTS[:-1])] + [(child_score.isNotNull(), len(CHILD_POINTS) - 1)], len(CHILD_POINTS))


def _child_points(child_is_customer, child_score):
    brought = [(child_score >= least, points) for least, points in CHILD_POINTS[:-1]]
    return first_true([(child_is_customer, CHILD_CUSTOMER), *brought, (child_score.isNotNull(), CHILD_POINTS[-1][1])], 0)


def _gate(score, has_surname, has_year, has_place):
    capped = F.when(~has_surname, F.least(score, F.lit(49))).otherwise(score)
    return F.when(~has_surname & ~has_year & ~has_place, F.least(capped, F.lit(35))).otherwise(capped)


def record_scoring(anc: DataFrame, src: DataFrame, fact: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Confidence of every slot from sources, facts, family and place.

    Everything but the child's own score is computed flat: a slot's score under each number of points that
    its child may bring. The one sequential dependence, which of them it is, is a fold over the slots of one tree
    in slot order (each tree at most 2^(g+1) - 1 rows), so the generations cost one shuffle, not one each.
    """
    placed = with_places(anc, src, fact, gazetteer).select(
        JOB, SLOT, "gen", PERSON, "name", "surname", "birth_date", date_year(F.col("birth_date")).alias("year"), "confidence_level", "discovery_method",
        "source_points", "fact_points", "place", "stated_county", "town", "seat", "county")
    # Both a slot and its child are read from here: written once, the citations and facts are aggregated and the dates read once.
    flat = place_date_points(materialized(placed))
    customer, has_child = _is_customer(F.col("confidence_level")), F.col("child_name").isNotNull() & (F.col(SLOT) > 1)
    flat = flat.select(
        JOB, F.col(SLOT).alias("slot"), customer.alias("customer"),
        F.coalesce("source_points", F.lit(0)).alias("source_points"), F.coalesce("fact_points", F.lit(0)).alias("fact_points"), "place_points",
        (F.col(SLOT) > 1).alias("above"), F.coalesce(_is_customer(F.col("child_confidence_level")), F.lit(False)).alias("child_customer"),
        (F.when(has_child, _surname_points(F.col(SLOT), F.col("surname"), F.col("child_surname"))).otherwise(0)
         + _method_points(F.col("discovery_method"))).alias("family_fixed"),
        (F.length(F.trim(F.coalesce("surname", F.lit("")))) > 1).alias("has_surname"),
        (F.coalesce("birth_date", F.lit("")) != "").alias("has_year"),
        F.col("place").isNotNull().alias("has_place"),
        (F.coalesce(PERSON, F.lit("")) != "").alias("has_person"))

    def score_with(child_points: int) -> Column:
        brought = F.when(F.col("child_customer"), CHILD_CUSTOMER).otherwise(child_points)
        family = F.when(F.col("above"), F.least(brought + F.col("family_fixed"), F.lit(FAMILY_MOST))).otherwise(0)
        total = F.col("source_points") + F.col("fact_points") + F.col("place_points") + family
        return F.when(F.col("customer"), 100).otherwise(_gate(evidence.confidence_from_points(total), F.col("has_surname"), F.col("has_year"), F.col("has_place"))).cast("int")

    flat = flat.withColumn("outcomes", F.array(*(score_with(points) for _, points in CHILD_POINTS), score_with(0)))
    trees = flat.groupBy(JOB).agg(F.array_sort(F.collect_list(F.struct(*(x for x in flat.columns if x != JOB)))).alias("slots"))

    def score_of(x, scores):
        return bind(F.try_element_at(scores, slots.child_of(x["slot"])), lambda child: F.get(x["outcomes"], _child_class(child)))

    def step(scores, x):
        return F.map_concat(scores, F.map_from_arrays(F.array(x["slot"]), F.array(score_of(x, scores))))

    empty = F.expr("cast(map() as map<int, int>)")
    scored = trees.withColumn("scores", F.aggregate("slots", empty, step))
    rows = scored.select(JOB, "scores", F.explode("slots").alias("s")).select(
        JOB, F.col("s.slot").alias(SLOT), "s.*", F.try_element_at("scores", F.col("s.slot")).alias("score"),
        F.try_element_at("scores", slots.child_of(F.col("s.slot"))).alias("child_score")).drop("slot", "outcomes")
    fam = F.when(F.col("above"), F.least(_child_points(F.col("child_customer"), F.col("child_score")) + F.col("family_fixed"), F.lit(FAMILY_MOST))).otherwise(0)
    fixed = F.col("customer")
    level = F.when(fixed, "Customer Data").otherwise(evidence.confidence_level(F.col("score")))
    missing = F.concat_ws(
        ", ",
        F.when(~F.col("has_place") & (F.col("score") < 75), "location"), F.when(~F.col("has_year") & (F.col("score") < 75), "date"),
        F.when((F.col("source_points") == 0) & F.col("has_person"), "records"), F.when(F.col("score") < 50, "confidence"))

    def scored_only(value):
        return F.when(fixed, F.lit(None).cast("int")).otherwise(value.cast("int"))

    total = F.col("source_points") + F.col("fact_points") + fam + F.col("place_points")
    return rows.select(
        JOB, SLOT, scored_only(F.col("source_points")).alias("source_points"), scored_only(F.col("fact_points")).alias("fact_points"),
        scored_only(fam).alias("family_points"), scored_only(F.col("place_points")).alias("place_points"), scored_only(total).alias("total_points"),
        "score", level.alias("level"), F.when(fixed | (F.col("score") >= 75), 1).otherwise(0).alias("accepted"),
        F.when(fixed, "").otherwise(missing).alias("missing"))


def family_points(scored: DataFrame, anc: DataFrame) -> DataFrame:
    """Family points of every slot against scores already known (one round of the fold, as a join)."""
    known = anc.join(scored.select(JOB, SLOT, "score"), [JOB, SLOT])
    both = with_child(known, ["score", "surname", "confidence_level", "name"])
    has_child = F.col("child_name").isNotNull()
    pts = (_child_points(_is_customer(F.col("child_confidence_level")), F.col("child_score"))
           + F.when(has_child, _surname_points(F.col(SLOT), F.col("surname"), F.col("child_surname"))).otherwise(0)
           + _method_points(F.col("discovery_method")))
    return both.select(JOB, SLOT, F.when(F.col(SLOT) > 1, F.least(pts, F.lit(FAMILY_MOST))).otherwise(0).cast("int").alias("family_points"))


def level_counts(scored: DataFrame) -> DataFrame:
    """Per tree: rows at each level; what the customer gave counts as verified."""
    lv = F.col("level")
    return scored.groupBy(JOB).agg(
        F.count("*").alias("total"), F.count_if(lv.isin("Verified", "Customer Data")).alias("verified"), F.count_if(lv == "Probable").alias("probable"),
        F.count_if(lv == "Possible").alias("possible"), F.count_if(lv == "Suggested").alias("suggested"))
