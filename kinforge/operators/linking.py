"""Search results linked to tree positions, and parents discovered generation by generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions import names, places, slots
from kinforge.functions.dates import date_year
from kinforge.functions.literals import first_true
from kinforge.operators.gazetteer import all_places, place_dimension, proximity, with_place
from kinforge.operators.ranking import best_row, first_row, top_rows
from kinforge.operators.tree import JOB, SLOT
from kinforge.session import materialized

KEY = [JOB, SLOT]
REGISTRATION = 1837
# --- fixed values: years a generation is apart, and the gap a parent may have ------------------
GENERATION_YEARS, YOUNGEST, OLDEST = 28, 12, 55


def rejected_people(cand: DataFrame) -> DataFrame:
    return cand.where((F.coalesce("rejection_reason", F.lit("")) != "") & (F.col("person_id") != "")).select(JOB, "person_id").distinct()


def exclude_rejected(df: DataFrame, rejected: DataFrame) -> DataFrame:
    return df.join(rejected, [JOB, "person_id"], "left_anti")


def newly_found(now: DataFrame, before: DataFrame) -> DataFrame:
    """Slots with a person that the earlier snapshot did not hold."""
    return now.where(F.coalesce("person_id", F.lit("")) != "").join(before.select(*KEY), KEY, "left_anti")


# Blocking ---------------------------------------------------------------------------------------
def surname_keys(surname: Column) -> Column:
    """The surname, its halves and the spelling variants of each, lower case."""
    halves = names.surname_halves(F.lower(surname))
    return F.array_distinct(F.concat(F.array(F.lower(surname)), halves, F.transform(names.surname_variants(surname), lambda v: F.lower(v))))


def contained_surnames(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """s, k: distinct surnames of which one stands inside the other, from three letters on.

    ``asked(s)`` and ``pool(k)`` are distinct surnames. Each is opened into the starts of its suffixes, and the
    other side's whole names meet those by equality; no two names are compared, and rows never come in.
    """
    names_in = asked.select("s", F.explode(names.parts_inside(F.col("s"))).alias("k")).join(pool, "k").select("s", "k")
    held_by = pool.select("k", F.explode(names.parts_inside(F.col("k"))).alias("s")).join(asked, "s").select("s", "k")
    return names_in.unionByName(held_by).distinct()


def block_candidates(targets: DataFrame, pool: DataFrame, keep: int = 10, reach: int = 5, by_given: bool = True) -> DataFrame:
    """The ``keep`` nearest people of the pool for every target, in rank order.

    ``targets``: job, slot, surname, given, year, place. ``pool``: person_id, surname, given, year, place.
    People block on a surname key (and first given name) and lie within ``reach`` years; the same
    district is asked first and dropped if nobody is there. Surnames meet whole, by their halves on both
    sides and by spelling variants; those that only stand inside one another come behind all these.

    Both sides meet as signatures. A pool signature carries its first ``keep`` people, which is all that
    can be shown of it, so a name shared by a third of the pool is one row, not a quadratic join.
    """
    g = ["g"] if by_given else []
    given = names.first_word(F.col("given"))
    t = targets.select(*KEY, F.lower("surname").alias("s"), given.alias("g"), F.col("year").alias("y"), F.lower(places.district_of(F.col("place"))).alias("d")).where("s <> '' and y is not null")
    p = pool.select("person_id", F.lower("surname").alias("k"), given.alias("g"), F.col("year").alias("py"), F.lower(places.district_of(F.col("place"))).alias("d")).where("py is not null and k <> ''")

    def signatures(by: list[str]) -> DataFrame:
        return top_rows(p, by, [F.col("person_id")], keep, "nth").groupBy(*by).agg(F.array_sort(F.collect_list("person_id")).alias("people"))

    asked = t.select("s", "g", "y", "d").distinct()
    wanted, held = materialized(asked.select("s").distinct()), materialized(p.select("k").distinct())
    # What a surname is asked by meets what a held one is known by; both are lists of distinct surnames.
    known = held.select("k", F.explode(F.array_distinct(F.concat(F.array("k"), names.surname_halves(F.col("k"))))).alias("key"))
    close = wanted.select("s", F.explode(surname_keys(F.col("s"))).alias("key")).join(known, "key").select("s", "k", F.lit(0).alias("far"))
    inside = contained_surnames(wanted, held).withColumn("far", F.lit(1))
    meets = materialized(close.unionByName(inside).groupBy("s", "k").agg(F.min("far").alias("far")))

    opened = asked.join(meets, "s").withColumn("py", F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach)))
    near = opened.where("d <> ''").join(signatures(["k", *g, "py", "d"]), ["k", *g, "py", "d"])
    near = near.select("s", "g" if by_given else opened["g"], "y", "d", "far", "py", "people")
    answered = near.select("s", "g", "y", "d").distinct()
    wide = opened.join(answered, ["s", "g", "y", "d"], "left_anti").join(signatures(["k", *g, "py"]), ["k", *g, "py"]).select("s", "g", "y", "d", "far", "py", "people")
    people = near.withColumn("same_place", F.lit(True)).unionByName(wide.withColumn("same_place", F.lit(False)))
    people = people.select("s", "g", "y", "d", "same_place", "far", F.abs(F.col("py") - F.col("y")).alias("off"), F.explode("people").alias("person_id"))
    shown = top_rows(people, ["s", "g", "y", "d"], [F.col("far"), F.col("off"), F.col("person_id")], keep, "rnk")
    return t.join(shown, ["s", "g", "y", "d"]).select(*KEY, "rnk", "person_id", "same_place", F.col("off").alias("years_off"))


# Checks on a candidate ----------------------------------------------------------------------------
def known_places(*tables: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """The dimension of all birth places of some tables."""
    return place_dimension(all_places(*((t, "birth_place") for t in tables)), gazetteer)


def with_family_years(anc: DataFrame) -> DataFrame:
    """Each slot with its own year and place, its child's, and the subject's year of its tree."""
    base = anc.select(*KEY, "gen", "person_id", "name", "birth_place", date_year(F.col("birth_date")).alias("year"),
                      names.given_part(F.col("name")).alias("given"), names.surname_part(F.col("name")).alias("surname"))
    kid = base.select(JOB, F.col(SLOT).alias("_c"), F.col("year").alias("child_year"), F.col("birth_place").alias("child_place"))
    root = base.where(F.col(SLOT) == 1).select(JOB, F.col("year").alias("subject_year"))
    return base.withColumn("_c", slots.child_of(F.col(SLOT))).join(kid, [JOB, "_c"], "left").drop("_c").join(root, JOB, "left")


def candidate_rows(cand: DataFrame, dimension: DataFrame, verify: DataFrame | None = None) -> DataFrame:
    """Candidates with the fields the checks read, and primary sources if given."""
    placed = with_place(cand, dimension, "birth_place", c_place="clean", c_seat="clean_seat", c_foreign="foreign", c_home="home")
    c = placed.select(*KEY, "rnk", "person_id", F.col("given_name").alias("c_given"), F.col("surname").alias("c_surname"), F.col("gender").alias("c_gender"), F.col("birth_date").alias("c_birth"),
                    date_year(F.col("birth_date")).alias("c_year"),
                    F.coalesce("c_place", F.lit("")).alias("c_place"), "c_seat", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("c_foreign", "c_home")], *[x for x in ("has_parents", "sources_hidden", "civil_confirmed") if x in cand.columns])
    if verify is None:
        return c.withColumn("primary_count", F.lit(0))
    v = verify.select("person_id", "primary_count")
    return c.join(v, "person_id", "left").withColumn("primary_count", F.coalesce("primary_count", F.lit(0)))


def link_known_people(anc: DataFrame, cand: DataFrame, verify: DataFrame, top_slot: int = 15, gazetteer: DataFrame | None = None) -> DataFrame:
    """Best search result for every slot the customer gave that is not linked yet.

    All filters are columns over one join of candidates to their slot; the winner is an aggregate.
    The slot's own year counts first, then the year estimated from its child, then from the subject.
    """
    want = with_family_years(anc).where((F.col(SLOT) <= top_slot) & (F.coalesce("person_id", F.lit("")) == "")).drop("person_id")
    dimension = known_places(anc, cand, gazetteer=gazetteer)
    rows = exclude_rejected(candidate_rows(cand, dimension, verify), rejected_people(cand)).join(want, KEY)
    own, cy, est = F.col("year"), F.col("c_year"), F.col("child_year") - GENERATION_YEARS
    est = F.when(own.isNull() & (F.col(SLOT) > 1), est)
    expected = F.coalesce(own, est, F.when(F.col("gen") >= 1, F.col("subject_year") - F.col("gen") * GENERATION_YEARS))
    ref = F.when(F.col("birth_place") != "", F.col("birth_place")).otherwise(F.coalesce("child_place", F.lit("")))
    placed, common = F.col("c_place") != "", names.is_common_surname(F.col("surname"))
    rows = with_place(rows.withColumns({"_ref": ref, "_common": common, "_expected": expected}), dimension, "_ref", _ref_seat="seat")
    common, prox = F.col("_common"), proximity(F.col("c_seat"), F.col("_ref_seat"))
    expected, both_placed = F.col("_expected"), placed & (F.col("_ref") != "")
    tolerance = F.when(F.col("gen") >= 3, 8).otherwise(5)

    def unless(bad: Column) -> Column:
        return ~F.coalesce(bad, F.lit(False))

    passes = (
        unless(F.col("c_foreign"))
        & names.names_similar(F.substring_index("c_given", " ", 1), F.col("given"))
        & names.surnames_compatible(F.col("c_surname"), F.col("surname"))
        & unless(F.abs(own - cy) > tolerance)
        & unless((own >= REGISTRATION) & cy.isNull() & (common | ~both_placed))
        & unless(own.isNull() & (F.abs(cy - expected) > 35))
        & unless(own.isNull() & cy.isNull() & est.isNotNull() & (common | ~placed))
        & unless(both_placed & (prox == "distant"))
        & unless(both_placed & F.col("c_seat").isNull() & F.col("_ref_seat").isNotNull())
        & unless(common & (F.col("primary_count") < 2)))
    score = (
        F.lit(50) + F.coalesce(F.greatest(F.lit(0), 30 - F.abs(cy - expected) * 3), F.lit(0)) + F.when(cy.isNotNull(), 15).otherwise(0) + F.when(placed, 10).otherwise(0)
        + F.when(both_placed, first_true([(prox == "same", 20), (prox == "adjacent", 10)], 0)).otherwise(0) + F.when(common, F.col("primary_count") * 5).otherwise(0)
        + F.when(F.col("has_parents"), 10).otherwise(0))
    return best_row(rows.where(passes).withColumn("score", score).select(*KEY, "person_id", "score", "rnk"), KEY, "score", [F.col("rnk")])


def find_person(anc: DataFrame, cand: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Person of every slot: its own link, else the first search result that passes.
    A blank birth year is estimated from the child."""
    base = with_family_years(anc)
    linked = base.where(F.coalesce("person_id", F.lit("")) != "").select(*KEY, "person_id", F.lit("linked").alias("how"))
    want = base.where((F.coalesce("person_id", F.lit("")) == "") & (F.col("given") != "") & (F.col("surname") != "")).drop("person_id")
    dimension = known_places(anc, cand, gazetteer=gazetteer)
    rows = with_place(exclude_rejected(candidate_rows(cand, dimension), rejected_people(cand)).join(want, KEY), dimension, "birth_place", own_seat="seat")
    year = F.coalesce("year", F.col("child_year") - GENERATION_YEARS)
    cy, placed = F.col("c_year"), F.col("c_place") != ""
    distant = placed & (F.col("birth_place") != "") & F.coalesce(proximity(F.col("c_seat"), F.col("own_seat")) == "distant", F.lit(False))
    ok = (~F.col("c_foreign") & names.names_similar(F.col("given"), F.col("c_given")) & names.surnames_compatible(F.col("c_surname"), F.col("surname"))
          & ~F.coalesce(F.abs(year - cy) > 5, F.lit(False)) & ~F.coalesce((year >= REGISTRATION) & cy.isNull(), F.lit(False)) & ~distant)
    found = first_row(rows.where(ok).select(*KEY, "person_id", "rnk"), KEY, [F.col("rnk")]).select(*KEY, "person_id", F.lit("searched").alias("how"))
    return linked.unionByName(found)


def parent_checks(p_gender: Column, p_year: Column, p_death: Column, p_foreign: Column, p_seat: Column, c_year: Column, c_seat: Column, expected: Column) -> dict[str, Column]:
    """Columns of the parent check: what is wrong, and how near the counties lie. Blank places have no seat."""
    gap = c_year - p_year
    sex = F.lower(p_gender)
    bad_sex = (sex != "") & (sex != F.lower(expected))
    bad_gap = (gap < YOUNGEST) | (gap > OLDEST)
    dead = p_death < c_year - 1
    wrong = {
        "gender": bad_sex, "birth gap": bad_gap, "died before birth": dead, "foreign": p_foreign,
    }
    reasons = F.concat_ws(", ", *[F.when(F.coalesce(b, F.lit(False)), F.lit(k)) for k, b in wrong.items()])
    return {"reasons": reasons, "valid": reasons == "", "proximity": proximity(p_seat, c_seat)}


def validate_parents(anc: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Every filled parent slot checked against its child."""
    placed = with_place(anc, known_places(anc, gazetteer=gazetteer), "birth_place", seat="clean_seat", foreign="foreign")
    base = placed.select(*KEY, "gender", date_year(F.col("birth_date")).alias("year"), date_year(F.col("death_date")).alias("death"), "seat", "foreign")
    kid = base.select(JOB, F.col(SLOT).alias("_c"), F.col("year").alias("child_year"), F.col("seat").alias("child_seat"))
    both = base.where(F.col(SLOT) > 1).withColumn("_c", slots.child_of(F.col(SLOT))).join(kid, [JOB, "_c"])
    checks = parent_checks(F.col("gender"), F.col("year"), F.col("death"), F.col("foreign"), F.col("seat"), F.col("child_year"), F.col("child_seat"), slots.expected_gender(F.col(SLOT)))
    return both.select(*KEY, *[v.alias(k) for k, v in checks.items()])


# One person, one slot ------------------------------------------------------------------------------
def once_per_tree(proposed: DataFrame, used: DataFrame) -> DataFrame:
    """One proposal per slot: people already in the tree go, then each person keeps its lowest slot."""
    free = proposed.join(used.select(JOB, "person_id").distinct(), [JOB, "person_id"], "left_anti")
    return first_row(free, [JOB, "person_id"], [F.col(SLOT)])


def ordered_assignment(passing: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Slots of a tree in order, each given its first passing person not taken by an earlier slot.

    ``used``: job, person_id of people who already stand in a tree. A slot's choice depends on all earlier ones, so
    the rows of a tree stream by in order of slot and rank; what is kept of them is the set of people given
    away, one a slot, and each row is looked at once, however many slots or choices there are. A person's lowest
    rank in a slot is found by sorting, which spills, as a hash table would hold every row of a task.
    """
    rows = passing.select(JOB, SLOT, "person_id", "rnk")
    if used is not None:
        rows = rows.join(used.select(JOB, "person_id").distinct(), [JOB, "person_id"], "left_anti")
    once = top_rows(rows, [JOB, SLOT, "person_id"], [F.col("rnk").asc_nulls_last()], 1, "_nth").select(JOB, SLOT, "person_id", F.col("rnk").cast("int").alias("rnk"))
    in_order = once.repartition(JOB).sortWithinPartitions(JOB, SLOT, "rnk", "person_id")

    def walk(batches):
        import pyarrow as pa

        tree, slot, given = object(), None, set()
        for b in batches:
            keep = []
            for job, at, person in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if job != tree:
                    tree, slot, given = job, None, set()
                keep.append(at != slot and person not in given)
                if keep[-1]:
                    slot = at
                    given.add(person)
            yield b.filter(pa.array(keep, pa.bool_()))

    return in_order.mapInArrow(walk, in_order.schema)


# Discovery -------------------------------------------------------------------------------------------
def people_facts(people: DataFrame, dimension: DataFrame) -> DataFrame:
    """job, person and what the parent check reads of it."""
    placed = with_place(people.where("person_id <> ''"), dimension, "birth_place", p_place="clean", p_seat="clean_seat", p_foreign="foreign")
    return placed.select(JOB, "person_id", "name", F.col("gender").alias("p_gender"), date_year(F.col("birth_date")).alias("p_year"), date_year(F.col("death_date")).alias("p_death"),
                         F.coalesce("p_place", F.lit("")).alias("p_place"), "p_seat", "p_foreign")


# Discovery -------------------------------------------------------------------------------------------
def parent_facts(anc_people: DataFrame, parents: DataFrame, verify: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Recorded parents with the fields their check reads: (job, child_id, is_father, person...)."""
    long = parents.select(JOB, "child_id", F.explode(F.array(F.struct(F.lit(True).alias("is_father"), F.col("father_id").alias("person_id")), F.struct(F.lit(False).alias("is_father"), F.col("mother_id").alias("person_id")))).alias("_p")).select(JOB, "child_id", "_p.*").where("person_id is not null")
    who = people_facts(anc_people, known_places(anc_people, gazetteer=gazetteer))
    return long.join(who, [JOB, "person_id"]).join(verify.select("person_id", "primary_count"), "person_id", "left").withColumn("primary_count", F.coalesce("primary_count", F.lit(0)))


def discover_parents(start: DataFrame, facts: DataFrame, used: DataFrame, filled: DataFrame, generations: int) -> DataFrame:
    """Recorded parents of the starting slots, then of those found, one generation a round.

    ``start``: job, slot, person_id, year, seat of the slots whose parents are wanted. ``filled``: slots
    that must not be overwritten. Each round is one join to the parent facts, written out before the next.
    Distant parents need four primary sources.
    """
    facts = materialized(facts)
    taken = materialized(used.select(JOB, "person_id").distinct())
    held = filled.select(*KEY)
    frontier, found = start.select(*KEY, "person_id", "year", "seat"), None
    for _ in range(generations):
        kids = frontier.select(JOB, F.col(SLOT).alias("_kid"), F.col("person_id").alias("child_id"), F.col("year").alias("_y"), F.col("seat").alias("_seat"))
        got = kids.join(facts, [JOB, "child_id"]).withColumn(SLOT, F.when(F.col("is_father"), F.col("_kid") * 2).otherwise(F.col("_kid") * 2 + 1))
        expected = F.when(F.col("is_father"), "Male").otherwise("Female")
        checks = parent_checks(F.col("p_gender"), F.col("p_year"), F.col("p_death"), F.col("p_foreign"), F.col("p_seat"), F.col("_y"), F.col("_seat"), expected)
        far = F.coalesce(checks["proximity"] == "distant", F.lit(False)) & (F.col("primary_count") < 4)
        ok = got.where(checks["valid"] & ~far & (F.col(SLOT) < 2 ** (generations + 1))).join(held, KEY, "left_anti")
        method = F.when(F.col("primary_count") > 0, "tree_parents_verified").otherwise("tree_parents_unverified")
        new = once_per_tree(ok.select(*KEY, "person_id", "name", F.col("p_year").alias("year"), F.col("p_place").alias("place"), F.col("p_seat").alias("seat"), "primary_count", method.alias("discovery_method")), taken)
        new = materialized(new)
        found = new if found is None else found.unionByName(new)
        taken = taken.unionByName(new.select(JOB, "person_id"))
        frontier = new
    return found


def min_primary_sources(gen: Column, cand_year: Column, common: Column, known_given: Column, distant: Column, mother: Column) -> Column:
    """Primary sources a searched parent needs."""
    base = first_true([(cand_year < REGISTRATION, 0), (gen >= 5, 1), (gen >= 4, F.when(common & ~known_given, 2).otherwise(1))], F.when(common & ~known_given, 3).otherwise(2))
    floor = F.when(mother & (gen >= 4), 2).otherwise(4)
    return F.when(distant, F.greatest(base, floor)).otherwise(base)


def passing_parents(empty: DataFrame, cand: DataFrame, verify: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Search results that may fill an empty slot.

    ``empty``: job, slot, child_year, child_place, search_surname, known_given. Where a candidate's sources
    cannot be seen (``sources_hidden``) a known given name, a civil confirmation or a rare surname of an
    early generation stands in for them.
    """
    dimension = place_dimension(all_places((cand, "birth_place"), (empty, "child_place")), gazetteer)
    rows = with_place(exclude_rejected(candidate_rows(cand, dimension, verify), rejected_people(cand)).join(empty, KEY), dimension, "child_place", child_seat="seat")
    slot, gen = F.col(SLOT), slots.generation(F.col(SLOT))
    cy, ky, place = F.col("c_year"), F.col("child_year"), F.col("c_place")
    mother = ~slots.is_father(slot)
    expected = slots.expected_gender(slot)
    checks = parent_checks(F.col("c_gender"), cy, F.lit(None).cast("int"), F.col("c_foreign"), F.col("c_seat"), ky, F.col("child_seat"), expected)
    known = F.col("known_given") != ""
    common = names.is_common_surname(F.col("search_surname"))
    distant = F.coalesce(checks["proximity"] == "distant", F.lit(False))
    hidden = F.coalesce("sources_hidden", F.lit(False)) if "sources_hidden" in cand.columns else F.lit(False)
    confirmed = F.coalesce("civil_confirmed", F.lit(False)) if "civil_confirmed" in cand.columns else F.lit(False)
    unseen = ~distant & F.when(known, names.names_similar(F.col("c_given"), F.col("known_given"))).otherwise(confirmed | (~common & (gen >= 4)))
    seen = F.col("primary_count") >= min_primary_sources(gen, cy, common, known, distant, mother)
    ok = (((place == "") | F.col("c_home")) & checks["valid"]
          & (mother | names.surnames_compatible(F.col("c_surname"), F.col("search_surname"))) & ~F.coalesce((ky >= REGISTRATION) & cy.isNull(), F.lit(False)) & F.when(hidden, unseen).otherwise(seen))
    method = F.when(hidden, "direct_search_unverified").otherwise("direct_search_verified")
    return rows.where(ok).select(*KEY, "person_id", "rnk", method.alias("discovery_method"))


def direct_parent_search(empty: DataFrame, cand: DataFrame, verify: DataFrame, used: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Empty slots filled by search, in slot order, nobody twice in a tree."""
    passing = materialized(passing_parents(empty, cand, verify, gazetteer))
    got = ordered_assignment(passing, used)
    return got.join(passing.groupBy(*KEY, "person_id").agg(F.min_by("discovery_method", "rnk").alias("discovery_method")), [*KEY, "person_id"])


def father_results(anc: DataFrame, cand: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Search results that may be a father who has a name but no link: job, slot, rnk, person_id.

    Neither rejected nor abroad, first names alike, born within five years where both years are known.
    """
    base = with_family_years(anc).where(slots.is_father(F.col(SLOT)) & (F.coalesce("person_id", F.lit("")) == "") & (F.col("given") != "") & (F.col("surname") != "")).select(*KEY, "given", "year")
    rows = exclude_rejected(candidate_rows(cand, known_places(cand, gazetteer=gazetteer)), rejected_people(cand)).join(base, KEY)
    ok = ~F.col("c_foreign") & names.names_similar(F.substring_index("c_given", " ", 1), F.col("given")) & ~F.coalesce(F.abs(F.col("year") - F.col("c_year")) > 5, F.lit(False))
    return rows.where(ok).select(*KEY, "rnk", "person_id")


def spouse_triangulation(need: DataFrame, father_ids: DataFrame, spouse_rows: DataFrame, people: DataFrame, verify: DataFrame, used: DataFrame, rejected: DataFrame, gazetteer: DataFrame | None = None, searched: DataFrame | None = None) -> DataFrame:
    """Empty mother slots filled from the father's recorded female spouses.

    ``need``: job, slot (the mother's), child_year, child_place. ``father_ids``: job, slot (the father's), person_id.
    ``searched`` (see ``father_results``): a father without a link stands for his first search result that has
    spouses on record. Where ``people`` says that a spouse's sources cannot be seen (``sources_hidden``), the
    marriage stands for them unless she is from a distant county.
    """
    wives = spouse_rows.select(JOB, F.col("person_id").alias("man_id"), F.col("spouse_id").alias("person_id")).where("man_id <> '' and person_id <> ''")
    fathers = father_ids.select(*KEY, "person_id")
    if searched is not None:
        married = wives.select(JOB, F.col("man_id").alias("person_id")).distinct()
        looked_for = searched.join(fathers.select(*KEY), KEY, "left_anti").join(married, [JOB, "person_id"], "left_semi")
        fathers = fathers.unionByName(first_row(looked_for.select(*KEY, "rnk", "person_id"), KEY, [F.col("rnk"), F.col("person_id")]).select(*KEY, "person_id"))
    men = fathers.select(JOB, (F.col(SLOT) + 1).alias(SLOT), F.col("person_id").alias("man_id"))
    dimension = place_dimension(all_places((people, "birth_place"), (need, "child_place")), gazetteer)
    who = people_facts(people, dimension)
    if "sources_hidden" in people.columns:
        who = who.join(people.where("sources_hidden").select(JOB, "person_id", F.lit(True).alias("hidden")).distinct(), [JOB, "person_id"], "left")
    need = with_place(need, dimension, "child_place", child_seat="seat")
    rows = need.join(men, KEY).join(wives, [JOB, "man_id"]).join(who, [JOB, "person_id"])
    rows = exclude_rejected(rows, rejected).join(verify.select("person_id", "primary_count"), "person_id", "left")
    gen = slots.generation(F.col(SLOT))
    checks = parent_checks(F.col("p_gender"), F.col("p_year"), F.col("p_death"), F.col("p_foreign"), F.col("p_seat"), F.col("child_year"), F.col("child_seat"), F.lit("Female"))
    base = first_true([(F.col("p_year") < REGISTRATION, 0), (gen >= 4, 1)], 2)
    far = F.coalesce(checks["proximity"] == "distant", F.lit(False))
    seen = F.coalesce("primary_count", F.lit(0)) >= F.when(far, F.greatest(base, F.when(gen >= 4, 2).otherwise(4))).otherwise(base)
    hidden = F.coalesce("hidden", F.lit(False)) if "hidden" in rows.columns else F.lit(False)
    # Recorded order of spouses is the order of their ids, by which the assignment breaks ties.
    ok = rows.where(checks["valid"] & F.when(hidden, ~far).otherwise(seen)).select(*KEY, "person_id", F.lit(1).alias("rnk"))
    return ordered_assignment(ok, used).select(*KEY, "person_id", F.lit("spouse_triangulation").alias("discovery_method"))


def most_lost(need: DataFrame, *lost: DataFrame) -> DataFrame:
    """job, may_lose: how many people a slot of each tree can lose to the tree's other rows."""
    every = need.select(JOB)
    for d in lost:
        every = every.unionAll(d.select(JOB))
    return every.groupBy(JOB).agg(F.count("*").alias("may_lose"))


def mother_from_maiden(need: DataFrame, pool: DataFrame, rejected: DataFrame, used: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Mother by a discovered surname: the first fitting person within fifteen years, else a placeholder.

    ``need``: job, slot (the mother's), maiden_name, child_year, child_place. People fit by surname, gender and
    place before any are left out; the child's district is asked first and dropped if nobody fits there. Both
    sides meet as signatures that carry as many people as the trees that ask can lose to their rejected, used and
    other slots, and one more, so the first free one is always among them; a large tree makes its own lists
    long, and no others.
    """
    reach = 15
    sign = ["s", "y", "d", "cc"]

    dimension = place_dimension(all_places((need, "child_place"), (pool, "place")), gazetteer)
    need_at, pool_at = with_place(need, dimension, "child_place", _seat="seat"), with_place(pool, dimension, "place", _seat="clean_seat", _foreign="foreign")
    county = F.coalesce("_seat.county", F.lit(""))
    asked = need_at.select(*KEY, F.lower("maiden_name").alias("s"), (F.col("child_year") - 26).alias("y"), F.lower(places.district_of(F.col("child_place"))).alias("d"), county.alias("cc")).where("s <> '' and y is not null")
    fit = pool_at.where(F.coalesce("gender", F.lit("")).isin("", "Female") & ~F.coalesce("_foreign", F.lit(False)) & F.col("year").isNotNull())
    fit = fit.select("person_id", F.lower("surname").alias("s"), F.col("year").alias("py"), F.lower(places.district_of(F.col("place"))).alias("d"), county.alias("pc"))
    wanted = materialized(asked.join(most_lost(need, rejected, used), JOB).groupBy(*sign).agg((F.max("may_lose") + 1).alias("keep")))
    opened = wanted.withColumn("py", F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach)))

    def met(asking: DataFrame, by: list[str]) -> DataFrame:
        asked_for = asking.groupBy(*by).agg(F.max("keep").alias("most"))
        nth = F.row_number().over(Window.partitionBy(*by, "pc").orderBy("person_id"))
        people = fit.join(asked_for, by).withColumn("nth", nth).where("nth <= most").groupBy(*by, "pc").agg(F.collect_list("person_id").alias("people"))
        apart = places.county_proximity(F.col("cc"), F.col("pc")) == "distant"
        return asking.join(people, by).where(~F.coalesce(apart, F.lit(False))).select(*sign, "py", "people")

    near = met(opened.where("d <> ''"), ["s", "py", "d"])
    wide = met(opened.join(near.select(*sign).distinct(), sign, "left_anti"), ["s", "py"])
    people = near.unionByName(wide).select(*sign, F.abs(F.col("py") - F.col("y")).alias("off"), F.explode("people").alias("person_id"))
    nearest = people.join(wanted, sign).withColumn("rnk", F.row_number().over(Window.partitionBy(*sign).orderBy("off", "person_id"))).where(F.col("rnk") <= F.col("keep"))
    ok = exclude_rejected(asked.join(nearest, sign), rejected)
    got = ordered_assignment(ok.select(*KEY, "person_id", "rnk"), used).join(pool.select("person_id", "name"), "person_id").select(*KEY, "person_id", "name", F.lit("maiden_name_search").alias("discovery_method"))
    got = materialized(got)
    left = need.join(got.select(*KEY), KEY, "left_anti").select(*KEY, F.lit("").alias("person_id"), F.concat(F.lit("? "), "maiden_name").alias("name"), F.lit("maiden_name_only").alias("discovery_method"))
    return got.unionByName(left)


def other_decade_census(fact_years: DataFrame, have: DataFrame) -> DataFrame:
    """The first census year of a person with none on record within eight years.

    ``fact_years``: person_id, seq, year. ``have``: person_id, year. Distinct years are few, so they are
    held as one array a person.
    """
    known = have.groupBy("person_id").agg(F.collect_set("year").alias("years"))
    j = fact_years.join(known, "person_id", "left")
    fresh = ~F.exists(F.coalesce("years", F.expr("cast(array() as array<int>)")), lambda y: F.abs(y - F.col("year")) < 8)
    return j.where(F.col("year").isNotNull() & fresh).groupBy("person_id").agg(F.min_by("year", "seq").alias("census_year"))
