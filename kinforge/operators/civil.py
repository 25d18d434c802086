"""Tree positions confirmed and discovered through the civil index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import names, places, slots
from kinforge.functions import values as V
from kinforge.functions.dates import date_year, extract_year
from kinforge.functions.literals import first_true
from kinforge.operators.ranking import first_row, top_rows
from kinforge.operators.tree import JOB, SLOT, with_child, with_parents, with_spouse
from kinforge.session import materialized
from kinforge.sources.civil_index import SEARCH, best_entries, resolve_district, with_search

# --- fixed values: score marks and windows --------------------------------------------------
CONFIRM_AT, MARRIAGE_AT, EVIDENCE_AT = 50, 45, 40
BIRTH_BONUS, DEATH_BONUS = 15, 10


def _blank() -> Column:
    return F.lit("")


def _in_civil_era(year: Column) -> Column:
    return year.between(V.CIVIL_FROM, V.CIVIL_TO)


def _prefix_points(entry: Column, first: Column, pts: int, inside: int = 0, either_way: bool = False) -> Column:
    """``pts`` where the entry's forenames begin with the name; ``inside`` where the name holds them, or (either way) they hold it."""
    e, f = F.lower(entry), F.lower(first)
    held = f.contains(e) | e.contains(f) if either_way else f.contains(e)
    return F.when((first != "") & (entry != ""), F.when(e.startswith(f), pts).when(held, inside).otherwise(0)).otherwise(0)


def with_resolved_district(df: DataFrame, civil: DataFrame, name: str, out: str) -> DataFrame:
    """The index's own name for a district text, blank when the index has no such district."""
    known = civil.select(F.col("district").alias("district_name"), F.col("district").alias("district_id")).distinct()
    found = resolve_district(df, known, name).select(name, F.col("district_id").alias(out))
    return df.join(found, name, "left").withColumn(out, F.coalesce(out, _blank()))


def named(anc: DataFrame) -> DataFrame:
    """First word, last word and bounded years of each slot, as the cross-check reads them."""
    return anc.select(JOB, SLOT, "name", "birth_place", F.substring_index("name", " ", 1).alias("first"), F.substring_index("name", " ", -1).alias("last"),
                      extract_year(F.col("birth_date"), "bounded").alias("birth_year"), extract_year(F.col("death_date"), "bounded").alias("death_year"))


def confirm_birth(people: DataFrame, civil: DataFrame) -> DataFrame:
    """Best birth entry within a year: given name 30 (20 where it stands behind another one, or is part of it),
    year 20 or 10, place 10 on top of surname 40; kept at 50.

    ``people`` has first, last, birth_year, birth_place. One row per person that asks and is answered.
    """
    y = F.col("birth_year")
    asked = with_search(people.where(_in_civil_era(y)), F.col("last"), F.col("first"), y - 1, y + 1, _blank())
    near = places.places_overlap(F.col("birth_place"), F.col("district"))
    score = (F.lit(40) + _prefix_points(F.col("forenames"), F.col("first"), 30, 20, either_way=True) + first_true([(F.col("year") == y, 20)], 10) + F.when(near, 10).otherwise(0))
    ask = ["first", "birth_year", "birth_place"]
    best = best_entries(asked, civil, "birth", ask, score, CONFIRM_AT)
    return asked.join(best, [*SEARCH, *ask]).drop(*SEARCH)


def confirm_death(people: DataFrame, civil: DataFrame) -> DataFrame:
    y = F.col("death_year")
    asked = with_search(people.where(_in_civil_era(y)), F.col("last"), F.col("first"), y - 1, y + 1, _blank())
    score = F.lit(40) + _prefix_points(F.col("forenames"), F.col("first"), 30) + F.when(F.col("year") == y, 20).otherwise(0)
    best = best_entries(asked, civil, "death", ["first", "death_year"], score, CONFIRM_AT)
    return asked.join(best, [*SEARCH, "first", "death_year"]).drop(*SEARCH)


def _marriage_score(spouse: Column, first: Column, district: Column) -> Column:
    entry_spouse = F.lower("spouse_surname")
    s = F.lower(spouse)
    has = (spouse != "") & (entry_spouse != "")
    return (F.lit(30) + _prefix_points(F.col("forenames"), first, 25, 15) + first_true([(has & (entry_spouse == s), 50), (has & s.contains(entry_spouse), 25)], 0)
            + F.when(places.district_match(district, F.col("district")), 20).otherwise(0))


def find_marriage(couples: DataFrame, civil: DataFrame) -> DataFrame:
    """Best marriage in a year window. ``couples`` has last, first, spouse_last, year_from_, year_to_, district_."""
    asked = with_search(couples, F.col("last"), F.col("first"), F.col("year_from_"), F.col("year_to_"), F.col("district_"))
    ask = ["first", "spouse_last"]
    best = best_entries(asked, civil, "marriage", ask, _marriage_score(F.col("spouse_last"), F.col("first"), F.col("district_key")), MARRIAGE_AT, given="maybe")
    return asked.join(best, [*SEARCH, *ask]).drop(*SEARCH)


def couples(anc: DataFrame) -> DataFrame:
    """Each dated slot with a filled spouse slot and the years its marriage may fall in."""
    n = named(anc)
    both = with_spouse(n, ["last", "birth_year"], "inner").where(F.col("birth_year").isNotNull())
    b, d = F.col("birth_year"), F.col("death_year")
    return (both.withColumn("spouse_last", F.col("spouse_last"))
            .withColumn("year_from_", F.greatest(b + 16, F.coalesce(F.col("spouse_birth_year"), b) + 16))
            .withColumn("year_to_", F.least(b + 45, F.coalesce(d, b + 45))).withColumn("district_", _blank()))


def civil_crossref(anc: DataFrame, civil: DataFrame) -> DataFrame:
    """Birth, death and marriage found for every slot above the subject. Births before registration are noted and skipped."""
    people = materialized(named(anc).where(F.col(SLOT) > 1))
    early = F.coalesce(F.col("birth_year") < V.CIVIL_FROM, F.lit(False))
    later = people.where(~early)
    birth = confirm_birth(later, civil).select(JOB, SLOT, F.col("entry_year").alias("birth_entry_year"), F.col("entry_district").alias("birth_entry_district"))
    death = confirm_death(later, civil).select(JOB, SLOT, F.col("entry_year").alias("death_entry_year"))
    pairs = materialized(couples(anc).where((F.col(SLOT) > 1) & (F.col("birth_year") >= V.CIVIL_FROM)))
    wed = find_marriage(pairs, civil).select(JOB, SLOT, F.col("entry_year").alias("marriage_year"), F.col("entry_spouse_surname").alias("marriage_spouse"))
    out = people.select(JOB, SLOT, F.when(early, "before registration").otherwise("").alias("note"))
    for found in (birth, death, wed):
        out = out.join(found, [JOB, SLOT], "left")
    return out


def confirm_with_civil(anc: DataFrame, civil: DataFrame) -> DataFrame:
    """Bonus for a birth within two years in or near the district (15) and a death (10)."""
    people = anc.select(JOB, SLOT, names.given_part(F.col("name")).alias("given"), names.surname_part(F.col("name")).alias("last"),
                        date_year(F.col("birth_date")).alias("birth_year"), date_year(F.col("death_date")).alias("death_year"),
                        places.district_of(F.col("birth_place")).alias("district_text"))
    people = materialized(with_resolved_district(people, civil, "district_text", "district_"))
    y, d = F.col("birth_year"), F.col("district_text")
    asked = with_search(people.where(_in_civil_era(y)), F.col("last"), F.col("given"), y - 2, y + 2, F.col("district_"))
    score = (F.when(names.names_similar(F.col("forenames"), F.col("given")), 30).otherwise(0)
             + first_true([(F.col("year") == y, 20), (F.abs(F.col("year") - y) <= 1, 15)], 0)
             + first_true([((d != "") & (F.lower("district") == F.lower(d)), 15), (places.district_match(d, F.col("district")), 10)], 0))
    ask = ["given", "birth_year", "district_text"]
    births = asked.join(best_entries(asked, civil, "birth", ask, score, EVIDENCE_AT), [*SEARCH, *ask]).select(
        JOB, SLOT, F.col("entry_year").alias("birth_entry_year"), F.col("score").alias("birth_score"))
    deaths = confirm_death(people.withColumn("first", F.substring_index("given", " ", 1)), civil).select(JOB, SLOT, F.col("entry_year").alias("death_entry_year"))
    out = people.select(JOB, SLOT).join(births, [JOB, SLOT], "left").join(deaths, [JOB, SLOT], "left")
    bonus = F.when(F.col("birth_entry_year").isNotNull(), BIRTH_BONUS).otherwise(0) + F.when(F.col("death_entry_year").isNotNull(), DEATH_BONUS).otherwise(0)
    return out.withColumn("bonus", bonus)


# Joins on a year range ------------------------------------------------------------------------
def birth_range(anc: DataFrame, civil: DataFrame, reach: int = 5) -> DataFrame:
    """Births of the same surname and given name within one, two and five years of each dated slot.

    Both sides meet as (surname, given, year) histograms, so no pair of rows is ever built.
    """
    who = anc.select(JOB, SLOT, F.lower("surname").alias("s"), F.lower("given_name").alias("g"), date_year(F.col("birth_date")).alias("y")).where("y is not null")
    hist = civil.where("entry_type = 'birth'").groupBy(F.lower("surname").alias("s"), F.lower("forenames").alias("g"), F.col("year").alias("ey")).agg(
        F.count("*").alias("n"), F.min("entry_id").alias("e"))
    asked = who.select("s", "g", "y").distinct().withColumn("ey", F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach)))
    gap = F.abs(F.col("ey") - F.col("y"))
    got = asked.join(hist, ["s", "g", "ey"]).groupBy("s", "g", "y").agg(
        *[F.coalesce(F.sum(F.when(gap <= k, F.col("n"))), F.lit(0)).alias(f"within_{k}") for k in (1, 2, reach)], F.min("e").alias("first_entry"))
    return who.join(got, ["s", "g", "y"]).select(JOB, SLOT, "within_1", "within_2", f"within_{reach}", "first_entry")


def marriage_window(anc: DataFrame, civil: DataFrame) -> DataFrame:
    """Marriages of each couple's surnames in the fifteen years up to the child's birth; else husband 18 to 45."""
    man = anc.where(slots.is_father(F.col(SLOT))).select(JOB, SLOT, "surname", date_year(F.col("birth_date")).alias("year"))
    dated = anc.select(JOB, SLOT, "surname", date_year(F.col("birth_date")).alias("year"))
    wives = dated.select(JOB, (F.col(SLOT) - 1).alias(SLOT), F.col("surname").alias("wife"))
    kids = dated.select(JOB, F.col(SLOT).alias("_c"), F.col("year").alias("child_year"))
    pair = man.join(wives, [JOB, SLOT]).withColumn("_c", slots.child_of(F.col(SLOT))).join(kids, [JOB, "_c"], "left")
    lo = F.coalesce(F.col("child_year") - 15, F.col("year") + 18)
    hi = F.coalesce(F.col("child_year"), F.col("year") + 45)
    pair = pair.select(JOB, SLOT, F.lower("surname").alias("s"), F.lower("wife").alias("w"), lo.alias("lo"), hi.alias("hi")).where("lo is not null")
    hist = civil.where("entry_type = 'marriage'").groupBy(F.lower("surname").alias("s"), F.lower("spouse_surname").alias("w"), F.col("year").alias("my")).agg(
        F.count("*").alias("n"), F.min("entry_id").alias("e"))
    asked = pair.select("s", "w", "lo", "hi").distinct().withColumn("my", F.explode(F.sequence("lo", "hi")))
    got = asked.join(hist, ["s", "w", "my"]).groupBy("s", "w", "lo", "hi").agg(F.sum("n").alias("marriages"), F.min_by("e", F.struct("my", "e")).alias("first_entry"))
    return pair.join(got, ["s", "w", "lo", "hi"]).select(JOB, SLOT, F.col("lo").alias("year_from"), F.col("hi").alias("year_to"), "marriages", "first_entry")


def sibling_births(civil: DataFrame, reach: int = 8, limit: int | None = None) -> DataFrame:
    """For every distinct birth with a mother's name: other births of the same surname, district and
    mother's name within eight years, and the earliest of them in index order.

    Per family and year only a count, the first row, and the first row of another given name are kept;
    that is enough to answer every member exactly without pairing members. With ``limit``, a family whose
    surname and district have more births in those years than the index displays is not answered.
    """
    fam = ["s", "d", "m"]
    births = civil.where((F.col("entry_type") == "birth") & (F.col("spouse_surname") != "") & (F.col("district") != "")).select(
        F.lower("surname").alias("s"), F.lower("district").alias("d"), F.lower("spouse_surname").alias("m"), "year", F.lower("forenames").alias("f"), "entry_id")
    people = births.groupBy(*fam, "year", "f").agg(F.count("*").alias("n"), F.min("entry_id").alias("e"))
    two = top_rows(people, [*fam, "year"], [F.col("e")], 2).groupBy(*fam, "year").agg(
        F.min_by("f", "rank").alias("f1"), F.min("e").alias("e1"), F.max(F.when(F.col("rank") == 2, F.col("e"))).alias("e2"))
    years = people.groupBy(*fam, "year").agg(F.sum("n").alias("year_n")).join(two, [*fam, "year"]).withColumnRenamed("year", "oy")
    asked = people.select(*fam, "year", "f", "n").withColumn("oy", F.explode(F.sequence(F.col("year") - reach, F.col("year") + reach)))
    same = F.col("oy") == F.col("year")
    got = asked.join(years, [*fam, "oy"])
    count = F.col("year_n") - F.when(same, F.col("n")).otherwise(0)
    first = F.when(same & (F.col("f1") == F.col("f")), F.col("e2")).otherwise(F.col("e1"))
    out = got.groupBy(*fam, "year", "f").agg(F.sum(count).alias("siblings"), F.min(first).alias("first_sibling"))
    if limit is not None:
        every = civil.where("entry_type = 'birth'").select(F.lower("surname").alias("s"), F.lower("district").alias("d"), "year")
        by_year = every.groupBy("s", "d", F.col("year").alias("oy")).agg(F.count("*").alias("all_n"))
        window = out.select("s", "d", "year").distinct().withColumn("oy", F.explode(F.sequence(F.col("year") - reach, F.col("year") + reach)))
        wide = window.join(by_year, ["s", "d", "oy"]).groupBy("s", "d", "year").agg(F.sum("all_n").alias("shown"))
        out = out.join(wide.where(F.col("shown") <= limit), ["s", "d", "year"])
    return out.where("siblings > 0").select(F.col("s").alias("surname"), F.col("d").alias("district"), F.col("m").alias("maiden"), "year", F.col("f").alias("forenames"), "siblings", "first_sibling")


def two_sided(civil: DataFrame, same_district: bool = False) -> DataFrame:
    """Every marriage entry beside the first entry of the other party: mirrored surnames, same year, and the
    same volume when both state one. The other side is reduced to one row per key first, so nothing multiplies."""
    m = civil.where((F.col("entry_type") == "marriage") & (F.col("spouse_surname") != ""))
    place = ["k_district"] if same_district else []
    keyed = m.withColumn("k_surname", F.lower("surname")).withColumn("k_spouse", F.lower("spouse_surname")).withColumn("k_district", F.lower("district"))
    key = ["k_surname", "k_spouse", "year", *place]
    groom = keyed.where(F.col("forenames") != "")
    other = F.struct("entry_id", "forenames", "surname", "volume", "page", "district", "quarter")
    any_volume = groom.groupBy(*key).agg(F.min_by(other, "entry_id").alias("any"), F.min_by(F.when(F.col("volume") == "", other), F.when(F.col("volume") == "", F.col("entry_id"))).alias("blank"))
    by_volume = groom.where(F.col("volume") != "").groupBy(*key, "volume").agg(F.min_by(other, "entry_id").alias("same"))
    bride = keyed.withColumns({"k_surname": F.col("k_spouse"), "k_spouse": F.col("k_surname")})
    both = bride.join(any_volume, key, "left").join(by_volume, [*key, "volume"], "left")
    pick = F.when(F.col("volume") == "", F.col("any")).when(F.col("blank").isNull() | (F.col("same.entry_id") < F.col("blank.entry_id")), F.col("same")).otherwise(F.col("blank"))
    return both.withColumn("groom", pick).where(F.col("groom").isNotNull()).drop("any", "blank", "same", "k_surname", "k_spouse", "k_district")


# Discovery of parents --------------------------------------------------------------------------
def children_missing_parents(anc: DataFrame, civil: DataFrame) -> DataFrame:
    """Filled slots with at least one empty parent slot inside six generations, and what is known of the parents."""
    base = anc.select(JOB, SLOT, "gen", names.given_part(F.col("name")).alias("given"), names.surname_part(F.col("name")).alias("last"),
                      date_year(F.col("birth_date")).alias("birth_year"), "birth_place", places.district_of(F.col("birth_place")).alias("district_text"), "name")
    both = with_parents(base, ["name", "last"])
    need = both.where((F.col("gen") < 6) & (F.col("father_name").isNull() | F.col("mother_name").isNull()))
    return materialized(with_resolved_district(need, civil, "district_text", "district_"))


def maiden_names(need: DataFrame, civil: DataFrame) -> DataFrame:
    """Mother's surname read off the child's own birth entry, registered since 1911; the first that fits."""
    y = F.col("birth_year")
    ask = need.where(F.col("mother_name").isNull() & y.between(1911, V.CIVIL_TO) & (F.col("last") != ""))
    asked = with_search(ask, F.col("last"), F.col("given"), y - 1, y + 1, F.col("district_"))
    fits = (F.col("spouse_surname") != "") & (F.lower(F.col("forenames")).startswith(F.lower(F.col("given"))) | names.names_similar(names.first_word(F.col("forenames")), F.col("given")))
    best = best_entries(asked, civil, "birth", ["given"], F.lit(1), 1, keep=fits)
    return asked.join(best, [*SEARCH, "given"]).select(JOB, SLOT, F.col("entry_spouse_surname").alias("maiden_name"), F.col("entry_year"), F.col("entry_id"))


def marriage_discovery(need: DataFrame, maiden: DataFrame, civil: DataFrame) -> DataFrame:
    """Father's name from the first marriage of the child's surname, seven years before birth to one after.
    Entries with a female first name are the other party and are skipped; a known mother's surname must agree."""
    known = need.join(materialized(maiden.select(JOB, SLOT, "maiden_name")), [JOB, SLOT], "left")
    wife = F.lower(F.coalesce(F.col("maiden_name"), F.col("mother_last"), _blank()))
    y = F.col("birth_year")
    ask = known.withColumn("wife", wife).where((F.col("last") != "") & y.isNotNull())
    asked = with_search(ask, F.col("last"), _blank(), F.greatest(y - 7, F.lit(V.CIVIL_FROM)), y + 1, F.col("district_"))
    man = ~names.first_word(F.col("forenames")).isin(*V.FEMALE_NAMES)
    fits = (F.col("forenames") != "") & (F.col("spouse_surname") != "") & man & ((F.col("wife") == "") | (F.lower("spouse_surname") == F.col("wife")))
    best = best_entries(asked, civil, "marriage", ["wife"], F.lit(1), 1, keep=fits, given="never")
    found = asked.join(best, [*SEARCH, "wife"])
    return found.select(JOB, SLOT, slots.father_of(F.col(SLOT)).alias("father_slot"), F.concat_ws(" ", "entry_forenames", "entry_surname").alias("father_name"),
                        (F.col("entry_year") - 25).alias("father_birth"), F.col("entry_spouse_surname").alias("mother_surname"), F.col("entry_year").alias("marriage_year"),
                        F.col("father_name").isNull().alias("fills_father"), F.col("entry_id"))


def unknown_father(need: DataFrame, civil: DataFrame) -> DataFrame:
    """Father of a child whose mother's surname is known, from their marriage, ten years before birth to two after:
    by the father's surname; else by the mother's entry and its other side; else anywhere."""
    y = F.col("birth_year")
    ask = need.where(F.col("father_name").isNull() & (F.coalesce("mother_last", _blank()) != "") & (F.col("last") != "") & y.isNotNull())
    lo, hi = F.greatest(y - 10, F.lit(V.CIVIL_FROM)), y + 2
    ask = ask.withColumn("wife", F.lower("mother_last")).withColumn("man", F.lower("last"))

    # Both searches by the father's surname ask at once, so the index is read and the questions are answered once.
    near, anywhere = (with_search(rows, F.col("last"), _blank(), lo, hi, district) for rows, district in ((ask, F.col("district_")), (ask.where(F.col("district_") != ""), _blank())))
    score = F.lit(80) + F.when(places.district_match(F.col("district_key"), F.col("district")), 20).otherwise(0)
    grooms = best_entries(near.unionByName(anywhere), civil, "marriage", ["wife"], score, MARRIAGE_AT, keep=F.lower("spouse_surname") == F.col("wife"), given="never")

    def by_groom(asked: DataFrame) -> DataFrame:
        return asked.join(grooms, [*SEARCH, "wife"]).where(F.col("entry_forenames") != "")

    def out(found: DataFrame, how: str, pass_no: int, forenames: Column, surname: Column) -> DataFrame:
        return found.select(JOB, SLOT, F.lit(pass_no).alias("pass_no"), F.lit(how).alias("searched_by"), F.concat_ws(" ", forenames, surname).alias("father_name"), "entry_year", "entry_id")

    entry = (F.col("entry_forenames"), F.col("entry_surname"))
    first = out(by_groom(near), "father_surname", 1, *entry)
    sides = two_sided(civil, same_district=True)
    brides = sides.select("entry_type", "surname", "spouse_surname", "year", "district", "volume", "page", "quarter",
                          F.col("groom.forenames").alias("forenames"), F.col("groom.entry_id").alias("groom_id"), "entry_id")
    # The bride's own entry is searched; the groom's forenames ride along in its place.
    asked = with_search(ask, F.col("wife"), _blank(), lo, hi, F.col("district_"))
    best = best_entries(asked, brides, "marriage", ["man"], F.lit(100), 1, keep=F.lower("spouse_surname") == F.col("man"), given="never")
    second = out(asked.join(best, [*SEARCH, "man"]), "mother_maiden_name", 2, F.col("entry_forenames"), F.col("entry_spouse_surname"))
    third = out(by_groom(anywhere), "father_surname_no_district", 3, *entry)
    return first_row(first.unionByName(second).unionByName(third), [JOB, SLOT], [F.col("pass_no")])
