"""The evidence loop: a birth entry, the person it fits, the parents' marriage, cross-checks and the
confidence they add up to. How many hypotheses of a slot are kept, how many are tried and how many of its
search results are looked at are arguments; without them all are, after those that cannot fit have gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions import evidence, names, places, slots
from kinforge.functions.dates import date_year
from kinforge.functions.literals import first_true
from kinforge.operators.civil import confirm_death, sibling_births, with_resolved_district
from kinforge.operators.gazetteer import read_once
from kinforge.operators.ranking import best_row, first_row, top_rows
from kinforge.operators.tree import JOB, SLOT, with_parents
from kinforge.session import materialized, maybe_broadcast, settled
from kinforge.sources.civil_index import SEARCH, SIGNATURE, best_entries, civil_search, least_ids, match_counts, search_rows, searches_of, signature_search, with_search

KEY = [JOB, SLOT]
# --- fixed values: hypotheses kept unless asked otherwise, fewest entries of a district, years; weights; thresholds ---
KEPT, FEW, YEARS = 15, 3, 5
BIRTH_WEIGHT, VARIANT_WEIGHT, CENSUS_WEIGHT, MARRIAGE_WEIGHT = 25, 20, 15, 30
SIBLING_WEIGHT, DEATH_WEIGHT, LATER_CENSUS_WEIGHT = 15, 10, 10
PRIMARY_AT, ALTERNATE_AT, COUPLE_AT, VERIFIED_AT, ENOUGH, LEAD_AT = 60, 30, 40, 25, 50, 25
#: Years after a birth in which a census shows a child; a number above any score of a result.
CHILD_YEARS, TOP_SCORE = 15, 1000


def people_of(anc: DataFrame, civil: DataFrame) -> DataFrame:
    """What is known of each dated slot before the search: own name, year, place, and parents' names."""
    base = anc.select(*KEY, "gen", "person_id", "confidence_level", names.given_part(F.col("name")).alias("given"), names.surname_part(F.col("name")).alias("surname"),
                      date_year(F.col("birth_date")).alias("year"), "birth_place", places.district_of(F.col("birth_place")).alias("district_text"))
    both = with_parents(base, ["given", "surname"])
    for c in ("father_given", "father_surname", "mother_given", "mother_surname"):
        both = both.withColumn(c, F.coalesce(c, F.lit("")))
    return materialized(with_resolved_district(both, civil, "district_text", "district_"))


def pass_union(people: DataFrame, civil: DataFrame) -> DataFrame:
    """Birth entries for every distinct question: within the district; anywhere if fewer than three; under all
    spelling variants if none. An entry with a volume and page already listed is not listed again by a later pass.

    Which passes a question needs is told by counts of signatures. Then all that is asked meets the index in one
    join, whatever pass it is for, and pages are told apart only for questions that have a later pass.
    """
    y = F.col("year")
    q = with_search(people.where("surname <> '' and year is not null"), F.col("surname"), F.col("given"), y - YEARS, y + YEARS, F.col("district_"))
    q = materialized(searches_of(q))
    span, entry = [c for c in SEARCH if c != "district_key"], ["surname", "forenames", "spouse_surname", "year", "quarter", "district", "volume", "page", "entry_id"]
    anywhere = q.withColumn("district_key", F.lit(""))
    counts = materialized(match_counts(q.unionByName(anywhere).distinct(), civil, "birth", given="maybe"))
    met = q.join(counts, list(SEARCH), "left").withColumn("n", F.coalesce("matches", F.lit(0))).drop("matches")
    met = met.join(counts.where("district_key = ''").select(*span, F.col("matches").alias("wide_n")), span, "left")
    few = (F.col("n") < FEW) & (F.col("district_key") != "")
    met = materialized(met.select(*SEARCH, "n", few.alias("few"), (few & F.col("wide_n").isNotNull()).alias("wide")))

    def asking(rows: DataFrame, pass_no: int, nth: Column, surname: Column, district: Column, paged: Column) -> DataFrame:
        return rows.select(surname.alias("surname_key"), "given_key", "year_from", "year_to", district.alias("district_key"), F.col("surname_key").alias("_surname"), F.col("district_key").alias("_asked"),
                           F.lit(pass_no).alias("pass_no"), nth.alias("nth"), paged.alias("paged"))

    spelt = met.where("n = 0 and not wide").select(*SEARCH, F.posexplode(names.surname_variants(F.col("surname_key"))).alias("nth", "variant"))
    own, first, later = F.col("surname_key"), F.lit(0), F.lit(True)
    asks = (asking(met.where("n > 0"), 1, first, own, F.col("district_key"), F.col("few"))
            .unionByName(asking(met.where("wide"), 2, first, own, F.lit(""), later))
            .unionByName(asking(spelt, 3, F.col("nth"), F.lower("variant"), F.lit(""), later)))
    asks = materialized(asks)

    def found(rows: DataFrame) -> DataFrame:
        got = search_rows(rows, civil, "birth", given="maybe").drop("surname_key", "district_key").withColumnsRenamed({"_surname": "surname_key", "_asked": "district_key"})
        return got.select(*SEARCH, *entry, "pass_no", "nth")

    again = F.row_number().over(Window.partitionBy(*SEARCH, "volume", "page").orderBy("pass_no", "nth", "entry_id"))
    once = found(asks.where("paged")).withColumn("_again", again).where((F.col("pass_no") == 1) | (F.col("volume") == "") | (F.col("_again") == 1)).drop("_again")
    return found(asks.where("not paged")).unionByName(once)


def _ends(a: Column, b: Column, equal: int, inside: int, near: int) -> Column:
    """District agreement: equal, one inside the other, on the list of neighbours."""
    la, lb = F.lower(a), F.lower(b)
    return F.when((a != "") & (b != ""), first_true([(la == lb, equal), (la.contains(lb) | lb.contains(la), inside), (places.district_match(a, b), near)], 0)).otherwise(0)


def _one_a_page(found: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of the entries of one volume and page the first in ``order``; entries without a volume all stay."""
    loose = F.when(F.col("volume") == "", F.struct(*order))
    return first_row(found.withColumn("_loose", loose), [*by, "volume", "page", "_loose"], [F.col(c) for c in order]).drop("_loose")


def best_of_passes(people: DataFrame, civil: DataFrame, keep: int = KEPT) -> DataFrame:
    """``pass_union`` as signatures: for each search, pass and set of fields that a score may read, its first
    ``keep`` entries as ``ids``. The best ``keep`` of any score of those fields are among them.

    What the first pass finds is met by signature alone. The second pass names an entry once a page, but the
    first pass only takes pages away from it where it found one or two entries; so pages are told apart once
    for all districts of a name and span of years, with that many entries in reserve. Nothing comes before
    the third pass.
    """
    y = F.col("year")
    q = with_search(people.where("surname <> '' and year is not null"), F.col("surname"), F.col("given"), y - YEARS, y + YEARS, F.col("district_"))
    q = materialized(searches_of(q))
    reserve = keep + FEW - 1
    span, entry = [c for c in SEARCH if c != "district_key"], [*SIGNATURE, "volume", "page", "entry_id"]
    narrow = materialized(signature_search(q, civil, "birth", reserve, given="maybe").select(*SEARCH, *SIGNATURE, "ids"))
    listed = narrow.groupBy(*SEARCH).agg(F.sum(F.size("ids")).alias("n"))
    met = q.join(listed, list(SEARCH), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = met.where((F.col("n") < FEW) & (F.col("district_key") != ""))
    paged = F.struct("volume", "page")
    taken = (narrow.join(few.where("n > 0").select(*SEARCH), list(SEARCH)).select(*SEARCH, F.inline("ids"))
             .where("volume <> ''").groupBy(*SEARCH).agg(F.collect_set(paged).alias("taken")))
    asked = few.select(*span, F.lit("").alias("district_key")).distinct()
    anywhere = _one_a_page(civil_search(asked, civil, "birth", given="maybe").select(*span, *entry), span, ["entry_id"])
    anywhere = materialized(least_ids(anywhere, [*span, *SIGNATURE], reserve))
    left = F.filter("ids", lambda x: ~F.array_contains(F.coalesce("taken", F.array().cast("array<struct<volume:string,page:string>>")), F.struct(x["volume"].alias("volume"), x["page"].alias("page"))))
    broad = few.select(*SEARCH).join(anywhere, span).join(taken, list(SEARCH), "left").select(*SEARCH, *SIGNATURE, left.alias("ids"))
    none = met.where("n = 0").join(few.join(anywhere.select(*span).distinct(), span).select(*SEARCH), list(SEARCH), "left_anti")
    spelt = none.select(*span).distinct().select(*span, F.posexplode(names.surname_variants(F.col("surname_key"))).alias("nth", "variant")).withColumn("variant", F.lower("variant"))
    under = spelt.select(F.col("variant").alias("surname_key"), "given_key", "year_from", "year_to", F.lit("").alias("district_key")).distinct()
    found = civil_search(under, civil, "birth", given="maybe").select(F.col("surname_key").alias("variant"), "given_key", "year_from", "year_to", *entry)
    third = _one_a_page(spelt.join(found, ["variant", "given_key", "year_from", "year_to"]).select(*span, "nth", *entry), span, ["nth", "entry_id"])
    third = none.select(*SEARCH).join(least_ids(third, [*span, "nth", *SIGNATURE], keep), span).select(*SEARCH, "nth", *SIGNATURE, "ids")
    once = {"pass_no": F.lit(1), "nth": F.lit(0)}
    return (narrow.withColumns(once).unionByName(broad.where(F.size("ids") > 0).withColumns({**once, "pass_no": F.lit(2)}))
            .unionByName(third.withColumn("pass_no", F.lit(3))))


def _by_alike_text(asked: DataFrame, districts: DataFrame) -> DataFrame:
    """``alike_text``: one text for all that agree alike with every district of the index, so that they ask as one.

    Most texts of places agree with no district at all. Distinct texts meet distinct districts; rows never do."""
    points = _ends(F.col("district_text"), F.col("district"), 15, 10, 8)
    texts = asked.select("district_text").where("district_text is not null").distinct()
    agree = texts.crossJoin(districts).withColumn("points", points).where("points > 0").groupBy("district_text").agg(F.array_sort(F.collect_list(F.struct("district", "points"))).alias("agrees"))
    agree = texts.join(agree, "district_text", "left").withColumn("agrees", F.coalesce("agrees", F.array().cast("array<struct<district:string,points:int>>")))
    first = agree.groupBy("agrees").agg(F.min("district_text").alias("alike_text"))
    return asked.join(agree.join(first, "agrees").select("district_text", "alike_text"), "district_text").drop("district_text")


#: What the parents' marriage asks beside a hypothesis, under names that no search result has.
PARENTS = {"father_given": "p_father_given", "mother_given": "p_mother_given", "mother_surname": "p_mother_surname"}


def birth_hypotheses(people: DataFrame, civil: DataFrame, keep: int = KEPT, parents: bool = False) -> DataFrame:
    """The ``keep`` best birth entries for every slot, best first; earlier in the search on a tie. With ``parents``
    the names of PARENTS stand beside each, so that no step has to fetch them for every hypothesis.

    Questions meet signatures, and a question's signatures are cut to the best ``keep`` before their entries
    are looked at, so what moves does not grow with the number of entries alike. Places that agree alike with the
    index's districts ask as one, and mothers' surnames only meet what is left of that."""
    y = F.col("year")
    asked = with_search(people.where("surname <> '' and year is not null"), F.col("surname"), F.col("given"), y - YEARS, y + YEARS, F.col("district_"))
    listed = best_of_passes(people, civil, keep).withColumns({"entry_id": F.col("ids")[0]["entry_id"], "n": F.size("ids"), "sig_no": F.monotonically_increasing_id()})
    listed = materialized(listed)  # read for its districts, for the scores and, where chosen, for the entries
    carried = [c for c in PARENTS if parents and c != "mother_surname"]
    asked = materialized(_by_alike_text(asked.select(*KEY, *SEARCH, "given", "district_text", "mother_surname", *carried), listed.select("district").distinct()))
    known_year = F.col("year_from") + YEARS
    off = F.abs(F.col("year") - known_year)
    name = F.when(F.col("given") != "", first_true([(names.names_similar(F.col("forenames"), F.col("given")), 20), (F.lower("forenames").startswith(names.first_word(F.col("given"))), 15)], 0)).otherwise(0)
    m, hm = F.lower("mother_surname"), F.lower("spouse_surname")
    maiden = F.when((m != "") & (hm != ""), first_true([(m == hm, 30), (m.contains(hm) | hm.contains(m), 15)], 0)).otherwise(0)
    base = name + first_true([(off == 0, 20), (off == 1, 15), (off <= 3, 10), (off <= 5, 5)], 0) + _ends(F.col("alike_text"), F.col("district"), 15, 10, 8)
    rank = [F.desc("score"), F.col("pass_no"), F.col("nth")]
    order = [*rank, F.col("entry_id")]

    # The mother's surname adds points by the spouse's surname alone. So the best signatures of a question are among
    # the best of its other fields: over all spouses, and for each spouse whose surname earns points.
    fields = [*SEARCH, "given", "alike_text"]
    scored = asked.select(*fields).distinct().join(listed.drop("ids"), list(SEARCH)).withColumn("score", base)
    of_all = F.row_number().over(Window.partitionBy(*fields).orderBy(*order))
    scored = materialized(top_rows(scored, [*fields, "spouse_surname"], order, keep, "_of_spouse").drop("_of_spouse").withColumn("_of_all", of_all))
    one = [*fields, "mother_surname"]
    rows = asked.select(*one).distinct().join(scored, fields).withColumn("_maiden", maiden).where((F.col("_maiden") > 0) | (F.col("_of_all") <= keep))
    best = top_rows(rows.withColumn("score", F.col("score") + F.col("_maiden")), one, order, keep, "_place")
    # Entries are looked up where fewer than ``keep`` stand before them.
    before = F.sum("n").over(Window.partitionBy(*one).orderBy(*rank)) - F.sum("n").over(Window.partitionBy(*one, "score", "pass_no", "nth"))
    best = best.withColumn("_before", before).where(F.col("_before") < keep).select(*one, *SIGNATURE, "score", "pass_no", "nth", "sig_no")
    each = best.join(listed.select("sig_no", F.explode("ids.entry_id").alias("entry_id")), "sig_no")
    best = top_rows(each, one, order, keep, "hyp")
    hyp = {"surname": "h_surname", "forenames": "h_forenames", "year": "h_year", "district": "h_district", "spouse_surname": "h_maiden"}
    best = best.select(*one, "hyp", "score", "pass_no", "entry_id", *[F.col(k).alias(v) for k, v in hyp.items()])
    beside = [F.col(c).alias(p) for c, p in PARENTS.items() if parents]
    return asked.select(*KEY, *one, *carried).join(best, one).select(*KEY, "hyp", "score", "pass_no", "entry_id", *hyp.values(), *beside)


def census_years(fact: DataFrame) -> DataFrame:
    """Distinct census years of each person in recorded order; there are few years, however many facts."""
    year = F.regexp_extract("fact_date", r"(\d{4})", 1).try_cast("int")
    once = fact.where(F.lower("fact_type").contains("census")).select("person_id", "seq", year.alias("year")).where("year is not null").groupBy("person_id", "year").agg(F.min("seq").alias("seq"))
    return once.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "year"))), lambda x: x["year"]).alias("census"))


def _with_usable(cand: DataFrame) -> DataFrame:
    """Search results with ``usable`` (neither rejected nor clearly abroad) and ``c_district``; places are read once each."""
    read = read_once(cand, "c_place", _abroad=places.clearly_foreign, c_district=places.district_of)
    return read.withColumn("usable", ~F.col("_abroad") & ~F.coalesce(F.col("rejected"), F.lit(False))).drop("_abroad")


def usable_results(cand: DataFrame, shown: int | None = None) -> DataFrame:
    """Search results that are neither rejected nor clearly abroad; then, if asked, the first ``shown`` of a slot."""
    left = _with_usable(cand).where("usable").drop("usable", "c_district")
    return left if shown is None else top_rows(left, KEY, [F.col("rnk")], shown, "_shown").drop("_shown")


def household_match(hyps: DataFrame, cand: DataFrame, census: DataFrame, tried: int | None = None, shown: int | None = None) -> DataFrame:
    """The search result that fits each tried hypothesis best, and how well: primary at 60, alternate at 30.

    ``cand``: job, slot, rnk, person_id, c_given, c_year, c_place, father_surname, mother_surname, death_year.
    All hypotheses and all usable results unless ``tried`` or ``shown`` says how many of each. A slot with
    no result at all, usable or not, leaves its hypotheses as they are. ``census_seen`` are the distinct years.

    A pair of hypothesis and result is folded into numbers alone: results are numbered within their slot, and the
    best one is looked up by its number afterwards. Hypotheses and results are each dealt out by slot and stay there:
    a hypothesis is a group by all its columns, so it need not be met again, and the best result is met by slot.
    Rows of one slot and number count as one hypothesis, and each of them stays.
    """
    tried = hyps if tried is None else hyps.where(F.col("hyp") <= tried)
    # What depends on the candidate alone is worked out before it meets the hypotheses, and after it met its census years.
    listed = _with_usable(cand.join(census, "person_id", "left")).withColumn("c_first", F.substring_index("c_given", " ", 1))
    if shown is not None:
        listed = top_rows(listed, [*KEY, "usable"], [F.col("rnk")], shown, "_shown").drop("_shown")
    listed = materialized(listed.withColumn("_row", F.monotonically_increasing_id()))
    listed = listed.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("rnk", "_row")))
    own = [*KEY, "hyp", *[c for c in tried.columns if c not in (*KEY, "hyp")]]
    rows = tried.where(F.col(JOB).isNotNull() & F.col(SLOT).isNotNull() & F.col("hyp").isNotNull()).join(listed, KEY, "left")
    seen = F.col("person_id").isNotNull()
    usable = F.coalesce("usable", F.lit(False))
    off = F.abs(F.col("c_year") - F.col("h_year"))
    place = F.when((F.col("h_district") != "") & (F.col("c_place") != ""), first_true([
        (F.lower("c_place").contains(F.lower("h_district")), 15), (places.district_match(F.col("h_district"), F.col("c_district")), 10)], 0)).otherwise(0)
    child = F.get(F.filter("census", lambda y: (y - F.col("h_year")).between(0, CHILD_YEARS)), F.lit(0))
    score = (F.when(names.names_similar(F.col("c_first"), F.col("h_forenames")), 20).otherwise(0) + place
             + first_true([(off <= 1, 15), (off <= 2, 10), (off <= 3, 5)], 0)
             + F.when((F.col("father_surname") != "") & (F.lower("father_surname") == F.lower("h_surname")), 15).otherwise(0)
             + F.when((F.col("mother_surname") != "") & (F.col("h_maiden") != "") & (F.lower("mother_surname") == F.lower("h_maiden")), 25).otherwise(0)
             + F.when(F.col("_child").isNotNull(), 10).otherwise(0))
    rows = rows.withColumn("_child", F.when(usable, child)).withColumn("_s", F.when(usable, score))
    # Highest score, then lowest number, as one number; the years seen as bits, which 64 hold for any span of sixteen.
    place_of = F.when(F.col("_s") > 0, (F.lit(TOP_SCORE) - F.col("_s")).cast("long") * F.lit(1 << 32) + F.col("nth"))
    bit = F.when(F.col("_child").isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("_child"), F.lit(64))))
    first = F.coalesce("nth", F.lit(1)) == 1
    out = rows.groupBy(*own).agg(F.count(F.when(seen, 1)).alias("results"), F.min(place_of).alias("_best"), F.count("_child").alias("census_hits"), F.bit_or(bit).alias("_seen"), F.count(F.when(first, 1)).cast("int").alias("_rows"))
    one = Window.partitionBy(*KEY, "hyp")
    out = out.withColumns({"results": F.sum("results").over(one), "_best": F.min("_best").over(one), "census_hits": F.sum("census_hits").over(one), "_seen": F.bit_or("_seen").over(one)})
    s = F.coalesce(F.lit(TOP_SCORE) - F.shiftright("_best", 32).cast("int"), F.lit(0))
    status = first_true([(F.col("results") == 0, "hypothesis"), (s >= PRIMARY_AT, "primary"), (s >= ALTERNATE_AT, "alternate")], "discarded")
    out = out.select(*own, status.alias("status"), s.alias("household_score"), (F.col("_best") % F.lit(1 << 32)).cast("int").alias("_nth"), "census_hits", "_seen", "_rows")
    won = listed.select(F.col(JOB).alias("_job"), F.col(SLOT).alias("_slot"), F.col("nth").alias("_won"), "person_id", "c_name", "death_year", "census")
    # A difference, not an equality: a join by number too would deal out all rows anew.
    out = out.join(won, (F.col(JOB) == F.col("_job")) & (F.col(SLOT) == F.col("_slot")) & (F.col("_won") - F.col("_nth") == 0), "left").drop("_job", "_slot", "_won", "_nth")
    out = out.withColumn("_rows", F.explode(F.sequence(F.lit(1), F.col("_rows")))).drop("_rows")
    years = F.filter(F.transform(F.sequence(F.lit(0), F.lit(CHILD_YEARS)), lambda k: k + F.col("h_year")), lambda y: F.getbit(F.col("_seen"), F.pmod(y, F.lit(64))) == 1)
    return out.withColumn("census_seen", F.when(F.col("_seen").isNotNull(), years).otherwise(F.array().cast("array<int>"))).drop("_seen")


def _gap_points(gap: Column) -> Column:
    return first_true([(gap.between(0, 5), 20), (gap.between(0, 10), 15), (gap.between(0, 15), 10)], 0)


def parent_couple(hyps: DataFrame, people: DataFrame, civil: DataFrame) -> DataFrame:
    """The parents' marriage for every tried hypothesis: by the father's name, and by the mother's if that is weak."""
    if set(PARENTS.values()) <= set(hyps.columns):
        j = hyps.withColumnsRenamed({p: c for c, p in PARENTS.items()})
    else:
        j = hyps.join(people.select(*KEY, *PARENTS), KEY)
    j = j.withColumn("wife", F.when(F.col("h_maiden") != "", F.col("h_maiden")).otherwise(F.col("mother_surname")))
    j = materialized(j.where((F.col("h_surname") != "") & (F.col("wife") != "") & F.col("h_year").isNotNull()).select(*KEY, "hyp", "h_surname", "h_year", "h_district", "wife", "father_given", "mother_given"))
    return _couple_marriage(j, civil, [*KEY, "hyp"], "h_surname", "father_given", "wife", "mother_given", F.col("h_year") - 15, F.col("h_year"), F.col("h_district"),
                            marks=(25, 30, 15), gap=_gap_points(F.col("h_year") - F.col("year")), ask_more=["h_year", "h_district"], weak=60)


def _couple_marriage(rows: DataFrame, civil: DataFrame, keys: list[str], man: str, man_given: str, wife: str, wife_given: str, lo: Column, hi: Column, district: Column,
                     marks: tuple[int, int, int], gap: Column, ask_more: list[str], weak: int, gap_bride: Column | None = None, bride_needs_given: bool = True) -> DataFrame:
    own, other, first = marks

    def side(df: DataFrame, who: str, given: str, spouse: str, how: int, gap_points: Column) -> DataFrame:
        asked = with_search(df, F.col(who), F.col(given), lo, hi, district).withColumn("_sp", F.lower(spouse))
        dist = F.col("district_text") if "district_text" in ask_more else F.col("district_key")
        score = (F.lit(own) + F.when(F.lower("spouse_surname") == F.col("_sp"), other).otherwise(0) + F.when((F.col(given) != "") & names.names_similar(F.col("forenames"), F.col(given)), first).otherwise(0)
                 + gap_points + F.when((dist != "") & (F.lower("district") == F.lower(dist)), 10).otherwise(F.when(places.district_match(dist, F.col("district")), 5).otherwise(0)))
        ask = list(dict.fromkeys([given, "_sp", *ask_more]))
        best = best_entries(asked, civil, "marriage", ask, score, 1, given="maybe")
        return asked.join(best, [*SEARCH, *ask]).select(*keys, F.lit(how).alias("side"), "score", "entry_id", "entry_surname", "entry_forenames", "entry_spouse_surname", "entry_year", "entry_district")

    groom = materialized(side(rows, man, man_given, wife, 1, gap))
    left = rows.join(groom.where(F.col("score") >= weak).select(*keys), keys, "left_anti").where(F.col(wife) != "")
    if bride_needs_given:
        left = left.where(F.col(wife_given) != "")
    left = materialized(left)  # read for its questions and again for their answers
    bride = side(left, wife, wife_given, man, 2, gap if gap_bride is None else gap_bride)
    return best_row(groom.unionByName(bride), keys, "score", [F.col("side")], COUPLE_AT)


def family_crosscheck(hyps: DataFrame, marriage: DataFrame) -> DataFrame:
    """Does the marriage agree with the birth: surnames 15 each, district 10 or 5, year 10; verified at 25."""
    j = hyps.join(marriage.drop("score"), [*KEY, "hyp"])
    gap = F.col("h_year") - F.col("entry_year")
    score = (F.when(F.lower("h_surname") == F.lower("entry_surname"), 15).otherwise(0) + F.when((F.col("h_maiden") != "") & (F.lower("h_maiden") == F.lower("entry_spouse_surname")), 15).otherwise(0)
             + F.when(F.lower("h_district") == F.lower("entry_district"), 10).otherwise(F.when(places.district_match(F.col("h_district"), F.col("entry_district")), 5).otherwise(0)) + F.when(gap.between(0, 15), 10).otherwise(0))
    return j.select(*KEY, "hyp", score.alias("crosscheck"), (score >= VERIFIED_AT).alias("verified"))


def other_decade() -> Column:
    """Does the person found stand in a census that is eight years or more from all that show the child?"""
    return F.when(F.col("person_id").isNotNull(), F.get(F.filter("census", lambda y: ~F.exists("census_seen", lambda e: F.abs(e - y) < 8)), F.lit(0))).isNotNull()


def reinforcements(matched: DataFrame, civil: DataFrame) -> DataFrame:
    """A sibling's birth (15), the death (10), a census in another decade (10), per hypothesis.

    ``matched`` has ``census`` and ``census_seen``, or ``later_census`` already worked out of them."""
    sib = sibling_births(civil).select(F.col("surname").alias("_s"), F.col("district").alias("_d"), F.col("maiden").alias("_m"), F.col("year").alias("h_year"), F.col("forenames").alias("_f"), "first_sibling")
    sib = materialized(sib)  # one row a distinct birth: its size decides how the hypotheses meet it
    later = F.col("later_census") if "later_census" in matched.columns else other_decade()
    j = matched.select(*KEY, "hyp", "h_year", F.lower("h_surname").alias("_s"), F.lower("h_district").alias("_d"), F.lower("h_maiden").alias("_m"), F.lower("h_forenames").alias("_f"), later.alias("later_census"))
    j = j.join(maybe_broadcast(sib), ["_s", "_d", "_m", "h_year", "_f"], "left").select(*KEY, "hyp", F.col("first_sibling").isNotNull().alias("sibling"), "later_census")
    ask = matched.where("person_id is not null and death_year is not null").select(
        *KEY, "hyp", names.first_word(names.given_part(F.col("c_name"))).alias("first"), names.surname_part(F.col("c_name")).alias("last"), "death_year")
    died = confirm_death(ask, civil).select(*KEY, "hyp", F.col("entry_id").alias("death_entry"))
    return j.join(died, [*KEY, "hyp"], "left").select(*KEY, "hyp", "sibling", F.col("death_entry").isNotNull().alias("death"), "later_census")


def triangle(birth_weight: Column, census_hits: Column, marriage: Column, verified: Column, sibling: Column, death: Column, later: Column) -> Column:
    """Confidence of an evidence chain: a closed triangle, with or without reinforcement, or what there is of it."""
    weight = (birth_weight + census_hits * CENSUS_WEIGHT + F.when(marriage, MARRIAGE_WEIGHT).otherwise(0) + F.when(sibling, SIBLING_WEIGHT).otherwise(0)
              + F.when(death, DEATH_WEIGHT).otherwise(0) + F.when(later, LATER_CENSUS_WEIGHT).otherwise(0))
    independent = F.lit(1) + marriage.cast("int") + sibling.cast("int") + death.cast("int")
    closed = marriage & ((census_hits > 0) | later | sibling)
    score = first_true([
        (closed & (sibling | death | later), F.least(F.lit(100), 85 + F.least(F.lit(15), weight - 55))),
        (closed, F.least(F.lit(89), 75 + F.least(F.lit(14), weight - 40))),
        (independent >= 2, F.least(F.lit(74), 50 + F.least(F.lit(24), weight - 25))),
    ], F.least(F.lit(49), 25 + F.least(F.lit(24), weight - 10)))
    score = F.when(marriage & ~verified, F.least(score, F.lit(60))).otherwise(score)
    return F.when(~marriage, F.least(score, F.lit(65))).otherwise(score).cast("int")


def _birth_weight() -> Column:
    return F.when(F.col("pass_no") == 3, VARIANT_WEIGHT).otherwise(BIRTH_WEIGHT)


def _no(*cols: str) -> dict[str, Column]:
    return {c: F.coalesce(c, F.lit(False)) for c in cols}


def chain(people: DataFrame, cand: DataFrame, census: DataFrame, civil: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All tried hypotheses with their confidence, and the one that is stored per slot: the first scoring 50,
    else the first hypothesis on its birth entry alone."""
    # Each part is written with no more than its flags, so no step deals out the texts and the flags of all parts at once.
    def matching() -> DataFrame:
        hyps = settled(lambda: birth_hypotheses(people, civil, parents=True))
        return household_match(hyps, cand, census).withColumn("later_census", other_decade()).drop("census", "census_seen")

    matched = settled(matching)
    live = matched.where("status <> 'discarded'")
    cross = settled(lambda: family_crosscheck(live, materialized(parent_couple(live, people, civil))))
    more = settled(lambda: reinforcements(live, civil))
    j = live.drop("later_census").join(cross.withColumn("marriage", F.lit(True)), [*KEY, "hyp"], "left").join(more, [*KEY, "hyp"], "left").withColumns(_no("marriage", "verified", "sibling", "death", "later_census"))
    f = F.col
    scored = materialized(j.select(*KEY, "hyp", "entry_id", "status", "household_score", "person_id", "marriage", "verified", F.coalesce("crosscheck", F.lit(0)).alias("crosscheck"), "sibling", "death", "later_census", "census_hits",
                                   triangle(_birth_weight(), f("census_hits"), f("marriage"), f("verified"), f("sibling"), f("death"), f("later_census")).alias("confidence")))
    good = first_row(scored.where(f("confidence") >= ENOUGH), KEY, [f("hyp")])
    no = F.lit(False)
    alone = matched.where("hyp = 1").join(good.select(*KEY), KEY, "left_anti")
    alone = alone.select(*KEY, "hyp", "entry_id", "status", "household_score", "person_id", no.alias("marriage"), no.alias("verified"), F.lit(0).alias("crosscheck"), no.alias("sibling"), no.alias("death"), no.alias("later_census"), "census_hits",
                         triangle(_birth_weight(), f("census_hits"), no, no, no, no, no).alias("confidence"))
    return scored, good.unionByName(alone).withColumn("level", evidence.confidence_level(f("confidence")))


def lead_only(people: DataFrame, hyps: DataFrame, cand: DataFrame, shown: int | None = None) -> DataFrame:
    """Slots without any birth entry: the best search result from 25 points, at most 49; else a not-found row."""
    left = materialized(people.join(hyps.select(*KEY).distinct(), KEY, "left_anti").drop("person_id"))  # few slots: results of others go first
    cand = cand.join(maybe_broadcast(left.select(*KEY)), KEY, "left_semi")
    rows = left.join(usable_results(cand, shown), KEY)
    inside = (F.col("c_place") != "") & (F.col("birth_place") != "") & F.lower("c_place").contains(F.lower("district_text"))
    score = (F.when(names.names_similar(F.substring_index("c_given", " ", 1), F.col("given")), 20).otherwise(0) + F.when(F.abs(F.col("c_year") - F.col("year")) <= 3, 15).otherwise(0)
             + F.when(inside, 10).otherwise(0) + F.when((rows["father_surname"] != "") & (F.lower(rows["c_father_surname"]) == F.lower(rows["father_surname"])), 15).otherwise(0)
             + F.when((rows["mother_surname"] != "") & (F.lower(rows["c_mother_surname"]) == F.lower(rows["mother_surname"])), 20).otherwise(0))
    best = best_row(rows.withColumn("score", score).select(*KEY, "person_id", F.col("c_name").alias("name"), "score", "rnk"), KEY, "score", [F.col("rnk")], LEAD_AT)
    found = best.select(*KEY, "person_id", "name", F.least(F.lit(49), F.col("score") + 25).alias("confidence"))
    missing = left.join(found.select(*KEY), KEY, "left_anti")
    who = F.when((F.col("given") != "") & (F.col("surname") != ""), F.concat_ws(" ", "given", "surname")).otherwise("Unknown")
    none = missing.select(*KEY, F.lit("").alias("person_id"), F.concat(who, F.lit(" (not found)")).alias("name"), F.lit(0).alias("confidence"))
    return found.unionByName(none).withColumn("level", evidence.confidence_level(F.col("confidence")))


def enrich_known(people: DataFrame, cand: DataFrame, civil: DataFrame, shown: int | None = None) -> DataFrame:
    """Customer rows with a birth entry within two years and a lead; their confidence stays."""
    mine = people.where("confidence_level = 'Customer Data'").drop("person_id")
    y = F.col("year")
    asked = with_search(mine.where("year is not null"), F.col("surname"), F.col("given"), y - 2, y + 2, F.col("district_"))
    best = best_entries(asked, civil, "birth", ["given"], F.lit(1), 1, keep=names.names_similar(F.col("forenames"), F.col("given")), given="maybe")
    births = asked.join(best, [*SEARCH, "given"]).select(*KEY, F.col("entry_id").alias("birth_entry"))
    rows = mine.join(usable_results(cand, shown), KEY)
    ok = (names.names_similar(F.substring_index("c_given", " ", 1), F.col("given")) & ~F.coalesce(F.abs(F.col("c_year") - y) > 5, F.lit(False)))
    leads = first_row(rows.where(ok).select(*KEY, "person_id", "rnk"), KEY, [F.col("rnk")]).select(*KEY, F.col("person_id").alias("lead_id"))
    return mine.select(*KEY, F.lit(100).alias("confidence")).join(births, KEY, "left").join(leads, KEY, "left").where("birth_entry is not null or lead_id is not null")


def parent_profiles(people: DataFrame, anchors: DataFrame) -> DataFrame:
    """Expected father and mother of every slot: what the customer said first, then what the child's result says.

    ``people`` carries father_given, father_surname, mother_given, mother_surname and maiden (may be blank).
    """
    f, m = F.col("father_given") != "", F.col("mother_given") != ""
    slot, year = F.col(SLOT), F.col("year")
    father = F.when(f | (F.col("father_surname") != ""), F.struct(slots.father_of(slot).alias("parent_slot"), F.col("father_given").alias("given"), F.when(F.col("father_surname") != "", F.col("father_surname")).otherwise(F.col("surname")).alias("surname"), (year - 28).alias("year")))
    mother = F.when(m | (F.col("mother_surname") != ""), F.struct(slots.mother_of(slot).alias("parent_slot"), F.col("mother_given").alias("given"), F.col("mother_surname").alias("surname"), (year - 25).alias("year")))
    rows = people.select(JOB, SLOT, F.col("birth_place").alias("place"), F.explode(F.array_compact(F.array(father, mother))).alias("_x")).select(JOB, SLOT, "place", "_x.*")
    said = anchors.select(JOB, F.col(SLOT).alias("parent_slot"), F.col("given").alias("_g"), F.col("surname").alias("_s"), F.col("year").alias("_y"))
    j = rows.join(said, [JOB, "parent_slot"], "left")
    return j.select(JOB, SLOT, "parent_slot", F.coalesce(F.when(F.col("_g") != "", F.col("_g")), "given").alias("given"), F.coalesce(F.when(F.col("_s") != "", F.col("_s")), "surname").alias("surname"), F.coalesce("_y", "year").alias("year"), "place")


def couple_marriage(people: DataFrame, civil: DataFrame) -> DataFrame:
    """Marriage of two filled slots, attached to both: by the husband's name, and by the wife's if that is weak."""
    men = people.where(slots.is_father(F.col(SLOT)) & (F.col("surname") != "")).select(*KEY, F.col("surname").alias("man"), F.col("given").alias("man_given"), F.col("year").alias("man_year"), F.col("birth_place").alias("man_place"))
    wives = people.select(JOB, (F.col(SLOT) - 1).alias(SLOT), F.col("surname").alias("wife"), F.col("given").alias("wife_given"), F.col("year").alias("wife_year"), F.col("birth_place").alias("wife_place"))
    kids = people.select(JOB, F.col(SLOT).alias("_c"), F.col("year").alias("child_year"))
    j = men.join(wives, KEY).withColumn("_c", slots.child_of(F.col(SLOT))).join(kids, [JOB, "_c"], "left").drop("_c")
    place = F.when(F.col("man_place") != "", F.col("man_place")).otherwise(F.col("wife_place"))
    j = j.withColumn("district_text", places.district_of(place)).where("child_year is not null or man_year is not null")
    j = materialized(with_resolved_district(j, civil, "district_text", "district_"))
    for c in ("child_year", "man_year", "wife_year"):
        j = j.withColumn(c, F.coalesce(c, F.lit(0)))
    has_child, g = F.col("child_year") > 0, F.col("child_year") - F.col("year")
    lo = F.when(has_child, F.col("child_year") - 15).otherwise(F.col("man_year") + 18)
    hi = F.when(has_child, F.col("child_year")).otherwise(F.col("man_year") + 45)
    man_age, wife_age = F.col("year") - F.col("man_year"), F.col("year") - F.col("wife_year")
    gap = F.when(has_child, first_true([(g.between(0, 5), 15), (g.between(0, 10), 10), (g.between(0, 15), 5)], 0)).otherwise(F.when((F.col("man_year") > 0) & man_age.between(20, 35), 10).otherwise(0))
    gap_bride = F.when(has_child, first_true([(g.between(0, 5), 15), (g.between(0, 10), 10)], 0)).otherwise(F.when((F.col("wife_year") > 0) & wife_age.between(18, 35), 10).otherwise(0))
    found = _couple_marriage(j, civil, KEY, "man", "man_given", "wife", "wife_given", lo, hi, F.col("district_"), (20, 30, 20), gap, ["child_year", "man_year", "wife_year", "district_text"], 50, gap_bride, bride_needs_given=False)
    both = found.select("*", F.explode(F.array(F.col(SLOT), F.col(SLOT) + 1)).alias("_slot"))
    return both.select(JOB, F.col("_slot").alias(SLOT), "score", "side", "entry_id", F.col("entry_year").alias("marriage_year"), F.col("entry_district").alias("marriage_district"))
