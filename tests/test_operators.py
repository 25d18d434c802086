"""Operators against brute force, their invariants, and what happens with one very heavy key."""

import random

import pytest
from pyspark.sql import functions as F

from kinforge.functions import names, places
from kinforge.operators import changes, civil, evidence_chain, linking, merge, ranking, review, scoring, tree
from kinforge.operators.review import agreed_adjustment
from kinforge.sources import civil_index, tree_api
from kinforge.fixtures import table


def test_ordered_assignment_equals_one_by_one(spark):
    rng = random.Random(7)
    rows = [(job, slot, f"C{rng.randint(1, 12)}", rnk) for job in range(6) for slot in range(1, 16) for rnk in range(1, rng.randint(2, 9))]
    got = {(r.job_id, r.asc_no): r.person_id for r in linking.ordered_assignment(spark.createDataFrame(rows, "job_id long, asc_no int, person_id string, rnk int")).collect()}
    want = {}
    for job in range(6):
        used = set()
        for slot in range(1, 16):
            for person in [p for _, _, p, _ in sorted((r for r in rows if r[0] == job and r[1] == slot), key=lambda r: r[3])]:
                if person not in used:
                    used.add(person)
                    want[(job, slot)] = person
                    break
    assert got == want


def test_ordered_assignment_survives_a_slot_with_very_many_candidates(spark):
    rows = spark.range(30000).select(F.lit(1).cast("long").alias("job_id"), F.lit(2).alias("asc_no"), F.concat(F.lit("P"), "id").alias("person_id"), (F.col("id") + 1).cast("int").alias("rnk"))
    few = spark.createDataFrame([(1, 3, "P0", 1), (1, 3, "Q", 2)], "job_id long, asc_no int, person_id string, rnk int")
    got = {r.asc_no: r.person_id for r in linking.ordered_assignment(rows.unionByName(few)).collect()}
    assert got == {2: "P0", 3: "Q"}


def test_once_per_tree_keeps_the_lowest_slot(spark):
    p = spark.createDataFrame([(1, 4, "a"), (1, 6, "a"), (1, 5, "b"), (2, 4, "a")], "job_id long, asc_no int, person_id string")
    used = spark.createDataFrame([(1, "b")], "job_id long, person_id string")
    assert sorted((r.job_id, r.asc_no) for r in linking.once_per_tree(p, used).collect()) == [(1, 4), (2, 4)]


def _merge_by_hand(rows):
    leaders, place = [], {}
    for seq, name, year in rows:
        f, k = name.lower().split()[0], name.lower().split()[-1]
        exact = next((n for n, (lf, lk, ly) in leaders if (lf, lk, ly) == (f, k, year)), None)

        def near(a, b):
            return a.startswith(b) or b.startswith(a) or (len(a) >= 3 and len(b) >= 3 and a[:3] == b[:3])

        hit = exact or next((n for n, (lf, lk, ly) in leaders if near(f, lf) and near(k, lk) and (year is None or ly is None or abs(year - ly) <= 3)), None)
        if hit is None:
            leaders.append((seq, (f, k, year)))
            hit = seq
        place[seq] = hit
    return sorted(set(place.values()))


def test_merge_equals_one_by_one(spark):
    rng = random.Random(3)
    given, family = ["Will", "William", "Wilma", "Bill", "Anne", "Ann", "W", "Wi", "Wil"], ["Hunt", "Hunter", "Smith", "Smyth", "H", "Hu", "S"]
    by_search, rows = {}, []
    for job in range(40):
        mine = []
        for seq in range(1, 25):
            name, year = f"{rng.choice(given)} {rng.choice(family)}", rng.choice([None, *range(1900, 1912)])
            mine.append((seq, name, year))
            rows.append((job, 1, seq, f"I{seq}", name, "" if year is None else str(year), "", rng.choice(["tree", "civil"])))
        by_search[job] = _merge_by_hand(mine)
    df = spark.createDataFrame(rows, "job_id long, asc_no int, rnk int, person_id string, name string, birth_date string, birth_place string, source string")
    got = {}
    for r in merge.merge_results(df).collect():
        got.setdefault(r.job_id, []).append(r.leader_rnk)
        mine = [x for x in rows if x[0] == r.job_id]
        assert sorted(r.sources) == sorted(r.source_ids) and set(r.sources) <= {x[7] for x in mine}
    assert {k: sorted(v) for k, v in got.items()} == by_search
    ids = sum(len(set(x[7] for x in rows if x[0] == job)) for job in by_search)
    assert merge.merge_results(df).selectExpr("sum(size(sources)) AS n").first().n >= ids


def test_merge_fills_six_gaps_from_rows_of_the_same_key(spark):
    rows = [(1, 1, 1, "a", "John Cox", "1900", "", "", "", "", "", "x"), (1, 1, 2, "b", "Johnny Cox", "1901", "Ely", "1950", "Ely", "F", "M", "y"), (1, 1, 3, "c", "john  cox", "1900", "Derby", "1970", "", "", "Ann", "z"), (1, 1, 4, "d", "John Cox", "1900", "Leek", "1980", "Hull", "Tom", "Eve", "x"),
            (1, 1, 5, "e", None, "", "", "", "", "", "", "x"), (1, 1, 6, "f", "", "", "", "", "", "", "", "y")]
    df = spark.createDataFrame(rows, "job_id long, asc_no int, rnk int, person_id string, name string, birth_date string, birth_place string, death_date string, death_place string, father_name string, mother_name string, source string")
    got = {r.leader_rnk: r for r in merge.merge_results(df).collect()}
    john = got[1]
    assert (john.birth_place, john.death_date, john.death_place, john.father_name, john.mother_name) == ("Derby", "1970", "Hull", "Tom", "Ann")
    assert john.sources == ["x", "y", "z"] and john.source_ids == {"x": "d", "y": "b", "z": "c"}
    assert set(got) == {1, 5} and got[5].source_ids == {"x": "e", "y": "f"}


def test_merge_of_one_search_with_very_many_keys(spark):
    """100,000 keys of one search, most of them alike in their first letters."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("job_id"), F.lit(1).alias("asc_no"), (F.col("id") + 1).cast("int").alias("rnk"), F.concat(F.lit("I"), "id").alias("person_id"),
                                 F.concat(F.lit("Will"), "id", F.lit(" Hunt"), F.col("id") % 7).alias("name"), (1700 + (F.col("id") * 7919) % 300).cast("string").alias("birth_date"), F.lit("").alias("birth_place"), F.lit("tree").alias("source"))
    years, leaders = [1700 + (i * 7919) % 300 for i in range(n)], []
    for y in years[:300]:
        if not any(abs(y - x) <= 3 for x in leaders):
            leaders.append(y)
    got = merge.merge_results(rows).collect()
    assert sorted(r.leader_rnk for r in got) == sorted(years.index(y) + 1 for y in leaders)


def test_carry_forward_crosses_chunks(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("string").alias("doc"), F.col("id").alias("n"), F.when(F.col("id").isin(0, 1, 700, 701), F.col("id").cast("string")).alias("v"))
    small = {(r.doc, r.n): r.o for r in ranking.carry_forward(df, "doc", "n", F.col("v"), "o", 16).collect()}
    big = {(r.doc, r.n): r.o for r in ranking.carry_forward(df, "doc", "n", F.col("v"), "o").collect()}
    assert small == big and small[("0", 698)] == "0" and small[("1", 999)] == "701"


def _civil(spark, rows):
    return spark.createDataFrame(rows, "entry_type string, surname string, forenames string, spouse_surname string, year int, quarter string, district string, volume string, page string, entry_id long")


def test_search_wider_than_the_index_shows_answers_nothing(spark):
    many = [("birth", "Smith", "John", "", 1900, "Mar", "Derby", "7b", str(i), i) for i in range(50)] + [("birth", "Hunt", "Ann", "", 1900, "Mar", "Derby", "7b", "1", 99)]
    idx = _civil(spark, many)
    asked = spark.createDataFrame([(1, 2, "John", "Smith", 1900, ""), (1, 3, "Ann", "Hunt", 1901, "Derby")], "job_id long, asc_no int, first string, last string, birth_year int, birth_place string")
    y = F.col("birth_year")
    s = civil_index.searches_of(civil_index.with_search(asked, F.col("last"), F.col("first"), y - 1, y + 1, F.lit("")))
    assert {(r.surname_key, r.overflow, r.matches) for r in civil_index.search_overflow(s, idx, "birth", 40).collect()} == {("smith", True, 50), ("hunt", False, 1)}
    assert [r.entry_id for r in civil_index.civil_search(s, idx, "birth", 40).collect()] == [99]
    best = civil.confirm_birth(asked, idx).collect()
    assert {(r.asc_no, r.entry_id, r.score) for r in best} == {(2, 0, 90), (3, 99, 90)}


def test_two_sided_tolerates_a_missing_volume(spark):
    m = [("marriage", "Hunt", "Norman", "Skinner", 1920, "Mar", "Derby", "7b", "1", 1), ("marriage", "Skinner", "Ethel", "Hunt", 1920, "Mar", "Derby", "7b", "1", 2),
         ("marriage", "Skinner", "Ada", "Hunt", 1920, "Mar", "Derby", "", "1", 3), ("marriage", "Skinner", "Amy", "Hunt", 1920, "Mar", "Derby", "8a", "1", 4)]
    got = {(r.entry_id, r.groom.entry_id) for r in civil.two_sided(_civil(spark, m)).collect()}
    assert got == {(1, 2), (2, 1), (3, 1)}


def test_block_candidates_keeps_one_heavy_name_small(spark):
    pool = spark.range(20000).select(F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("person_id"), F.lit("Smith").alias("surname"), F.lit("John").alias("given"), F.lit(1900).alias("year"), F.lit("Derby").alias("place"))
    targets = spark.range(20000).select(F.col("id").alias("job_id"), F.lit(2).alias("asc_no"), F.lit("Smith").alias("surname"), F.lit("John").alias("given"), F.lit(1901).alias("year"), F.lit("Derby").alias("place"))
    out = linking.block_candidates(targets, pool, keep=3)
    assert out.count() == 60000
    assert [r.person_id for r in out.where("job_id = 7").orderBy("rnk").collect()] == ["P000000", "P000001", "P000002"]


def _pool(spark, names):
    rows = [(f"P{i:03d}", n, "John", 1900, "") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "person_id string, surname string, given string, year int, place string")


def test_contained_surnames_are_all_found_and_come_last(spark):
    """By brute force over many names; short ones stand inside nothing."""
    rng = random.Random(5)
    pool = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(400)} | {"hunt-smith", "whitehunt", "hunt", "hunter"})
    asked = pool[::3] + ["hunt", "smith", "zzz"]
    frames = spark.createDataFrame([(x,) for x in set(asked)], "s string"), spark.createDataFrame([(x,) for x in pool], "k string")
    got = {(r.s, r.k) for r in linking.contained_surnames(*frames).collect()}
    assert got == {(s, k) for s in asked for k in pool if s != k and min(len(s), len(k)) >= 3 and (s in k or k in s)}


def test_block_candidates_by_halves_and_inside(spark):
    pool = _pool(spark, ["Whitehunt", "Hunt-Smith", "Hunte", "Smith", "Jones-Hunt", "Hun", "Hu", "Brown", None, ""])
    def found(surname):
        one = spark.createDataFrame([(1, 2, surname, "John", 1901, "")], "job_id long, asc_no int, surname string, given string, year int, place string")
        return [r.person_id for r in linking.block_candidates(one, pool).orderBy("rnk").collect()]
    assert found("Hunt") == ["P001", "P002", "P004", "P000", "P005"]  # halves and spelling first, then what only contains
    assert found("Smith-Hunt") == ["P001", "P003", "P004", "P005"]
    assert found("Hu") == ["P006"] and found("Green") == [] and found("") == []


def test_contained_surnames_with_one_part_in_all(spark):
    """A part that most surnames share makes rows by distinct surname only, with no pair of people."""
    pool = spark.range(30_000).select(F.concat(F.lit("P"), "id").alias("person_id"), F.concat(F.lit("x"), F.col("id") % 500, F.lit("hunt")).alias("surname"), F.lit("John").alias("given"), F.lit(1900).alias("year"), F.lit("").alias("place"))
    targets = spark.range(5000).select(F.col("id").alias("job_id"), F.lit(2).alias("asc_no"), F.lit("Hunt").alias("surname"), F.lit("John").alias("given"), F.lit(1900).alias("year"), F.lit("").alias("place"))
    assert linking.block_candidates(targets, pool, keep=2).count() == 10_000


def test_a_middle_name_meets_and_counts_less(spark):
    rows = [("birth", "Hunt", "Herbert William", "", 1900, "Mar", "Derby", "7b", "1", 1), ("birth", "Hunt", "Williamson", "", 1900, "Mar", "Derby", "7b", "1", 2), ("birth", "Hunt", "William Herbert", "", 1901, "Mar", "Derby", "7b", "1", 3),
            ("birth", "Hunt", "", "", 1900, "Mar", "Derby", "7b", "1", 4), ("marriage", "Hunt", "Ann", "Cox", 1920, "Mar", "", "7b", "1", 5), ("marriage", "Hunt", "Mary Ann", "Fox", 1920, "Mar", "", "7b", "1", 6)]
    idx = _civil(spark, rows)
    asked = spark.createDataFrame([(1, 2, "William", "Hunt", 1900, ""), (1, 3, "Herbert", "Hunt", 1900, ""), (1, 4, "Will", "Hunt", 1900, "")], "job_id long, asc_no int, first string, last string, birth_year int, birth_place string")
    assert {(r.asc_no, r.entry_id, r.score) for r in civil.confirm_birth(asked, idx).collect()} == {(2, 1, 80), (3, 1, 90)}
    third = idx.where("entry_id = 3")
    assert {(r.asc_no, r.entry_id, r.score) for r in civil.confirm_birth(asked, third).collect()} == {(2, 3, 80), (3, 3, 70)}
    pairs = spark.createDataFrame([(1, 2, "Ann Mary", "Hunt", "Cox"), (1, 4, "Ann", "Hunt", "Fox")], "job_id long, asc_no int, first string, last string, spouse_last string")
    pairs = pairs.selectExpr("*", "1915 AS year_from_", "1925 AS year_to_", "'' AS district_")
    assert {(r.asc_no, r.entry_id, r.score) for r in civil.find_marriage(pairs, idx).collect()} == {(2, 5, 95), (4, 6, 80)}


def test_the_sixth_result_wins_where_five_cannot(spark):
    """Rejected and foreign results go before any cut; a cut is an argument and counts those that are left."""
    cand = spark.createDataFrame(
        [(1, 4, i, f"C{i}", "John", "John Cox", 1900, "Ohio, United States" if i < 4 else "", "", "", None, i in (4, 5)) for i in range(1, 6)] + [(1, 4, 6, "C6", "John", "John Cox", 1900, "Derby", "Cox", "", None, False), (1, 4, 7, "C7", "John", "John Cox", 1900, "Derby", "Cox", "Fox", None, False)],
        "job_id long, asc_no int, rnk int, person_id string, c_given string, c_name string, c_year int, c_place string, father_surname string, mother_surname string, death_year int, rejected boolean")
    hyps = spark.createDataFrame([(1, 4, h, "Cox", "John", 1900, "Derby", "Fox") for h in range(1, 8)], "job_id long, asc_no int, hyp int, h_surname string, h_forenames string, h_year int, h_district string, h_maiden string")
    census = spark.createDataFrame([], "person_id string, census array<int>")
    got = {r.hyp: (r.person_id, r.status) for r in evidence_chain.household_match(hyps, cand, census).collect()}
    assert got == {h: ("C7", "primary") for h in range(1, 8)}
    assert {r.hyp: r.person_id for r in evidence_chain.household_match(hyps, cand, census, tried=2, shown=1).collect()} == {1: "C6", 2: "C6"}


def test_hypotheses_from_signatures_are_the_best_of_all_entries(spark):
    """Against a full listing, ranked in Python: many entries alike, pages shared, none and few in the district."""
    rnd = random.Random(17)
    made, n = [], 0
    for surname in ("Hall", "Hallam", "Phoulton", "Foolton", "Brown"):
        for _ in range(400):
            n += 1
            district = rnd.choice(["Belper", "Derby", "Derby", "Ripley"])
            fore = rnd.choice(["Ann", "Ann", "Ann Mary", "Mary Ann", "Annie"])
            made.append(("birth", surname, fore, rnd.choice(["", "Smith"]), 1840 + rnd.randrange(4), "Mar", district, rnd.choice(["", "7b", "7b", "8c"]), str(rnd.randrange(60)), n))
    for k in range(2):
        made.append(("birth", "Hall", "Jane", "", 1841, "Mar", "Belper", "7b", str(k), n + 1 + k))
        made.append(("birth", "Hall", "Jane", "", 1842, "Jun", "Derby", "7b", str(k), n + 3 + k))
        made.append(("birth", "Hall", "Jane", "", 1842, "Jun", "Derby", "", str(k), n + 5 + k))
    civil_rows = spark.createDataFrame(made, "entry_type string, surname string, forenames string, spouse_surname string, year int, quarter string, district string, volume string, page string, entry_id long")
    asks = [("Hall", "Ann", "Belper"), ("Hall", "Ann", "Nowhere"), ("Hall", "Jane", "Belper"), ("Foulton", "Ann", "Derby"), ("Foolton", "Mary", ""), ("Brown", "", "Ripley"), ("Brown", "Ann", "")]
    people = spark.createDataFrame([("j", i, g, s, 1838 + i % 5, d, d, rnd.choice(["", "Smith"])) for i, (s, g, d) in enumerate(asks * 3)],
                                   "job_id string, asc_no long, given string, surname string, year int, district_text string, district_ string, mother_surname string")
    listed = evidence_chain.pass_union(people, civil_rows)
    asked = {(r.surname.lower(), r.given.lower(), r.year - 5, r.district_.lower()): [] for r in people.collect()}
    for r in listed.collect():
        asked[r.surname_key, r.given_key, r.year_from, r.district_key].append(r)
    assert {r.pass_no for rows in asked.values() for r in rows} == {1, 2, 3}
    pairs = spark.createDataFrame(sorted({(g.lower(), r[2]) for _, g, _ in asks for r in made}), "g string, f string")
    similar = {(r.g, r.f): r.s for r in pairs.select("g", "f", names.names_similar(F.col("f"), F.col("g")).alias("s")).collect()}
    spots = spark.createDataFrame(sorted({(d, r[6]) for _, _, d in asks for r in made}), "d string, e string")
    near = {(r.d, r.e): 8 for r in spots.select("d", "e", places.district_match(F.col("d"), F.col("e")).alias("m")).collect() if r.m}
    for keep in (1, 4, 15):
        got = {}
        for r in evidence_chain.birth_hypotheses(people, civil_rows, keep).collect():
            got.setdefault(r.asc_no, []).append((r.hyp, r.score, r.pass_no, r.entry_id))
        for p in people.collect():

            def score(e, p=p):
                off, given, fore = abs(e.year - p.year), p.given.lower(), e.forenames.lower()
                name = 0 if not given else 20 if similar[given, e.forenames] else 15 if fore.startswith(given) else 0
                place = 0 if not p.district_text else 15 if p.district_text == e.district else near.get((p.district_text, e.district), 0)
                return name + (20 if off == 0 else 15 if off == 1 else 10 if off <= 3 else 5) + place + (30 if p.mother_surname and p.mother_surname == e.spouse_surname else 0)

            rows = asked[p.surname.lower(), p.given.lower(), p.year - 5, p.district_.lower()]
            best = sorted((-score(e), e.pass_no, e.nth, e.entry_id) for e in rows)[:keep]
            assert sorted(got.get(p.asc_no, [])) == [(i + 1, -b[0], b[1], b[3]) for i, b in enumerate(best)], (keep, p)


def test_spans_make_up_every_range_of_years(spark):
    rng = random.Random(6)
    ranges = [(a, a + rng.randrange(0, 600)) for a in (rng.randrange(1500, 2000) for _ in range(300))] + [(1900, 1900), (1536, 2047)]
    rows = spark.createDataFrame(ranges, "lo int, hi int").select("lo", "hi", review._spans_within(F.col("lo"), F.col("hi")).alias("s")).collect()
    for r in rows:
        years = [y for j, n in (map(int, x.split(":")) for x in r.s) for y in range(n << j, (n + 1) << j)]
        assert sorted(years) == list(range(r.lo, r.hi + 1)) and len(r.s) <= 2 * review.SPANS


@pytest.mark.parametrize("keep", [3, 40])
def test_feedback_is_scored_in_full(spark, keep):
    """Every decision against every tree, by brute force; old decisions, blanks and nulls among them."""
    from datetime import datetime, timedelta

    rng, start = random.Random(9), datetime(2020, 1, 1)
    family = ["Hunt", "Hunt-Smith", "Hu", "Cox", "Coxe", "", None, "smith"]
    towns = ["Derby", "Derby, Derbyshire", "derbyshire", "", None, "Ely", "E"]
    told = [(i, 1, start + timedelta(hours=rng.randrange(20_000)), rng.choice(["accept", "reject"]), rng.choice(family), rng.choice([None, *range(1700, 2030, 7)]), rng.choice(towns)) for i in range(900)]
    feedback = spark.createDataFrame(told, "id long, job_id long, created_at timestamp, action_type string, surname string, birth_year int, location string")
    slots = [(job, s, 0, f"P{job}{s}", "A B", rng.choice(family) or "", rng.choice(towns) or "", str(rng.randrange(1750, 1990)) if job % 4 else "", "Male") for job in range(12) for s in range(1, 5)]
    anc = spark.createDataFrame(slots, "job_id long, asc_no int, gen int, person_id string, name string, surname string, birth_place string, birth_date string, gender string").withColumn("confidence_level", F.lit(""))
    era = {r.job_id: (r.year_from, r.year_to) for r in tree.tree_context(anc).collect()}
    newest, want = max(t[2] for t in told), set()
    low = lambda x: (x or "").lower()
    for job in era:
        names_ = {low(s[5]) for s in slots if s[0] == job} - {""}
        places_ = {low(s[6]) for s in slots if s[0] == job} - {""}
        scored = []
        for i, _, at, what, sur, year, place in told:
            sur, place, (lo, hi) = low(sur), low(place), era[job]
            points = (30 if sur in names_ else 15 if sur and any(sur in n or n in sur for n in names_) else 0) + (20 if place and any(place in p or p in place for p in places_) else 0)
            points += 10 * bool(year is not None and lo is not None and lo - 50 <= year <= hi + 50) + 5 * (at > newest - timedelta(days=30))
            if points:
                scored.append((-points, -at.timestamp(), -i, what))
        want |= {(job, -i, what, -p) for p, _, i, what in sorted(scored)[:keep]}
    assert {tuple(r) for r in review.feedback_relevance(feedback, anc, keep=keep).collect()} == want


def test_range_joins_build_no_pairs(spark, sf_dir):
    anc, idx = table(spark, sf_dir, "fx_anc"), table(spark, sf_dir, "fx_civil")
    for df in (civil.birth_range(anc, idx), civil.marriage_window(anc, idx), civil.sibling_births(idx), civil.confirm_birth(civil.named(anc), idx)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "PythonUDF" not in plan


def test_scores_lie_in_range_and_acceptance_follows(spark, sf_dir):
    anc, src, fact = (table(spark, sf_dir, n) for n in ("fx_anc", "fx_src", "fx_fact"))
    s = scoring.record_scoring(anc, src, fact)
    assert s.where("score < 0 or score > 100 or (accepted = 1) <> (score >= 75)").count() == 0
    assert s.count() == s.select("job_id", "asc_no").distinct().count() == anc.count()
    shuffled = scoring.record_scoring(anc.orderBy(F.rand(1)), src.orderBy(F.rand(2)), fact.orderBy(F.rand(3)))
    assert s.exceptAll(shuffled).count() == 0


def test_prune_is_idempotent_and_matches_subtree(spark, sf_dir):
    anc = table(spark, sf_dir, "fx_anc")
    roots = anc.where("asc_no in (5, 12)")
    once = changes.prune_subtree(anc, roots)
    assert changes.prune_subtree(once, roots).count() == once.count() == anc.count() - tree.subtree(anc, roots).count()


def test_undo_restores_what_apply_changed(spark, sf_dir):
    anc = table(spark, sf_dir, "fx_anc").select("job_id", "asc_no", "birth_date", "birth_place", "confidence_score", F.expr(f"cast(array() as {changes.LOG_TYPE})").alias("corrections_log"))
    fix = anc.where("asc_no = 9").select("job_id", "asc_no", F.lit("birth_place").alias("field"), F.lit("Belper").alias("value"), F.lit(0).alias("adj_a"), F.lit(0).alias("adj_b"))
    applied = changes.apply_suggestion(anc, fix)
    assert applied.where("birth_place = 'Belper'").count() == fix.count()
    command = fix.select("job_id", "asc_no", F.lit(0).alias("log_index"))
    back, told = changes.undo_correction(applied, command)
    assert back.drop("corrections_log").exceptAll(anc.drop("corrections_log")).count() == 0 and told.count() == fix.count()
    again, none = changes.undo_correction(back, command)
    assert none.count() == 0 and again.exceptAll(back).count() == 0


def test_agreed_adjustment_rounds_half_up(spark):
    df = spark.createDataFrame([(-2, -3), (5, 4), (-20, -34), (-20, -36), (5, -5), (0, 4)], "a int, b int")
    assert [r[0] for r in df.select(agreed_adjustment(F.col("a"), F.col("b"))).collect()] == [-2, 5, -27, None, None, None]


def test_slot_held_twice_is_refused(spark):
    twice = spark.createDataFrame([(1, 2), (1, 2)], "job_id long, asc_no int")
    with pytest.raises(Exception, match="slot held twice"):
        tree.assert_unique_slots(twice).collect()


def test_repeated_commands_keep_one_row_a_slot(spark):
    from kinforge.operators import changes

    log = f"cast(array() as {changes.LOG_TYPE}) as corrections_log"
    anc = spark.sql(f"SELECT 1 AS job_id, 4 AS asc_no, '1900' AS birth_date, 'Derby' AS birth_place, 50 AS confidence_score, 'Customer Data' AS confidence_level, 'location,date' AS missing_info, {log}")
    two = spark.createDataFrame([(1, 4, "birth_place", "Belper", None, None), (1, 4, "confidence_score", None, -8, 2)], "job_id int, asc_no int, field string, value string, adj_a int, adj_b int")
    out = changes.apply_suggestion(anc, two).collect()
    assert [(r.birth_place, r.confidence_score, len(r.corrections_log)) for r in out] == [("Belper", 47, 2)]
    undo = spark.createDataFrame([(1, 4, 0), (1, 4, 1), (1, 4, 1), (1, 4, 7)], "job_id int, asc_no int, log_index int")
    back, done = changes.undo_correction(changes.apply_suggestion(anc, two), undo)
    assert [(r.birth_place, r.confidence_score, [e.undone for e in r.corrections_log]) for r in back.collect()] == [("Derby", 50, [True, True])]
    assert done.count() == 2
    for said in (["Derby", "Belper"], ["Belper", "Derby"]):
        edits = spark.createDataFrame([(1, 4, "1901", None, 1), (1, 4, None, said[0], 2), (1, 4, None, said[1], 3)], "job_id int, asc_no int, birth_date string, birth_place string, at int")
        assert [(r.birth_date, r.birth_place) for r in changes.edit_info(anc, edits, "at").collect()] == [("1901", said[1])]
        assert [(r.birth_date, r.birth_place) for r in changes.partial_update(anc, edits, changes.KEY, "at").collect()] == [("1901", said[1])]
    new = spark.createDataFrame([(1, 4, "a"), (1, 4, "b"), (1, 5, "c"), (1, 5, "d")], "job_id int, asc_no int, confidence_level string")
    rows = changes.protected_upsert(anc.select("job_id", "asc_no", "confidence_level"), new).collect()
    assert sorted((r.asc_no, r.confidence_level) for r in rows) == [(4, "Customer Data"), (5, "d")]


def test_wide_searches_are_answered(spark):
    from kinforge.sources.civil_index import civil_search

    civil = spark.range(10_000).selectExpr("id AS entry_id", "'birth' AS entry_type", "'Smith' AS surname", "'John' AS forenames", "'' AS spouse_surname", "cast(1880 as int) AS year", "'Mar' AS quarter", "'Derby' AS district", "'7b' AS volume", "'1' AS page")
    asked = spark.createDataFrame([("smith", "john", 1878, 1882, "")], "surname_key string, given_key string, year_from int, year_to int, district_key string")
    assert civil_search(asked, civil, "birth").count() == 10_000
    assert civil_search(asked, civil, "birth", limit=3000).count() == 0


def test_mother_from_maiden_looks_behind_ten_nearer_men(spark):
    need = spark.createDataFrame([(1, 3, "Cox", 1900, "Derby")], "job_id long, asc_no int, maiden_name string, child_year int, child_place string")
    men = [(f"m{i:02d}", "A Cox", "Male", "Cox", "A", 1874, "Derby") for i in range(40)]
    women = [("w1", "Ida Cox", "Female", "Cox", "Ida", 1880, "Derby"), ("w0", "Ivy Coxe", "Female", "Coxe", "Ivy", 1874, "Derby"), ("w2", "Una Cox", "Female", "Cox", "Una", 1879, "Truro")]
    pool = spark.createDataFrame(men + women, "person_id string, name string, gender string, surname string, given string, year int, place string")
    none = spark.createDataFrame([], "job_id long, person_id string")

    def found(rejected, used):
        return [(r.person_id, r.discovery_method) for r in linking.mother_from_maiden(need, pool, rejected, used).collect()]

    one = spark.createDataFrame([(1, "w1")], "job_id long, person_id string")
    assert found(none, none) == [("w1", "maiden_name_search")]
    assert found(one, none) == found(none, one) == [("", "maiden_name_only")]


def test_a_tree_of_very_many_slots_that_want_the_same_people(spark):
    """100,000 slots, all with the same short list but for a person of their own, and used people left out."""
    n = 100_000
    rows = spark.range(n).selectExpr("1L AS job_id", "cast(id + 1 AS int) AS asc_no", "explode(array('a', 'b', 'c', concat('p', id))) AS person_id").withColumn("rnk", F.when(F.col("person_id").startswith("p"), 9).otherwise(F.ascii("person_id")).cast("int") - 90)
    rows = rows.withColumn("rnk", F.when(F.col("person_id").startswith("p"), 100).otherwise(F.col("rnk")))
    used = spark.createDataFrame([(1, "b"), (2, "a"), (1, "p7")], "job_id long, person_id string")
    got = {r.asc_no: r.person_id for r in linking.ordered_assignment(rows, used).collect()}
    assert got == {1: "a", 2: "c"} | {i + 1: f"p{i}" for i in range(2, n) if i != 7}


def test_long_trees_lose_no_choice(spark):
    """2,500 slots that all want the same people in the same order: the n-th gets the n-th."""
    n = 2500
    rows = spark.range(n).selectExpr("1L AS job_id", "cast(id + 1 AS int) AS asc_no").crossJoin(spark.range(n - 10, n).selectExpr("cast(id AS int) + 1 AS rnk", "format_string('p%05d', id) AS person_id"))
    first = spark.range(n).selectExpr("1L AS job_id", "cast(id + 1 AS int) AS asc_no", "1 AS rnk", "format_string('p%05d', id) AS person_id")
    got = linking.ordered_assignment(rows.unionByName(first)).collect()
    assert len(got) == n and {r.person_id for r in got} == {f"p{i:05d}" for i in range(n)}


def test_districts_by_prefix_either_way(spark):
    rng = random.Random(4)
    known = [("".join(rng.choice("abD ") for _ in range(rng.randrange(1, 6))), i) for i in range(60)] + [("Ashby de la Zouch", 77), ("", 1), (None, 2)]
    asked = ["".join(rng.choice("abd ") for _ in range(rng.randrange(0, 8))) for _ in range(300)] + ["Ashby Z.", "ash", None]
    frames = spark.createDataFrame([(a,) for a in asked], "district string"), spark.createDataFrame([(n, f"{i:03d}") for n, i in known], "district_name string, district_id string")
    want = {}
    tidy = [((n or "").lower().strip(), f"{i:03d}") for n, i in known if (n or "").strip()]
    for a in set(asked):
        n = (a or "").lower().strip()
        full = "ashby de la zouch" if n == "ashby z." else n
        hits = [(0 if k == n else 1 if k == full else 2, i) for k, i in tidy if n and (k == n or k == full or k.startswith(n) or n.startswith(k))]
        if hits:
            want[a] = min(hits)
    assert {r.district: (r.how, r.district_id) for r in civil_index.resolve_district(*frames).collect()} == want


def test_districts_of_very_many_names_with_one_first_letter(spark):
    names_ = spark.range(100_000).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("district"))
    known = spark.range(100_000).select(F.concat(F.lit("a"), F.col("id") * 10).alias("district_name"), F.format_string("%07d", "id").alias("district_id"))
    got = civil_index.resolve_district(names_, known)
    assert got.count() == 100_000 and got.where("how = 0").count() == 10_000


def test_ancestors_of_a_line_and_where_lines_meet(spark):
    line = [(f"L{i}", f"L{i + 1}", None) for i in range(1000)]
    rows = [*line, ("A", "B", "C"), ("B", "D", None), ("C", "B", "E"), ("E", "A", None)]
    links = spark.createDataFrame(rows, "child_id string, father_id string, mother_id string")
    start = spark.createDataFrame([("L0",), ("A",), ("none",), ("A",)], "root_id string")
    got = {(r.root_id, r.person_id): r.depth for r in tree_api.ancestors_walk(start, links).collect()}
    assert got == {("L0", f"L{i}"): i for i in range(1, 1001)} | {("A", "B"): 1, ("A", "C"): 1, ("A", "D"): 2, ("A", "E"): 2, ("A", "A"): 3}
    few = {(r.root_id, r.person_id) for r in tree_api.ancestors_walk(start, links, 3).collect()}
    assert few == {k for k, d in got.items() if d <= 3}


def test_feedback_stream_goes_on_after_a_restart(spark, tmp_path):
    """Resent decisions count once, also across a restart; a batch written twice counts once."""
    from kinforge.streaming import jobs

    place, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    def land(rows):
        spark.createDataFrame(rows, "id long, job_id long, action_type string, at string").selectExpr("id", "job_id", "action_type", "cast(at AS timestamp) AS created_at").coalesce(1).write.mode("append").parquet(place)
    def run():
        jobs.feedback_stream(spark, place, out, check, "10 days").awaitTermination()
        return {r.action_type: r.decisions for r in jobs.feedback_totals(spark, out).collect()}
    land([(i, 1, "accept" if i % 2 else "reject", f"2024-01-0{1 + i % 3} 10:00:00") for i in range(20)])
    assert run() == {"accept": 10, "reject": 10}
    land([(i, 1, "accept" if i % 2 else "reject", "2024-01-04 10:00:00") for i in range(10, 30)])
    assert run() == {"accept": 15, "reject": 15}
    assert run() == {"accept": 15, "reject": 15}
    batches = sorted((tmp_path / "out").glob("batch=*"))
    spark.read.parquet(str(batches[0])).write.mode("overwrite").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(str(batches[0]))
    assert {r.action_type: r.decisions for r in jobs.feedback_totals(spark, out).collect()} == {"accept": 15, "reject": 15}


def test_spouses_of_a_father_who_is_searched(spark):
    """The first result with spouses on record stands for a father without a link; hidden sources need a near county."""
    anc = spark.createDataFrame([(1, 1, 0, "K", "Kit Cox", "", "1930", "", "Derby, Derbyshire"), (1, 2, 1, "", "John Cox", "Male", "1900", "", ""), (2, 1, 0, "K2", "Kit Cox", "", "1930", "", "Derby, Derbyshire"), (2, 2, 1, "", "John Cox", "Male", "1900", "", "")],
                                "job_id long, asc_no int, gen int, person_id string, name string, gender string, birth_date string, death_date string, birth_place string")
    cand = spark.createDataFrame(
        [(job, 2, r, f"M{r}", g, "Cox", "Male", y, p, why) for job in (1, 2) for r, g, y, p, why in [(1, "John", "1900", "Ohio, United States", ""), (2, "Peter", "1900", "", ""), (3, "John", "1880", "", ""), (4, "John", "1901", "", "no"), (5, "Jack", "1902", "", ""), (6, "John", "1900", "", ""), (7, "John", "1900", "", "")]],
        "job_id long, asc_no int, rnk int, person_id string, given_name string, surname string, gender string, birth_date string, birth_place string, rejection_reason string")
    found = linking.father_results(anc, cand)
    assert {(r.job_id, r.rnk) for r in found.collect()} == {(j, r) for j in (1, 2) for r in (5, 6, 7)}
    wives = spark.createDataFrame([(1, "M6", "W1"), (1, "M6", "W2"), (1, "M7", "W0"), (2, "M7", "W3"), (1, "M1", "W0")], "job_id long, person_id string, spouse_id string")
    people = spark.createDataFrame([(1, "W0", "A"), (1, "W1", "B"), (1, "W2", "C"), (2, "W3", "D")], "job_id long, person_id string, name string").selectExpr("*", "'Female' AS gender", "'1905' AS birth_date", "'' AS death_date", "if(person_id = 'W1', 'Truro, Cornwall', 'Belper, Derbyshire') AS birth_place", "true AS sources_hidden")
    need = spark.createDataFrame([(1, 3, 1930, "Derby, Derbyshire"), (2, 3, 1930, "Derby, Derbyshire")], "job_id long, asc_no int, child_year int, child_place string")
    none, verify = spark.createDataFrame([], "job_id long, asc_no int, person_id string"), spark.createDataFrame([], "person_id string, primary_count int")
    got = linking.spouse_triangulation(need, none, wives, people, verify, none, linking.rejected_people(cand), searched=found)
    assert {(r.job_id, r.person_id) for r in got.collect()} == {(1, "W2"), (2, "W3")}
    seen = linking.spouse_triangulation(need, none, wives, people.drop("sources_hidden"), verify, none, linking.rejected_people(cand), searched=found)
    assert seen.count() == 0


def test_one_large_tree_does_not_lengthen_the_lists_of_others(spark):
    need = spark.createDataFrame([(1, 3, "Cox", 1900, "Derby")] + [(2, 3 + 2 * i, "Fox", 1900, "Derby") for i in range(50)], "job_id long, asc_no int, maiden_name string, child_year int, child_place string")
    women = [(f"c{i:03d}", "Ida", "Female", "Cox", "Ida", 1874, "Derby") for i in range(200)] + [(f"f{i:03d}", "Ada", "Female", "Fox", "Ada", 1874, "Derby") for i in range(60)]
    pool = spark.createDataFrame(women, "person_id string, name string, gender string, surname string, given string, year int, place string")
    none = spark.createDataFrame([], "job_id long, person_id string")
    got = sorted((r.job_id, r.asc_no, r.person_id) for r in linking.mother_from_maiden(need, pool, none, none).collect())
    assert got == [(1, 3, "c000")] + [(2, 3 + 2 * i, f"f{i:03d}") for i in range(50)]
    assert {r.job_id: r.may_lose for r in linking.most_lost(need, none, none).collect()} == {1: 1, 2: 50}


def test_a_stored_table_is_weighed_as_rows_before_it_is_broadcast(spark):
    from kinforge.session import SIZE_SETTING, materialized

    # 1.6 MB of Parquet that are far more as rows; a short table is still broadcast.
    ids = materialized(spark.range(200_000).select(F.xxhash64("id").alias("id"), F.lit("a name that all rows share").alias("name")))
    few = materialized(spark.range(9).select(F.xxhash64("id").alias("id")))
    many = spark.range(1 << 22).select(F.xxhash64("id").alias("id"))
    plan = lambda t: many.join(t, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(ids) and "BroadcastHashJoin" in plan(few)
    assert float(spark.conf.get(SIZE_SETTING)) > 1


def test_places_that_agree_alike_with_the_districts_ask_as_one(spark):
    towns = [(i, t) for i, t in enumerate(["Zug", "Ypres", "Xanten", "Derby", "derby", "South Derby", ""])]
    asked = spark.createDataFrame(towns, "nth int, district_text string")
    known = spark.createDataFrame([("Derby",), ("Truro",)], "district string")
    got = {r.nth: r.alike_text for r in evidence_chain._by_alike_text(asked, known).collect()}
    assert len(got) == len(towns) and len({got[i] for i in (0, 1, 2, 6)}) == 1
    assert got[3] == got[4] and len({got[0], got[3], got[5]}) == 3


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_results_of_a_slot_are_folded_without_sorting_texts(spark):
    """The best result, its ties and the census years, as numbers; no pair of hypothesis and result goes through a sorted aggregate."""
    cand = spark.createDataFrame(
        [(1, 4, rnk, f"C{rnk}", "John", f"John {rnk}", 1900, place, "Cox", "", 1960 + rnk, False) for rnk, place in ((1, None), (2, "Derby"), (3, "Derby"), (4, "Ohio, United States"))],
        "job_id long, asc_no int, rnk int, person_id string, c_given string, c_name string, c_year int, c_place string, father_surname string, mother_surname string, death_year int, rejected boolean")
    hyps = spark.createDataFrame([(1, 4, 1, "Cox", "John", 1900, "Derby", ""), (1, 4, 2, "Fox", "Ann", 1800, "Kent", ""), (1, 6, 1, "Cox", "John", 1900, "Derby", "")],
                                 "job_id long, asc_no int, hyp int, h_surname string, h_forenames string, h_year int, h_district string, h_maiden string")
    census = spark.createDataFrame([("C1", [1891, 1911]), ("C2", [1901]), ("C3", [1915, 1921]), ("C4", [1905])], "person_id string, census array<int>")
    found = evidence_chain.household_match(hyps, cand, census)
    got = {(r.asc_no, r.hyp): (r.status, r.household_score, r.person_id, r.c_name, r.death_year, r.census, r.census_hits, r.census_seen) for r in found.collect()}
    assert got == {(4, 1): ("primary", 75, "C2", "John 2", 1962, [1901], 3, [1901, 1911, 1915]), (4, 2): ("discarded", 0, None, None, None, None, 0, []),
                   (6, 1): ("hypothesis", 0, None, None, None, None, 0, [])}
    assert "ObjectHashAggregate" not in _plan(found) and "SortAggregate" not in _plan(found)


def test_best_entries_meet_as_numbers_and_are_stored(spark):
    rows = [("marriage", "Hunt", "Bill", "Cox", 1901, "Derby", "7", "1", 5), ("marriage", "Hunt", "Bill", "Cox", 1901, "Derby", "8", "1", 3), ("marriage", "Hunt", "Bill", "Fox", 1901, "Derby", "7", "2", 2),
            ("marriage", "Hunt", "William", "Cox", 1902, "Kent", "7", "3", 3)]
    idx = spark.createDataFrame(rows, "entry_type string, surname string, forenames string, spouse_surname string, year int, district string, volume string, page string, entry_id long").withColumn("quarter", F.lit("Mar"))
    asked = spark.createDataFrame([(1, "Hunt", "Bill", "Cox"), (2, "Hunt", "", "Cox"), (3, "Hunt", "Bill", "Day"), (4, "Hunt", None, None)], "n int, s string, g string, w string")
    asked = civil_index.with_search(asked, F.col("s"), F.col("g"), F.lit(1900), F.lit(1902), F.lit(""))
    score = F.lit(30) + F.when(F.col("spouse_surname") == F.col("w"), 20).otherwise(0)
    best = civil_index.best_entries(asked, idx, "marriage", ["w"], score, 30, given="maybe")
    got = {(r.given_key, r.w): (r.score, r.entry_id, r.entry_volume) for r in best.collect()}
    assert got.pop(("", None)) == (30, 2, "7")
    assert got.pop(("", "Cox"))[:2] == (50, 3)
    assert got == {("bill", "Cox"): (50, 3, "8"), ("bill", "Day"): (30, 2, "7")}
    assert "Join" not in _plan(best) and "Aggregate" not in _plan(best)
