"""Steps that left files behind or dealt out more rows and texts than they need: same results, less on disk."""

from __future__ import annotations

import contextlib
import os
import time

from pyspark.sql import functions as F

from kinforge import session
from kinforge.operators import evidence_chain, gazetteer, merge
from kinforge.sources import civil_index

INDEX = "entry_type string, surname string, forenames string, spouse_surname string, year int, quarter string, district string, volume string, page string, entry_id bigint"
CAND = "job_id long, asc_no int, rnk int, person_id string, c_given string, c_name string, c_year int, c_place string, father_surname string, mother_surname string, death_year int, rejected boolean"
HYPS = "job_id long, asc_no int, hyp int, h_surname string, h_forenames string, h_year int, h_district string, h_maiden string"


@contextlib.contextmanager
def _no_broadcast_by_size(spark):
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k in settings:
            spark.conf.set(k, "-1")
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _path(df) -> str:
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    out = session.materialized(spark.range(10_000).groupBy((F.col("id") % 977).alias("k")).count().join(spark.range(977).withColumnRenamed("id", "k"), "k"))
    until = time.time() + 10
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert out.count() == 977
    assert spark.conf.get(session.CLEANUP_SETTING, "false") == "false"


def test_a_settled_step_leaves_its_result_alone(spark):
    stored, kept = [], []

    def step():
        stored.append(session.materialized(spark.range(5)))
        kept.append(session.materialized(spark.range(6), for_all=True))
        stored.append(session.settled(lambda: session.materialized(spark.range(7))))
        return stored[0].join(stored[1], "id")

    paths = []
    out = session.settled(lambda: (df := step(), paths.extend(map(_path, stored)))[0])
    assert out.count() == 5 and kept[0].count() == 6 and os.path.isdir(_path(kept[0]))
    assert len(paths) == 2 and not any(map(os.path.exists, paths))


def test_names_are_opened_by_their_starts_only_beside_short_ones(spark, monkeypatch):
    schema = "job_id long, asc_no int, f string, l string, year int, seq int"
    rows = [(1, 1, "wil", "hun", y, s) for s, y in ((5, 1900), (4, 1903), (3, 1904), (2, None), (1, 1901))] + [(1, 1, "ann", "hun", 1900, 6), (2, 1, "wil", "hun", 1900, 7), (None, 1, "wil", "hun", 1900, 8), (None, 1, "wil", "hun", 1901, 9), (1, 1, "", "hun", 1900, 10)]
    long_names = {(1, 1, 1, 2), (1, 1, 2, 3), (1, 1, 2, 4), (1, 1, 2, 5), (1, 1, 1, 5), (1, 1, 1, 4), (1, 1, 1, 3), (1, 1, 3, 4), (1, 1, 4, 5)}
    got = lambda found: {tuple(r) for r in found.collect()}
    # Of one search with short names: they meet in both names the same way, or each in its own.
    more = [(3, 1, "w", "hun", None, 1), (3, 1, "wil", "hun", 1900, 2), (3, 1, "wi", "h", 1903, 3), (3, 1, "wil", "hu", 1950, 4), (3, 1, "bo", "hun", 1900, 5)]
    short_names = {(3, 1, 1, 2), (3, 1, 1, 3), (3, 1, 1, 4), (3, 1, 2, 3)}
    assert got(merge.resembling(spark.createDataFrame(rows + more, schema))) == long_names | short_names
    monkeypatch.setattr(merge, "_starts", lambda c: F.array(F.col(c), F.when(F.col(c) != "", F.raise_error(F.concat(F.lit("opened: "), F.col(c)))).otherwise(F.col(c))))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else a side may be given up, as the other is seen to be empty in time
    try:
        assert got(merge.resembling(spark.createDataFrame(rows, schema))) == long_names
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hypotheses_are_dealt_out_once_by_slot(spark):
    cand = spark.createDataFrame([(1, 4, 1, "C1", "John", "John Cox", 1900, "Derby", "Cox", "", 1960, False), (1, 4, 1, "C2", "John", "John Cox", 1900, "Derby", "Cox", "Fox", 1961, False), (1, 6, 1, None, "John", "J", 1900, "", "", "", None, False)], CAND)
    hyps = spark.createDataFrame([(1, 4, 1, "Cox", "John", 1900, "Derby", "Fox"), (1, 4, 1, "Cox", "John", 1900, "Derby", "Fox"), (1, 4, 1, "Day", "Ann", 1900, "Kent", ""), (1, 6, 1, "Cox", "John", 1900, "Derby", ""), (None, 6, 1, "Cox", "John", 1900, "Derby", "")], HYPS)
    census = spark.createDataFrame([("C1", [1901]), ("C2", [1911])], "person_id string, census array<int>")
    with _no_broadcast_by_size(spark):
        found = evidence_chain.household_match(hyps, cand, census)
        plan = _plan(found)
        got = sorted(tuple(r) for r in found.select("asc_no", "h_surname", "status", "household_score", "person_id", "death_year", "census_hits", "census_seen").collect())
    # Rows of one slot and number are one hypothesis: the best score and the census years of any of them, for each.
    best = ("primary", 100, "C2", 1961, 6, [1901, 1911])
    assert got == [(4, "Cox", *best), (4, "Cox", *best), (4, "Day", *best), (6, "Cox", "hypothesis", 35, None, None, 0, [])]
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and not [line for line in dealt if "hyp#" in line or "nth#" in line or "_won#" in line]


def test_parents_names_come_with_the_hypotheses(spark):
    people = spark.createDataFrame([(1, 2, "Ann", "Hunt", 1900, "Derby", "", "Tom", "Eve", "Cox"), (1, 3, "Ann", "Hunt", 1900, "Derby", "", "Sam", "", "Day")],
                                   "job_id long, asc_no int, given string, surname string, year int, district_text string, district_ string, father_given string, mother_given string, mother_surname string")
    index = spark.createDataFrame([("birth", "Hunt", "Ann", "", 1901, "Mar", "Derby", "7", "1", 1), ("marriage", "Hunt", "Tom", "Cox", 1899, "Mar", "Derby", "7", "2", 2), ("marriage", "Day", "Eve", "Hunt", 1899, "Mar", "Derby", "7", "2", 3)], INDEX)
    plain = evidence_chain.birth_hypotheses(people, index)
    assert not [c for c in plain.columns if c.startswith("p_")]
    carried = evidence_chain.birth_hypotheses(people, index, parents=True)
    assert sorted((r.asc_no, r.p_father_given, r.p_mother_given, r.p_mother_surname) for r in carried.collect()) == [(2, "Tom", "Eve", "Cox"), (3, "Sam", "", "Day")]
    rows = lambda df: sorted(tuple(r) for r in df.select("asc_no", "hyp", "side", "score", "entry_id").collect())
    assert rows(evidence_chain.parent_couple(carried, None, index)) == rows(evidence_chain.parent_couple(plain, people, index)) == [(2, 1, 1, 100, 2)]


def test_flags_of_a_hypothesis_need_no_census_lists(spark):
    index = spark.createDataFrame([("birth", "Cox", "John", "Fox", 1900, "Mar", "Derby", "7", "1", 1), ("birth", "Cox", "Ann", "Fox", 1905, "Mar", "Derby", "7", "1", 2), ("death", "Cox", "John", "", 1961, "Mar", "Derby", "7", "1", 3)], INDEX)
    rows = [(1, 4, 1, "Cox", "John", 1900, "Derby", "Fox", "C1", "John Cox", 1961, True), (1, 4, 2, "Day", "John", 1900, "Derby", "Fox", "C1", "John Cox", None, False), (1, 6, 1, "Cox", "John", 1900, "Derby", "Fox", None, None, None, False)]
    matched = spark.createDataFrame(rows, HYPS + ", person_id string, c_name string, death_year int, later_census boolean")
    got = sorted(tuple(r) for r in evidence_chain.reinforcements(matched, index).select("asc_no", "hyp", "sibling", "death", "later_census").collect())
    assert got == [(4, 1, True, True, True), (4, 2, False, False, False), (6, 1, True, False, False)]


def test_the_chain_stores_flags_and_lets_go_of_the_rest(spark, monkeypatch):
    people = spark.createDataFrame([(1, 2, "Ann", "Hunt", 1900, "Derby", "", "Tom", "Eve", "Cox"), (1, 3, "Zoe", "Zed", 1900, "Derby", "", "", "", "")],
                                   "job_id long, asc_no int, given string, surname string, year int, district_text string, district_ string, father_given string, mother_given string, mother_surname string")
    index = spark.createDataFrame([("birth", "Hunt", "Ann", "Cox", 1901, "Mar", "Derby", "7", "1", 1), ("birth", "Hunt", "Ann", "Day", 1902, "Mar", "Kent", "7", "1", 4), ("marriage", "Hunt", "Tom", "Cox", 1899, "Mar", "Derby", "7", "2", 2)], INDEX)
    cand = spark.createDataFrame([(1, 2, 1, "C1", "Ann", "Ann Hunt", 1901, "Derby", "Hunt", "Cox", 1960, False)], CAND)
    census = spark.createDataFrame([("C1", [1911, 1931])], "person_id string, census array<int>")
    paths, write = [], session.uuid.uuid4
    monkeypatch.setattr(session.uuid, "uuid4", lambda: (paths.append(write()), paths[-1])[1])
    scored, stored = evidence_chain.chain(people, cand, census, index)
    assert [(r.hyp, r.marriage, r.verified, r.crosscheck, r.sibling, r.death, r.later_census, r.confidence) for r in scored.collect()] == [(1, True, True, 50, False, False, True, 100), (2, False, False, 0, False, False, True, 49)]
    assert [(r.asc_no, r.entry_id, r.confidence) for r in stored.collect()] == [(2, 1, 100)]
    left = [p for p in paths if os.path.exists(f"{session.shared_dir(spark).removeprefix('file:')}/table-{p.hex}")]
    assert len(paths) > 15 and len(left) == 4  # the hypotheses matched, two parts' flags and the scores


def test_leads_are_looked_for_among_results_of_their_own_slots(spark, monkeypatch):
    people = spark.createDataFrame([(1, s, None, "Ann", "Hunt", 1900, "Derby", "Derby", "", "") for s in (2, 3)], "job_id long, asc_no int, person_id string, given string, surname string, year int, birth_place string, district_text string, father_surname string, mother_surname string")
    cand = spark.createDataFrame([(1, s, 1, f"C{s}", "Ann", "Ann Hunt", 1900, "Derby", "", "", None, False) for s in (2, 3, 9)], CAND.replace("father_surname", "c_father_surname").replace("mother_surname", "c_mother_surname"))
    seen, usable = [], evidence_chain.usable_results
    monkeypatch.setattr(evidence_chain, "usable_results", lambda c, shown=None: (seen.extend(r.asc_no for r in c.collect()), usable(c, shown))[1])
    out = evidence_chain.lead_only(people, spark.createDataFrame([(1, 2, 1)], "job_id long, asc_no int, hyp int"), cand)
    assert [(r.asc_no, r.person_id, r.confidence) for r in out.collect()] == [(3, "C3", 49)]
    assert seen == [3]


def test_rows_stay_where_they_are_when_few_answers_or_places_meet_them(spark):
    asked = civil_index.with_search(spark.createDataFrame([(1, "Hunt", "Bill"), (2, "Hunt", "")], "n int, s string, g string"), F.col("s"), F.col("g"), F.lit(1900), F.lit(1902), F.lit(""))
    index = spark.createDataFrame([("marriage", "Hunt", "Bill", "Cox", 1901, "Mar", "Derby", "7", "1", 5)], INDEX)
    with _no_broadcast_by_size(spark):
        best = civil_index.best_entries(asked, index, "marriage", ["g"], F.lit(30), 30, given="maybe")
        met = asked.join(best, [*civil_index.SEARCH, "g"])
        read = gazetteer.read_once(asked, "s", big=F.upper)
        assert "SortMergeJoin" not in _plan(met) and "SortMergeJoin" not in _plan(read)
        assert sorted(r.n for r in met.collect()) == [1, 2] and {r.big for r in read.collect()} == {"HUNT"}
