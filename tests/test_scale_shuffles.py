"""Queries that moved or held more than their rows need: same results, fewer rows stored, shuffled or held."""

from __future__ import annotations

import pytest

from kinforge.operators import changes, civil, evidence_chain, linking


def test_pass_union_stores_no_entries_and_lists_the_same(spark, monkeypatch):
    people = spark.createDataFrame([("Hunt", "Ann", 1900, "Derby"), ("Hunt", "Ann", 1900, "Belper"), ("Hunt", "Ann", 1900, ""), ("Ahlfors", "Jo", 1900, "")], "surname string, given string, year int, district_ string")
    rows = [("Hunt", "Ann", "Derby", "7b", "1", i) for i in (1, 2, 3)] + [("Hunt", "May Ann", "Belper", "7b", "1", 4), ("Hunt", "Ann", "Kent", "", "9", 5), ("Hunt", "Ann", "Kent", "", "9", 6), ("Hunt", "Ann", "Kent", "8b", "2", 7), ("Hunt", "Ann", "Kent", "8b", "2", 8), ("Alfors", "Jo", "Kent", "8b", "3", 9)]
    civil = spark.createDataFrame([("birth", s, f, "", 1901, "Mar", d, v, p, i) for s, f, d, v, p, i in rows], "entry_type string, surname string, forenames string, spouse_surname string, year int, quarter string, district string, volume string, page string, entry_id bigint")
    held, stored = [], evidence_chain.materialized
    monkeypatch.setattr(evidence_chain, "materialized", lambda df: (held.append(df.columns), stored(df))[1])
    listed = {}
    for r in evidence_chain.pass_union(people, civil).collect():
        listed.setdefault((r.surname_key, r.district_key), []).append((r.pass_no, r.entry_id))
    listed = {k: sorted(v) for k, v in listed.items()}
    assert listed[("hunt", "derby")] == [(1, 1), (1, 2), (1, 3)]
    assert listed[("hunt", "belper")] == [(1, 4), (2, 5), (2, 6), (2, 7)]
    assert listed[("hunt", "")] == [(1, i) for i in range(1, 9)]
    assert all(p == 3 for p, _ in listed.get(("ahlfors", ""), []))
    assert not [c for c in held if "entry_id" in c]


def test_reject_reads_candidates_once(spark):
    people = "job_id bigint, asc_no int, person_id string, given_name string, surname string, gender string, birth_date string, birth_place string"
    anc = spark.createDataFrame([(1, 2, "P1", "A", "B", "Male", "", ""), (1, 2, "P1", "A", "B", "Male", "", ""), (1, 4, "P2", "A", "B", "Male", "", ""), (2, 3, "P3", "A", "B", "", "", ""), (2, 5, "", "A", "B", "", "", "")], people)
    cand = spark.createDataFrame([(1, 2, 1, "P1", ""), (1, 2, 2, "P9", ""), (1, 4, 1, "P8", ""), (1, 4, 2, "P7", "no"), (1, 3, 1, "P6", None), (2, 3, 1, None, ""), (None, 3, 1, "P3", "")], "job_id bigint, asc_no int, rnk int, person_id string, rejection_reason string")
    out = changes.reject(anc, cand, spark.createDataFrame([(1, 2), (2, 3), (2, 5), (1, 2)], "job_id bigint, asc_no int"))["candidates"]
    got = sorted((repr(r.job_id), r.asc_no, repr(r.person_id), repr(r.rejection_reason), r.rnk) for r in out.collect())
    why = repr(changes.REJECTED)
    assert got == sorted([("1", 2, "'P1'", why, 1), ("1", 2, "'P1'", why, 1), ("1", 4, "'P7'", "'no'", 2), ("1", 3, "'P6'", "None", 1), ("2", 3, "'P3'", why, 0), ("None", 3, "'P3'", "''", 1)])
    assert out.columns[:5] == ["job_id", "asc_no", "person_id", "rnk", "rejection_reason"]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("LogicalRDD" in line and "rejection_reason#" in line for line in plan) == 1


@pytest.mark.parametrize("name", ["reject", "table_reads"])
def test_tables_read_once_are_not_stored(spark, sf_dir, monkeypatch, name):
    from kinforge import catalog
    from kinforge.catalog import base

    got, staged = [], base.staged
    monkeypatch.setattr(base, "staged", lambda s, d, n: (got.append(n), staged(s, d, n))[1])
    catalog.queries()[name](spark, sf_dir)
    assert got == []


def test_ordered_assignment_sorts_and_holds_no_table_of_rows(spark):
    # The least stated rank of a person counts; a person without any comes first.
    rows = [(1, 2, "P1", None), (1, 2, "P1", 3), (1, 2, "P2", 2), (1, 2, "P2", 5), (1, 4, "P2", 1), (1, 4, "P3", 4), (1, 4, "P1", None), (2, 2, "P9", 1), (2, 2, "P8", None), (2, 2, "P8", None)]
    out = linking.ordered_assignment(spark.createDataFrame(rows, "job_id bigint, asc_no int, person_id string, rnk int"))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(1, 2, "P2", 2), (1, 4, "P1", None), (2, 2, "P8", None)]))
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_unknown_father_asks_the_index_once_by_the_fathers_surname(spark, monkeypatch):
    need = spark.createDataFrame([(1, 2, None, "Hunt", "Smith", 1900, "Derby"), (1, 3, None, "Hunt", "Jones", 1900, "Derby"), (1, 4, None, "Hunt", "Smith", 1900, "")],
                                 "job_id bigint, asc_no int, father_name string, last string, mother_last string, birth_year int, district_ string")
    entries = [("Hunt", "Tom", "Smith", "Derby", 1), ("Hunt", "Bob", "Jones", "Kent", 2), ("Hunt", "Sam", "Smith", "Kent", 3)]
    index = spark.createDataFrame([("marriage", s, f, w, 1895, "Mar", d, "7b", "1", i) for s, f, w, d, i in entries], "entry_type string, surname string, forenames string, spouse_surname string, year int, quarter string, district string, volume string, page string, entry_id bigint")
    calls, best = [], civil.best_entries
    monkeypatch.setattr(civil, "best_entries", lambda asked, *a, **k: (calls.append(a[2]), best(asked, *a, **k))[1])
    got = {(r.job_id, r.asc_no): (r.pass_no, r.father_name, r.entry_id) for r in civil.unknown_father(need, index).collect()}
    assert got == {(1, 2): (1, "Tom Hunt", 1), (1, 3): (3, "Bob Hunt", 2), (1, 4): (1, "Tom Hunt", 1)}
    assert calls == [["wife"], ["man"]]
