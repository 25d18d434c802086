"""Hand-written expectations for the scalar rules."""

import pytest
from pyspark.sql import functions as F

from kinforge.functions import corrections, dates, evidence, names, notes, places, slots
from kinforge.functions import values as V


def run(spark, values, fn, schema="x string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in df.select(fn(*[F.col(c) for c in df.columns]).alias("r")).collect()]


def test_normalize_date(spark):
    got = run(spark, ["01.09.59", "01/09/1959", "c. 1900", "Aug 1935", "spring 1900", "", "12-03-24", "About 3 May 1881"], dates.normalize_date)
    assert [None if g is None else tuple(g) for g in got] == [
        (1959, 9, 1), (1959, 9, 1), (1900, None, None), (1935, 8, None), None, None, (2024, 3, 12), (1881, 5, 3)]


def test_date_year_agrees_with_normalize_date(spark):
    texts = ["1959", " 1959 ", "~1850", "abt 1 January 1900", "31/12/26", "31/12/25", "May 18", "1 Foo 1900", "19590"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(dates.date_year(F.col("x")).alias("y"), dates.normalize_date(F.col("x"))["year"].alias("n"))
    assert all(r.y == r.n for r in df.collect())


def test_parse_name(spark):
    got = run(spark, ["Sarah", "Jo Hunt (not found)", "unknown", "", "Mary  Ann Hunt"], names.parse_name)
    assert [tuple(g) for g in got] == [("Sarah", ""), ("Jo", "Hunt"), ("", ""), ("", ""), ("Mary Ann", "Hunt")]


def test_resolve_county(spark):
    assert run(spark, ["Pinxton, Derbyshire", "Ashford", "Kent, England", "nowhere", "Leics", "Ely; Cambs"], places.resolve_county) == [
        "derbyshire", "kent", "kent", None, "leicestershire", "cambridgeshire"]


def test_gazetteer_is_a_parameter(spark):
    assert run(spark, ["Ely"], lambda c: places.resolve_county(c, {"ely": "cambridgeshire"})) == ["cambridgeshire"]


def test_county_proximity_is_symmetric(spark):
    pairs = [("derbyshire", "derbyshire"), ("derbyshire", "yorkshire"), ("cornwall", "kent"), ("wales", "kent"), ("wales", "wales"), (None, "kent")]
    there = run(spark, pairs, places.county_proximity, "a string, b string")
    back = run(spark, [(b, a) for a, b in pairs], places.county_proximity, "a string, b string")
    assert there == back == ["same", "adjacent", "distant", None, "same", None]


@pytest.mark.parametrize("points,score", [(-10, 0), (-9, 25), (9, 25), (10, 30), (24, 44), (25, 50), (44, 69), (45, 75), (59, 89), (60, 90), (200, 95)])
def test_confidence_from_points(spark, points, score):
    assert run(spark, [points], evidence.confidence_from_points, "x int") == [score]


def test_classify_source(spark):
    titles = ["England Birth Registration Index", "Parish register of births", "UK Census 1881", "1939 Register", "Banns 1799", "War Office medal", "Warwickshire collection", "Will proved 1850", "Family note", None]
    assert [g["category"] for g in run(spark, titles, evidence.classify_source)] == [
        "Civil Registration", "Parish Register", "Census", "1939 Register", "Parish Register", "Military", "Other", "Probate", "Other", "Other"]


def test_slot_role(spark):
    assert run(spark, [1, 2, 3, 7, 16, 64], slots.slot_role, "x int") == [
        "Subject", "Father", "Mother", "Grandmother (mother → mother)", "2x Great-Grandfather (father → father → father → father)",
        "4x Great-Grandfather (father → father → father → father → father → father)"]


def test_foreign_words_are_whole(spark):
    assert run(spark, ["Brighton, Sussex", "Springfield, IL", "Ohio", "Derby"], places.looks_foreign) == [False, True, True, False]


def test_surname_variants_replace_the_first_place_only(spark):
    assert run(spark, ["Thth"], names.surname_variants)[0] == ["Ththe", "Tth"]
    assert "Mcdonald" in run(spark, ["MacDonald"], names.surname_variants)[0]


def test_sanitize_place(spark):
    assert run(spark, ["Wæringscīr, Англи", "道, Derby,,", ""], places.sanitize_place) == ["Warwickshire, England", "Derby", ""]


def test_parse_correction(spark):
    got = run(spark, ["birth year should be 1909", "Death date: ~1963", "birth place to 'Derby, Derbyshire'", "looks fine"], corrections.parse_correction)
    assert [None if g is None else tuple(g) for g in got] == [("birth_date", "1909"), ("death_date", "1963"), ("birth_place", "Derby, Derbyshire"), None]


def test_parse_correction_steps(spark):
    said = ["Death year → 1950; birth date to ~1901", "BIRTHPLACE: \"Derby\"", "death place should be Pinxton, Derbyshire, birth place unknown", "birth year 1909", "birth year should be 1409", "birth place:", None, ""]
    assert [None if g is None else tuple(g) for g in run(spark, said, corrections.parse_correction)] == [
        ("birth_date", "1901"), ("birth_place", "Derby"), ("death_place", "Pinxton, Derbyshire"), None, None, None, None, None]


def told(spark, text):
    rows = run(spark, [text], lambda c: F.transform(notes.relatives(c), lambda r: notes.complete(c, r)))
    return [tuple(r) for r in rows[0]]


def test_notes_parents_and_couples(spark):
    assert told(spark, "Father: Brian Jackson (1940-2021), Mother Julie Ann Jackson (1942 – living)\nMaternal GP: Charles Herbert Jackson (1909-1963) and Nellie Gregory (1911-)") == [
        (2, "Brian", "Jackson", "1940", "2021", ""), (3, "Julie Ann", "Jackson", "1942", "", ""),
        (6, "Charles Herbert", "Jackson", "1909", "1963", ""), (7, "Nellie", "Gregory", "1911", "", "")]


def test_notes_kinship_words_are_whole(spark):
    assert told(spark, "Maternal grandfather was Albert Jackson from Derby\nGrandmother: Ivy Skinner (1902-1980).\nmaternal maternal great-grandmother: Jessie Mayne (1880-1959)") == [
        (5, "Ivy", "Skinner", "1902", "1980", ""), (6, "Albert", "Jackson", "", "", ""), (15, "Jessie", "Mayne", "1880", "1959", "")]


def test_notes_dates_and_places_on_the_line(spark):
    assert told(spark, "Paternal grandfather: Norman Hunt, b. 01.02.1931, Derby Derbyshire, d. 20.02.1991\nGreat grandfather (paternal maternal): Fred Cox; born Dec 1880, died 1950") == [
        (4, "Norman", "Hunt", "01.02.1931", "20.02.1991", "Derby Derbyshire"), (10, "Fred", "Cox", "Dec 1880", "1950", "")]


def test_notes_ranks_and_nearby_dates(spark):
    assert told(spark, "Paternal paternal great-grandfather: One Hunt\nGreat-grandfather (paternal paternal): Two Hunt\nGGP8: Three Hunt\nasc#8: Four Hunt\nGGP16: Five Hunt\nFour Hunt was a miner, born in 1860") == [
        (8, "Four", "Hunt", "1860", "", "")]
    assert told(spark, "GGP9: Ann Cox\n" + "x" * 92 + " born 1860") == [(9, "Ann", "Cox", "", "", "")]


@pytest.mark.parametrize("text", [None, "", "Father was a miner.", "Father: (1900-1950)", "great-grandfather: Nobody Known", "paternal GP: A B, C D", "Grandfather Norman Hunt, Derby"])
def test_notes_without_a_readable_relative(spark, text):
    assert run(spark, [text], notes.relatives) == [[]]


def test_fixed_values_have_their_known_sizes():
    pairs = V.border_pairs()
    assert len(pairs) == 272 and len(V.counties()) == 54 and {(b, a) for a, b in pairs} == set(pairs)
    assert len(V.nearby_pairs()) == 122 and len(V.COMMON_SURNAMES) == 97
    assert all(list(bs) == sorted(bs) for bs in V.COUNTY_BORDERS.values())


def test_farther_ancestors_of_notes_fill_no_nearer_slot(spark):
    from kinforge.functions import notes

    text = "Great-grandfather (paternal paternal): Fred Hunt\n2x Great-grandfather (paternal paternal): Amos Hunt (1841)\n2x Great-grandmother (user_mat_gm): Eve Cox"
    got = spark.createDataFrame([(text,)], "t string").select(notes.relatives(F.col("t")).alias("r")).first().r
    assert [(x.slot, x.name) for x in got] == [(8, "Fred Hunt")]
