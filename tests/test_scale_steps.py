"""Steps of scoring that read a title or a place, or fold a tree, cheaper than they did: same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.functions import evidence, places
from kinforge.operators import scoring


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cited_county_needs_no_pattern_of_all_counties(spark):
    rows = [("Held at <b>Derbyshire</b> Office", "derbyshire"), ("<kent>Devon, Kent", "kent"), ("<kent Devon", "kent"), ("a < b Essex", "essex"), ("Derby", None), ("", None)]
    df = spark.createDataFrame(rows, "text string, county string").withColumn("got", places.cited_county(F.col("text")))
    assert [r.got for r in df.collect()] == [r[1] for r in rows]
    assert "|yorkshire|" not in _plan(df)


def test_category_alone_is_that_of_the_whole_class(spark):
    titles = ["England Birth Registration Index", "Parish Register 1799", "parish index of births", "Census", "Census 1881", "National Register", "Army Medal", "warden", "Will proved", "Will", None, "  X "]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    got = df.select(evidence.classify_source(F.col("title"))["category"].alias("a"), evidence.source_category(evidence.lowered(F.col("title"))).alias("b"))
    assert [r.a for r in got.collect()] == [r.b for r in got.collect()]


def test_scores_follow_the_class_of_the_childs_score(spark):
    anc = spark.createDataFrame([(1, s, len(bin(s)) - 3, "", "A Hunt", "Hunt", "1900", "", "Customer Data" if s == 1 else "Pending", "") for s in (1, 2, 4, 8, 5, 13)],
                                "job_id bigint, asc_no int, gen int, person_id string, name string, surname string, birth_date string, birth_place string, confidence_level string, discovery_method string")
    src = spark.createDataFrame([], "person_id string, seq int, title string, citation string")
    fact = spark.createDataFrame([], "person_id string, seq int, fact_type string, fact_date string, fact_place string")
    scored = scoring.record_scoring(anc, src, fact)
    assert "outcomes" not in scored.columns
    got = {r.asc_no: (r.family_points, r.total_points, r.score) for r in scored.collect()}
    assert got[1] == (None, None, 100)
    # 15 for a customer child of the same surname; -30 for no years between them. 13 has no child: no points for one.
    assert got[2] == (15, -15, 0) and got[4] == (6, -24, 0) and got[8] == (6, -24, 0) and got[5] == (4, -26, 0) and got[13] == (0, 0, 25)
