"""Places against a gazetteer of many towns, and nearness by border bits."""

import pytest
from pyspark.sql import functions as F

from kinforge.functions import places
from kinforge.functions import values as V
from kinforge.operators import gazetteer as G


@pytest.fixture(scope="module")
def many(spark):
    """Five thousand towns, each of a known county by its number."""
    shires = V.counties()
    rows = spark.range(5000).select(F.concat(F.lit("Town "), "id").alias("town"), F.element_at(F.array(*map(F.lit, shires)), (F.col("id") % len(shires) + 1).cast("int")).alias("county"))
    extra = spark.createDataFrame([(" DERBY ", "Kent"), ("Kent", "surrey"), ("Twice", "surrey"), ("twice", "essex"), ("", "essex"), (None, "kent"), ("Nowhere", None)], "town string, county string")
    return G.gazetteer_table(spark, rows.unionByName(extra))


def test_every_town_finds_its_county(spark, many):
    asked = spark.range(5000).select(F.concat(F.lit(" tOWN "), "id", F.element_at(F.array(F.lit(""), F.lit(", England"), F.lit("; x")), (F.col("id") % 3 + 1).cast("int"))).alias("place"))
    got = G.lookup_counties(asked, "place", many).collect()
    want = {i: c for i, c in enumerate(V.counties())}
    assert len(got) == 5000
    assert all(r.county == want[int(r.place.lower().split("town ")[1].split(",")[0].split(";")[0]) % len(want)] for r in got)


def test_precedence(spark, many):
    """Counties before given towns before shipped towns before short names before historic names; first part that is known."""
    asked = {"Derby": "kent", "kent": "kent", "Twice": "essex", "Pinxton": "derbyshire", "Leics": "leicestershire", "sūþrīge": "surrey", "Xyz, Town 3, Kent": V.counties()[3], "": None, " , ": None, "Nowhere": None}
    rows = spark.createDataFrame([(k,) for k in asked] + [(None,)], "place string")
    assert {r.place: r.county for r in G.lookup_counties(rows, "place", many).collect()} == asked | {None: None}


def test_dimension_agrees_with_the_rules_by_row(spark):
    texts = ["Derby, Derbyshire, England", "Shardlow, Derbyshire", "Springfield, IL", "Ohio, United States", "Нэгдсэн", "Англи", "Deorbyscir, Англи", "Truro, Cornwall", "Ely; Cambs", "nowhere", "Leics", "Oxenaford"]
    rows = spark.createDataFrame([(t,) for t in texts * 3], "place string")
    made = G.place_dimension(rows)
    assert made.count() == len(texts)
    p, clean = F.col("place"), F.col("clean")
    stated = places.parse_place(p)
    same = made.select(
        F.col("seat.county").eqNullSafe(places.resolve_county(p)), F.col("clean_seat.county").eqNullSafe(places.resolve_county(clean)), clean == places.sanitize_place(p),
        F.col("foreign") == places.clearly_foreign(places.sanitize_place(p)), F.col("town").eqNullSafe(stated["town"]), F.col("stated_county").eqNullSafe(stated["county"]),
        F.col("stated_seat.county").eqNullSafe(F.coalesce(stated["county"], places.resolve_county(p))))
    assert all(all(r) for r in same.collect())


def test_nearness_of_all_pairs_of_counties(spark):
    names = spark.createDataFrame([(c,) for c in [*V.counties(), "atlantis"]], "county string")
    table = G.gazetteer_table(spark, spark.createDataFrame([("Atlantis", "atlantis")], "town string, county string"))
    seats = G.with_place(names, G.place_dimension(names.select(F.col("county").alias("place")), table), "county", seat="seat")
    pairs = seats.select(F.col("county").alias("x"), F.col("seat").alias("a")).crossJoin(seats.select(F.col("county").alias("y"), F.col("seat").alias("b")))
    near = {(r.x, r.y): r.near for r in pairs.select("x", "y", G.proximity(F.col("a"), F.col("b")).alias("near")).collect()}
    borders = set(V.border_pairs())
    for (x, y), got in near.items():
        known = "atlantis" not in (x, y)
        assert got == ("same" if x == y else "adjacent" if (x, y) in borders else "distant" if known else None), (x, y)


def test_towns_come_from_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "towns")
    spark.createDataFrame([("Ely", "cambridgeshire")], "town string, county string").write.parquet(path)
    asked = spark.createDataFrame([("Ely, England",), ("Ashford",)], "place string")
    spark.conf.set(G.TOWNS_SETTING, path)
    try:
        assert {r.place: r.county for r in G.lookup_counties(asked, "place").collect()} == {"Ely, England": "cambridgeshire", "Ashford": "kent"}
    finally:
        spark.conf.unset(G.TOWNS_SETTING)
    assert {r.place: r.county for r in G.lookup_counties(asked, "place").collect()} == {"Ely, England": None, "Ashford": "kent"}


def test_no_places(spark):
    none = spark.createDataFrame([], "place string")
    assert G.lookup_counties(none, "place").count() == 0


def test_one_place_of_most_rows(spark):
    """Rows of one place are many, its row in the dimension is one, and no plan pairs rows with rows."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("Town "), "id")).otherwise("Derby").alias("place"))
    got = G.lookup_counties(rows, "place")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {r.county: r["count"] for r in got.groupBy("county").count().collect()} == {"derbyshire": 40_000, None: 20_000}
