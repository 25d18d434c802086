"""Tree services' answers as tables: nested search responses, relationship edges, sources, facts, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions.literals import first_true
from kinforge.operators.ranking import top_rows
from kinforge.operators.scoring import fact_bucket
from kinforge.session import materialized

# --- fixed values ---------------------------------------------------------------------------
PARENT_CHILD = "http://gedcomx.org/ParentChild"
SEARCH_SCHEMA = (
    "score double, persons array<struct<id: string, display: struct<name: string, gender: string, birthDate: string, birthPlace: string,"
    " deathDate: string, deathPlace: string>>>, relationships array<struct<type: string, person1: struct<resourceId: string>, person2: struct<resourceId: string>>>"
)
SEARCH_RESULTS_SHOWN = 10


def _text(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def flatten_search(responses: DataFrame, json: str = "response") -> DataFrame:
    """One row per search result with both parents, read from the relationships it carries.

    Each result is self-contained, so parents are looked up inside the row: no explode, no shuffle.
    """
    r = responses.withColumn("r", F.from_json(F.col(json), SEARCH_SCHEMA)).where(F.size("r.persons") > 0)
    me = F.get("r.persons", F.lit(0))
    mine = F.filter("r.relationships", lambda x: (x["type"] == PARENT_CHILD) & (x["person2"]["resourceId"] == me["id"]))
    people = F.transform(mine, lambda x: F.get(F.filter("r.persons", lambda p: p["id"] == x["person1"]["resourceId"]), F.lit(0)))

    def parent(gender):
        return F.try_element_at(F.filter(people, lambda p: F.lower(p["display"]["gender"]) == gender), F.lit(-1))

    d, f, m = me["display"], parent("male"), parent("female")
    keys = [c for c in responses.columns if c != json]
    return r.select(
        *keys, me["id"].alias("person_id"), _text(d["name"], "Unknown").alias("name"), _text(d["gender"], "Unknown").alias("gender"),
        _text(d["birthDate"]).alias("birth_date"), _text(d["birthPlace"]).alias("birth_place"), F.col("r.score").alias("score"),
        _text(f["id"]).alias("father_id"), _text(f["display"]["name"]).alias("father_name"), _text(m["id"]).alias("mother_id"), _text(m["display"]["name"]).alias("mother_name"))


def parents(edges: DataFrame) -> DataFrame:
    """Child to (father, mother): biological before other kinds, then the order recorded.
    A parent of unknown gender fills the father's place, then the mother's."""
    e = edges.where("rel = 'ParentChild'").withColumn("_sex", first_true([(F.lower("src_gender") == "male", "m"), (F.lower("src_gender") == "female", "f")], "u"))
    two = top_rows(e, ["job_id", "dst", "_sex"], [(F.col("kind") != "Biological").cast("int"), F.col("ord")], 2)

    def nth(sex, k):
        return F.max(F.when((F.col("_sex") == sex) & (F.col("rank") == k), F.col("src")))

    got = two.groupBy("job_id", "dst").agg(nth("m", 1).alias("m1"), nth("f", 1).alias("f1"), nth("u", 1).alias("u1"), nth("u", 2).alias("u2"))
    spare = F.when(F.col("m1").isNull(), F.col("u2")).otherwise(F.col("u1"))
    return got.select("job_id", F.col("dst").alias("child_id"), F.coalesce("m1", "u1").alias("father_id"), F.coalesce("f1", spare).alias("mother_id"))


def spouses(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Both ends of every couple, each with the other's name and the marriage date."""
    c = edges.where("rel = 'Couple'")
    both = c.select("job_id", F.explode(F.array(F.struct(F.col("src").alias("person_id"), F.col("dst").alias("spouse_id")), F.struct(F.col("dst").alias("person_id"), F.col("src").alias("spouse_id")))).alias("_end"), "marriage_date")
    who = people.where("person_id <> ''").select("job_id", F.col("person_id").alias("spouse_id"), F.col("name").alias("spouse_name"), F.col("gender").alias("spouse_gender"))
    return both.select("job_id", "_end.*", "marriage_date").join(who, ["job_id", "spouse_id"])


def person_sources(refs: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Sources a person refers to, resolved to their descriptions; all descriptions when a person refers to none."""
    known = descriptions.select("person_id", F.col("desc_id"), "title", "url")
    named = refs.join(known, ["person_id", "desc_id"], "left").select(
        "person_id", "desc_id", F.coalesce(F.col("title"), F.col("desc_id"), F.lit("Unknown source")).alias("title"), _text(F.col("url")).alias("url"))
    rest = known.join(refs.select("person_id").distinct(), "person_id", "left_anti")
    return named.unionByName(rest.select("person_id", "desc_id", "title", "url"))


def facts_by_type(fact: DataFrame) -> DataFrame:
    """Facts with their bucket and year."""
    return fact.select("person_id", "seq", fact_bucket(F.col("fact_type")).alias("bucket"), F.regexp_extract("fact_date", r"(\d{4})", 1).try_cast("int").alias("year"), "fact_place")


def person_lookup(people: DataFrame, ids: DataFrame) -> DataFrame:
    return people.join(ids.select("person_id").distinct(), "person_id", "left_semi")


# The second service -------------------------------------------------------------------------
def event_date(e: Column) -> Column:
    """DD/MM/YYYY, MM/YYYY or YYYY from a struct of numbers."""
    y, m, d = e["year"], e["month"], e["day"]
    mm, dd = F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")
    return (F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.concat_ws("/", dd, mm, y)).when(y.isNotNull() & m.isNotNull(), F.concat_ws("/", mm, y))
            .otherwise(F.coalesce(y.cast("string"), F.lit(""))))


def event_place(e: Column) -> Column:
    parts = F.filter(F.array(e["city"], e["state"], e["country"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_join(F.array_distinct(parts), ", ")


def gender_word(c: Column) -> Column:
    g = F.lower(F.trim(_text(c)))
    return first_true([(g.isin("male", "m"), "Male"), (g.isin("female", "f"), "Female")], F.concat(F.upper(F.substring(g, 1, 1)), F.substring(g, 2, 100)))


def normalise_profiles(profiles: DataFrame) -> DataFrame:
    """Profile (first/middle/last/maiden name, event structs) to the shape every source shares."""
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("first_name", "middle_name", "last_name")]
    joined = F.concat_ws(" ", *parts)
    year = F.col("birth.year")
    keys = [c for c in ("job_id", "asc_no", "rnk") if c in profiles.columns]
    return profiles.select(
        *keys, "person_id", first_true([(joined != "", joined), (_text(F.col("maiden_name")) != "", F.col("maiden_name"))], "Unknown").alias("name"),
        gender_word(F.col("gender")).alias("gender"), event_date(F.col("birth")).alias("birth_date"),
        F.when(year.between(1000, 2100), year).alias("birth_year"), event_place(F.col("birth")).alias("birth_place"), F.lit("profiles").alias("source"))


def profile_search(profiles: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first ten results of every search."""
    return top_rows(normalise_profiles(profiles), keys, [order], SEARCH_RESULTS_SHOWN)


def union_parents(unions: DataFrame) -> DataFrame:
    """Child to (father, mother) through unions: first male and first female partner; a later union overwrites.

    Partners are reduced to one row per union before they meet the children.
    """
    seen = F.substring("node_id", 2, 30).cast("bigint")
    sex = gender_word(F.col("gender"))
    partner = F.col("role") == "partner"
    pairs = unions.where(partner).groupBy("union_id").agg(
        F.min_by("node_id", F.when(sex == "Male", seen)).alias("father"), F.min_by("node_id", F.when(sex == "Female", seen)).alias("mother"))
    kids = unions.where(F.col("role") == "child").select("union_id", F.col("node_id").alias("child_id"))
    linked = kids.join(pairs, "union_id")
    return linked.groupBy("child_id").agg(
        F.max_by("father", F.when(F.col("father").isNotNull(), F.col("union_id"))).alias("father_id"),
        F.max_by("mother", F.when(F.col("mother").isNotNull(), F.col("union_id"))).alias("mother_id"))


def profile_parents(unions: DataFrame, people: DataFrame) -> DataFrame:
    """Each child with its parents' names."""
    links = union_parents(unions)
    long = links.select("child_id", F.explode(F.array(F.struct(F.lit("father").alias("side"), F.col("father_id").alias("person_id")), F.struct(F.lit("mother").alias("side"), F.col("mother_id").alias("person_id")))).alias("p")).select("child_id", "p.*").where("person_id is not null")
    return long.join(people.select("person_id", "name"), "person_id").select("child_id", "side", "person_id", "name")


def ancestors_walk(start: DataFrame, links: DataFrame, depth: int | None = None) -> DataFrame:
    """Everyone reachable upwards (within ``depth`` steps, if given), once, at the smallest depth.

    Paths double: what the roots reach in n steps, joined to jumps of n steps, is what they reach in 2n, and jumps
    joined to themselves are twice as long. So a line of n generations takes log2(n) rounds; each is written
    out, so the plan does not grow. It ends when a round reaches nobody farther up, also where a faulty
    record makes somebody an ancestor of themselves.
    """
    up = links.select(F.col("child_id").alias("person_id"), F.explode(F.array("father_id", "mother_id")).alias("parent_id")).where("parent_id is not null").distinct()
    jump, span = materialized(up), 1
    reach = materialized(start.select("root_id").distinct().join(jump.withColumnRenamed("person_id", "root_id"), "root_id").select("root_id", F.col("parent_id").alias("person_id"), F.lit(1).alias("depth")))
    while depth is None or span < depth:
        farther = reach.join(jump, "person_id").select("root_id", F.col("parent_id").alias("person_id"), (F.col("depth") + span).alias("depth"))
        reach = materialized(reach.unionByName(farther).groupBy("root_id", "person_id").agg(F.min("depth").alias("depth")))
        if reach.where(F.col("depth") > span).isEmpty():
            break
        beyond = jump.select(F.col("person_id").alias("parent_id"), F.col("parent_id").alias("far_id"))
        jump, span = materialized(jump.join(beyond, "parent_id").select("person_id", F.col("far_id").alias("parent_id")).distinct()), span * 2
    return reach if depth is None else reach.where(F.col("depth") <= depth)
