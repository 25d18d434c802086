"""Results of several sources for one search merged into distinct people.

Rows come in order of arrival. A row with the exact key (first name, last name, year) of an earlier person
is that person; one whose key is new joins the first earlier person it resembles, else it is a new one. So
the people are the lexicographically first maximal independent set of the keys that resemble one another.

Two names resemble each other by their first three letters alone (one's are a start of the other's). Keys
alike in those letters and the year are therefore one node; a node meets its neighbours of the same letters in
order of years, and shorter names by equality on starts and years. The set is found in rounds: a node without an earlier undecided neighbour is a person, its
neighbours follow. A round is a few joins over edges, however many keys a search has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions.names import first_word
from kinforge.session import materialized, maybe_broadcast, settled

SEARCH_KEY = ["job_id", "asc_no"]
# --- fixed values ---------------------------------------------------------------------------------
YEARS_APART, LETTERS = 3, 3
FILLED = ("birth_date", "birth_place", "death_date", "death_place", "father_name", "mother_name")

_NODE = [*SEARCH_KEY, "f", "l", "year"]


def _starts(c: str) -> Column:
    """The starts of a name's letters, the whole of them included."""
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i))


def resembling(nodes: DataFrame) -> DataFrame:
    """search, u, v: nodes ``v`` that resemble an earlier node ``u``. ``nodes``: search, f, l, year, seq.

    Nodes of the same letters stand in order of years, one a year: those near a node are the next few, and an unknown
    year, which stands first, goes with all. Names shorter than three letters, which are few, are starts of longer
    names: in searches that have some, nodes offer every start and their year, and the short ones ask by their
    letters and the years near their own, in both names the same way or each in its own.
    """
    named = nodes.where("f <> '' and l <> ''").where(F.col(SEARCH_KEY[0]).isNotNull() & F.col(SEARCH_KEY[1]).isNotNull())
    alike = Window.partitionBy(*SEARCH_KEY, "f", "l").orderBy(F.col("year").asc_nulls_first())
    undated = F.max(F.when(F.col("year").isNull(), F.col("seq"))).over(alike)
    after = [F.when(F.lead("year", k).over(alike) - F.col("year") <= YEARS_APART, F.lead("seq", k).over(alike)) for k in range(1, YEARS_APART + 1)]
    whole = named.withColumn("bs", F.array_compact(F.array(undated, *after))).select(*SEARCH_KEY, F.col("seq").alias("a"), F.explode("bs").alias("b"))
    year, any_year = F.col("year").cast("string"), F.lit("*")
    offered = F.array(F.coalesce(year, F.lit("?")), any_year)
    near = F.transform(F.sequence(F.col("year") - YEARS_APART, F.col("year") + YEARS_APART), lambda y: y.cast("string"))
    asked = F.when(F.col("year").isNull(), F.array(any_year)).otherwise(F.concat(near, F.array(F.lit("?"))))
    short = lambda c: F.length(c) < LETTERS

    def opened(rows: DataFrame, f: Column, l: Column, y: Column, seq: str) -> DataFrame:
        at = rows.select(*SEARCH_KEY, F.col("seq").alias(seq), f.alias("kf"), "l", y.alias("ys")).select(*SEARCH_KEY, seq, "kf", l.alias("kl"), "ys")
        return at.select(*SEARCH_KEY, seq, "kf", "kl", F.explode("ys").alias("ky"))

    keys, f, l = [*SEARCH_KEY, "kf", "kl", "ky"], F.col("f"), F.col("l")
    starts = lambda c: F.explode(_starts(c))
    few = materialized(named.where(short("f") | short("l")))
    beside = named.join(maybe_broadcast(materialized(few.select(*SEARCH_KEY).distinct())), SEARCH_KEY, "left_semi")
    same_way = opened(few, f, l, asked, "a").join(opened(beside, starts("f"), starts("l"), offered, "b").where(short("kf") | short("kl")), keys)
    crosswise = opened(few.where(short("f")), f, starts("l"), offered, "a").join(opened(few.where(short("l")), starts("f"), l, asked, "b"), keys)
    met = same_way.unionByName(crosswise).select(*SEARCH_KEY, "a", "b").unionByName(whole).where("a <> b")
    return met.select(*SEARCH_KEY, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def followers(edges: DataFrame) -> DataFrame:
    """search, v: nodes that are not in the lexicographically first maximal independent set."""
    left, gone = edges, None
    while True:
        open_ = left.select(*SEARCH_KEY, F.col("u").alias("n")).distinct().join(left.select(*SEARCH_KEY, F.col("v").alias("n")).distinct(), [*SEARCH_KEY, "n"], "left_anti")
        out = materialized(left.join(open_.select(*SEARCH_KEY, F.col("n").alias("u")), [*SEARCH_KEY, "u"], "left_semi").select(*SEARCH_KEY, "v").distinct())
        gone = out if gone is None else gone.unionByName(out)
        left = materialized(left.join(out, [*SEARCH_KEY, "v"], "left_anti").join(out.withColumnRenamed("v", "u"), [*SEARCH_KEY, "u"], "left_anti").select(*SEARCH_KEY, "u", "v"))
        if left.isEmpty():
            return gone


def merge_results(results: DataFrame) -> DataFrame:
    """``results``: job, slot, rnk (arrival), person_id, name, source, and those of FILLED that the sources give.

    Rows with an earlier row's exact key fill its gaps; rows that only resemble it add their source and id.
    Blank names resemble nothing.
    """
    filled = [c for c in FILLED if c in results.columns]
    low = F.coalesce(F.lower(F.trim("name")), F.lit(""))
    keyed = results.withColumns({"first": first_word(low), "last": F.substring_index(low, " ", -1), "year": F.regexp_extract("birth_date", r"(\d{4})", 1).try_cast("int")})
    keyed = materialized(keyed)  # read for the people and again for their sources
    key = [*SEARCH_KEY, "first", "last", "year"]
    gap = [F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("rnk"))).alias(c) for c in filled]
    letters = {"f": F.substring("first", 1, LETTERS), "l": F.substring("last", 1, LETTERS)}
    exact = materialized(keyed.groupBy(*key).agg(F.min("rnk").alias("seq"), F.min_by("name", "rnk").alias("name"), *gap).withColumns(letters))

    nodes = materialized(exact.groupBy(*_NODE).agg(F.min("seq").alias("seq")))
    edges = settled(lambda: resembling(nodes))
    out = settled(lambda: followers(edges))
    # A follower goes to the first of its neighbours that is a person.
    led = edges.join(out.withColumnRenamed("v", "u"), [*SEARCH_KEY, "u"], "left_anti").join(out, [*SEARCH_KEY, "v"], "left_semi").groupBy(*SEARCH_KEY, "v").agg(F.min("u").alias("lead"))
    placed = materialized(nodes.join(led.withColumnRenamed("v", "seq"), [*SEARCH_KEY, "seq"], "left").select(*_NODE, F.coalesce("lead", "seq").alias("leader_rnk")))
    year = F.coalesce("year", F.lit(-1)).alias("year")
    node = [*SEARCH_KEY, "f", "l", "year"]
    led_by = placed.select(*SEARCH_KEY, "f", "l", year, "leader_rnk")

    who = exact.join(placed.select(*SEARCH_KEY, F.col("leader_rnk").alias("seq")).distinct(), [*SEARCH_KEY, "seq"]).select(*SEARCH_KEY, F.col("seq").alias("leader_rnk"), "name", *filled)
    # Per node and source the last id wins and the first arrival counts.
    ids = keyed.withColumns(letters).select(*SEARCH_KEY, "f", "l", year, "source", "rnk", "person_id").groupBy(*node, "source").agg(F.min("rnk").alias("s"), F.max_by("person_id", "rnk").alias("id"), F.max("rnk").alias("last_seq"))
    one = materialized(ids.join(led_by, node).groupBy(*SEARCH_KEY, "leader_rnk", "source").agg(F.min("s").alias("s"), F.max_by("id", "last_seq").alias("id")))
    src = one.groupBy(*SEARCH_KEY, "leader_rnk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("s", "source"))), lambda x: x["source"]).alias("sources"), F.map_from_entries(F.collect_list(F.struct("source", "id"))).alias("source_ids"))
    return who.join(materialized(src), [*SEARCH_KEY, "leader_rnk"])
