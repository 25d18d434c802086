"""Civil birth, marriage and death index: reading raw result pages and searching the index.

A search is (record type, surname, a given name if known, years, district if known). Many
tree positions ask the same question, and many index rows share the searched fields, so both
sides are reduced to distinct searches and distinct signatures before they meet. A search with
more matches than the index displays returns no rows; that is counted on signatures, before any
row is joined, so a common surname never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import values as V
from kinforge.functions.literals import lookup
from kinforge.functions.names import first_word, forename_tokens
from kinforge.operators.ranking import carry_forward, first_row, top_rows
from kinforge.session import materialized, maybe_broadcast

# --- fixed values -------------------------------------------------------------------------
OVERFLOW_AT = 3000
ROW_PATTERN = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL_PATTERN = r"(?is)<td[^>]*>(.*?)</td>"


def _field(i: int) -> Column:
    return F.coalesce(F.get(F.split("line", ";"), F.lit(i)), F.lit(""))


def _decoded(i: int) -> Column:
    return F.trim(F.coalesce(F.try_url_decode(_field(i)), _field(i)))


def parse_dump(dump: DataFrame) -> DataFrame:
    """Delimited text to index rows. A line with a blank first field sets quarter and year for the lines below."""
    is_header = (F.trim(_field(0)) == "") & (F.size(F.split("line", ";")) >= 4)
    header = F.when(is_header, F.struct(_field(2).try_cast("int").alias("q"), _field(3).try_cast("int").alias("y")))
    dated = carry_forward(dump, "doc", "line_no", header, "head")
    rows = dated.where(~is_header & (F.size(F.split("line", ";")) >= 6))
    quarter = F.coalesce(F.get(F.array(*[F.lit(x) for x in V.QUARTERS]), F.col("head.q")), F.lit(""))
    out = rows.select(
        "doc", "line_no", "entry_type", _field(1).alias("surname"), _decoded(2).alias("forenames"), _decoded(3).alias("spouse_surname"),
        F.col("head.y").alias("year"), quarter.alias("quarter"), _decoded(5).alias("district"), _field(6).alias("volume"), _field(7).alias("page"))
    return out.where((F.col("forenames") != "") | (F.col("spouse_surname") != ""))


def html_rows(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Rows of HTML tables with four cells or more, cells read by their shape."""
    body = F.transform(F.regexp_extract_all(F.col(html), F.lit(ROW_PATTERN), F.lit(1)), lambda r: F.transform(
        F.regexp_extract_all(r, F.lit(CELL_PATTERN), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", ""))))
    rows = pages.select(key, F.posexplode(body).alias("row_no", "cells")).where(F.size("cells") >= 4)
    first = F.lower(F.get("cells", F.lit(0)))
    rows = rows.where(~first.isin("surname", "type", ""))
    rest = F.slice("cells", 3, 1000000)

    def numbers(x):
        return x.rlike(r"(?i)^\d+[a-z]?$") & ~x.rlike(r"^\d{4}$")

    def years(x):
        return x.rlike(r"^\d{4}$")

    def quarters(x):
        return x.isin(*V.QUARTERS)

    nums = F.filter(rest, numbers)
    return rows.select(
        key, "row_no", F.get("cells", F.lit(0)).alias("surname"), F.get("cells", F.lit(1)).alias("forenames"),
        F.try_element_at(F.filter(rest, years), F.lit(-1)).cast("int").alias("year"),
        F.try_element_at(F.filter(rest, quarters), F.lit(-1)).alias("quarter"),
        F.get(nums, F.lit(0)).alias("volume"), F.when(F.size(nums) > 1, F.try_element_at(nums, F.lit(-1))).alias("page"),
        F.get(F.filter(rest, lambda x: (x != "") & ~years(x) & ~quarters(x) & ~numbers(x)), F.lit(0)).alias("district"))


def resolve_district(wanted: DataFrame, known: DataFrame, name: str = "district") -> DataFrame:
    """District name to id: exact, then a short form, then a prefix either way (lowest id first).

    Every way is an equality join. A name asks by those of its starts that are as long as some known name; a known
    name answers for its own starts, of which only the lowest id is kept before anything meets. So names that
    begin alike are never paired, however many there are.
    """
    asked = wanted.select(name).distinct().withColumn("_n", F.lower(F.trim(name))).where(F.col("_n") != "")
    asked = asked.withColumn("_full", F.coalesce(lookup(V.DISTRICT_SHORT_FORMS, F.col("_n")), F.col("_n")))
    ids = known.select(F.lower(F.trim("district_name")).alias("_k"), "district_id").where(F.col("_k") != "").groupBy("_k").agg(F.min("district_id").alias("district_id"))
    lengths = ids.agg(F.coalesce(F.collect_set(F.length("_k")), F.expr("cast(array() as array<int>)")).alias("sizes")).scalar()  # as many numbers as the longest name has letters

    def starts(text: Column, sizes: Column) -> Column:
        return F.transform(F.filter(sizes, lambda k: k < F.length(text)), lambda k: F.substring(text, F.lit(1), k))

    def met(asking: DataFrame, answers: DataFrame, how: int) -> DataFrame:
        return asking.join(answers, "_k").select(name, F.lit(how).alias("how"), "district_id")

    begins = ids.select(F.explode(starts(F.col("_k"), F.sequence(F.lit(1), F.length("_k")))).alias("_k"), "district_id").groupBy("_k").agg(F.min("district_id").alias("district_id"))
    found = (met(asked.select(name, F.col("_n").alias("_k")), ids, 0)
             .unionByName(met(asked.where("_full <> _n").select(name, F.col("_full").alias("_k")), ids, 1))
             .unionByName(met(asked.withColumn("_sizes", lengths).select(name, F.explode(starts(F.col("_n"), F.col("_sizes"))).alias("_k")), ids, 2))
             .unionByName(met(asked.select(name, F.col("_n").alias("_k")), begins, 2)))
    return first_row(found, name, [F.col("how"), F.col("district_id")])


SEARCH = ("surname_key", "given_key", "year_from", "year_to", "district_key")


def with_search(df: DataFrame, surname: Column, given: Column, year_from: Column, year_to: Column, district: Column) -> DataFrame:
    """Adds the search a row asks. A blank given name or district leaves that field open."""
    return (df.withColumn("surname_key", F.lower(surname)).withColumn("given_key", first_word(F.coalesce(given, F.lit(""))))
            .withColumn("year_from", year_from.cast("int")).withColumn("year_to", year_to.cast("int"))
            .withColumn("district_key", F.lower(F.coalesce(district, F.lit("")))))


def searches_of(df: DataFrame) -> DataFrame:
    s = df.select(*SEARCH).where((F.col("surname_key") != "") & F.col("year_from").isNotNull() & (F.col("year_from") <= F.col("year_to")))
    return s.distinct()


def _signed(civil: DataFrame, entry_type: str) -> DataFrame:
    """The entries of a type with what searches meet them by; ``s_givens`` are all their forenames."""
    return (civil.where(F.col("entry_type") == entry_type).withColumn("s_surname", F.lower("surname")).withColumn("s_givens", forename_tokens(F.col("forenames")))
            .withColumn("s_district", F.lower("district")))


def _match(searches: DataFrame, index: DataFrame, given: str) -> DataFrame:
    """Meet on surname, year, given name and district in one equality join.

    A field a search leaves open is blank. So the index offers each row twice, under its district
    and under a blank one, and a search meets exactly one of the two. A given name meets any forename of an
    entry, as each row is offered under every one of them; how well it fits is for the scores, which see where
    it stands. ``given`` says whether the searches state a given name: ``always``, ``never``, or ``maybe``
    (offered under a blank one too).
    """
    opened = searches.withColumn("_year", F.explode(F.sequence("year_from", "year_to")))
    offered = index.withColumn("_district", F.explode(F.array_distinct(F.array("s_district", F.lit("")))))
    on = [F.col("surname_key") == F.col("s_surname"), F.col("_year") == offered["year"], F.col("district_key") == F.col("_district")]
    if given == "maybe":
        offered = offered.withColumn("_given", F.explode(F.array_union("s_givens", F.array(F.lit("")))))
        on.append(F.col("given_key") == F.col("_given"))
    elif given == "always":
        offered = offered.withColumn("_given", F.explode("s_givens"))
        on.append(F.col("given_key") == F.col("_given"))
    return opened.join(offered, on).drop("_year", "_district", "_given", "s_surname", "s_givens", "s_district")


def match_counts(searches: DataFrame, civil: DataFrame, entry_type: str, given: str = "always") -> DataFrame:
    """Matches of every search, counted on index signatures."""
    by = ["s_surname", "s_district", "year"] + ([] if given == "never" else ["s_givens"])
    sign = _signed(civil, entry_type).groupBy(*by).agg(F.count("*").alias("rows"))
    return _match(searches, sign, given).groupBy(*SEARCH).agg(F.sum("rows").alias("matches"))


def _shown(searches: DataFrame, civil: DataFrame, entry_type: str, limit: int | None, given: str) -> DataFrame:
    if limit is None:
        return searches.select(*SEARCH).distinct()
    return match_counts(searches, civil, entry_type, given).where(F.col("matches") <= limit).drop("matches")


def civil_search(searches: DataFrame, civil: DataFrame, entry_type: str, limit: int | None = None, given: str = "always") -> DataFrame:
    """Index rows of every search. With a ``limit``, searches that have more matches answer nothing."""
    return search_rows(_shown(searches, civil, entry_type, limit, given), civil, entry_type, given)


def search_rows(searches: DataFrame, civil: DataFrame, entry_type: str, given: str = "always") -> DataFrame:
    """Index rows beside every row of ``searches``, whose other columns stay; rows that ask alike are each answered."""
    return _match(searches, _signed(civil, entry_type), given)


#: Entries alike in these are one signature: all that a score of an entry may read.
SIGNATURE = ("surname", "forenames", "spouse_surname", "year", "district")


def least_ids(rows: DataFrame, by: list[str], keep: int) -> DataFrame:
    """For each ``by`` the first ``keep`` entries as ``ids``, an array of (entry_id, volume, page) in order of entry.

    Ranks are cut before the shuffle, so no more than ``keep`` rows a task and group move, however many are alike."""
    few = top_rows(rows, by, [F.col("entry_id")], keep, "_least")
    return few.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("entry_id", "volume", "page"))).alias("ids"))


def signature_search(searches: DataFrame, civil: DataFrame, entry_type: str, keep: int, given: str = "always") -> DataFrame:
    """What ``civil_search`` finds, as signatures with their first ``keep`` entries (``ids``): the rows that
    meet the searches do not grow with the number of entries alike."""
    index = least_ids(_signed(civil, entry_type), [*SIGNATURE, "s_surname", "s_givens", "s_district"], keep)
    return _match(searches, index, given)


def search_overflow(searches: DataFrame, civil: DataFrame, entry_type: str, limit: int = OVERFLOW_AT) -> DataFrame:
    """Every search with its match count and whether it has more than ``limit`` (a report; no search is cut by it)."""
    counted = searches.join(match_counts(searches, civil, entry_type), list(SEARCH), "left")
    n = F.coalesce("matches", F.lit(0))
    return counted.select(*SEARCH, n.alias("matches"), (n > limit).alias("overflow"))


def best_entries(asked: DataFrame, civil: DataFrame, entry_type: str, ask_by: list[str], score: Column, at_least: int,
                 limit: int | None = None, keep: Column | None = None, given: str = "always") -> DataFrame:
    """For every distinct question the best index entry, first in index order on a tie.

    ``ask_by`` names the question's own columns used by ``score`` beside the search columns.
    Index rows alike in every field a score may read are one candidate, the earliest of them. Questions and
    candidates meet under numbers: what is sorted to find the best of a question are a few numbers a pair, and
    texts are looked up for the best alone. The answers are written: there is one a question, and their size
    decides how the rows that ask meet them (few answers are broadcast, so that those rows stay where they are).
    """
    questions = materialized(asked.select(*SEARCH, *ask_by).distinct().withColumn("_q", F.monotonically_increasing_id()))
    shown = _shown(searches_of(questions), civil, entry_type, limit, given)
    alike = list(SIGNATURE)
    index = _signed(civil, entry_type).groupBy(*alike, "s_surname", "s_givens", "s_district").agg(F.min_by(F.struct("entry_id", "quarter", "volume", "page"), "entry_id").alias("e"))
    index = materialized(index.withColumn("_sig", F.monotonically_increasing_id()))
    scored = questions.join(_match(shown, index, given), list(SEARCH)).withColumn("score", score)
    if keep is not None:
        scored = scored.where(keep)
    pairs = scored.where(F.col("score") >= at_least).select("_q", "_sig", "score", F.col("e.entry_id").alias("_id"))
    best = pairs.groupBy("_q").agg(F.min_by(F.struct("_sig", "score"), F.struct(-F.col("score"), F.col("_id"))).alias("b")).select("_q", "b.*")
    best = best.join(index, "_sig").join(questions, "_q")
    best = best.select(*SEARCH, *ask_by, "score", *[F.col(a).alias(f"entry_{a}") for a in alike],
                       *[F.col(f"e.{a}").alias(a if a == "entry_id" else f"entry_{a}") for a in ("entry_id", "quarter", "volume", "page")])
    return maybe_broadcast(materialized(best))
