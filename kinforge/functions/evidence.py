"""Source classes, levels and the points-to-confidence curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinforge.functions import values as V
from kinforge.functions.literals import first_true, lookup

# --- fixed values: words in a citation title ---------------------------------------------
CIVIL_INDEX_WORDS = ("registration", "index", "register", "certificate")
REGISTER_1939_WORDS = ("1939 register", "national register")
PARISH_WORDS = ("parish register", "christening", "baptism", "burial", "banns")
GRANT_WORDS = ("proved", "grant")
MILITARY_WORDS = r"\b(military|army|navy|air force|war|medal|conscription)\b"
UNKNOWN_YEAR = "unknown"


def normalized_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words anywhere; a plain search each, cheaper than a pattern of them all."""
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def lowered(title: Column) -> Column:
    return F.lower(F.coalesce(title, F.lit("")))


def _rules(t: Column) -> list[tuple[Column, str, str]]:
    """Rule, category and sub type for a lower-case title; the first rule that fits wins."""
    civil = ~t.contains("parish") & _any_of(t, CIVIL_INDEX_WORDS)
    will = t.contains("will") & _any_of(t, GRANT_WORDS)
    return [
        (civil & t.contains("birth"), "Civil Registration", "birth"),
        (civil & t.contains("marriage"), "Civil Registration", "marriage"),
        (civil & t.contains("death"), "Civil Registration", "death"),
        (t.contains("census"), "Census", "census"),
        (_any_of(t, REGISTER_1939_WORDS), "1939 Register", "1939"),
        (_any_of(t, PARISH_WORDS), "Parish Register", "parish"),
        (t.rlike(MILITARY_WORDS), "Military", "military"),
        (t.contains("probate") | will | t.contains("administration"), "Probate", "probate"),
    ]


def source_category(t: Column) -> Column:
    """The category alone of a title that ``lowered`` has read."""
    return first_true([(rule, category) for rule, category, _ in _rules(t)], "Other")


def classify_lowered(t: Column, key_length: int | None = None) -> Column:
    """``classify_source`` of a title that ``lowered`` has read, so that a column of it is read once for all rules."""
    head = t if key_length is None else F.substring(t, 1, key_length)
    year = F.regexp_extract(t, r"(\d{4})", 1)
    census_year = F.when(year == "", UNKNOWN_YEAR).otherwise(year)
    keys = {"census": F.concat(F.lit("census_"), census_year), "1939": F.lit("1939_register"), "parish": F.concat_ws("_", F.lit("parish"), year, head),
            "military": F.concat(F.lit("military_"), head), "probate": F.lit("probate")}

    def of(category, sub_type):
        return F.struct(F.lit(category).alias("category"), (census_year if sub_type == "census" else F.lit(sub_type)).alias("sub_type"),
                        keys.get(sub_type, F.lit(f"civil_{sub_type}")).alias("key"))

    other = F.struct(F.lit("Other").alias("category"), F.lit("other").alias("sub_type"), F.concat(F.lit("other_"), head).alias("key"))
    return first_true([(rule, of(category, sub_type)) for rule, category, sub_type in _rules(t)], other)


def classify_source(title: Column, key_length: int | None = None) -> Column:
    """STRUCT<category, sub_type, key>; the first rule that fits wins.

    Titles without a kind of their own are told apart by the whole title, or by its first ``key_length`` characters.
    """
    return classify_lowered(lowered(title), key_length)


def category_points(category: Column) -> Column:
    return lookup({k: p for k, (p, _) in V.CATEGORY_POINTS.items()}, category)


def category_cap(category: Column) -> Column:
    return lookup({k: c for k, (_, c) in V.CATEGORY_POINTS.items()}, category)


def is_primary(category: Column) -> Column:
    return category.isin(*V.PRIMARY_CATEGORIES)


def confidence_level(score: Column) -> Column:
    return first_true(
        [(score >= 90, "Verified"), (score >= 75, "Probable"), (score >= 50, "Possible"), (score >= 25, "Suggested")],
        "Not Found",
    )


def candidate_level(score: Column) -> Column:
    """Level of a hand-picked candidate: never below Suggested."""
    return first_true([(score >= 90, "Verified"), (score >= 75, "Probable"), (score >= 50, "Possible")], "Suggested")


def card_colour(score: Column, level: Column, person_id: Column) -> Column:
    linked = F.coalesce(person_id, F.lit("")) != ""
    return first_true([
        (level == "Customer Data", "customer_data"),
        (score >= 90, "verified"),
        (score >= 75, "probable"),
        (score >= 50, "possible"),
        ((score > 0) | linked, "suggested"),
    ], "empty")


def confidence_from_points(points: Column) -> Column:
    """Piecewise curve from evidence points to a percentage."""
    def band(base, most, above):
        return F.lit(base) + F.least(F.lit(most), points - above)

    return first_true([
        (points >= 60, band(90, 5, 60)),
        (points >= 45, band(75, 14, 45)),
        (points >= 25, band(50, 24, 25)),
        (points >= 10, band(30, 19, 10)),
        (points <= -10, 0),
    ], 25).cast("int")


def multi_source_bonus(n_sources: Column) -> Column:
    return first_true([(n_sources >= 3, 15), (n_sources == 2, 10)], 0)
