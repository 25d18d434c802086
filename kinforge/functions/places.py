"""Places: parts, county, country, nearness of counties and districts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinforge.functions import values as V
from kinforge.functions.literals import first_true, lookup, one_of, word_pattern
from kinforge.functions.names import ACCENTED, PLAIN, contains_either


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[,.\s]+", " "))


def place_parts(c: Column) -> Column:
    """Comma parts, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def district_of(c: Column) -> Column:
    return F.coalesce(F.get(place_parts(c), F.lit(0)), F.lit(""))


def place_town(c: Column) -> Column:
    return parse_place(c)["town"]


def parse_place(c: Column) -> Column:
    """STRUCT<town, county, country>: first plain part is the town, the last county wins."""
    parts = place_parts(F.regexp_replace(F.lower(c), r"[^a-z\s,]", ""))
    counties, countries = V.CITED_COUNTIES, V.UK_COUNTRIES
    plain = F.filter(parts, lambda p: ~one_of(counties, p) & ~one_of(countries, p) & (F.length(p) > 1))
    return F.struct(
        F.get(plain, F.lit(0)).alias("town"),
        F.try_element_at(F.filter(parts, lambda p: one_of(counties, p)), F.lit(-1)).alias("county"),
        F.try_element_at(F.filter(parts, lambda p: one_of(countries, p)), F.lit(-1)).alias("country"),
    )


def looks_foreign(c: Column) -> Column:
    """A state, country or closing state code of another country, as whole words."""
    s = _flat(c)
    code = one_of(V.US_STATE_CODES, F.substring_index(s, " ", -1)) & s.contains(" ")
    hit = s.rlike(word_pattern(V.US_STATES)) | code | s.rlike(word_pattern(V.FOREIGN_COUNTRIES))
    return F.coalesce(hit, F.lit(False))


def looks_uk(c: Column) -> Column:
    return F.coalesce(_flat(c).rlike(word_pattern(V.UK_WORDS)), F.lit(False))


def clearly_foreign(c: Column) -> Column:
    return looks_foreign(c) & ~looks_uk(c)


def place_contains(candidate: Column, known: Column) -> Column:
    """Same text, or any word of the known place longer than two letters."""
    a, b = _flat(candidate), _flat(known)
    ws = F.filter(F.split(b, " "), lambda w: F.length(w) > 2)
    ok = (a == b) | F.exists(ws, lambda w: a.contains(w))
    return F.coalesce((F.trim(candidate) != "") & (F.trim(known) != "") & ok, F.lit(False))


def place_specificity(candidate: Column, known: Column) -> Column:
    a, b = parse_place(candidate), parse_place(known)
    return first_true([
        (a["town"] == b["town"], "town"),
        (a["county"] == b["county"], "county"),
        (a["country"] == b["country"], "country"),
        (place_contains(candidate, known), "partial"),
    ])


def sanitize_place(c: Column) -> Column:
    """Translate known foreign words, drop other scripts, tidy commas, modernise old counties."""
    s = c
    for word, english in V.FOREIGN_PLACE_WORDS.items():
        s = F.replace(s, F.lit(word), F.lit(english))
    s = F.regexp_replace(s, r"[^\u0000-ɏḀ-ỿⱠ-Ɀ꜠-ꟿ]", "")
    s = F.regexp_replace(s, r",\s*,", ",")
    s = F.regexp_replace(F.regexp_replace(s, r",\s*$", ""), r"^\s*,", "")
    s = F.regexp_replace(s, r"\s{2,}", " ")
    table = str.maketrans(ACCENTED, PLAIN)
    old = {k.translate(table): v for k, v in V.OLD_COUNTY_SPELLINGS.items()}
    modern = F.transform(place_parts(s), lambda p: F.coalesce(lookup(old, F.translate(F.lower(p), ACCENTED, PLAIN)), p))
    return F.coalesce(F.array_join(modern, ", "), F.lit(""))


def resolve_county(c: Column, towns: dict[str, str] | None = None) -> Column:
    """County of a place: the whole text first, then its parts in order. ``towns`` adds to the gazetteer."""
    names = V.gazetteer(towns)
    whole = F.trim(F.lower(c))
    parts = F.transform(F.split(whole, r"[,;]+"), lambda p: lookup(names, F.trim(p)))
    return F.coalesce(lookup(names, whole), F.get(F.filter(parts, lambda x: x.isNotNull()), F.lit(0)))


def county_proximity(a: Column, b: Column) -> Column:
    """same, adjacent, distant; null when either is unknown or has no borders on record."""
    known = V.counties()
    borders: dict[str, list[str]] = {}
    for x, y in V.border_pairs():
        borders.setdefault(x, []).append(y)
    return (
        F.when(a == b, "same")
        .when(F.array_contains(lookup(borders, a), b), "adjacent")
        .when(one_of(known, a) & one_of(known, b), "distant")
    )


def place_proximity(a: Column, b: Column) -> Column:
    return county_proximity(resolve_county(a), resolve_county(b))


def district_match(target: Column, candidate: Column) -> Column:
    """Equal, or on the target's own list of neighbours (the lists are one-directional)."""
    t, c = F.lower(F.trim(target)), F.lower(F.trim(candidate))
    near: dict[str, list[str]] = {}
    for x, y in V.nearby_pairs():
        near.setdefault(x, []).append(y)
    ok = (t == c) | F.coalesce(F.array_contains(lookup(near, t), c), F.lit(False))
    return F.coalesce((t != "") & (c != "") & ok, F.lit(False))


def places_overlap(a: Column, b: Column) -> Column:
    la, lb = F.lower(a), F.lower(b)
    return F.coalesce((la != "") & (lb != "") & contains_either(la, lb), F.lit(False))


def cited_county(text: Column) -> Column:
    """First county of the fixed list found anywhere in a citation text. Each is looked for by itself: a pattern of
    all of them tries every county at every letter. A plain CASE (not a lambda) keeps the tidied text a shared subexpression."""
    low = F.lower(text)
    plain = F.when(low.contains("<"), F.regexp_replace(low, r"<[^>]+>", "")).otherwise(low)
    return first_true([(plain.contains(x), x) for x in V.CITED_COUNTIES])


def short_place(c: Column) -> Column:
    """At most the first two parts."""
    return F.array_join(F.slice(place_parts(F.coalesce(c, F.lit(""))), 1, 2), ", ")


def chart_place(c: Column) -> Column:
    """Town and the last part, a closing country name skipped."""
    parts = place_parts(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x20-\x7E]", "")))
    countries = ["england", "wales", "scotland", "ireland", "united kingdom", "uk", "united states", "usa"]
    n = F.size(parts)
    last = F.try_element_at(parts, F.lit(-1))
    tail = F.when(one_of(countries, F.lower(last)), F.try_element_at(parts, F.lit(-2))).otherwise(last)
    return F.when(n <= 2, F.array_join(parts, ", ")).otherwise(F.concat_ws(", ", F.get(parts, F.lit(0)), tail))
