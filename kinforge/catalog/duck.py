"""Small DuckDB expressions the checks are built from, written independently of the Spark columns."""

from __future__ import annotations

from kinforge.functions import values as V
from kinforge.functions.names import SPELLING_RULES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


def dict_map(pairs: dict) -> str:
    def val(v):
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(q(x) for x in v) + "]"
        return q(v) if isinstance(v, str) else str(v)

    return "MAP {" + ", ".join(f"{q(k)}: {val(v)}" for k, v in pairs.items()) + "}"


def stripped(c: str) -> str:
    return f"regexp_replace(trim({c}), '^(abt|about|circa|c\\.?|~)\\s*', '', 'i')"


TEXT_DATE = r"(\d{1,2}\s+)?([A-Za-z]+)\s+(\d{4})"


def month(c: str) -> str:
    return f"{dict_map(V.MONTHS)}[lower(regexp_extract({stripped(c)}, '^{TEXT_DATE}$', 2))]"


def year(c: str) -> str:
    s = stripped(c)
    return (
        f"(CASE WHEN regexp_full_match({s}, '\\d{{4}}') THEN TRY_CAST({s} AS INT) "
        f"WHEN regexp_full_match({s}, '\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{4}}') THEN TRY_CAST(right({s}, 4) AS INT) "
        f"WHEN regexp_full_match({s}, '\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{2}}') THEN TRY_CAST(right({s}, 2) AS INT) + CASE WHEN TRY_CAST(right({s}, 2) AS INT) > 25 THEN 1900 ELSE 2000 END "
        f"WHEN {month(c)} IS NOT NULL THEN TRY_CAST(right({s}, 4) AS INT) END)"
    )


def bounded_year(c: str) -> str:
    return f"TRY_CAST(regexp_extract({c}, '\\b(1[6-9]\\d{{2}}|20[0-2]\\d)\\b', 1) AS INT)"


def flat(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[,.\\s]+', ' ', 'g'))"


def foreign(c: str) -> str:
    def pat(t):
        return "(^| )(" + "|".join(x.replace("'", "''") for x in t) + ")( |$)"
    return (
        f"coalesce(regexp_matches({flat(c)}, '{pat(V.US_STATES)}') OR regexp_matches({flat(c)}, '{pat(V.FOREIGN_COUNTRIES)}') "
        f"OR (strpos({flat(c)}, ' ') > 0 AND split_part({flat(c)}, ' ', -1) IN {in_list(V.US_STATE_CODES)}), false)"
    )


def uk(c: str) -> str:
    return f"coalesce(regexp_matches({flat(c)}, '(^| )(" + "|".join(x.replace("'", "''") for x in V.UK_WORDS) + ")( |$)'), false)"


#: Names that the towns of fx_town win over.
_SHIPPED = {**V.HISTORIC_COUNTIES, **V.COUNTY_ALIASES, **V.TOWNS}


#: Where the place texts of a query's tables stand.
_PLACE_TEXTS = {"fx_anc": "SELECT birth_place AS p FROM fx_anc", "fx_cand": "SELECT birth_place AS p FROM fx_cand", "fx_fact": "SELECT fact_place AS p FROM fx_fact", "fx_src": f"SELECT unnest([{', '.join(q(x) for x in V.CITED_COUNTIES)}]) AS p"}


def seats(tables) -> str:
    """CTE fx_seat(p, y): the county of every place text of some tables, by fx_town and the shipped names. Places have four parts at most."""
    names = f"SELECT lower(town) AS n, min(county) AS y FROM fx_town GROUP BY 1 UNION ALL SELECT n, y FROM (SELECT unnest(map_keys({dict_map(_SHIPPED)})) AS n, unnest(map_values({dict_map(_SHIPPED)})) AS y) k WHERE n NOT IN (SELECT lower(town) FROM fx_town)"
    texts = " UNION ".join(_PLACE_TEXTS[t] for t in tables if t in _PLACE_TEXTS)
    tried = "unnest([lower(trim(p))] || list_transform(string_split_regex(lower(p), '[,;]+'), lambda x: trim(x))) AS n, unnest(range(len(string_split_regex(lower(p), '[,;]+')) + 1)) AS i"
    return (f"fx_seat AS MATERIALIZED (WITH names AS ({names}), known AS (SELECT n, y FROM names WHERE n NOT IN {in_list(V.counties())} UNION ALL SELECT unnest([{', '.join(q(x) for x in V.counties())}]) AS n, n AS y) "
            f"SELECT p, arg_min(y, i) AS y FROM (SELECT p, {tried} FROM ({texts}) t WHERE p <> '') u JOIN known USING (n) GROUP BY p)")


def county(c: str) -> str:
    return f"(SELECT fx_seat.y FROM fx_seat WHERE fx_seat.p = {c})"


def proximity(a: str, b: str) -> str:
    """Of two county expressions."""
    pairs = ["|".join(p) for p in V.border_pairs()]
    known = in_list(V.counties())
    return (
        f"(CASE WHEN {a} = {b} THEN 'same' WHEN concat({a}, '|', {b}) IN {in_list(pairs)} AND {a} IS NOT NULL AND {b} IS NOT NULL THEN 'adjacent' "
        f"WHEN {a} IN {known} AND {b} IN {known} THEN 'distant' END)"
    )


def district_match(t: str, c: str) -> str:
    pairs = ["|".join(p) for p in V.nearby_pairs()]
    return f"coalesce({t} <> '' AND {c} <> '' AND (lower({t}) = lower({c}) OR concat(lower({t}), '|', lower({c})) IN {in_list(pairs)}), false)"


def first_word(c: str) -> str:
    return f"split_part(lower(trim({c})), ' ', 1)"


def has_name(forenames: str, name: str) -> str:
    """Whether a name is one of the forenames."""
    return f"list_contains(string_split(lower(trim({forenames})), ' '), lower({name}))"


def spelt(s: str) -> str:
    """The spelling variants of a lower-case surname, in order."""
    made = []
    for rule, to in SPELLING_RULES:
        if rule == "(?<!t)t(?!h)":
            made.append(f"regexp_replace({s}, '^(|.*?[^t])t([^h]|$)', '\\1th\\2')")
        else:
            made.append(f"regexp_replace({s}, '{rule}', '{to}')")
    every = "[" + ", ".join(made) + "]"
    return f"list_filter({every}, lambda v, i: v <> {s} AND length(v) > 2 AND list_position({every}, v) = i)"


def similar(a: str, b: str) -> str:
    pairs = ["|".join(p) for p in V.diminutive_pairs()]
    return (
        f"coalesce({a} <> '' AND {b} <> '' AND (contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})) "
        f"OR {first_word(a)} = {first_word(b)} OR concat({first_word(a)}, '|', {first_word(b)}) IN {in_list(pairs)}), false)"
    )


def common(c: str) -> str:
    return f"(lower({c}) IN {in_list(V.COMMON_SURNAMES)})"


def level(c: str) -> str:
    return f"(CASE WHEN {c} >= 90 THEN 'Verified' WHEN {c} >= 75 THEN 'Probable' WHEN {c} >= 50 THEN 'Possible' WHEN {c} >= 25 THEN 'Suggested' ELSE 'Not Found' END)"


def from_points(p: str) -> str:
    return (
        f"(CASE WHEN {p} >= 60 THEN 90 + least(5, {p} - 60) WHEN {p} >= 45 THEN 75 + least(14, {p} - 45) WHEN {p} >= 25 THEN 50 + least(24, {p} - 25) "
        f"WHEN {p} >= 10 THEN 30 + least(19, {p} - 10) WHEN {p} <= -10 THEN 0 ELSE 25 END)"
    )


_T = "lower({c})"


def _civil(c: str) -> str:
    return f"strpos(lower({c}), 'parish') = 0 AND regexp_matches(lower({c}), 'registration|index|register|certificate')"


def category(c: str) -> str:
    t = f"lower({c})"
    return (
        f"(CASE WHEN {_civil(c)} AND regexp_matches({t}, 'birth|marriage|death') THEN 'Civil Registration' "
        f"WHEN strpos({t}, 'census') > 0 THEN 'Census' WHEN regexp_matches({t}, '1939 register|national register') THEN '1939 Register' "
        f"WHEN regexp_matches({t}, 'parish register|christening|baptism|burial|banns') THEN 'Parish Register' "
        f"WHEN regexp_matches({t}, '\\b(military|army|navy|air force|war|medal|conscription)\\b') THEN 'Military' "
        f"WHEN strpos({t}, 'probate') > 0 OR (strpos({t}, 'will') > 0 AND regexp_matches({t}, 'proved|grant')) OR strpos({t}, 'administration') > 0 THEN 'Probate' "
        f"ELSE 'Other' END)"
    )


def source_key(c: str) -> str:
    t = f"lower({c})"
    yr = f"regexp_extract({t}, '(\\d{{4}})', 1)"
    return (
        f"(CASE WHEN {_civil(c)} AND strpos({t}, 'birth') > 0 THEN 'civil_birth' WHEN {_civil(c)} AND strpos({t}, 'marriage') > 0 THEN 'civil_marriage' "
        f"WHEN {_civil(c)} AND strpos({t}, 'death') > 0 THEN 'civil_death' "
        f"WHEN {category(c)} = 'Census' THEN 'census_' || CASE WHEN {yr} = '' THEN 'unknown' ELSE {yr} END "
        f"WHEN {category(c)} = '1939 Register' THEN '1939_register' "
        f"WHEN {category(c)} = 'Parish Register' THEN 'parish_' || {yr} || '_' || {t} "
        f"WHEN {category(c)} = 'Military' THEN 'military_' || {t} WHEN {category(c)} = 'Probate' THEN 'probate' "
        f"ELSE 'other_' || {t} END)"
    )


def category_points(c: str) -> str:
    return "(CASE " + c + " " + " ".join(f"WHEN {q(k)} THEN {p}" for k, (p, _) in V.CATEGORY_POINTS.items()) + " END)"


def category_cap(c: str) -> str:
    return "(CASE " + c + " " + " ".join(f"WHEN {q(k)} THEN {m}" for k, (_, m) in V.CATEGORY_POINTS.items()) + " END)"


def gen(c: str) -> str:
    return f"CAST(length(bin({c})) - 1 AS INT)"


def role(c: str) -> str:
    """Position words and the path to the subject."""
    who = f"CASE WHEN {c} % 2 = 0 THEN 'father' ELSE 'mother' END"
    path = (f"array_to_string(list_transform(string_split(substr(bin({c}), 2), ''), lambda d: CASE WHEN d = '0' THEN 'father' ELSE 'mother' END), ' → ')")
    return (
        f"(CASE {c} WHEN 1 THEN 'Subject' WHEN 2 THEN 'Father' WHEN 3 THEN 'Mother' ELSE "
        f"CASE {gen(c)} WHEN 2 THEN 'Grand' WHEN 3 THEN 'Great-Grand' ELSE CAST({gen(c)} - 2 AS VARCHAR) || 'x Great-Grand' END || {who} || ' (' || {path} || ')' END)"
    )


def parts(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '')"


def district(c: str) -> str:
    return f"coalesce({parts(c)}[1], '')"


def corrections_agree(a: str, b: str) -> str:
    def plain(x):
        return f"trim(regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g'))"

    pa, pb = plain(a), plain(b)
    ya, yb = (f"regexp_extract({p}, '\\b(1[6-9]\\d{{2}}|20[0-2]\\d)\\b', 1)" for p in (pa, pb))
    both = f"list_filter(list_intersect(string_split_regex({pa}, '\\s+'), string_split_regex({pb}, '\\s+')), lambda w: length(w) > 2)"
    return (
        f"coalesce({a} <> '' AND {b} <> '' AND (contains({pa}, {pb}) OR contains({pb}, {pa}) OR ({ya} <> '' AND {ya} = {yb} AND len({both}) >= 2)), false)"
    )


def correction_field(c: str) -> str:
    """The field a sentence of ``fx_flag`` or ``fx_review`` corrects: they all say "<event> <field> should be"."""
    return (f"(CASE WHEN {c} ILIKE '%birth year should be%' THEN 'birth_date' WHEN {c} ILIKE '%birth place should be%' THEN 'birth_place' "
            f"WHEN {c} ILIKE '%death place should be%' THEN 'death_place' END)")


def correction_value(c: str) -> str:
    said = f"trim(split_part({c}, 'should be', 2))"
    return f"(CASE WHEN {correction_field(c)} = 'birth_date' THEN {said}[1:4] WHEN {correction_field(c)} IS NOT NULL THEN {said} END)"
