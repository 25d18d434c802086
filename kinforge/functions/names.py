"""Person names: normalising, splitting, similarity, variants, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinforge.functions.literals import lookup, one_of
from kinforge.functions import values as V

NOT_FOUND_SUFFIX = r"(?i)\s*\(not found\)\s*$"
# --- fixed values: letters and their base letter ----------------------------------------
ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżžǣǫ"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzzæo"


def unaccent(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(c: Column) -> Column:
    s = F.regexp_replace(unaccent(F.trim(c)), r"\bnee\b\s*", "")
    return F.coalesce(squeeze(F.regexp_replace(s, r"[^a-z\s]", "")), F.lit(""))


def _cleaned(full: Column) -> Column:
    s = squeeze(F.regexp_replace(F.coalesce(full, F.lit("")), NOT_FOUND_SUFFIX, ""))
    return F.when(F.lower(s) == "unknown", "").otherwise(s)


def given_part(full: Column) -> Column:
    s = _cleaned(full)
    return F.when(s.contains(" "), F.regexp_replace(s, r" [^ ]*$", "")).otherwise(s)


def surname_part(full: Column) -> Column:
    s = _cleaned(full)
    return F.when(s.contains(" "), F.substring_index(s, " ", -1)).otherwise("")


def parse_name(full: Column) -> Column:
    return F.struct(given_part(full).alias("given_name"), surname_part(full).alias("surname"))


def first_word(c: Column) -> Column:
    return F.substring_index(F.lower(F.trim(c)), " ", 1)


def is_common_surname(c: Column) -> Column:
    return F.coalesce(one_of(V.COMMON_SURNAMES, F.lower(c)), F.lit(False))


def contains_either(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def names_similar(a: Column, b: Column) -> Column:
    """Equal, one inside the other, same first word, or a diminutive pair. Blank never matches."""
    na, nb = F.lower(F.trim(a)), F.lower(F.trim(b))
    fa, fb = first_word(a), first_word(b)
    pairs = [f"{x}|{y}" for x, y in V.diminutive_pairs()]
    hit = contains_either(na, nb) | (fa == fb) | F.concat_ws("|", fa, fb).isin(*pairs)
    return F.coalesce((F.length(na) > 0) & (F.length(nb) > 0) & hit, F.lit(False))


def surnames_compatible(a: Column, b: Column) -> Column:
    """Equal or one inside the other; an unknown surname on either side passes."""
    la, lb = F.lower(a), F.lower(b)
    return F.coalesce(F.length(la) == 0, F.lit(True)) | F.coalesce(F.length(lb) == 0, F.lit(True)) | contains_either(la, lb)


def prefix_similar(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    three = (F.length(x) >= 3) & (F.length(y) >= 3) & (F.substring(x, 1, 3) == F.substring(y, 1, 3))
    return F.coalesce((F.length(x) > 0) & (F.length(y) > 0) & (x.startswith(y) | y.startswith(x) | three), F.lit(False))


def name_contains(candidate: Column, known: Column) -> Column:
    """Every word of the known name (two letters or more) occurs in the candidate."""
    a, b = normalize_name(candidate), normalize_name(known)
    ws = F.filter(F.split(b, " "), lambda w: F.length(w) > 1)
    ok = (a == b) | F.forall(ws, lambda w: a.contains(w))
    return F.coalesce((F.trim(candidate) != "") & (F.trim(known) != "") & ok, F.lit(False))


def given_name_variants(c: Column) -> Column:
    return F.coalesce(lookup(V.name_variants(), first_word(c)), F.expr("cast(array() as array<string>)"))


def is_name_variant(a: Column, b: Column) -> Column:
    same = first_word(a) == first_word(b)
    ok = same | F.array_contains(given_name_variants(a), first_word(b))
    return F.coalesce((F.trim(a) != "") & (F.trim(b) != "") & ok, F.lit(False))


# --- fixed values: spelling rules, each applied once, to the first place it fits ---------
SPELLING_RULES = [
    ("^mac", "mc"), ("^mc", "mac"), ("e$", ""), ("$", "e"),
    ("son$", "sen"), ("sen$", "son"), ("y$", "ey"), ("ey$", "y"),
    ("th", "t"), ("(?<!t)t(?!h)", "th"), ("ph", "f"), ("f", "ph"), ("oo", "ou"), ("ou", "oo"),
]


def surname_variants(c: Column) -> Column:
    s = F.lower(c)
    made = F.array(*[F.regexp_replace(s, f"^(.*?)(?:{rule})", f"$1{to}") for rule, to in SPELLING_RULES])
    kept = F.filter(made, lambda v: (v != s) & (F.length(v) > 2))
    named = F.transform(kept, lambda v: F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, 2, 1000)))
    return F.array_distinct(F.coalesce(named, F.expr("cast(array() as array<string>)")))


def surname_halves(c: Column) -> Column:
    """The parts of a hyphenated surname, or the surname itself."""
    return F.filter(F.transform(F.split(c, "-"), lambda x: F.trim(x)), lambda x: x != "")


def forename_tokens(c: Column) -> Column:
    """The distinct forenames, lower case; one blank where there is none."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("")))


def parts_inside(c: Column, least: int = 3) -> Column:
    """Every run of ``least`` characters or more inside a text, itself left out: each start of each suffix."""
    n = F.length(c)
    starts = F.when(n >= least, F.sequence(F.lit(1), n - least + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(least), n - i + 1), lambda k: F.substring(c, i, k))))
    return F.filter(F.array_distinct(runs), lambda r: r != c)


# Display forms ---------------------------------------------------------------------------
def slashed_name(c: Column) -> Column:
    s = squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\(not found\)\s*$", ""))
    return (
        F.when(s == "", "//")
        .when(~s.contains(" "), F.concat(s, F.lit(" //")))
        .otherwise(F.regexp_replace(s, r" ([^ ]+)$", " /$1/"))
    )


def surname_upper(c: Column) -> Column:
    last = F.upper(F.substring_index(c, " ", -1))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "Unknown")
        .when(~c.contains(" "), last)
        .otherwise(F.concat(F.regexp_replace(c, r" [^ ]*$", " "), last))
    )


def join_present(sep: str, *cols: Column) -> Column:
    return F.concat_ws(sep, *[F.when(c != "", c) for c in cols])


def full_name(first: Column, middle: Column, last: Column) -> Column:
    return squeeze(join_present(" ", first, middle, last))


def year_range(birth_year: Column, birth_date: Column, death_year: Column) -> Column:
    birth = F.when(birth_date != "", birth_date).otherwise(F.coalesce(birth_year, F.lit("")))
    death = F.coalesce(death_year, F.lit(""))
    return (
        F.when((birth == "") & (death == ""), "(unknown)")
        .when((birth != "") & (death != ""), F.concat(F.lit("("), birth, F.lit("-"), death, F.lit(")")))
        .otherwise(F.concat(F.lit("("), birth, F.lit(")")))
    )


def slug(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9 ]", "")


def entry_text(kind: Column, forenames: Column, surname: Column, spouse: Column, year: Column, quarter: Column, district: Column) -> Column:
    """One line describing a civil index entry, parts joined by a long dash."""
    def present(c):
        return F.coalesce(c.cast("string"), F.lit("")) != ""

    return F.concat_ws(
        " — ",
        F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 100)),
        F.when(present(forenames) & present(surname), F.concat_ws(" ", forenames, surname)),
        F.when(present(spouse), F.concat(F.lit("married "), spouse)),
        F.when(present(year), year.cast("string")),
        F.when(present(quarter), F.concat(F.lit("Q"), quarter)),
        F.when(present(district), district),
    )
