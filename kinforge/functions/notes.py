"""Relatives read out of free text.

The text is cut once at kinship labels ("Father", "maternal grandmother", "GGP15"). A statement is a label and the
rest of its line up to the next label. The label's words give the slot by slot arithmetic; a name, an optional year
bracket and dates are read from what follows.

Kinship words count whole: a grandmother is no mother, a great-grandmother no grandmother, and a maternal
grandfather fills no paternal slot. A grandparent without a side is paternal. A 2x great-grandparent has no slot here. A name is letters and blanks on one
line, ending at a bracket, punctuation or a stop word.

Null or empty text: no relatives. Statements that cannot be read are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinforge.functions.dates import DATE_PHRASE
from kinforge.functions.literals import behind, bind
from kinforge.functions.names import parse_name

# --- fixed values: the four great-grandparent lines and how far a date may stand from its name ------
LINEAGES = {"paternal paternal": 8, "paternal maternal": 10, "maternal paternal": 12, "maternal maternal": 14}
REACH = 100

# The grammar, from words up.
SIDES = r"(?:(?:paternal|maternal)\s+){0,2}"
KIN = r"(?:(?:great[- ]?)?grand)?(?:father|mother)"
COUPLE = r"gp|grandparents?"
NUMBERED = r"(?:ggp|asc\s*#?)\d{1,2}"
FARTHER = r"\d+x\s+great[- ]?grand(?:father|mother|parents?)"
LABEL = rf"(?i)\b(?:{FARTHER}|{SIDES}(?:{KIN}|{COUPLE})|{NUMBERED})\b"
CUT = "\u0001"
JOINER = r"(?i)^[ \t]*(?:was\b|[-:–])"
NAME_RUN = r"^\s*([A-Za-z][A-Za-z \t]*)"
STOP_WORDS = r"(?i)\s+(?:born|from|and|died|b|d)\b.*$"
BORN, DIED = r"(?i)\b(?:born|b\.?)\s+", r"(?i)\b(?:died|d\.?)\s+"
STATED = {"birth": BORN + rf"({DATE_PHRASE})", "death": DIED + rf"({DATE_PHRASE})"}
NEARBY = BORN + rf"(?:(?:on|in)\s+)?({DATE_PHRASE})"
AFTER_BIRTH = BORN + r"[\d./-]+\s*,\s*(.*)$"

_RELATIVE = "struct<slot: int, rank: int, name: string, birth: string, death: string>"
# Ranks: a numbered label over a bracketed lineage over everything else; the last of the first two counts.
_NUMBERED_RANK, _BRACKET_RANK, _LISTED_RANK, _SAID_RANK = -2000000, -1000000, 0, 1000000


def _after(text: Column, pattern: str) -> Column:
    """The text behind a leading pattern."""
    return F.substring(text, F.length(F.regexp_extract(text, pattern, 0)) + 1, F.length(text))


def statements(notes: Column) -> Column:
    """ARRAY<STRUCT<label, tail>>: every kinship label with the rest of its line, in the order of the text."""
    parts = behind(F.split(F.regexp_replace(F.coalesce(notes, F.lit("")), LABEL, CUT + "$0"), CUT))
    return F.transform(parts, lambda p: F.struct(
        F.lower(F.regexp_extract(p, "^" + LABEL, 0)).alias("label"), F.substring_index(_after(p, "^" + LABEL), "\n", 1).alias("tail")))


def slot_of(sides: Column, generation: Column, mother: Column) -> Column:
    """The slot reached from the subject: a step to each named side, then to the father or the mother.

    Null unless as many sides are named as the generation has between; grandparents without a side are paternal.
    """
    steps = F.filter(F.split(F.lower(F.trim(sides)), r"\s+"), lambda w: w != "")
    known = F.when((generation == 2) & (F.size(steps) == 0), F.array(F.lit("paternal"))).when(
        generation < 3, F.slice(steps, F.size(steps) - generation + 2, generation - 1)).otherwise(steps)
    last = F.when(mother, 1).otherwise(0)

    def walk(path: Column) -> Column:
        side = F.aggregate(path, F.lit(1), lambda at, w: F.when(w == "paternal", at * 2).when(w == "maternal", at * 2 + 1))
        return F.when(F.size(path) == generation - 1, side * 2 + last).cast("int")

    return bind(known, walk)


def person(text: Column) -> Column:
    """STRUCT<name, birth, death, dated, ok> read at the start of a text.

    ``dated``: a year range stands behind the name. ``ok``: there is a name, and no other bracket or
    sign runs on from it.
    """
    run = F.regexp_extract(text, NAME_RUN, 1)
    follows = F.ltrim(_after(text, NAME_RUN))
    name = F.trim(F.regexp_replace(run, STOP_WORDS, ""))

    def read(p: Column) -> Column:
        years = F.split(F.regexp_extract(p["follows"], r"^\(([^)]*)\)", 1), "[-–]")
        birth, death = F.trim(F.get(years, F.lit(0))), F.lower(F.trim(F.coalesce(F.get(years, F.lit(1)), F.lit(""))))
        living = death.isin("", "present", "living")
        dated = (F.trim(p["run"]) == p["name"]) & (F.size(years) == 2) & birth.rlike(r"^\d{4}$") & (living | death.rlike(r"^\d{4}$"))
        ends = (F.trim(p["run"]) != p["name"]) | (p["follows"] == "") | F.substring(p["follows"], 1, 1).isin(",", ".", ";")
        return F.struct(p["name"].alias("name"), F.when(dated, birth).otherwise("").alias("birth"), F.when(dated & ~living, death).otherwise("").alias("death"),
                        dated.alias("dated"), ((F.length(p["name"]) > 1) & (dated | ends)).alias("ok"))

    return bind(F.struct(run.alias("run"), name.alias("name"), follows.alias("follows")), read)


def _relative(slot: Column, rank: Column, who: Column, when: Column) -> Column:
    filled = F.struct(slot.cast("int").alias("slot"), rank.cast("int").alias("rank"), who["name"].alias("name"), who["birth"].alias("birth"), who["death"].alias("death"))
    return F.filter(F.array(filled), lambda r: when & who["ok"] & r["slot"].isNotNull()).cast(f"array<{_RELATIVE}>")


def _one(label: Column, tail: Column, at: Column) -> Column:
    """A label for one relative. Parents need a year range, the others a joining sign or word."""
    mother, generation = label.endswith("mother"), F.when(label.contains("great"), 3).when(label.contains("grand"), 2).otherwise(1)
    number = F.regexp_extract(label, r"(\d+)$", 1).try_cast("int")
    bracket = F.when((generation == 3) & number.isNull(), F.regexp_extract(tail, r"^\s*\(([^)]*)\)", 1)).otherwise("")
    head = F.struct(number.alias("number"), generation.alias("generation"), bracket.alias("bracket"), F.when(bracket != "", _after(tail, r"^\s*\([^)]*\)")).otherwise(tail).alias("said"))

    def read(h: Column) -> Column:
        sides = F.when(h["bracket"] != "", h["bracket"]).otherwise(F.regexp_extract(label, "^" + SIDES, 0))
        slot = F.when(h["number"].isNotNull(), F.when(h["number"].between(8, 15), h["number"])).otherwise(slot_of(sides, h["generation"], mother))
        rank = F.when(h["number"].isNotNull(), _NUMBERED_RANK - at).when(h["bracket"] != "", _BRACKET_RANK - at).when(h["generation"] == 2, _SAID_RANK + at).otherwise(at)
        parent = h["number"].isNull() & (h["generation"] == 1)
        return bind(person(_after(h["said"], JOINER)), lambda who: _relative(
            slot, rank, who, F.when(parent, who["dated"]).otherwise(h["said"].rlike(JOINER))))

    return bind(head, read)


def _couple(label: Column, tail: Column, at: Column) -> Column:
    """"Maternal GP: one (years) and another (years)": both grandparents of a side, each with a year range."""
    side, rank = F.regexp_extract(label, "^" + SIDES, 0), at + _LISTED_RANK
    listed = (side != "") & tail.rlike(r"^\s*[-:–]")
    first = bind(person(_after(tail, JOINER)), lambda who: _relative(slot_of(side, F.lit(2), F.lit(False)), rank, who, listed & who["dated"]))
    other = bind(person(F.regexp_extract(tail, r"(?i)\band\b(.*)$", 1)), lambda who: _relative(slot_of(side, F.lit(2), F.lit(True)), rank, who, listed & who["dated"]))
    return F.concat(first, other)


def relatives(notes: Column) -> Column:
    """ARRAY<STRUCT<slot, rank, name, birth, death>>: the relative told of each slot, in slot order."""
    near = F.filter(statements(notes), lambda s: ~s["label"].rlike(r"^\d+x"))
    told = F.flatten(F.transform(near, lambda s, i: F.when(
        s["label"].rlike(rf"(?:{COUPLE})$"), _couple(s["label"], s["tail"], i)).otherwise(_one(s["label"], s["tail"], i))))
    return bind(F.array_sort(told), lambda all_: F.filter(all_, lambda r, i: (i == 0) | (F.get(all_, i - 1)["slot"] != r["slot"])))


def complete(notes: Column, relative: Column) -> Column:
    """STRUCT<slot, given, surname, birth_date, death_date, birth_place> of a relative.

    Blank dates and the place are read from the rest of the first line that holds the full name; a birth date
    still blank is the first one that begins within 100 characters of the full name (its own length included).
    """
    def read(p: Column) -> Column:
        full = F.lower(F.concat_ws(" ", p["given"], F.when(p["surname"] != "", p["surname"])))
        spaced = F.regexp_replace(full, " ", r"\\s+")
        rests = behind(F.split(notes, F.concat(F.lit("(?i)"), spaced)))
        return bind(F.struct(full.alias("full"), F.when(full != "", rests).alias("rests")), lambda m: dates(p, m))

    def dates(p: Column, m: Column) -> Column:
        line = F.coalesce(F.substring_index(F.get(m["rests"], F.lit(0)), "\n", 1), F.lit(""))
        room = REACH - F.length(m["full"])

        def near(b: Column) -> Column:
            at = F.regexp_instr(b, F.lit(NEARBY))
            return F.when((at > 0) & (at <= room + 1), F.regexp_extract(b, NEARBY, 1)).otherwise("")

        windows = F.transform(m["rests"], lambda b: F.substring(b, F.lit(1), F.lit(2 * REACH)))
        nearby = F.get(F.filter(F.transform(windows, near), lambda d: d != ""), F.lit(0))

        def settle(on_line: Column) -> Column:
            birth = F.when(relative["birth"] != "", relative["birth"]).otherwise(on_line["birth"])
            birth = F.when((birth == "") & (p["surname"] != ""), F.coalesce(nearby, F.lit(""))).otherwise(birth)
            death = F.when(relative["death"] != "", relative["death"]).otherwise(on_line["death"])
            return F.struct(relative["slot"].alias("slot"), p["given"].alias("given"), p["surname"].alias("surname"),
                            birth.alias("birth_date"), death.alias("death_date"), on_line["place"].alias("birth_place"))

        return bind(line, lambda t: bind(F.struct(*[F.regexp_extract(t, pat, 1).alias(k) for k, pat in STATED.items()], _place(t).alias("place")), settle))

    return bind(parse_name(relative["name"]).cast("struct<given: string, surname: string>"), read)


def _place(line: Column) -> Column:
    """Words between a birth date in figures and the death, or the end of the line."""
    words = F.regexp_replace(F.regexp_extract(line, AFTER_BIRTH, 1), r"(?i)\s*,\s*(?:d\.|died\b).*$", "")
    return F.when(words.rlike(r"^[A-Za-z][A-Za-z\s,]+$"), F.trim(words)).otherwise("")
