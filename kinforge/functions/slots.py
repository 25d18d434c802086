"""Tree positions: subject 1, father 2n, mother 2n + 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinforge.functions.literals import first_true


def generation(asc: Column) -> Column:
    return (F.length(F.bin(asc.cast("bigint"))) - 1).cast("int")


def child_of(asc: Column) -> Column:
    return F.shiftright(asc, 1)


def father_of(asc: Column) -> Column:
    return asc * 2


def mother_of(asc: Column) -> Column:
    return asc * 2 + 1


def spouse_of(asc: Column) -> Column:
    return F.when(asc > 1, asc.bitwiseXOR(F.lit(1)))


def is_father(asc: Column) -> Column:
    return asc % 2 == 0


def expected_gender(asc: Column) -> Column:
    return F.when(asc == 1, F.lit(None).cast("string")).when(is_father(asc), "Male").otherwise("Female")


def is_paternal(asc: Column) -> Column:
    """On the father's side: the second binary digit is 0. The subject is on neither."""
    return F.substring(F.bin(asc.cast("bigint")), 2, 1) == "0"


def in_subtree(asc: Column, root: Column) -> Column:
    """The slot itself or any slot above it: dropping low bits brings it to the root."""
    steps = generation(asc) - generation(root)
    return F.when(steps < 0, False).otherwise(F.floor(asc / F.pow(F.lit(2.0), steps)) == root)


def slot_path(asc: Column) -> Column:
    digits = F.filter(F.split(F.substring(F.bin(asc.cast("bigint")), 2, 64), ""), lambda d: d != "")
    return F.array_join(F.transform(digits, lambda d: F.when(d == "0", "father").otherwise("mother")), " → ")


def slot_role(asc: Column) -> Column:
    g = generation(asc)
    word = F.when(is_father(asc), "father").otherwise("mother")
    label = first_true([
        (g == 2, F.concat(F.lit("Grand"), word)),
        (g == 3, F.concat(F.lit("Great-Grand"), word)),
    ], F.concat((g - 2).cast("string"), F.lit("x Great-Grand"), word))
    return first_true(
        [(asc == 1, "Subject"), (asc == 2, "Father"), (asc == 3, "Mother")],
        F.concat(label, F.lit(" ("), slot_path(asc), F.lit(")")),
    )


def slot_card_role(asc: Column) -> Column:
    """Short form for the tree cards: side of the family first."""
    g = generation(asc)
    side = F.when(is_paternal(asc), "Pat. ").otherwise("Mat. ")
    who = F.when(is_father(asc), "Grandfather").otherwise("Grandmother")
    return first_true([
        (asc <= 1, "Subject"),
        (asc == 2, "Father"),
        (asc == 3, "Mother"),
        (g == 2, F.concat(side, who)),
        (g == 3, F.concat(side, F.lit("Gr-"), who)),
    ], F.concat(side, (g - 2).cast("string"), F.lit("x Gr-"), who))


def tree_slots(generations: Column) -> Column:
    """Number of slots of a whole tree."""
    return F.pow(F.lit(2), generations + 1).cast("int") - 1
