"""Form submissions to jobs and customer rows; all row-local, so it runs the same on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import names, notes as N, slots
from kinforge.functions.literals import first_true
from kinforge.operators.ranking import first_row
from kinforge.operators.tree import JOB, SLOT

SUB = "submission_id"
# --- fixed values: form fields ------------------------------------------------------------------------
MOST_CHILDREN = 6
GENERATIONS = 6
LEGACY_FIELDS = {  # newest name of a field to the old names it may arrive under, in order
    "subject_name": ("q1_fullName", "q2_subjectName"), "customer_email": ("q3_email", "q2_email"), "customer_name": ("q4_customerName", "q3_customerName"),
    "birth_date": ("q5_birthDate", "q4_birthDate"), "birth_place": ("q6_birthPlace", "q5_birthPlace"), "death_date": ("q7_deathDate",), "death_place": ("q8_deathPlace",),
    "father_name": ("q9_fatherName", "q6_fatherName"), "mother_name": ("q10_motherName", "q7_motherName"), "notes": ("q11_notes", "q8_notes", "q12_additionalInfo"),
    "generations": ("q13_generations", "q9_generations"),
}
LEGACY_GENERATIONS = 4
EXTRA_LINES = (  # field, text before it
    ("family_towns", "Family locations: "), ("family_counties", "Family counties: "), ("known_moves", "Known moves: "),
)
MARRIAGE_LINES = (("parents", "Parents married: "), ("user_parents", "Parents married: "), ("partner_parents", "Partner's parents married: "))
CONDITIONAL_LINES = (("has_adoption", "adoption_details", "Adoption note: "), ("has_surname_change", "surname_change_details", "Surname changes: "))
CUSTOMER = {"confidence": "customer_data", "confidence_score": 100, "confidence_level": "Customer Data", "accepted": 1}

# Where the person of a form prefix stands. The family of the submitter and of the partner have the same
# shape; which of the two is the father's depends on the submitter.
_SIDE = {"": 0, "_dad": 1, "_mum": 2, "_pat_gf": 3, "_pat_gm": 4, "_mat_gf": 5, "_mat_gm": 6}
_FATHER_SIDE = (2, 4, 5, 8, 9, 10, 11)
_MOTHER_SIDE = (3, 6, 7, 12, 13, 14, 15)


def prefix_slots() -> dict[str, list[tuple[str, int]]]:
    """Form prefixes and their slots for each path: ``dad``, ``mum`` (who submitted), ``root`` (no children)."""
    def family(prefix, places):
        return [(prefix + tail, places[i]) for tail, i in _SIDE.items()]

    root = [("root", 1), ("root_dad", 2), ("root_mum", 3)]
    for i, grand in enumerate(("pat_gf", "pat_gm", "mat_gf", "mat_gm")):
        root += [(f"root_{grand}", 4 + i), (f"root_{grand}_ggf", 8 + 2 * i), (f"root_{grand}_ggm", 9 + 2 * i)]
    return {"dad": family("user", _FATHER_SIDE) + family("partner", _MOTHER_SIDE), "mum": family("partner", _FATHER_SIDE) + family("user", _MOTHER_SIDE), "root": root}


# Great-grandparents whose parents a form may name, and the branch each stands for in the notes: by path the
# grandfathers' side by branch, then the grandmothers' side by the form's own prefix.
_BRANCHES = tuple(N.LINEAGES)
_FAR = ("user_pat", "user_mat", "partner_pat", "partner_mat")


def far_prefixes() -> dict[str, list[tuple[str, str]]]:
    """(prefix of a great-grandparent, what the notes call it) for each path, in the order of the notes."""
    by_dad = [f"{f}_gf" for f in _FAR]
    own = [(f"{f}_gm", f"{f}_gm") for f in _FAR]
    return {"dad": list(zip(by_dad, _BRANCHES, strict=True)) + own, "mum": list(zip(by_dad[2:] + by_dad[:2], _BRANCHES, strict=True)) + own, "root": []}


def field(name, fields: str = "fields") -> Column:
    key = name if isinstance(name, Column) else F.lit(name)
    return F.trim(F.coalesce(F.try_element_at(F.col(fields), key), F.lit("")))


def payload_fields(rows: DataFrame, raw: str = "raw_request", top: str = "top") -> DataFrame:
    """Inner JSON text merged with the outer fields; a filled outer field wins."""
    empty = F.expr("cast(map() as map<string, string>)")
    inner = F.coalesce(F.from_json(F.col(raw), "map<string, string>"), empty)
    outer = F.coalesce(F.col(top), empty) if top in rows.columns else empty
    return rows.withColumn("fields", F.map_zip_with(inner, outer, lambda k, a, b: F.when(F.coalesce(b, F.lit("")) != "", b).otherwise(a))).drop(raw, top)


def path_of() -> Column:
    with_children = F.lower(field("has_children")) == "yes"
    return F.when(~with_children, "root").when(F.lower(field("user_role")).contains("dad"), "dad").otherwise("mum")


def person_blocks(sub: DataFrame) -> DataFrame:
    """One row per person named in a submission, with its slot."""
    def mapped(pairs):
        return F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(s).alias("slot")) for p, s in pairs])

    plan = prefix_slots()
    places = first_true([(F.col("path") == k, mapped(v)) for k, v in plan.items()], mapped(plan["root"]))
    rows = sub.withColumn("path", path_of()).withColumn("_b", F.explode(places)).select("*", F.col("_b.prefix").alias("prefix"), F.col("_b.slot").alias(SLOT)).drop("_b")

    def f(suffix):
        return field(F.concat(F.col("prefix"), F.lit(suffix)))

    sex = f("_sex_at_birth")
    rows = rows.where(f("_first_name") != "")
    return rows.select(
        SUB, "path", "prefix", SLOT, names.full_name(f("_first_name"), f("_middle_names"), f("_last_name_at_birth")).alias("full_name"),
        F.coalesce(slots.expected_gender(F.col(SLOT)), F.when(sex.isin("Male", "Female"), sex).otherwise("Unknown")).alias("gender"),
        f("_birth_date").alias("birth_date"), f("_birth_year").alias("birth_year"), names.join_present(", ", f("_birth_place_town"), f("_birth_place_county")).alias("birth_place"),
        f("_death_year").alias("death_year"), (F.lower(f("_known")) != "no").alias("known"))


def children(sub: DataFrame) -> DataFrame:
    """One row per child up to the first blank name or the first "no more"."""
    def named(i):
        return field(F.concat(F.lit("child"), i.cast("string"), F.lit("_first_name"))) != ""

    def stopped(i):
        return F.lower(field(F.concat(F.lit("add_child_"), (i + 1).cast("string")))) == "no"

    numbers = F.filter(F.sequence(F.lit(1), F.lit(MOST_CHILDREN)), lambda i: F.forall(F.sequence(F.lit(1), i), lambda j: named(j) & ((j == i) | ~stopped(j))))
    rows = sub.where(path_of() != "root").withColumn("child_index", F.explode(numbers))

    def f(suffix):
        return field(F.concat(F.lit("child"), F.col("child_index").cast("string"), F.lit(suffix)))

    sex = f("_sex_at_birth")
    return rows.select(SUB, "child_index", names.full_name(f("_first_name"), f("_middle_names"), f("_last_name_at_birth")).alias("full_name"), F.when(sex.isin("Male", "Female"), sex).otherwise("Unknown").alias("gender"),
                       f("_birth_date").alias("birth_date"), names.join_present(", ", f("_birth_place_town"), f("_birth_place_county")).alias("birth_place"))


def validate(sub: DataFrame) -> DataFrame:
    """Each submission with the reason it is refused, blank when it is accepted."""
    path = path_of()
    parent = (field("user_first_name") != "") | (field("partner_first_name") != "")
    reason = first_true([
        ((path != "root") & (field("child1_first_name") == ""), "No children found"),
        ((path != "root") & ~parent, "Missing parent data"),
        ((path == "root") & ((field("root_first_name") == "") | (field("root_last_name_at_birth") == "")), "Missing required fields"),
    ], "")
    return sub.select(SUB, path.alias("path"), reason.alias("reason"), (reason == "").alias("accepted"))


def intake_rows(sub: DataFrame) -> DataFrame:
    """Customer rows of every job: the child (or root) as subject, then everyone known in slots 2 to 15."""
    ok = sub.join(validate(sub).where("accepted").select(SUB), SUB, "left_semi")
    people = person_blocks(ok)
    near = F.col(SLOT) <= 3
    born = F.when((F.col("birth_date") != "") | near, F.col("birth_date")).otherwise(F.col("birth_year"))
    died = F.when(near & (F.col("path") != "root"), "").otherwise(F.col("death_year"))
    kept = people.where(F.col("known") | (F.col("path") != "root") & near | (F.col(SLOT) == 1)).select(SUB, "path", SLOT, F.col("full_name").alias("name"), "gender", born.alias("birth_date"), "birth_place", died.alias("death_date"))
    kids = children(ok)
    subject = kids.select(SUB, "child_index", F.lit(1).alias(SLOT), F.col("full_name").alias("name"), "gender", "birth_date", "birth_place", F.lit("").alias("death_date"))
    family = kids.select(SUB, "child_index").join(kept.where("path <> 'root'").drop("path"), SUB)
    alone = kept.where("path = 'root'").drop("path").withColumn("child_index", F.lit(1))
    rows = subject.unionByName(family).unionByName(alone)
    return rows.withColumn("generation", slots.generation(F.col(SLOT))).withColumns({k: F.lit(v) for k, v in CUSTOMER.items()})


def notes_render(sub: DataFrame) -> DataFrame:
    """Known relatives and extras as the lines of text the notes reader understands.

    One submission names at most thirty relatives, so its lines are gathered safely.
    """
    p = person_blocks(sub).where("known")
    slot = F.col(SLOT)
    side = F.when(slots.is_paternal(slot), "Paternal").otherwise("Maternal")
    who = F.when(slots.is_father(slot), "father").otherwise("mother")
    place = F.when(F.col("birth_place") != "", F.concat(F.lit(" "), "birth_place")).otherwise("")
    grand = F.concat(side, F.lit(" grand"), who, F.lit(": "), "full_name", F.lit(" "), names.year_range(F.col("birth_year"), F.col("birth_date"), F.col("death_year")), place)
    yr = F.when(F.col("birth_date") != "", F.col("birth_date")).otherwise(F.col("birth_year"))
    years = F.when(yr == "", "").when(F.col("death_year") != "", F.concat(F.lit(" ("), yr, F.lit("-"), F.col("death_year"), F.lit(")"))).otherwise(F.concat(F.lit(" ("), yr, F.lit(")")))
    great = F.concat(F.lit("Great-grand"), who, F.lit(" ("), lineage_words(slot), F.lit("): "), "full_name", years, place)
    lines = p.where(slot >= 4).select(SUB, slot.alias("_o"), F.when(slot < 8, grand).otherwise(great).alias("line"))
    lines = lines.unionByName(_far_lines(sub))
    told = lines.groupBy(SUB).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "line"))), lambda x: x["line"]).alias("told"))
    extra = [F.when(field(f) != "", F.concat(F.lit(t), field(f))) for f, t in EXTRA_LINES]
    for who_, t in MARRIAGE_LINES:
        y, pl = field(f"{who_}_marriage_year"), field(f"{who_}_marriage_place")
        said = F.concat_ws(" ", F.when(y != "", y), F.when(pl != "", F.concat(F.lit("at "), pl)))
        extra.append(F.when(said != "", F.concat(F.lit(t), said)))
    extra += [F.when((field(flag) == "Yes") & (field(f) != ""), F.concat(F.lit(t), field(f))) for flag, f, t in CONDITIONAL_LINES]
    extra.append(F.when(field("additional_notes") != "", F.concat(F.lit("Additional: "), field("additional_notes"))))
    out = sub.join(told, SUB, "left")
    return out.select(SUB, F.array_join(F.concat(F.coalesce("told", F.expr("cast(array() as array<string>)")), F.array_compact(F.array(*extra))), "\n").alias("notes"))


def _far_lines(sub: DataFrame) -> DataFrame:
    """Lines of the parents of great-grandparents, who have no slot of their own in the notes' reading."""
    def listed(pairs):
        return F.array(*[F.struct(F.lit(f"{p}_{who}").alias("prefix"), F.lit(label).alias("label"), F.lit(16 + 2 * i + j).alias("_o")) for i, (p, label) in enumerate(pairs) for j, who in enumerate(("ggf", "ggm"))])

    plan = {k: v for k, v in far_prefixes().items() if v}
    rows = sub.withColumn("_path", path_of()).where(F.col("_path").isin(*plan))
    rows = rows.withColumn("_b", F.explode(first_true([(F.col("_path") == k, listed(v)) for k, v in plan.items()], listed(plan["dad"])))).select(SUB, "fields", "_b.*")

    def f(suffix):
        return field(F.concat(F.col("prefix"), F.lit(suffix)))

    rows = rows.where(f("_first_name") != "")
    who = F.when(F.col("_o") % 2 == 0, "father").otherwise("mother")
    year = F.when(f("_birth_year") != "", F.concat(F.lit(" ("), f("_birth_year"), F.lit(")"))).otherwise("")
    at = names.join_present(", ", f("_birth_place_town"), f("_birth_place_county"))
    name = names.full_name(f("_first_name"), f("_middle_names"), f("_last_name_at_birth"))
    return rows.select(SUB, "_o", F.concat(F.lit("2x Great-grand"), who, F.lit(" ("), F.col("label"), F.lit("): "), name, year, F.when(at != "", F.concat(F.lit(" "), at)).otherwise("")).alias("line"))


def lineage_words(slot: Column) -> Column:
    pair = F.shiftright(slot, 1) * 2
    return first_true([(pair == v, k) for k, v in N.LINEAGES.items()], "")


def legacy_fields(rows: DataFrame) -> DataFrame:
    """Old field names to today's; the first filled one wins, notes are joined, generations 2 to 7 else 4."""
    def filled(name):
        return F.when(field(name) != "", field(name))

    def first(key):
        return F.coalesce(*[filled(n) for n in LEGACY_FIELDS[key]], F.lit(""))

    subject = first("subject_name")
    given, surname = names.given_part(subject), names.surname_part(subject)
    gens = [field(n).try_cast("int") for n in LEGACY_FIELDS["generations"]]
    valid = F.coalesce(*[F.when(g.between(2, 7), g) for g in reversed(gens)], F.lit(LEGACY_GENERATIONS))
    customer = F.when(first("customer_name") != "", first("customer_name")).otherwise(F.trim(F.concat_ws(" ", given, surname)))
    out = {k: first(k) for k in LEGACY_FIELDS if k not in ("subject_name", "customer_name", "notes", "generations")}
    reason = F.when((given == "") | (surname == ""), "Missing required fields").otherwise("")
    return rows.select(SUB, given.alias("given_name"), surname.alias("surname"), customer.alias("customer_name"), *[v.alias(k) for k, v in out.items()],
                       F.concat_ws("\n", *[filled(n) for n in LEGACY_FIELDS["notes"]]).alias("notes"), valid.alias("generations"), reason.alias("reason"))


# Anchors ------------------------------------------------------------------------------------------------
def notes_anchors(rows: DataFrame, key: str, text: str = "notes") -> DataFrame:
    """Relatives named in free text: (key, slot, given, surname, dates, place). Whole texts, row by row."""
    told = rows.select(key, F.col(text).alias("_t"), N.relatives(F.col(text)).alias("_r")).where(F.size("_r") > 0)
    done = told.select(key, F.explode(F.transform("_r", lambda r: N.complete(F.col("_t"), r))).alias("_c"))
    return done.select(key, F.col("_c.slot").alias(SLOT), "_c.given", "_c.surname", "_c.birth_date", "_c.death_date", "_c.birth_place")


def anchors(flat: DataFrame, noted: DataFrame, stored: DataFrame) -> DataFrame:
    """Known people per slot: notes over form fields; what the tree already holds from the customer fills the rest."""
    f = flat.select(JOB, SLOT, F.lit(1).alias("rank"), "given", "surname", "birth_date", "death_date", "birth_place")
    n = noted.select(JOB, SLOT, F.lit(0).alias("rank"), "given", "surname", "birth_date", "death_date", "birth_place")
    s = stored.where((F.col("confidence_level") == "Customer Data") & (F.col(SLOT) >= 4)).select(
        JOB, SLOT, F.lit(2).alias("rank"), names.given_part(F.col("name")).alias("given"), names.surname_part(F.col("name")).alias("surname"), "birth_date", "death_date", "birth_place").where("given <> ''")
    every = n.unionByName(f).unionByName(s)
    best = first_row(every, [JOB, SLOT], [F.col("rank")])
    place = f.where("birth_place <> ''").select(JOB, SLOT, F.col("birth_place").alias("_p"))
    j = best.join(place, [JOB, SLOT], "left")
    return j.select(JOB, SLOT, "given", "surname", "birth_date", "death_date", F.when((F.col("rank") == 0) & (F.col("birth_place") == ""), F.coalesce("_p", F.lit(""))).otherwise(F.col("birth_place")).alias("birth_place"))


def customer_rows(known: DataFrame, subjects: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows for known people not stored yet. A blank place is the child's (from generation 3), else the subject's."""
    kid = known.select(JOB, F.col(SLOT).alias("_c"), F.col("birth_place").alias("_kp"))
    j = known.withColumn("_c", slots.child_of(F.col(SLOT))).join(kid, [JOB, "_c"], "left").join(subjects.select(JOB, F.col("birth_place").alias("_sp")), JOB, "left")
    from_child = F.when((F.col(SLOT) >= 8) & (F.coalesce("_kp", F.lit("")) != ""), F.col("_kp"))
    place = F.when(F.col("birth_place") != "", F.col("birth_place")).otherwise(F.coalesce(from_child, "_sp", F.lit("")))
    fresh = j.where("given <> ''").join(stored.select(JOB, SLOT), [JOB, SLOT], "left_anti")
    return fresh.select(JOB, SLOT, F.trim(F.concat_ws(" ", "given", "surname")).alias("name"), slots.expected_gender(F.col(SLOT)).alias("gender"), "birth_date", "death_date", place.alias("birth_place"),
                        *[F.lit(v).alias(k) for k, v in CUSTOMER.items()])
