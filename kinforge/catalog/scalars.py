"""Scalar rules applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.catalog import duck as D
from kinforge.catalog.base import query
from kinforge.functions import corrections as C
from kinforge.functions import dates, evidence, names, places, slots
from kinforge.functions import values as V
from kinforge.operators import gazetteer

c = F.col


@query("normalize_date", "fx_anc", sql=f"""
SELECT row_id, birth_date, {D.year('birth_date')} AS year,
  CAST(CASE WHEN regexp_full_match(birth_date, '\\d+/\\d+/\\d+') THEN TRY_CAST(split_part(birth_date, '/', 2) AS INT) ELSE {D.month('birth_date')} END AS INT) AS month,
  CASE WHEN regexp_full_match(birth_date, '\\d+/\\d+/\\d+') THEN TRY_CAST(split_part(birth_date, '/', 1) AS INT)
       WHEN regexp_full_match(birth_date, '\\d+ [A-Za-z]+ \\d+') THEN TRY_CAST(split_part(birth_date, ' ', 1) AS INT) END AS day
FROM fx_anc""")
def normalize_date(anc):
    d = dates.normalize_date(c("birth_date"))
    return anc.select("row_id", "birth_date", d.alias("d")).select("row_id", "birth_date", "d.year", "d.month", "d.day")


@query("extract_year", "fx_fact", sql=f"""
SELECT person_id, seq, TRY_CAST(regexp_extract(fact_date, '(\\d{{4}})', 1) AS INT) AS first4, {D.bounded_year('fact_date')} AS bounded,
  CASE WHEN fact_date = '' THEN NULL ELSE right(fact_date, 4) END AS word, CASE WHEN fact_date = '' THEN '' ELSE right(fact_date, 4) END AS display
FROM fx_fact""")
def extract_year(fact):
    return fact.select("person_id", "seq", *[dates.extract_year(c("fact_date"), m).alias(m) for m in ("first4", "bounded", "word", "display")])


@query("api_year", "fx_pair", sql=f"""
SELECT job_id, asc_no, rnk, CAST({D.year('anc_birth')} AS VARCHAR) AS api_year, abs({D.year('anc_birth')} - {D.year('cand_birth')}) AS year_diff FROM fx_pair""")
def api_year(pair):
    a, b = dates.date_year(c("anc_birth")), dates.date_year(c("cand_birth"))
    return pair.select("job_id", "asc_no", "rnk", a.cast("string").alias("api_year"), dates.year_diff(a, b).alias("year_diff"))


@query("normalize_name", "fx_anc", sql="""
SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(concat(given_name, ' Née  O''', surname, '-Ström'))), '\\bnee\\b\\s*', ''), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')) AS normal
FROM fx_anc""")
def normalize_name(anc):
    full = F.concat(c("given_name"), F.lit(" Née  O'"), c("surname"), F.lit("-Ström"))
    return anc.select("row_id", names.normalize_name(full).alias("normal"))


@query("parse_name", "fx_cand", sql="""
SELECT job_id, asc_no, rnk, CASE WHEN rnk = 5 THEN '' WHEN rnk = 6 THEN split_part(given_name, ' ', 1) ELSE given_name END AS given_name,
  CASE WHEN rnk = 5 OR rnk = 6 THEN '' ELSE surname END AS surname
FROM fx_cand""")
def parse_name(cand):
    full = (F.when(c("rnk") == 5, "Unknown").when(c("rnk") == 6, F.substring_index("given_name", " ", 1))
            .otherwise(F.concat_ws(" ", "given_name", "surname", F.when(c("rnk") % 2 == 0, "(not found)"))))
    return cand.select("job_id", "asc_no", "rnk", names.parse_name(full).alias("n")).select("job_id", "asc_no", "rnk", "n.*")


@query("parse_place", "fx_pair", sql=f"""
SELECT job_id, asc_no, rnk, list_filter(ps, lambda p: p NOT IN {D.in_list(V.CITED_COUNTIES)} AND p NOT IN {D.in_list(V.UK_COUNTRIES)} AND length(p) > 1)[1] AS town,
  list_filter(ps, lambda p: p IN {D.in_list(V.CITED_COUNTIES)})[-1] AS county, list_filter(ps, lambda p: p IN {D.in_list(V.UK_COUNTRIES)})[-1] AS country
FROM (SELECT job_id, asc_no, rnk, {D.parts("regexp_replace(lower(CASE WHEN rnk % 2 = 0 THEN cand_place ELSE anc_place END), '[^a-z\\s,]', '', 'g')")} AS ps FROM fx_pair) s""")
def parse_place(pair):
    place = F.when(c("rnk") % 2 == 0, c("cand_place")).otherwise(c("anc_place"))
    return pair.select("job_id", "asc_no", "rnk", places.parse_place(place).alias("p")).select("job_id", "asc_no", "rnk", "p.*")


def _messy_place(col):
    """A place with old spellings, another script and stray commas."""
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Belper, Deorbyscir", "Wæringscīr,, ", "Derby, Нэгдсэн Вант Улс", "Norfolk,  Англи, ", "道 Ely, Grantabrycgscir")]),
                                 (F.col("row_id") % 5 + 1).cast("int")), F.lit(", "), col)


@query("sanitize_place", "fx_anc", sql=f"""
SELECT row_id, array_to_string(list_filter(list_transform(string_split(tidy, ','), lambda p: coalesce({D.dict_map({'deorbyscir': 'Derbyshire', 'wæringscir': 'Warwickshire', 'grantabrycgscir': 'Cambridgeshire'})}[strip_accents(lower(trim(p)))], trim(p))), lambda p: p <> ''), ', ') AS place
FROM (SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        replace(replace(replace(raw, 'Нэгдсэн Вант Улс', 'United Kingdom'), 'Англи', 'England'), '道', ''), ',\\s*,', ',', 'g'), ',\\s*$', ''), '^\\s*,', ''), '\\s{{2,}}', ' ', 'g')) AS tidy
  FROM (SELECT row_id, concat(['Belper, Deorbyscir', 'Wæringscīr,, ', 'Derby, Нэгдсэн Вант Улс', 'Norfolk,  Англи, ', '道 Ely, Grantabrycgscir'][row_id % 5 + 1], ', ', birth_place) AS raw FROM fx_anc) r) t""")
def sanitize_place(anc):
    return anc.select("row_id", places.sanitize_place(_messy_place(c("birth_place"))).alias("place"))


@query("place_country", "fx_pair", sql=f"""
SELECT job_id, asc_no, rnk, {D.foreign('cand_place')} AS cand_foreign, {D.uk('cand_place')} AS cand_uk, {D.foreign('anc_place')} AS anc_foreign, {D.uk('anc_place')} AS anc_uk FROM fx_pair""")
def place_country(pair):
    return pair.select("job_id", "asc_no", "rnk",
                       places.looks_foreign(c("cand_place")).alias("cand_foreign"), places.looks_uk(c("cand_place")).alias("cand_uk"),
                       places.looks_foreign(c("anc_place")).alias("anc_foreign"), places.looks_uk(c("anc_place")).alias("anc_uk"))


@query("text_contains", "fx_pair", sql=f"""
SELECT job_id, asc_no, rnk,
  cand_place <> '' AND anc_place <> '' AND ({D.flat('cand_place')} = {D.flat('anc_place')} OR len(list_filter(string_split({D.flat('anc_place')}, ' '), lambda w: length(w) > 2 AND contains({D.flat('cand_place')}, w))) > 0) AS place_hit,
  contains(lower(cand_given || ' ' || cand_surname), lower(anc_given)) AND contains(lower(cand_given || ' ' || cand_surname), lower(anc_surname)) AS name_hit
FROM fx_pair""")
def text_contains(pair):
    cand, known = F.concat_ws(" ", "cand_given", "cand_surname"), F.concat_ws(" ", "anc_given", "anc_surname")
    return pair.select("job_id", "asc_no", "rnk", places.place_contains(c("cand_place"), c("anc_place")).alias("place_hit"),
                       names.name_contains(cand, known).alias("name_hit"))


@query("place_specificity", "fx_pair", sql=f"""
SELECT job_id, asc_no, rnk, CASE WHEN t1 = t2 THEN 'town' WHEN c1 = c2 THEN 'county' WHEN n1 = n2 THEN 'country' WHEN hit THEN 'partial' END AS level FROM (
SELECT job_id, asc_no, rnk,
  {', '.join(f"list_filter({ps}, lambda p: p NOT IN {D.in_list(V.CITED_COUNTIES)} AND p NOT IN {D.in_list(V.UK_COUNTRIES)} AND length(p) > 1)[1] AS t{i}, list_filter({ps}, lambda p: p IN {D.in_list(V.CITED_COUNTIES)})[-1] AS c{i}, list_filter({ps}, lambda p: p IN {D.in_list(V.UK_COUNTRIES)})[-1] AS n{i}"
              for i, ps in ((1, D.parts("regexp_replace(lower(cand_place), '[^a-z\\s,]', '', 'g')")), (2, D.parts("regexp_replace(lower(anc_place), '[^a-z\\s,]', '', 'g')"))))},
  cand_place <> '' AND anc_place <> '' AND len(list_filter(string_split({D.flat('anc_place')}, ' '), lambda w: length(w) > 2 AND contains({D.flat('cand_place')}, w))) > 0 AS hit
FROM fx_pair) s""")
def place_specificity(pair):
    return pair.select("job_id", "asc_no", "rnk", places.place_specificity(c("cand_place"), c("anc_place")).alias("level"))


@query("common_surname", "fx_cand", sql=f"SELECT job_id, asc_no, rnk, surname, {D.common('surname')} AS is_common FROM fx_cand")
def common_surname(cand):
    return cand.select("job_id", "asc_no", "rnk", "surname", names.is_common_surname(c("surname")).alias("is_common"))


_FAMILY = ["|".join(p) for k, vs in V.name_variants().items() for p in [(k, v) for v in vs]]


@query("name_variants", "fx_pair", sql=f"""
SELECT job_id, asc_no, rnk, coalesce(array_to_string({D.dict_map(V.name_variants())}[lower(anc_given)], ' '), '') AS variants,
  {D.first_word('cand_given')} = lower(anc_given) OR concat({D.first_word('anc_given')}, '|', {D.first_word('cand_given')}) IN {D.in_list(_FAMILY)} AS is_variant
FROM fx_pair""")
def name_variants(pair):
    return pair.select("job_id", "asc_no", "rnk", F.array_join(names.given_name_variants(c("anc_given")), " ").alias("variants"),
                       names.is_name_variant(c("anc_given"), c("cand_given")).alias("is_variant"))


@query("names_similar", "fx_pair", sql=f"SELECT job_id, asc_no, rnk, {D.similar('cand_given', 'anc_given')} AS similar_names FROM fx_pair")
def names_similar(pair):
    return pair.select("job_id", "asc_no", "rnk", names.names_similar(c("cand_given"), c("anc_given")).alias("similar_names"))


@query("prefix_similar", "fx_pair", sql="""
SELECT job_id, asc_no, rnk, starts_with(lower(cand_given), lower(anc_given)) OR starts_with(lower(anc_given), lower(cand_given))
  OR (length(cand_given) >= 3 AND length(anc_given) >= 3 AND lower(left(cand_given, 3)) = lower(left(anc_given, 3))) AS similar_prefix FROM fx_pair""")
def prefix_similar(pair):
    return pair.select("job_id", "asc_no", "rnk", names.prefix_similar(c("cand_given"), c("anc_given")).alias("similar_prefix"))


def _variant_sql(s: str) -> str:
    """Each spelling rule as a plain replacement; the lone-t rule by listing what precedes and follows."""
    out = []
    for rule, to in names.SPELLING_RULES:
        if rule == "(?<!t)t(?!h)":
            out.append(f"regexp_replace({s}, '^(|.*?[^t])t([^h]|$)', '\\1th\\2')")
        else:
            out.append(f"regexp_replace({s}, '{rule}', '{to}')")
    return "[" + ", ".join(out) + "]"


@query("surname_variants", "fx_anc", sql=f"""
SELECT DISTINCT surname, upper(left(v, 1)) || substr(v, 2) AS variant FROM (
  SELECT surname, lower(surname) AS s, unnest({_variant_sql('lower(surname)')}) AS v FROM (SELECT DISTINCT surname FROM fx_anc) d) u
WHERE v <> s AND length(v) > 2""")
def surname_variants(anc):
    return anc.select("surname").distinct().select("surname", F.explode(names.surname_variants(c("surname"))).alias("variant")).distinct()


@query("district_of", "fx_anc", sql=f"SELECT row_id, {D.district('birth_place')} AS district FROM fx_anc")
def district_of(anc):
    return anc.select("row_id", places.district_of(c("birth_place")).alias("district"))


@query("resolve_county", "fx_pair", "fx_town", sql=f"SELECT job_id, asc_no, rnk, {D.county('anc_place')} AS anc_county, {D.county('cand_place')} AS cand_county FROM fx_pair")
def resolve_county(pair, town):
    names = gazetteer.gazetteer_table(town.sparkSession, town)
    both = gazetteer.lookup_counties(gazetteer.lookup_counties(pair, "anc_place", names, "anc_county"), "cand_place", names, "cand_county")
    return both.select("job_id", "asc_no", "rnk", "anc_county", "cand_county")


@query("county_proximity", "fx_pair", "fx_town", sql=f"""
SELECT job_id, asc_no, rnk, {D.proximity('c1', 'c2')} AS proximity FROM (
  SELECT job_id, asc_no, rnk, {D.county('cand_place')} AS c1, {D.county('anc_place')} AS c2 FROM fx_pair) s""")
def county_proximity(pair, town):
    dimension = gazetteer.place_dimension(gazetteer.all_places((pair, "anc_place"), (pair, "cand_place")), gazetteer.gazetteer_table(town.sparkSession, town))
    both = gazetteer.with_place(gazetteer.with_place(pair, dimension, "anc_place", a="seat"), dimension, "cand_place", b="seat")
    return both.select("job_id", "asc_no", "rnk", gazetteer.proximity(c("b"), c("a")).alias("proximity"))


@query("district_match", "fx_civil", sql=f"""
SELECT entry_id, district, {D.district_match("'Derby'", 'district')} AS near_derby, {D.district_match('district', "'Basford'")} AS basford_near FROM fx_civil""")
def district_match(civil):
    return civil.select("entry_id", "district", places.district_match(F.lit("Derby"), c("district")).alias("near_derby"),
                        places.district_match(c("district"), F.lit("Basford")).alias("basford_near"))


@query("slot_algebra", "fx_anc", sql="""
SELECT row_id, asc_no, asc_no // 2 AS child, asc_no * 2 AS father, asc_no * 2 + 1 AS mother, CASE WHEN asc_no > 1 THEN asc_no + 1 - 2 * (asc_no % 2) END AS spouse,
  CAST(floor(log2(asc_no)) AS INT) AS generation, CASE WHEN asc_no = 1 THEN NULL WHEN asc_no % 2 = 0 THEN 'Male' ELSE 'Female' END AS expected_gender,
  substr(bin(asc_no), 2, 1) = '0' AS paternal
FROM fx_anc""")
def slot_algebra(anc):
    a = c("asc_no")
    return anc.select("row_id", "asc_no", slots.child_of(a).alias("child"), slots.father_of(a).alias("father"), slots.mother_of(a).alias("mother"),
                      slots.spouse_of(a).alias("spouse"), slots.generation(a).alias("generation"),
                      slots.expected_gender(a).alias("expected_gender"), slots.is_paternal(a).alias("paternal"))


@query("slot_role", "fx_anc", sql=f"""
SELECT row_id, asc_no, {D.role('asc_no')} AS role,
  CASE asc_no WHEN 1 THEN 'Subject' WHEN 2 THEN 'Father' WHEN 3 THEN 'Mother' ELSE
    CASE WHEN substr(bin(asc_no), 2, 1) = '0' THEN 'Pat. ' ELSE 'Mat. ' END || CASE gen WHEN 2 THEN '' WHEN 3 THEN 'Gr-' ELSE CAST(gen - 2 AS VARCHAR) || 'x Gr-' END || CASE WHEN asc_no % 2 = 0 THEN 'Grandfather' ELSE 'Grandmother' END END AS card_role
FROM fx_anc""")
def slot_role(anc):
    return anc.select("row_id", "asc_no", slots.slot_role(c("asc_no")).alias("role"), slots.slot_card_role(c("asc_no")).alias("card_role"))


@query("confidence_level", "fx_anc", sql=f"""
SELECT row_id, {D.level('confidence_score')} AS level,
  CASE WHEN confidence_level = 'Customer Data' THEN 'customer_data' WHEN confidence_score >= 90 THEN 'verified' WHEN confidence_score >= 75 THEN 'probable'
       WHEN confidence_score >= 50 THEN 'possible' WHEN confidence_score > 0 OR person_id <> '' THEN 'suggested' ELSE 'empty' END AS colour,
  CASE WHEN confidence_score < 50 THEN 'Suggested' ELSE {D.level('confidence_score')} END AS candidate_level
FROM fx_anc""")
def confidence_level(anc):
    s = c("confidence_score")
    return anc.select("row_id", evidence.confidence_level(s).alias("level"), evidence.card_colour(s, c("confidence_level"), c("person_id")).alias("colour"),
                      evidence.candidate_level(s).alias("candidate_level"))


@query("confidence_from_points", "fx_anc", sql=f"SELECT row_id, CAST({D.from_points('confidence_score - 20')} AS INT) AS confidence FROM fx_anc")
def confidence_from_points(anc):
    return anc.select("row_id", evidence.confidence_from_points(c("confidence_score") - 20).alias("confidence"))


@query("classify_source", "fx_src", sql=f"""
SELECT person_id, seq, category, key, CASE WHEN category = 'Civil Registration' THEN substr(key, 7) WHEN category = 'Census' THEN substr(key, 8) WHEN category = '1939 Register' THEN '1939'
  WHEN category = 'Parish Register' THEN 'parish' ELSE lower(category) END AS sub_type
FROM (SELECT person_id, seq, {D.category('title')} AS category, {D.source_key('title')} AS key FROM fx_src) s""")
def classify_source(src):
    return src.select("person_id", "seq", evidence.classify_source(c("title")).alias("k")).select("person_id", "seq", "k.*")


@query("format_names", "fx_pair", sql="""
SELECT job_id, asc_no, rnk, cand_given || ' /' || cand_surname || '/' AS slashed, cand_given || ' ' || upper(cand_surname) AS upper_surname,
  trim(cand_given || ' ' || anc_given || ' ' || cand_surname) AS full_name, CASE WHEN cand_birth = '' THEN '(unknown)' ELSE '(' || cand_birth || ')' END AS years,
  CASE WHEN anc_place IN ('Derby, Derbyshire, England') THEN 'Derby, Derbyshire' WHEN anc_place = 'Kensington, Middlesex, England' THEN 'Kensington, Middlesex' ELSE anc_place END AS short_place,
  CASE WHEN cand_birth = '' THEN '' ELSE upper('abt ' || cand_birth) END AS tree_date, regexp_replace(cand_place, '[^a-zA-Z0-9 ]', '', 'g') AS slug
FROM fx_pair""")
def format_names(pair):
    cand = F.concat_ws(" ", "cand_given", "cand_surname")
    return pair.select(
        "job_id", "asc_no", "rnk", names.slashed_name(cand).alias("slashed"), names.surname_upper(cand).alias("upper_surname"),
        names.full_name(c("cand_given"), c("anc_given"), c("cand_surname")).alias("full_name"),
        names.year_range(F.lit(""), c("cand_birth"), F.lit("")).alias("years"), places.short_place(c("anc_place")).alias("short_place"),
        F.when(c("cand_birth") == "", "").otherwise(F.upper(F.concat(F.lit("abt "), c("cand_birth")))).alias("tree_date"),
        names.slug(c("cand_place")).alias("slug"))


@query("entry_text", "fx_civil", sql="""
SELECT entry_id, upper(left(entry_type, 1)) || substr(entry_type, 2) || ' — ' || forenames || ' ' || surname || CASE WHEN spouse_surname <> '' THEN ' — married ' || spouse_surname ELSE '' END
  || ' — ' || CAST(year AS VARCHAR) || ' — Q' || quarter || ' — ' || district AS entry FROM fx_civil""")
def entry_text(civil):
    return civil.select("entry_id", names.entry_text(c("entry_type"), c("forenames"), c("surname"), c("spouse_surname"), c("year"), c("quarter"), c("district")).alias("entry"))


@query("parse_correction", "fx_flag", sql=f"SELECT job_id, asc_no, reviewer, pos, {D.correction_field('suggestion')} AS field, {D.correction_value('suggestion')} AS value FROM fx_flag")
def parse_correction(flag):
    p = C.parse_correction(c("suggestion"))
    return flag.select("job_id", "asc_no", "reviewer", "pos", p["field"].alias("field"), p["value"].alias("value"))


@query("corrections_agree", "fx_review", sql=f"""
SELECT job_id, asc_no, {D.corrections_agree('fix_a', 'fix_b')} AS agree, coalesce({D.bounded_year('fix_a')} = 1840 + adj_a % 5 * 28, false) AS civil_agrees FROM fx_review""")
def corrections_agree(review):
    return review.select("job_id", "asc_no", C.corrections_agree(c("fix_a"), c("fix_b")).alias("agree"),
                         C.civil_confirms(c("fix_a"), F.lit(1840) + c("adj_a") % 5 * 28, F.lit(None).cast("int")).alias("civil_agrees"))


@query("json_safe", "fx_intake", sql="""
SELECT submission_id, coalesce(json_extract_string(j, '$.customer_full_name'), '') AS customer_name, j IS NOT NULL AS readable
FROM (SELECT submission_id, TRY_CAST(CASE WHEN submission_id % 7 = 0 THEN '{broken' || raw_request ELSE raw_request END AS JSON) AS j FROM fx_intake) s""")
def json_safe(intake):
    raw = F.when(c("submission_id") % 7 == 0, F.concat(F.lit("{broken"), c("raw_request"))).otherwise(c("raw_request"))
    v = F.try_parse_json(raw)
    return intake.select("submission_id", F.coalesce(F.try_variant_get(v, "$.customer_full_name", "string"), F.lit("")).alias("customer_name"),
                         v.isNotNull().alias("readable"))


@query("slim_view", "fx_anc", sql="""
SELECT job_id, asc_no AS slot, name AS full_name, substr(birth_date, length(birth_date) - 3) AS born, confidence_score AS score FROM fx_anc""")
def slim_view(anc):
    return anc.select("job_id", c("asc_no").alias("slot"), c("name").alias("full_name"), F.regexp_extract("birth_date", r"\d{4}", 0).alias("born"),
                      c("confidence_score").alias("score"))
