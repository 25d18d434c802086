"""Sources, tables and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinforge.catalog import duck as D
from kinforge.catalog.base import query
from kinforge.plans import reports
from kinforge.session import shared_dir
from kinforge.sources import registry, tables, tree_api

c = F.col


def _search_responses(anc):
    """A nested search response for every slot, carrying its recorded parents."""
    from kinforge.operators.tree import with_parents

    both = with_parents(anc.where("person_id <> ''").select("job_id", "asc_no", "person_id", "name", "gender", "birth_date", "birth_place"), ["person_id", "name"])

    def person(pid, name, gender):
        return F.when(F.coalesce(pid, F.lit("")) != "", F.struct(pid.alias("id"), F.struct(name.alias("name"), gender.alias("gender")).alias("display")))

    def rel(pid):
        return F.when(F.coalesce(pid, F.lit("")) != "", F.struct(F.lit(tree_api.PARENT_CHILD).alias("type"), F.struct(pid.alias("resourceId")).alias("person1"), F.struct(c("person_id").alias("resourceId")).alias("person2")))

    me = F.struct(c("person_id").alias("id"), F.struct("name", "gender", c("birth_date").alias("birthDate"), c("birth_place").alias("birthPlace")).alias("display"))
    others = F.array_compact(F.array(person(c("father_person_id"), c("father_name"), F.lit("Male")), person(c("mother_person_id"), c("mother_name"), F.lit("Female"))))
    response = F.to_json(F.struct(
        (c("asc_no") * 0.5).alias("score"),
        F.concat(F.array(me.cast("struct<id:string,display:struct<name:string,gender:string,birthDate:string,birthPlace:string>>")),
                 F.transform(others, lambda o: F.struct(o["id"].alias("id"), F.struct(o["display"]["name"].alias("name"), o["display"]["gender"].alias("gender"), F.lit("").alias("birthDate"), F.lit("").alias("birthPlace")).alias("display")))).alias("persons"),
        F.array_compact(F.array(rel(c("father_person_id")), rel(c("mother_person_id")))).alias("relationships")))
    return both.select("job_id", "asc_no", response.alias("response"))


@query("tree_search_flatten", "fx_anc", sql="""
SELECT a.job_id, a.asc_no, a.person_id, a.name, a.gender, a.birth_date, a.birth_place, CAST(a.asc_no * 0.5 AS DOUBLE) AS score, coalesce(f.person_id, '') AS father_id, coalesce(f.name, '') AS father_name,
  coalesce(m.person_id, '') AS mother_id, coalesce(m.name, '') AS mother_name
FROM fx_anc a LEFT JOIN fx_anc f ON f.job_id = a.job_id AND f.asc_no = 2 * a.asc_no AND f.person_id <> '' LEFT JOIN fx_anc m ON m.job_id = a.job_id AND m.asc_no = 2 * a.asc_no + 1 AND m.person_id <> '' WHERE a.person_id <> ''""")
def tree_search_flatten(anc):
    return tree_api.flatten_search(_search_responses(anc))


@query("tree_parents", "fx_edge", sql="""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY job_id, dst, src_gender ORDER BY kind <> 'Biological', ord) AS n FROM fx_edge WHERE rel = 'ParentChild')
SELECT job_id, dst AS child_id, max(CASE WHEN src_gender = 'Male' AND n = 1 THEN src END) AS father_id, max(CASE WHEN src_gender = 'Female' AND n = 1 THEN src END) AS mother_id FROM e GROUP BY 1, 2""")
def tree_parents(edge):
    return tree_api.parents(edge)


@query("tree_spouses", "fx_edge", "fx_anc", sql="""
WITH b AS (SELECT job_id, src AS person_id, dst AS spouse_id, marriage_date FROM fx_edge WHERE rel = 'Couple' UNION ALL SELECT job_id, dst, src, marriage_date FROM fx_edge WHERE rel = 'Couple')
SELECT b.*, a.name AS spouse_name, a.gender AS spouse_gender FROM b JOIN fx_anc a ON a.job_id = b.job_id AND a.person_id = b.spouse_id""")
def tree_spouses(edge, anc):
    return tree_api.spouses(edge, anc)


_DESC = "d AS (SELECT person_id, 'SD' || CAST(seq AS VARCHAR) AS desc_id, title, url, seq FROM fx_src), r AS (SELECT person_id, 'SD' || CAST(seq + CASE WHEN seq = 3 THEN 100 ELSE 0 END AS VARCHAR) AS desc_id FROM fx_src WHERE seq % 2 = 1 AND CAST(substr(person_id, 2) AS BIGINT) % 3 <> 0)"


@query("person_sources", "fx_src", sql=f"""WITH {_DESC}
SELECT r.person_id, r.desc_id, coalesce(d.title, r.desc_id) AS title, coalesce(d.url, '') AS url FROM r LEFT JOIN d ON d.person_id = r.person_id AND d.desc_id = r.desc_id
UNION ALL SELECT person_id, desc_id, title, url FROM d WHERE person_id NOT IN (SELECT person_id FROM r)""")
def person_sources(src):
    desc = src.withColumn("desc_id", F.concat(F.lit("SD"), c("seq").cast("string")))
    refs = src.where((c("seq") % 2 == 1) & (F.substring("person_id", 2, 20).cast("bigint") % 3 != 0)).select(
        "person_id", F.concat(F.lit("SD"), (c("seq") + F.when(c("seq") == 3, 100).otherwise(0)).cast("string")).alias("desc_id"))
    return tree_api.person_sources(refs, desc)


@query("facts_by_type", "fx_fact", sql="""
SELECT person_id, seq, CASE split_part(fact_type, '/', -1) WHEN 'Birth' THEN 'birth' WHEN 'Christening' THEN 'birth' WHEN 'Death' THEN 'death' WHEN 'Marriage' THEN 'marriage' WHEN 'Residence' THEN 'residence'
  WHEN 'Census' THEN 'census' WHEN 'Burial' THEN 'burial' ELSE 'other' END AS bucket, TRY_CAST(right(fact_date, 4) AS INT) AS year, fact_place FROM fx_fact""")
def facts_by_type(fact):
    return tree_api.facts_by_type(fact)


@query("person_lookup", "fx_anc", "fx_edge", sql="SELECT job_id, asc_no, person_id, name FROM fx_anc WHERE person_id IN (SELECT src FROM fx_edge WHERE rel = 'Couple')")
def person_lookup(anc, edge):
    return tree_api.person_lookup(anc, edge.where("rel = 'Couple'").select(c("src").alias("person_id"))).select("job_id", "asc_no", "person_id", "name")


def _profiles(anc):
    y = F.regexp_extract("birth_date", r"(\d{4})", 1).try_cast("int")
    day = F.when(c("row_id") % 3 == 0, 1)
    month = F.when(c("row_id") % 3 < 2, 9)
    county = F.when(c("row_id") % 2 == 0, "Derby")
    return anc.where("person_id <> ''").select(
        "job_id", "asc_no", "person_id", c("given_name").alias("first_name"), F.when(c("row_id") % 4 == 1, "Herbert").otherwise("").alias("middle_name"), c("surname").alias("last_name"), F.lit("").alias("maiden_name"),
        F.when(c("gender") == "Male", "m").otherwise(F.lower("gender")).alias("gender"),
        F.struct(y.alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"), F.lit("Derby").alias("city"), county.alias("state"), F.lit("England").alias("country")).alias("birth"))


_PROFILE_SQL = """SELECT job_id, asc_no, person_id, given_name || CASE WHEN row_id % 4 = 1 THEN ' Herbert' ELSE '' END || ' ' || surname AS name, gender,
  CASE WHEN y = '' THEN '' WHEN row_id % 3 = 0 THEN '01/09/' || y WHEN row_id % 3 = 1 THEN '09/' || y ELSE y END AS birth_date, TRY_CAST(y AS INT) AS birth_year, 'Derby, England' AS birth_place, 'profiles' AS source
FROM (SELECT *, regexp_extract(birth_date, '(\\d{4})', 1) AS y FROM fx_anc WHERE person_id <> '') s"""


@query("profile_normalise", "fx_anc", sql=_PROFILE_SQL)
def profile_normalise(anc):
    return tree_api.normalise_profiles(_profiles(anc))


@query("profile_search", "fx_anc", sql=f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY asc_no) AS rank FROM ({_PROFILE_SQL}) p) q WHERE rank <= 10")
def profile_search(anc):
    return tree_api.profile_search(_profiles(anc), ["job_id"], c("asc_no"))


_UNION_SQL = """pr AS (SELECT union_id, arg_min(node_id, CAST(substr(node_id, 2) AS BIGINT)) FILTER (WHERE gender = 'Male') AS f, arg_min(node_id, CAST(substr(node_id, 2) AS BIGINT)) FILTER (WHERE gender = 'Female') AS m FROM fx_union WHERE role = 'partner' GROUP BY 1),
pm AS (SELECT k.node_id AS child_id, arg_max(pr.f, k.union_id) FILTER (WHERE pr.f IS NOT NULL) AS father_id, arg_max(pr.m, k.union_id) FILTER (WHERE pr.m IS NOT NULL) AS mother_id FROM fx_union k JOIN pr ON pr.union_id = k.union_id AND k.role = 'child' GROUP BY 1)"""


@query("union_parent_map", "fx_union", sql=f"WITH {_UNION_SQL} SELECT * FROM pm")
def union_parent_map(unions):
    return tree_api.union_parents(unions)


@query("profile_parents", "fx_union", "fx_anc", sql=f"""WITH {_UNION_SQL}
SELECT child_id, 'father' AS side, a.person_id, a.name FROM pm JOIN fx_anc a ON a.person_id = pm.father_id UNION ALL SELECT child_id, 'mother', a.person_id, a.name FROM pm JOIN fx_anc a ON a.person_id = pm.mother_id""")
def profile_parents(unions, anc):
    return tree_api.profile_parents(unions, anc.where("person_id <> ''"))


@query("ancestors_walk", "fx_union", "fx_anc", sql=f"""WITH RECURSIVE {_UNION_SQL}, up AS (SELECT child_id, father_id AS parent_id FROM pm WHERE father_id IS NOT NULL UNION ALL SELECT child_id, mother_id FROM pm WHERE mother_id IS NOT NULL),
w AS (SELECT person_id AS root_id, person_id, 0 AS depth FROM fx_anc WHERE asc_no = 1 AND person_id <> '' UNION ALL SELECT w.root_id, up.parent_id, w.depth + 1 FROM w JOIN up ON up.child_id = w.person_id)
SELECT root_id, person_id, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1, 2""")
def ancestors_walk(unions, anc):
    start = anc.where("asc_no = 1 and person_id <> ''").select(c("person_id").alias("root_id"))
    return tree_api.ancestors_walk(start, tree_api.union_parents(unions))


@query("source_union", "fx_cand", "fx_anc", "fx_civil", sql="""
SELECT person_id, given_name || ' ' || surname AS name, gender, birth_date, birth_place, 'tree' AS source FROM fx_cand UNION ALL SELECT person_id, name, gender, birth_date, birth_place, 'profiles' FROM fx_anc WHERE person_id <> ''
UNION ALL SELECT 'B' || CAST(entry_id AS VARCHAR), forenames || ' ' || surname, '', CAST(year AS VARCHAR), district, 'civil' FROM fx_civil WHERE entry_type = 'birth'""")
def source_union(cand, anc, civil):
    return registry.source_union({"tree": cand, "profiles": anc, "civil": civil})


@query("jobs_list", "fx_job", sql="SELECT job_id, customer_name, status, created_on FROM fx_job ORDER BY created_on DESC, job_id DESC LIMIT 50 OFFSET 5")
def jobs_list(jobs):
    return tables.jobs_page(jobs.select("job_id", "customer_name", "status", "created_on"), 50, 5)


@query("table_reads", "fx_cand", "fx_anc", stored=False, sql="""
SELECT a.job_id, a.asc_no, a.name, c.person_id, c.rnk, CASE WHEN c.rnk % 4 = 0 THEN '' ELSE c.birth_place END AS shown_place FROM fx_anc a JOIN fx_cand c ON c.job_id = a.job_id AND c.asc_no = a.asc_no""")
def table_reads(cand, anc):
    raw = F.when(c("rnk") % 4 == 0, "{not json").otherwise(F.to_json(F.struct(F.struct(c("birth_place").alias("birthPlace")).alias("display"))))
    got = cand.withColumn("raw_data", raw).select("job_id", "asc_no", "person_id", "rnk", tables.json_field(c("raw_data"), "$.display.birthPlace").alias("shown_place"))
    return anc.select("job_id", "asc_no", "name").join(got, ["job_id", "asc_no"]).sortWithinPartitions("job_id", "asc_no", "rnk")


@query("appends", "fx_cand", sql="""
SELECT job_id, asc_no, person_id, rejection_reason, 1 AS search_pass, 0 AS selected, '{}' AS raw_data, 'tree' AS source_origin FROM fx_cand UNION ALL
SELECT job_id, asc_no, person_id, '' AS rejection_reason, 2, 0, '{}', 'tree' FROM fx_cand WHERE rnk = 1""")
def appends(cand):
    path = f"{shared_dir(cand.sparkSession)}/candidates-{uuid.uuid4().hex}"
    tables.append(cand.select("job_id", "asc_no", "person_id", "rejection_reason"), path, tables.CANDIDATE_DEFAULTS)
    second = cand.where("rnk = 1").select("job_id", "asc_no", "person_id", F.lit(None).cast("string").alias("rejection_reason"), F.lit(2).alias("search_pass"))
    tables.append(second, path, tables.CANDIDATE_DEFAULTS)
    return cand.sparkSession.read.parquet(path)


@query("schema_evolve", "fx_anc", sql="""
SELECT row_id, name, CASE WHEN row_id % 2 = 0 THEN 'Unknown' ELSE confidence_level END AS confidence_level, CASE WHEN row_id % 2 = 0 THEN 0 ELSE confidence_score END AS confidence_score, CASE WHEN row_id % 2 = 0 THEN '[]' ELSE NULL END AS missing_info FROM fx_anc""")
def schema_evolve(anc):
    old = anc.where("row_id % 2 = 0").select("row_id", "name")
    new = anc.where("row_id % 2 = 1").select("row_id", "name", "confidence_level", "confidence_score", F.lit(None).cast("string").alias("missing_info"))
    return tables.evolve(old, new, {"confidence_level": "Unknown", "confidence_score": 0, "missing_info": "[]"})


_SHOWN = "sh AS (SELECT * FROM fx_anc WHERE confidence_score >= 50), ns AS (SELECT s.job_id, s.asc_no, count(*) AS n FROM sh s JOIN fx_src r ON r.person_id = s.person_id AND s.person_id <> '' GROUP BY 1, 2)"


def _head_sql() -> str:
    rows = ", ".join(f"({i}, {D.q(h)})" for i, h in enumerate(reports.HEADER))
    return f"SELECT j.job_id, 0 AS section, 0 AS asc_no, v.i AS line_no, v.t AS line FROM fx_job j CROSS JOIN (VALUES {rows}) v(i, t) UNION ALL SELECT job_id, 0, 0, {len(reports.HEADER)}, '1 FILE ' || customer_name || '.ged' FROM fx_job"


@query("export_tree_text", "fx_anc", "fx_job", "fx_src", sql=f"""WITH {_SHOWN},
ln AS (SELECT s.job_id, 1 AS section, s.asc_no, list_filter(list_concat(['0 @I' || s.asc_no || '@ INDI', '1 NAME ' || s.given_name || ' /' || s.surname || '/', '1 SEX ' || CASE s.gender WHEN 'Male' THEN 'M' WHEN 'Female' THEN 'F' ELSE 'U' END,
    CASE WHEN s.birth_date <> '' OR s.birth_place <> '' THEN '1 BIRT' END, CASE WHEN s.birth_date <> '' THEN '2 DATE ' || upper(s.birth_date) END, CASE WHEN s.birth_place <> '' THEN '2 PLAC ' || s.birth_place END,
    CASE WHEN s.death_date <> '' THEN '1 DEAT' END, CASE WHEN s.death_date <> '' THEN '2 DATE ' || upper(s.death_date) END,
    '1 NOTE Confidence: ' || s.confidence_score || '% (' || s.confidence_level || ') — ' || coalesce(ns.n, 0) || ' source(s)'],
    list_transform(range(coalesce(ns.n, 0)), lambda i: '1 SOUR @S' || s.asc_no || '_' || i || '@'),
    [CASE WHEN s.asc_no > 1 THEN '1 FAMS @F' || (s.asc_no - s.asc_no % 2) || '_' || (s.asc_no - s.asc_no % 2 + 1) || '@' END, CASE WHEN EXISTS (SELECT 1 FROM sh p WHERE p.job_id = s.job_id AND p.asc_no IN (2 * s.asc_no, 2 * s.asc_no + 1)) THEN '1 FAMC @F' || (2 * s.asc_no) || '_' || (2 * s.asc_no + 1) || '@' END]), lambda x: x IS NOT NULL) AS ls
  FROM sh s LEFT JOIN ns ON ns.job_id = s.job_id AND ns.asc_no = s.asc_no),
fm AS (SELECT job_id, asc_no - asc_no % 2 AS lo, bool_or(asc_no % 2 = 0) AS h, bool_or(asc_no % 2 = 1) AS w FROM sh WHERE asc_no > 1 GROUP BY 1, 2),
fl AS (SELECT f.job_id, 2 AS section, f.lo AS asc_no, list_filter(['0 @F' || lo || '_' || (lo + 1) || '@ FAM', CASE WHEN h THEN '1 HUSB @I' || lo || '@' END, CASE WHEN w THEN '1 WIFE @I' || (lo + 1) || '@' END, CASE WHEN EXISTS (SELECT 1 FROM sh k WHERE k.job_id = f.job_id AND k.asc_no = f.lo // 2) THEN '1 CHIL @I' || (lo // 2) || '@' END], lambda x: x IS NOT NULL) AS ls FROM fm f),
sl AS (SELECT s.job_id, 3 AS section, s.asc_no, r.seq, list_filter(['0 @S' || s.asc_no || '_' || (r.seq - 1) || '@ SOUR', CASE WHEN r.title <> '' THEN '1 TITL ' || r.title END, CASE WHEN r.citation <> '' THEN '1 TEXT ' || r.citation END, '1 _URL ' || r.url], lambda x: x IS NOT NULL) AS ls FROM sh s JOIN fx_src r ON r.person_id = s.person_id AND s.person_id <> '')
{_head_sql()}
UNION ALL SELECT job_id, section, asc_no, generate_subscripts(ls, 1) - 1, unnest(ls) FROM ln UNION ALL SELECT job_id, section, asc_no, generate_subscripts(ls, 1) - 1, unnest(ls) FROM fl
UNION ALL SELECT job_id, section, asc_no, seq * 10 + generate_subscripts(ls, 1) - 1, unnest(ls) FROM sl UNION ALL SELECT job_id, 9, 0, 0, '0 TRLR' FROM fx_job""")
def export_tree_text(anc, jobs, src):
    return reports.export_lines(anc, jobs, src)


@query("fan_layout", "fx_anc", sql="""
WITH s AS (SELECT *, 360.0 / pow(2, gen) AS w FROM fx_anc WHERE confidence_score >= 50 OR confidence_level = 'Customer Data')
SELECT job_id, asc_no, gen AS ring, 90 + (asc_no - pow(2, gen)) * w AS start_angle, 90 + (asc_no - pow(2, gen) + 1) * w AS end_angle, 90 + (asc_no - pow(2, gen) + 0.5) * w AS mid_angle, substr(bin(asc_no), 2, 1) = '0' AS paternal,
  CASE birth_place WHEN 'Derby, Derbyshire, England' THEN 'Derby, Derbyshire' WHEN 'Kensington, Middlesex, England' THEN 'Kensington, Middlesex' ELSE birth_place END AS short_place,
  CASE WHEN birth_date = '' AND death_date = '' THEN '' WHEN birth_date = '' THEN 'd.' || death_date WHEN death_date = '' THEN 'b.' || right(birth_date, 4) ELSE 'b.' || right(birth_date, 4) || ' – d.' || death_date END AS dates FROM s""")
def fan_layout(anc):
    return reports.fan_layout(anc)


@query("job_stats", "fx_job", sql="SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running FROM fx_job")
def job_stats(jobs):
    return reports.job_stats(jobs)


@query("feedback_stats", "fx_feedback", sql="""
SELECT count(*) AS total, count(*) FILTER (WHERE action_type = 'accept') AS accepts, count(*) FILTER (WHERE action_type = 'reject') AS rejects, count(*) FILTER (WHERE action_type = 'correct') AS corrections, count(*) FILTER (WHERE action_type = 'select_alternative') AS alternatives FROM fx_feedback""")
def feedback_stats(feedback):
    return reports.feedback_stats(feedback)


@query("jobs_with_counts", "fx_job", "fx_anc", sql="""
SELECT j.job_id, j.customer_name, j.status, count(a.asc_no) AS filled, count(*) FILTER (WHERE a.confidence_level = 'Customer Data') AS given FROM fx_job j LEFT JOIN fx_anc a ON a.job_id = j.job_id GROUP BY 1, 2, 3""")
def jobs_with_counts(jobs, anc):
    return reports.jobs_with_counts(jobs, anc)


@query("candidate_summary", "fx_cand", sql="""
SELECT job_id, asc_no, bool_or(rnk = 1 AND rejection_reason = '') AS any_selected, count(*) FILTER (WHERE NOT (rnk = 1 AND rejection_reason = '')) AS unselected, count(*) FILTER (WHERE rejection_reason <> '') AS rejected FROM fx_cand GROUP BY 1, 2""")
def candidate_summary(cand):
    return reports.candidate_summary(cand)
