"""Submissions, notes, anchors, and the two continuous jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinforge.catalog import duck as D
from kinforge.catalog.base import query
from kinforge.plans import intake as ops
from kinforge.session import shared_dir
from kinforge.streaming import jobs as streams

c = F.col


def _fields(intake):
    top = F.create_map(F.lit("user_role"), F.when(c("submission_id") % 9 == 0, "Dad").otherwise(""), F.lit("form_id"), F.lit("F1"), F.lit("known_moves"), F.when(c("submission_id") % 8 == 3, "Derby to Leeds"))
    return ops.payload_fields(intake.withColumn("top", top))


_J = """j AS (SELECT submission_id AS sid, CAST(raw_request AS JSON) AS js, CASE WHEN submission_id % 9 = 0 THEN 'Dad' ELSE json_extract_string(raw_request, '$.user_role') END AS role, CASE WHEN submission_id % 8 = 3 THEN 'Derby to Leeds' ELSE '' END AS moves FROM fx_intake),
pa AS (SELECT *, CASE WHEN json_extract_string(js, '$.has_children') <> 'Yes' THEN 'root' WHEN role = 'Dad' THEN 'dad' ELSE 'mum' END AS path FROM j)"""


def _f(name: str) -> str:
    return f"coalesce(json_extract_string(js, '$.{name}'), '')"


@query("payload_fields", "fx_intake", sql="""
SELECT submission_id, key, CASE WHEN key = 'user_role' AND submission_id % 9 = 0 THEN 'Dad' ELSE json_extract_string(raw_request, '$.' || key) END AS value FROM (SELECT submission_id, raw_request, unnest(json_keys(raw_request)) AS key FROM fx_intake) k
UNION ALL SELECT submission_id, 'form_id', 'F1' FROM fx_intake UNION ALL SELECT submission_id, 'known_moves', CASE WHEN submission_id % 8 = 3 THEN 'Derby to Leeds' END FROM fx_intake""")
def payload_fields(intake):
    return _fields(intake).select("submission_id", F.explode("fields").alias("key", "value"))


def _blocks_sql() -> str:
    out = []
    for path, pairs in ops.prefix_slots().items():
        for prefix, slot in pairs:
            sex = "'Unknown'" if slot == 1 else ("'Male'" if slot % 2 == 0 else "'Female'")
            out.append(f"SELECT sid AS submission_id, path, '{prefix}' AS prefix, {slot} AS asc_no, trim(regexp_replace({_f(prefix + '_first_name')} || ' ' || {_f(prefix + '_middle_names')} || ' ' || {_f(prefix + '_last_name_at_birth')}, '\\s+', ' ', 'g')) AS full_name, {sex} AS gender,"
                       f" {_f(prefix + '_birth_date')} AS birth_date, {_f(prefix + '_birth_year')} AS birth_year, CASE WHEN {_f(prefix + '_birth_place_town')} <> '' THEN {_f(prefix + '_birth_place_town')} || ', ' || {_f(prefix + '_birth_place_county')} ELSE '' END AS birth_place,"
                       f" {_f(prefix + '_death_year')} AS death_year, {_f(prefix + '_known')} <> 'No' AS known FROM pa WHERE path = '{path}' AND {_f(prefix + '_first_name')} <> ''")
    return "bl AS (" + " UNION ALL ".join(out) + ")"


_KIDS = "kd AS (SELECT sid AS submission_id, CAST(i AS INT) AS child_index, CASE i WHEN 1 THEN 'Alan Hunt' WHEN 2 THEN 'Joan Hunt' ELSE 'Tim' END AS full_name FROM pa CROSS JOIN (VALUES (1), (2), (3)) v(i) WHERE path <> 'root' AND " + _f("child1_first_name") + " <> '' AND (i = 1 OR (" + _f("child2_first_name") + " <> '' AND " + _f("add_child_2") + " <> 'No' AND (i = 2 OR " + _f("child3_first_name") + " <> ''))))"
_VALID = f"vd AS (SELECT sid AS submission_id, path, CASE WHEN path <> 'root' AND {_f('child1_first_name')} = '' THEN 'No children found' WHEN path = 'root' AND {_f('root_first_name')} = '' THEN 'Missing required fields' ELSE '' END AS reason FROM pa)"


@query("person_blocks", "fx_intake", sql=f"WITH {_J}, {_blocks_sql()} SELECT * FROM bl")
def person_blocks(intake):
    return ops.person_blocks(_fields(intake))


@query("one_job_per_child", "fx_intake", sql=f"WITH {_J}, {_KIDS} SELECT * FROM kd")
def one_job_per_child(intake):
    return ops.children(_fields(intake)).select("submission_id", "child_index", "full_name")


@query("intake_validate", "fx_intake", sql=f"WITH {_J}, {_VALID} SELECT *, reason = '' AS accepted FROM vd")
def intake_validate(intake):
    return ops.validate(_fields(intake))


@query("intake_rows", "fx_intake", sql=f"""WITH {_J}, {_blocks_sql()}, {_KIDS}, {_VALID}, ok AS (SELECT submission_id FROM vd WHERE reason = ''),
kp AS (SELECT bl.*, CASE WHEN birth_date <> '' OR asc_no <= 3 THEN birth_date ELSE birth_year END AS bd, CASE WHEN asc_no <= 3 AND path <> 'root' THEN '' ELSE death_year END AS dd FROM bl JOIN ok ON ok.submission_id = bl.submission_id WHERE known OR (path <> 'root' AND asc_no <= 3) OR asc_no = 1),
rw AS (SELECT kd.submission_id, child_index, 1 AS asc_no, full_name AS name, 'Unknown' AS gender, '' AS birth_date, '' AS birth_place, '' AS death_date FROM kd JOIN ok ON ok.submission_id = kd.submission_id
 UNION ALL SELECT kp.submission_id, kd.child_index, kp.asc_no, kp.full_name, kp.gender, kp.bd, kp.birth_place, kp.dd FROM kp JOIN kd ON kd.submission_id = kp.submission_id WHERE kp.path <> 'root' UNION ALL SELECT submission_id, 1, asc_no, full_name, gender, bd, birth_place, dd FROM kp WHERE path = 'root')
SELECT *, {D.gen('asc_no')} AS generation, 'customer_data' AS confidence, 100 AS confidence_score, 'Customer Data' AS confidence_level, 1 AS accepted FROM rw""")
def intake_rows(intake):
    return ops.intake_rows(_fields(intake))


def _far_sql() -> str:
    """Lines of the parents of great-grandparents, one SELECT a prefix."""
    rows = []
    for path, pairs in ops.far_prefixes().items():
        for i, (prefix, label) in enumerate(pairs):
            for j, (tail, who) in enumerate((("ggf", "father"), ("ggm", "mother"))):
                k = f"{prefix}_{tail}"
                name = f"trim(regexp_replace({_f(k + '_first_name')} || ' ' || {_f(k + '_middle_names')} || ' ' || {_f(k + '_last_name_at_birth')}, '\\s+', ' ', 'g'))"
                place = f"CASE WHEN {_f(k + '_birth_place_town')} <> '' THEN ' ' || {_f(k + '_birth_place_town')} || ', ' || {_f(k + '_birth_place_county')} ELSE '' END"
                rows.append(f"SELECT sid AS submission_id, {16 + 2 * i + j} AS asc_no, '2x Great-grand{who} ({label}): ' || {name} || CASE WHEN {_f(k + '_birth_year')} <> '' THEN ' (' || {_f(k + '_birth_year')} || ')' ELSE '' END || {place} AS line FROM pa WHERE path = '{path}' AND {_f(k + '_first_name')} <> ''")
    return " UNION ALL ".join(rows)


@query("notes_render", "fx_intake", sql=f"""WITH {_J}, {_blocks_sql()},
ln AS (SELECT submission_id, asc_no, CASE WHEN asc_no < 8 THEN CASE WHEN asc_no < 6 THEN 'Paternal' ELSE 'Maternal' END || ' grand' || CASE WHEN asc_no % 2 = 0 THEN 'father' ELSE 'mother' END || ': ' || full_name || ' ' || CASE WHEN birth_date || birth_year = '' THEN '(unknown)' ELSE '(' || CASE WHEN birth_date <> '' THEN birth_date ELSE birth_year END || ')' END
  ELSE 'Great-grand' || CASE WHEN asc_no % 2 = 0 THEN 'father' ELSE 'mother' END || ' (' || CASE asc_no // 2 WHEN 4 THEN 'paternal paternal' WHEN 5 THEN 'paternal maternal' WHEN 6 THEN 'maternal paternal' ELSE 'maternal maternal' END || '): ' || full_name || CASE WHEN birth_date || birth_year = '' THEN '' ELSE ' (' || CASE WHEN birth_date <> '' THEN birth_date ELSE birth_year END || ')' END END
  || CASE WHEN birth_place <> '' THEN ' ' || birth_place ELSE '' END AS line FROM bl WHERE known AND asc_no >= 4 UNION ALL {_far_sql()}),
tx AS (SELECT pa.sid AS submission_id, (SELECT string_agg(line, chr(10) ORDER BY asc_no) FROM ln WHERE ln.submission_id = pa.sid) AS told, moves FROM pa)
SELECT submission_id, concat_ws(chr(10), told, CASE WHEN moves <> '' THEN 'Known moves: ' || moves END) AS notes FROM tx""")
def notes_render(intake):
    return ops.notes_render(_fields(intake))


def _legacy(customer):
    k = c("c_custkey")
    m = F.create_map(
        F.lit("q1_fullName"), F.when(k % 3 == 0, "").otherwise("Alan Brian Hunt"), F.lit("q2_subjectName"), F.when(k % 6 == 0, "Unknown").otherwise(" Joan Skinner "), F.lit("q3_email"), F.when(k % 2 == 0, "a@example.org").otherwise(""), F.lit("q2_email"), F.lit("b@example.org"),
        F.lit("q4_customerName"), F.when(k % 4 == 0, c("c_name")).otherwise(""), F.lit("q5_birthDate"), (F.lit(1950) + k % 40).cast("string"), F.lit("q11_notes"), F.when(k % 2 == 0, "first").otherwise(""), F.lit("q12_additionalInfo"), F.lit("more"),
        F.lit("q13_generations"), (k % 10).cast("string"), F.lit("q9_generations"), F.when(k % 5 == 0, "3").otherwise("x"))
    return customer.select(k.alias("submission_id"), m.alias("fields"))


@query("legacy_fields", "customer", sql="""
WITH s AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 3 <> 0 THEN 'Alan Brian' WHEN c_custkey % 6 = 0 THEN '' ELSE 'Joan' END AS g, CASE WHEN c_custkey % 3 <> 0 THEN 'Hunt' WHEN c_custkey % 6 = 0 THEN '' ELSE 'Skinner' END AS sn FROM customer)
SELECT k AS submission_id, g AS given_name, sn AS surname, CASE WHEN k % 4 = 0 THEN c_name ELSE trim(g || ' ' || sn) END AS customer_name, CASE WHEN k % 2 = 0 THEN 'a@example.org' ELSE 'b@example.org' END AS customer_email, CAST(1950 + k % 40 AS VARCHAR) AS birth_date, '' AS birth_place, '' AS death_date, '' AS death_place,
  '' AS father_name, '' AS mother_name, CASE WHEN k % 2 = 0 THEN 'first' || chr(10) || 'more' ELSE 'more' END AS notes, CASE WHEN k % 5 = 0 THEN 3 WHEN k % 10 BETWEEN 2 AND 7 THEN CAST(k % 10 AS INT) ELSE 4 END AS generations, CASE WHEN g = '' OR sn = '' THEN 'Missing required fields' ELSE '' END AS reason FROM s""")
def legacy_fields(customer):
    return ops.legacy_fields(_legacy(customer))


# What the lines added by ``fx_notes`` say, by doc_id. A birth date within 100 characters after a full name
# counts for that name, whoever the sentence is about.
@query("notes_anchors", "fx_notes", sql="""
WITH d AS (SELECT doc_id FROM fx_notes),
an AS (
  SELECT doc_id, 2 AS asc_no, 'Brian' AS given, 'Jackson' AS surname, CAST(1930 + doc_id % 20 AS VARCHAR) AS birth_date, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '2001' END AS death_date FROM d
  UNION ALL SELECT doc_id, 3, 'Julie Ann', 'Jackson', '1942', '' FROM d WHERE doc_id % 4 = 3
  UNION ALL SELECT doc_id, 4, 'Norman', 'Hunt', CAST(1900 + doc_id % 40 AS VARCHAR), CAST(1970 + doc_id % 30 AS VARCHAR) FROM d WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 5, 'Ivy', 'Skinner', '1902', '1980' FROM d WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 5, 'Ethel', 'Skinner', '1905', '1980' FROM d WHERE doc_id % 4 = 2
  UNION ALL SELECT doc_id, 6, 'Albert', 'Jackson', CASE WHEN doc_id % 3 = 0 THEN '1875' WHEN doc_id % 5 = 1 THEN '01.02.1911' WHEN doc_id % 15 = 10 THEN '3 May 1881' ELSE '' END, '' FROM d WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, 8, 'Frederick', 'Hunt', '1875', '1950' FROM d WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 15, 'Gertrude May', 'Griffin', CASE doc_id % 5 WHEN 0 THEN '3 May 1881' WHEN 1 THEN '01.02.1911' ELSE '' END, '' FROM d WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, 15, 'Jessie', 'Mayne', '1880', '1959' FROM d WHERE doc_id % 3 = 2)
SELECT *, '' AS birth_place FROM an""")
def notes_anchors(notes):
    return ops.notes_anchors(notes, "doc_id")


def _flat(jobs):
    """Parents' names typed into the form."""
    two = F.array(F.struct(F.lit(2).alias("asc_no"), F.lit("Brian").alias("given"), F.lit("Hunt").alias("surname")), F.struct(F.lit(3).alias("asc_no"), F.lit("Julie").alias("given"), F.lit("Jackson").alias("surname")))
    return jobs.where("job_id % 2 = 0").select("job_id", F.explode(two).alias("_x")).select("job_id", "_x.*", F.lit("").alias("birth_date"), F.lit("").alias("death_date"), F.lit("Ripley, Derbyshire").alias("birth_place"))


def _noted(jobs):
    """One relative from the notes of every third job."""
    return jobs.where("job_id % 3 = 0").select("job_id", F.explode(F.array(F.lit(2), F.lit(9))).alias("asc_no"), F.lit("Norman").alias("given"), F.lit("Hunt").alias("surname"), F.lit("1901").alias("birth_date"), F.lit("").alias("death_date"), F.lit("").alias("birth_place"))


def _stored(anc):
    return anc.withColumn("confidence_level", F.when(c("asc_no") <= 5, "Customer Data").otherwise(c("confidence_level")))


_ANCH = f"""fl AS (SELECT job_id, v.s AS asc_no, v.g AS given, v.n AS surname FROM fx_job CROSS JOIN (VALUES (2, 'Brian', 'Hunt'), (3, 'Julie', 'Jackson')) v(s, g, n) WHERE job_id % 2 = 0), nt AS (SELECT job_id, v.s AS asc_no FROM fx_job CROSS JOIN (VALUES (2), (9)) v(s) WHERE job_id % 3 = 0),
an AS (SELECT nt.job_id, nt.asc_no, 'Norman' AS given, 'Hunt' AS surname, '1901' AS birth_date, '' AS death_date, CASE WHEN fl.job_id IS NULL THEN '' ELSE 'Ripley, Derbyshire' END AS birth_place FROM nt LEFT JOIN fl ON fl.job_id = nt.job_id AND fl.asc_no = nt.asc_no
 UNION ALL SELECT job_id, asc_no, given, surname, '', '', 'Ripley, Derbyshire' FROM fl WHERE NOT EXISTS (SELECT 1 FROM nt WHERE nt.job_id = fl.job_id AND nt.asc_no = fl.asc_no)
 UNION ALL SELECT job_id, asc_no, given_name, surname, birth_date, death_date, birth_place FROM fx_anc WHERE asc_no IN (4, 5))"""


@query("anchors", "fx_job", "fx_anc", sql=f"WITH {_ANCH} SELECT * FROM an")
def anchors(jobs, anc):
    return ops.anchors(_flat(jobs), _noted(jobs), _stored(anc))


@query("customer_rows", "fx_job", "fx_anc", sql=f"""WITH {_ANCH}
SELECT an.job_id, an.asc_no, an.given || ' ' || an.surname AS name, CASE WHEN an.asc_no % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender, an.birth_date, an.death_date,
  CASE WHEN an.birth_place <> '' THEN an.birth_place WHEN an.asc_no >= 8 AND coalesce(k.birth_place, '') <> '' THEN k.birth_place ELSE coalesce(s.birth_place, '') END AS birth_place, 'customer_data' AS confidence, 100 AS confidence_score, 'Customer Data' AS confidence_level, 1 AS accepted
FROM an LEFT JOIN an k ON k.job_id = an.job_id AND k.asc_no = an.asc_no // 2 LEFT JOIN fx_anc s ON s.job_id = an.job_id AND s.asc_no = 1 WHERE NOT EXISTS (SELECT 1 FROM fx_anc t WHERE t.job_id = an.job_id AND t.asc_no = an.asc_no AND t.row_id % 2 = 0)""")
def customer_rows(jobs, anc):
    known = ops.anchors(_flat(jobs), _noted(jobs), _stored(anc))
    return ops.customer_rows(known, anc.where("asc_no = 1"), anc.where("row_id % 2 = 0"))


@query("intake_stream", "fx_intake", sql=f"""WITH {_J.replace("CASE WHEN submission_id % 9 = 0 THEN 'Dad' ELSE json_extract_string(raw_request, '$.user_role') END", "json_extract_string(raw_request, '$.user_role')")}, {_KIDS}, {_VALID}
SELECT 'accepted' AS outcome, submission_id FROM vd WHERE reason = '' UNION ALL SELECT 'refused', submission_id FROM vd WHERE reason <> ''""")
def intake_stream(intake):
    """Submissions land as files (some twice), a stream takes them in, the stored rows are read back."""
    spark = intake.sparkSession
    base = f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}"
    landed = intake.withColumn("received_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    landed.unionByName(landed.where("submission_id % 5 = 0")).write.parquet(f"{base}/in")
    q = streams.intake_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    rows = spark.read.parquet(f"{base}/out/rows").where("asc_no = 1 and child_index = 1").select(F.lit("accepted").alias("outcome"), "submission_id")
    return rows.unionByName(spark.read.parquet(f"{base}/out/refused").select(F.lit("refused").alias("outcome"), "submission_id"))


@query("feedback_stream", "fx_feedback", sql="SELECT action_type, count(*) AS decisions FROM fx_feedback GROUP BY 1")
def feedback_stream(feedback):
    """Decisions land in two parts, some of the first again in the second; the stream runs, ends, and is started again."""
    spark = feedback.sparkSession
    base = f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}"
    rows = feedback.select("id", "job_id", "action_type", c("created_at").cast("timestamp").alias("created_at"))
    for part, late in (("id % 3 <> 0", "36500 days"), ("id % 3 = 0 or id % 7 = 1", "36500 days")):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        streams.feedback_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", late).awaitTermination()
    return streams.feedback_totals(spark, f"{base}/out")
