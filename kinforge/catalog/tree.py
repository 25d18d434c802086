"""Relatives, rankings and whole-tree reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.catalog import duck as D
from kinforge.catalog.base import query
from kinforge.functions import names
from kinforge.functions.dates import date_year
from kinforge.operators import ranking, tree

c = F.col


@query("child_of", "fx_anc", sql="""
SELECT a.job_id, a.asc_no, a.name, ch.name AS child_name, ch.birth_date AS child_birth FROM fx_anc a
LEFT JOIN fx_anc ch ON ch.job_id = a.job_id AND ch.asc_no = a.asc_no // 2""")
def child_of(anc):
    return tree.with_child(anc.select("job_id", "asc_no", "name", "birth_date"), ["name", "birth_date"]).select(
        "job_id", "asc_no", "name", "child_name", c("child_birth_date").alias("child_birth"))


@query("parents_of", "fx_anc", sql="""
SELECT a.job_id, a.asc_no, f.name AS father_name, m.name AS mother_name FROM fx_anc a
LEFT JOIN fx_anc f ON f.job_id = a.job_id AND f.asc_no = 2 * a.asc_no LEFT JOIN fx_anc m ON m.job_id = a.job_id AND m.asc_no = 2 * a.asc_no + 1""")
def parents_of(anc):
    return tree.with_parents(anc.select("job_id", "asc_no", "name"), ["name"]).select("job_id", "asc_no", "father_name", "mother_name")


@query("spouse_of", "fx_anc", sql="""
SELECT a.job_id, a.asc_no, s.name AS spouse_name, s.birth_date AS spouse_birth FROM fx_anc a
JOIN fx_anc s ON s.job_id = a.job_id AND s.asc_no = xor(a.asc_no, 1) AND a.asc_no > 1""")
def spouse_of(anc):
    return tree.with_spouse(anc.select("job_id", "asc_no", "name", "birth_date"), ["name", "birth_date"], "inner").select(
        "job_id", "asc_no", "spouse_name", c("spouse_birth_date").alias("spouse_birth"))


@query("same_generation", "fx_anc", sql="""
SELECT a.job_id, a.asc_no, a.gen, g.n - 1 AS others, g.lo AS first_slot, g.hi AS last_slot FROM fx_anc a
JOIN (SELECT job_id, gen, count(*) AS n, min(asc_no) AS lo, max(asc_no) AS hi FROM fx_anc GROUP BY 1, 2) g ON g.job_id = a.job_id AND g.gen = a.gen""")
def same_generation(anc):
    return tree.same_generation(anc)


@query("empty_slots", "fx_anc", "fx_job", sql=f"""
SELECT j.job_id, s.asc_no, ch.asc_no AS child_slot, ch.name AS child_name, {D.role('s.asc_no')} AS role
FROM fx_job j CROSS JOIN (SELECT CAST(range AS INT) AS asc_no FROM range(2, 128)) s
JOIN fx_anc ch ON ch.job_id = j.job_id AND ch.asc_no = s.asc_no // 2
WHERE NOT EXISTS (SELECT 1 FROM fx_anc a WHERE a.job_id = j.job_id AND a.asc_no = s.asc_no)""")
def empty_slots(anc, jobs):
    return tree.empty_slots(anc, jobs)


@query("completion", "fx_anc", "fx_job", sql="""
SELECT j.job_id, coalesce(n, 0) AS accepted, 127 AS slots, round(coalesce(n, 0) * 100.0 / 127, 2) AS percent FROM fx_job j
LEFT JOIN (SELECT job_id, count(*) AS n FROM fx_anc WHERE confidence_score >= 75 OR confidence_level = 'Customer Data' GROUP BY 1) a ON a.job_id = j.job_id""")
def completion(anc, jobs):
    return tree.completion(anc, jobs).withColumn("percent", c("percent").cast("double"))


@query("family_gap", "fx_anc", sql=f"""
SELECT p.job_id, p.gen - 1 AS child_gen, CAST(floor(avg({D.year('ch.birth_date')} - {D.year('p.birth_date')}) + 0.5) AS INT) AS mean_gap, count(*) AS pairs
FROM fx_anc p JOIN fx_anc ch ON ch.job_id = p.job_id AND ch.asc_no = p.asc_no // 2
WHERE {D.year('ch.birth_date')} > {D.year('p.birth_date')} GROUP BY 1, 2""")
def family_gap(anc):
    return tree.family_gaps(anc)


@query("parent_year_estimate", "fx_anc", sql=f"""
WITH y AS (SELECT job_id, asc_no, gen, {D.year('birth_date')} AS yr FROM fx_anc),
gaps AS (SELECT p.job_id, p.gen - 1 AS gen, CAST(floor(avg(ch.yr - p.yr) + 0.5) AS INT) AS gap FROM y p JOIN y ch ON ch.job_id = p.job_id AND ch.asc_no = p.asc_no // 2 WHERE ch.yr > p.yr GROUP BY 1, 2)
SELECT y.job_id, y.asc_no, 2 * y.asc_no + side AS parent_slot, coalesce(p.yr, y.yr - g.gap, y.yr - CASE side WHEN 0 THEN 28 ELSE 26 END) AS expected_year
FROM y CROSS JOIN (VALUES (0), (1)) s(side) LEFT JOIN y p ON p.job_id = y.job_id AND p.asc_no = 2 * y.asc_no + side LEFT JOIN gaps g ON g.job_id = y.job_id AND g.gen = y.gen
WHERE y.yr IS NOT NULL""")
def parent_year_estimate(anc):
    return tree.parent_year_estimate(anc)


@query("batches", "fx_anc", sql="""
WITH b AS (SELECT job_id, asc_no, CAST((row_number() OVER (PARTITION BY job_id ORDER BY asc_no) - 1) // 25 + 1 AS INT) AS batch FROM fx_anc)
SELECT job_id, asc_no, batch, concat('asc#', min(asc_no) OVER (PARTITION BY job_id, batch), '-', max(asc_no) OVER (PARTITION BY job_id, batch)) AS label FROM b""")
def batches(anc):
    return tree.batches(anc)


@query("tree_context", "fx_anc", sql=f"""
SELECT job_id, array_to_string(list_sort(list_distinct(list(surname))), ', ') AS surnames,
  coalesce(array_to_string(list_sort(list_distinct(list(birth_place) FILTER (WHERE birth_place <> ''))), '; '), '') AS places,
  min({D.bounded_year('birth_date')}) AS year_from, max({D.bounded_year('birth_date')}) AS year_to FROM fx_anc GROUP BY 1""")
def tree_context(anc):
    return tree.tree_context(anc)


@query("subtree", "fx_anc", sql="""
WITH roots AS (SELECT job_id, asc_no FROM fx_anc WHERE confidence_score < 12 AND asc_no > 1)
SELECT DISTINCT a.job_id, a.asc_no, a.name FROM fx_anc a JOIN roots r ON r.job_id = a.job_id AND a.gen >= length(bin(r.asc_no)) - 1
  AND a.asc_no // CAST(pow(2, a.gen - (length(bin(r.asc_no)) - 1)) AS INT) = r.asc_no""")
def subtree(anc):
    roots = anc.where((c("confidence_score") < 12) & (c("asc_no") > 1))
    return tree.subtree(anc, roots).select("job_id", "asc_no", "name")


# Rankings ----------------------------------------------------------------------------------
def _lead_score(pair):
    """Name 20, year within three 15, place 10."""
    near = F.abs(date_year(c("cand_birth")) - date_year(c("anc_birth"))) <= 3
    from kinforge.functions.places import places_overlap

    score = (F.when(names.names_similar(c("cand_given"), c("anc_given")), 20).otherwise(0) + F.when(near, 15).otherwise(0)
             + F.when(places_overlap(c("cand_place"), c("anc_place")), 10).otherwise(0))
    return pair.select("job_id", "asc_no", "rnk", "person_id", score.alias("score"))


_LEAD_SQL = f"""s AS (SELECT job_id, asc_no, rnk, person_id, CASE WHEN {D.similar('cand_given', 'anc_given')} THEN 20 ELSE 0 END + CASE WHEN abs({D.year('cand_birth')} - {D.year('anc_birth')}) <= 3 THEN 15 ELSE 0 END
 + CASE WHEN cand_place <> '' AND anc_place <> '' AND (contains(lower(cand_place), lower(anc_place)) OR contains(lower(anc_place), lower(cand_place))) THEN 10 ELSE 0 END AS score FROM fx_pair)"""


@query("best_match", "fx_pair", sql=f"""WITH {_LEAD_SQL}
SELECT job_id, asc_no, person_id, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY score DESC, rnk) AS n FROM s) t WHERE n = 1 AND score >= 25""")
def best_match(pair):
    return ranking.best_row(_lead_score(pair), ["job_id", "asc_no"], "score", [c("rnk")], 25)


@query("first_passing", "fx_pair", sql=f"""
SELECT job_id, asc_no, person_id, rnk FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY rnk) AS n FROM fx_pair
WHERE {D.similar('cand_given', 'anc_given')} AND rejection_reason = '' AND lower(cand_surname) = lower(anc_surname)) t WHERE n = 1""")
def first_passing(pair):
    ok = pair.where(names.names_similar(c("cand_given"), c("anc_given")) & (c("rejection_reason") == "") & (F.lower("cand_surname") == F.lower("anc_surname")))
    return ranking.first_row(ok.select("job_id", "asc_no", "person_id", "rnk"), ["job_id", "asc_no"], [c("rnk")])


@query("top_k", "fx_pair", sql=f"""WITH {_LEAD_SQL}
SELECT job_id, asc_no, person_id, score, rnk, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY score DESC, rnk) AS n FROM s) t WHERE n <= 3""")
def top_k(pair):
    return ranking.top_rows(_lead_score(pair), ["job_id", "asc_no"], [F.desc("score"), c("rnk")], 3)


@query("first_good_enough", "fx_pair", sql=f"""WITH {_LEAD_SQL}
SELECT job_id, asc_no, person_id, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY score < 35, rnk) AS n FROM s) t WHERE n = 1""")
def first_good_enough(pair):
    return ranking.first_good_enough(_lead_score(pair), ["job_id", "asc_no"], "score", "rnk", 35)


@query("runner_up", "fx_pair", sql=f"""WITH {_LEAD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY score DESC, rnk) AS n FROM s)
SELECT job_id, asc_no, max(CASE WHEN n = 1 THEN person_id END) AS best, max(CASE WHEN n = 1 THEN score END) AS best_score, max(CASE WHEN n = 2 THEN person_id END) AS second,
  max(CASE WHEN n = 2 THEN score END) AS second_score, max(CASE WHEN n = 1 THEN score END) - max(CASE WHEN n = 2 THEN score END) AS margin FROM r GROUP BY 1, 2""")
def runner_up(pair):
    return ranking.runner_up(_lead_score(pair), ["job_id", "asc_no"], "score", [c("rnk")], "person_id")


@query("carry_forward", "fx_dump", sql="""
SELECT doc, line_no, last_value(CASE WHEN starts_with(line, ';') THEN split_part(line, ';', 3) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS quarter_no FROM fx_dump""")
def carry_forward(dump):
    header = F.when(c("line").startswith(";"), F.get(F.split("line", ";"), F.lit(2)))
    return ranking.carry_forward(dump, "doc", "line_no", header, "quarter_no").select("doc", "line_no", "quarter_no")


@query("recent_n", "fx_feedback", sql="SELECT id, action_type, surname FROM fx_feedback ORDER BY created_at DESC, id DESC LIMIT 500")
def recent_n(feedback):
    return feedback.orderBy(F.desc("created_at"), F.desc("id")).limit(500).select("id", "action_type", "surname")


@query("ordered_output", "fx_anc", sql="""
SELECT job_id, asc_no, name, row_number() OVER (PARTITION BY job_id ORDER BY gen, asc_no) AS position FROM fx_anc""")
def ordered_output(anc):
    from pyspark.sql import Window

    w = Window.partitionBy("job_id").orderBy("gen", "asc_no")
    return anc.select("job_id", "asc_no", "name", F.row_number().over(w).alias("position")).sortWithinPartitions("job_id", "position")
