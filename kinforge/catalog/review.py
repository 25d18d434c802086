"""Reviewers, consensus, feedback and the operator's changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.catalog import duck as D
from kinforge.catalog.base import query
from kinforge.operators import changes, review

c = F.col
_KEYS = ["job_id", "asc_no"]


def _side(flag, who):
    return flag.where(c("reviewer") == who).groupBy(*_KEYS).agg(F.count("*").alias(f"n_{who}"), F.min("suggestion").alias(f"first_{who}"))


@query("reviewers_joined", "fx_flag", sql="""
WITH a AS (SELECT job_id, asc_no, count(*) AS n_a, min(suggestion) AS first_a FROM fx_flag WHERE reviewer = 'a' GROUP BY 1, 2), b AS (SELECT job_id, asc_no, count(*) AS n_b, min(suggestion) AS first_b FROM fx_flag WHERE reviewer = 'b' GROUP BY 1, 2)
SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.asc_no, b.asc_no) AS asc_no, n_a, first_a, n_b, first_b FROM a FULL OUTER JOIN b ON a.job_id = b.job_id AND a.asc_no = b.asc_no""")
def reviewers_joined(flag):
    return review.reviewers_joined(_side(flag, "a"), _side(flag, "b"))


_MATCH = f"""fa AS (SELECT * FROM fx_flag WHERE reviewer = 'a'), fb AS (SELECT * FROM fx_flag WHERE reviewer = 'b'),
ab AS (SELECT fa.job_id, fa.asc_no, fa.pos AS pa, fb.pos AS pb, fa.suggestion AS sa, fb.suggestion AS sb FROM fa JOIN fb ON fa.job_id = fb.job_id AND fa.asc_no = fb.asc_no AND {D.corrections_agree('fa.suggestion', 'fb.suggestion')}),
mt AS (SELECT fa.job_id, fa.asc_no, fa.pos AS pos_a, f.pb AS pos_b, fa.suggestion AS sa, f.sb FROM fa LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no, pa ORDER BY pb) AS n FROM ab) t WHERE n = 1) f ON f.job_id = fa.job_id AND f.asc_no = fa.asc_no AND f.pa = fa.pos
 UNION ALL SELECT fb.job_id, fb.asc_no, NULL, fb.pos, NULL, fb.suggestion FROM fb WHERE NOT EXISTS (SELECT 1 FROM ab WHERE ab.job_id = fb.job_id AND ab.asc_no = fb.asc_no AND ab.pb = fb.pos))"""


@query("flags_matched", "fx_flag", sql=f"WITH {_MATCH} SELECT job_id, asc_no, pos_a, pos_b FROM mt")
def flags_matched(flag):
    return review.flags_matched(review.pack_flags(flag)).select(*_KEYS, c("flag_a.pos").alias("pos_a"), c("flag_b.pos").alias("pos_b"))


_CIVIL = "civ AS (SELECT job_id, asc_no, CASE WHEN row_id % 5 < 2 THEN 1980 - 28 * gen END AS cb, CAST(NULL AS INT) AS cd FROM fx_anc)"
_CONS = f"""{_MATCH}, {_CIVIL}, op AS (SELECT * FROM fx_anc WHERE asc_no > 1 AND confidence_level <> 'Customer Data'),
ad AS (SELECT o.job_id, o.asc_no, o.confidence_score AS old, r.adj_a AS a, r.adj_b AS b, abs((r.adj_a + r.adj_b) / 2.0) AS mag FROM op o JOIN fx_review r ON r.job_id = o.job_id AND r.asc_no = o.asc_no),
st AS (SELECT *, CASE WHEN a <> 0 AND b <> 0 AND sign(a) = sign(b) AND abs(a - b) <= CASE WHEN mag >= 20 THEN 15 WHEN mag >= 10 THEN 8 ELSE 2 END THEN CAST(floor((a + b) / 2.0 + 0.5) AS INT) END AS step FROM ad),
nw AS (SELECT *, greatest(0, least(100, old + step)) AS new FROM st),
fx AS (SELECT m.job_id, m.asc_no, coalesce(m.sa, m.sb) AS said, CASE WHEN m.sa IS NULL THEN 'b' WHEN m.sb IS NULL THEN 'a' ELSE 'both' END AS said_by, o.birth_date, o.birth_place, o.death_date, civ.cb FROM mt m JOIN op o ON o.job_id = m.job_id AND o.asc_no = m.asc_no JOIN civ ON civ.job_id = m.job_id AND civ.asc_no = m.asc_no),
co AS (SELECT job_id, asc_no, CASE WHEN step IS NOT NULL THEN 'apply' ELSE 'suggest' END AS action, 'confidence_score' AS field, CAST(old AS VARCHAR) AS old_value, CASE WHEN step IS NOT NULL THEN CAST(new AS VARCHAR) END AS new_value, 'both' AS said_by FROM nw
  WHERE (step IS NOT NULL AND new <> old) OR (step IS NULL AND (a <> 0 OR b <> 0) AND abs(a - b) > 2)
UNION ALL SELECT job_id, asc_no, CASE WHEN said_by = 'both' AND coalesce({D.bounded_year('said')} = cb, false) THEN 'apply' WHEN said_by = 'both' THEN 'suggest' ELSE 'suggest_single' END, field,
  CASE field WHEN 'birth_date' THEN birth_date WHEN 'birth_place' THEN birth_place WHEN 'death_date' THEN death_date ELSE '' END, value, said_by
  FROM (SELECT *, {D.correction_field('said')} AS field, {D.correction_value('said')} AS value FROM fx) z WHERE field IS NOT NULL)"""


def _civil_years(anc):
    return anc.select(*_KEYS, F.when(c("row_id") % 5 < 2, 1980 - 28 * c("gen")).alias("civil_birth"), F.lit(None).cast("int").alias("civil_death"))


@query("consensus", "fx_anc", "fx_review", "fx_flag", sql=f"WITH {_CONS} SELECT * FROM co")
def consensus(anc, rev, flag):
    return review.consensus(anc, rev, review.pack_flags(flag), _civil_years(anc))


@query("reviews_store", "fx_flag", "fx_review", sql="""
WITH p AS (SELECT job_id, asc_no, count(*) FILTER (WHERE reviewer = 'a') AS fa, count(*) FILTER (WHERE reviewer = 'b') AS fb FROM fx_flag GROUP BY 1, 2)
SELECT coalesce(p.job_id, r.job_id) AS job_id, coalesce(p.asc_no, r.asc_no) AS asc_no, CASE WHEN coalesce(fa, 0) > 0 OR coalesce(adj_a, 0) <> 0 THEN coalesce(adj_a, 0) END AS adjustment_a, CASE WHEN coalesce(fa, 0) > 0 OR coalesce(adj_a, 0) <> 0 THEN coalesce(fa, 0) END AS flags_a,
  CASE WHEN coalesce(fb, 0) > 0 OR coalesce(adj_b, 0) <> 0 THEN coalesce(adj_b, 0) END AS adjustment_b, CASE WHEN coalesce(fb, 0) > 0 OR coalesce(adj_b, 0) <> 0 THEN coalesce(fb, 0) END AS flags_b
FROM p FULL OUTER JOIN fx_review r ON r.job_id = p.job_id AND r.asc_no = p.asc_no""")
def reviews_store(flag, rev):
    stored = review.reviews_store(review.pack_flags(flag), rev.select(*_KEYS, "adj_a", "adj_b"))
    return stored.select(*_KEYS, *[F.try_element_at("review", F.lit(w))[f].alias(f"{f}_{w}") for w in ("a", "b") for f in ("adjustment", "flags")])


@query("flag_counts", "fx_flag", sql="""
SELECT *, CASE WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'warning' WHEN confirmations > 0 THEN 'confirmation' ELSE 'none' END AS worst FROM (SELECT job_id, asc_no, count(*) FILTER (WHERE severity = 'error') AS errors,
  count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'confirmation') AS confirmations FROM fx_flag GROUP BY 1, 2) t""")
def flag_counts(flag):
    return review.flag_counts(flag)


@query("gaps_merged", "fx_flag", sql="SELECT job_id, asc_no, string_agg(reviewer || ': ' || suggestion, ' | ' ORDER BY reviewer, pos) AS suggestions FROM fx_flag GROUP BY 1, 2")
def gaps_merged(flag):
    return review.gaps_merged(flag)


@query("unique_lookups", "fx_flag", sql="""
SELECT job_id, asc_no, string_agg(suggestion, ' | ' ORDER BY s) AS lookups FROM (SELECT job_id, asc_no, suggestion, min(reviewer || CAST(pos AS VARCHAR)) AS s FROM fx_flag GROUP BY 1, 2, 3) t GROUP BY 1, 2""")
def unique_lookups(flag):
    return review.unique_lookups(flag)


_REL = f"""rc AS (SELECT *, lower(surname) AS ls, lower(location) AS ll FROM fx_feedback), mx AS (SELECT max(created_at) AS now_ FROM rc),
cx AS (SELECT job_id, list_distinct(list(lower(surname))) AS sn, list_distinct(list(lower(birth_place)) FILTER (WHERE birth_place <> '')) AS pl, min({D.bounded_year('birth_date')}) AS y0, max({D.bounded_year('birth_date')}) AS y1 FROM fx_anc GROUP BY 1),
rl AS (SELECT cx.job_id, rc.id, rc.action_type, rc.created_at, CASE WHEN ls <> '' AND list_contains(sn, ls) THEN 30 WHEN ls <> '' AND len(list_filter(sn, lambda v: contains(v, ls) OR contains(ls, v))) > 0 THEN 15 ELSE 0 END
  + CASE WHEN ll <> '' AND len(list_filter(pl, lambda v: contains(v, ll) OR contains(ll, v))) > 0 THEN 20 ELSE 0 END + CASE WHEN birth_year BETWEEN y0 - 50 AND y1 + 50 THEN 10 ELSE 0 END + CASE WHEN created_at > now_ - INTERVAL 30 DAY THEN 5 ELSE 0 END AS relevance FROM cx CROSS JOIN rc CROSS JOIN mx),
rk AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY relevance DESC, created_at DESC, id DESC) AS n FROM rl WHERE relevance > 0)"""


@query("feedback_relevance", "fx_feedback", "fx_anc", sql=f"WITH {_REL} SELECT job_id, id, action_type, relevance FROM rk WHERE n <= 50")
def feedback_relevance(feedback, anc):
    return review.feedback_relevance(feedback, anc)


@query("review_payload", "fx_anc", "fx_job", "fx_src", "fx_feedback", sql=f"""WITH {_REL},
ev AS (SELECT a.job_id, count(*) AS n FROM fx_anc a JOIN (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY seq) AS rn FROM fx_src) s ON s.person_id = a.person_id AND a.person_id <> '' AND rn <= 3 GROUP BY 1),
gp AS (SELECT ch.job_id, 2 * ch.asc_no + s.side AS slot FROM fx_anc ch CROSS JOIN (VALUES (0), (1)) s(side) WHERE 2 * ch.asc_no + s.side <= 127 AND NOT EXISTS (SELECT 1 FROM fx_anc a WHERE a.job_id = ch.job_id AND a.asc_no = 2 * ch.asc_no + s.side)),
gn AS (SELECT job_id, least(30, count(*)) AS n, min(slot) AS first FROM gp GROUP BY 1), fn AS (SELECT job_id, least(20, count(*)) AS n FROM rk WHERE n <= 50 GROUP BY 1)
SELECT a.job_id, count(*) AS found, count(*) FILTER (WHERE confidence_level = 'Customer Data') AS given, coalesce(any_value(ev.n), 0) AS evidence_rows, coalesce(any_value(gn.n), 0) AS gaps_shown, any_value(gn.first) AS first_gap, coalesce(any_value(fn.n), 0) AS feedback_shown, true AS has_document
FROM fx_anc a LEFT JOIN ev ON ev.job_id = a.job_id LEFT JOIN gn ON gn.job_id = a.job_id LEFT JOIN fn ON fn.job_id = a.job_id GROUP BY 1""")
def review_payload(anc, jobs, src, feedback):
    p = review.review_payload(anc, jobs, src, feedback)
    return p.withColumn("has_document", F.length("document") > 100).drop("document")


# Changes ------------------------------------------------------------------------------------
@query("protected_upsert", "fx_anc", sql="""
WITH n AS (SELECT job_id, asc_no + 2 AS asc_no, 'New ' || name AS name, 'Suggested' AS confidence_level, 40 AS confidence_score FROM fx_anc WHERE row_id % 4 = 1)
SELECT coalesce(o.job_id, n.job_id) AS job_id, coalesce(o.asc_no, n.asc_no) AS asc_no, CASE WHEN o.confidence_level = 'Customer Data' THEN o.name ELSE coalesce(n.name, o.name) END AS name,
  CASE WHEN o.confidence_level = 'Customer Data' THEN o.confidence_level ELSE coalesce(n.confidence_level, o.confidence_level) END AS confidence_level,
  CASE WHEN o.confidence_level = 'Customer Data' THEN o.confidence_score ELSE coalesce(n.confidence_score, o.confidence_score) END AS confidence_score
FROM fx_anc o FULL OUTER JOIN n ON n.job_id = o.job_id AND n.asc_no = o.asc_no""")
def protected_upsert(anc):
    old = anc.select(*_KEYS, "name", "confidence_level", "confidence_score")
    new = anc.where("row_id % 4 = 1").select("job_id", (c("asc_no") + 2).alias("asc_no"), F.concat(F.lit("New "), "name").alias("name"), F.lit("Suggested").alias("confidence_level"), F.lit(40).alias("confidence_score"))
    return changes.protected_upsert(old, new)


@query("partial_update", "fx_anc", sql="""
SELECT job_id, asc_no, CASE WHEN row_id % 9 = 2 THEN 'Belper' ELSE birth_place END AS birth_place, CASE WHEN row_id % 9 = 2 AND row_id % 2 = 0 THEN 77 ELSE confidence_score END AS confidence_score FROM fx_anc""")
def partial_update(anc):
    upd = anc.where("row_id % 9 = 2").select(*_KEYS, F.lit("Belper").alias("birth_place"), F.when(c("row_id") % 2 == 0, 77).alias("confidence_score"))
    earlier = upd.withColumns({"birth_place": F.lit("Zeal"), "confidence_score": F.lit(None).cast("int"), "said": F.lit(1)})
    return changes.partial_update(anc.select(*_KEYS, "birth_place", "confidence_score"), earlier.unionByName(upd.withColumn("said", F.lit(2))), _KEYS, "said")


@query("delete_cascade", "fx_job", "fx_anc", "fx_cand", sql="""
SELECT 'jobs' AS kept_in, job_id, count(*) AS n FROM fx_job WHERE job_id % 3 <> 1 GROUP BY 2 UNION ALL SELECT 'ancestors', job_id, count(*) FROM fx_anc WHERE job_id % 3 <> 1 GROUP BY 2 UNION ALL SELECT 'candidates', job_id, count(*) FROM fx_cand WHERE job_id % 3 <> 1 GROUP BY 2""")
def delete_cascade(jobs, anc, cand):
    left = changes.delete_cascade({"jobs": jobs, "ancestors": anc, "candidates": cand}, jobs.where("job_id % 3 = 1"))
    out = [df.groupBy("job_id").agg(F.count("*").alias("n")).withColumn("kept_in", F.lit(k)) for k, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("purge_candidates", "fx_cand", "fx_job", sql="SELECT job_id, asc_no, rnk, person_id FROM fx_cand WHERE job_id % 2 = 1 OR rejection_reason <> ''")
def purge_candidates(cand, jobs):
    return changes.purge_candidates(cand, jobs.where("job_id % 2 = 0"), keep_rejected=True).select(*_KEYS, "rnk", "person_id")


_ROOTS = "roots AS (SELECT job_id, asc_no FROM fx_anc WHERE row_id % 23 = 5 AND asc_no > 1)"
_HIT = "EXISTS (SELECT 1 FROM roots r WHERE r.job_id = t.job_id AND length(bin(t.asc_no)) >= length(bin(r.asc_no)) AND t.asc_no // CAST(pow(2, length(bin(t.asc_no)) - length(bin(r.asc_no))) AS INT) = r.asc_no)"


@query("prune_subtree", "fx_anc", "fx_cand", sql=f"""WITH {_ROOTS}
SELECT 'ancestors' AS kept_in, job_id, asc_no, 0 AS rnk FROM fx_anc t WHERE NOT {_HIT} UNION ALL SELECT 'candidates', job_id, asc_no, rnk FROM fx_cand t WHERE NOT {_HIT}""")
def prune_subtree(anc, cand):
    roots = anc.where("row_id % 23 = 5 and asc_no > 1")
    a = changes.prune_subtree(anc, roots).select(F.lit("ancestors").alias("kept_in"), *_KEYS, F.lit(0).alias("rnk"))
    return a.unionByName(changes.prune_subtree(cand, roots).select(F.lit("candidates").alias("kept_in"), *_KEYS, "rnk"))


@query("accept", "fx_anc", "fx_job", sql="""
WITH k AS (SELECT * FROM fx_anc WHERE row_id % 6 = 1),
w AS (SELECT k.job_id, 2 * k.asc_no + s.side AS asc_no FROM k CROSS JOIN (VALUES (0), (1)) s(side) WHERE k.person_id <> '' AND 2 * k.asc_no <= 127)
SELECT 'accepted' AS what, job_id, asc_no FROM fx_anc WHERE row_id % 6 = 1 OR confidence_score >= 75 UNION ALL SELECT 'feedback', job_id, asc_no FROM k
UNION ALL SELECT 'research', job_id, asc_no FROM w WHERE NOT EXISTS (SELECT 1 FROM fx_anc a WHERE a.job_id = w.job_id AND a.asc_no = w.asc_no)""")
def accept(anc, jobs):
    with_flag = anc.withColumn("accepted", F.when(c("confidence_score") >= 75, 1).otherwise(0))
    out = changes.accept(with_flag, jobs, anc.where("row_id % 6 = 1"))
    parts = {"accepted": out["ancestors"].where("accepted = 1"), "feedback": out["feedback"], "research": out["research"]}
    dfs = [df.select(F.lit(k).alias("what"), *_KEYS) for k, df in parts.items()]
    return dfs[0].unionByName(dfs[1]).unionByName(dfs[2])


@query("reject", "fx_anc", "fx_cand", stored=False, sql=f"""WITH {_ROOTS},
rj AS (SELECT a.* FROM fx_anc a JOIN roots r ON r.job_id = a.job_id AND r.asc_no = a.asc_no WHERE a.person_id <> '')
SELECT 'ancestors' AS what, job_id, asc_no, person_id, '' AS why FROM fx_anc t WHERE NOT {_HIT} UNION ALL SELECT 'candidates', job_id, asc_no, person_id, rejection_reason FROM fx_cand t WHERE rejection_reason <> '' OR NOT {_HIT}
UNION ALL SELECT 'candidates', job_id, asc_no, person_id, 'Manually rejected by admin' FROM rj""")
def reject(anc, cand):
    out = changes.reject(anc, cand, anc.where("row_id % 23 = 5 and asc_no > 1"))
    a = out["ancestors"].select(F.lit("ancestors").alias("what"), *_KEYS, "person_id", F.lit("").alias("why"))
    return a.unionByName(out["candidates"].select(F.lit("candidates").alias("what"), *_KEYS, "person_id", c("rejection_reason").alias("why")))


@query("choose_candidate", "fx_anc", "fx_cand", sql=f"""
WITH roots AS (SELECT job_id, asc_no FROM fx_cand WHERE rnk = 2 AND asc_no % 9 = 4),
pk AS (SELECT c.*, CAST(substr(c.person_id, 2) AS INT) % 101 AS sc FROM fx_cand c WHERE rnk = 2 AND asc_no % 9 = 4)
SELECT job_id, asc_no, person_id, name, confidence_score, confidence_level FROM fx_anc t WHERE NOT {_HIT}
UNION ALL SELECT job_id, asc_no, person_id, given_name || ' ' || surname, sc, CASE WHEN sc < 50 THEN 'Suggested' ELSE {D.level('sc')} END FROM pk""")
def choose_candidate(anc, cand):
    scored = cand.withColumn("computed_score", F.substring("person_id", 2, 20).cast("int") % 101)
    picks = cand.where("rnk = 2 and asc_no % 9 = 4").select(*_KEYS, "person_id")
    # The same person may be listed twice for a slot; the choice is of the listed row.
    scored = scored.where("rnk = 2")
    out = changes.choose_candidate(anc.withColumn("accepted", F.lit(0)), scored, picks)
    return out["ancestors"].select(*_KEYS, "person_id", "name", "confidence_score", "confidence_level")


@query("edit_info", "fx_anc", sql="""
SELECT job_id, asc_no, CASE WHEN row_id % 8 = 3 THEN 'Belper, Derbyshire' ELSE birth_place END AS birth_place, CASE WHEN row_id % 16 = 3 THEN '1901' ELSE birth_date END AS birth_date,
  CASE WHEN row_id % 16 = 3 THEN 'birth_date,birth_place' WHEN row_id % 8 = 3 THEN 'birth_place' ELSE '' END AS changed, CASE WHEN row_id % 16 = 3 THEN 'records' WHEN row_id % 8 = 3 THEN 'date,records' ELSE 'location,date,records' END AS missing_info FROM fx_anc""")
def edit_info(anc):
    edits = anc.where("row_id % 8 = 3").select(*_KEYS, F.lit("Belper, Derbyshire").alias("birth_place"), F.when(c("row_id") % 16 == 3, "1901").otherwise(c("birth_date")).alias("birth_date"))
    return changes.edit_info(anc.select(*_KEYS, "birth_date", "birth_place", F.lit("location,date,records").alias("missing_info")), edits.withColumn("said", F.lit(1)), "said")


def _with_log(anc):
    return anc.select(*_KEYS, "row_id", "birth_date", "birth_place", "confidence_score", F.expr(f"cast(array() as {changes.LOG_TYPE})").alias("corrections_log"))


def _suggestions(anc):
    which = c("row_id") % 10
    return anc.where("row_id % 10 in (1, 2)").select(*_KEYS, F.when(which == 1, "confidence_score").otherwise("birth_place").alias("field"), F.lit("Belper").alias("value"), F.lit(-7).alias("adj_a"), F.lit(2).alias("adj_b"))


_NEW = "CASE WHEN row_id % 10 = 1 THEN greatest(0, confidence_score - 2) ELSE confidence_score END"


@query("apply_suggestion", "fx_anc", sql=f"""
SELECT job_id, asc_no, {_NEW} AS confidence_score, CASE WHEN row_id % 10 = 2 THEN 'Belper' ELSE birth_place END AS birth_place, CASE WHEN row_id % 10 IN (1, 2) THEN 1 ELSE 0 END AS logged,
  CASE row_id % 10 WHEN 1 THEN CAST(confidence_score AS VARCHAR) WHEN 2 THEN birth_place END AS old_value, CASE row_id % 10 WHEN 1 THEN CAST({_NEW} AS VARCHAR) WHEN 2 THEN 'Belper' END AS new_value FROM fx_anc""")
def apply_suggestion(anc):
    out = changes.apply_suggestion(_with_log(anc), _suggestions(anc))
    e = F.get("corrections_log", F.lit(0))
    return out.select(*_KEYS, "confidence_score", "birth_place", F.size("corrections_log").alias("logged"), e["old_value"].alias("old_value"), e["new_value"].alias("new_value"))


@query("undo_correction", "fx_anc", sql=f"""
SELECT job_id, asc_no, CASE WHEN row_id % 3 = 0 THEN confidence_score ELSE {_NEW} END AS confidence_score, CASE WHEN row_id % 10 = 2 AND row_id % 3 <> 0 THEN 'Belper' ELSE birth_place END AS birth_place,
  CASE WHEN row_id % 10 IN (1, 2) THEN row_id % 3 = 0 END AS undone FROM fx_anc""")
def undo_correction(anc):
    applied = changes.apply_suggestion(_with_log(anc), _suggestions(anc))
    out, _ = changes.undo_correction(applied, anc.where("row_id % 3 = 0").select(*_KEYS, F.lit(0).alias("log_index")))
    return out.select(*_KEYS, "confidence_score", "birth_place", F.get("corrections_log", F.lit(0))["undone"].alias("undone"))


@query("exclude_rejected", "fx_cand", sql="""
SELECT job_id, asc_no, rnk, person_id FROM fx_cand c WHERE NOT EXISTS (SELECT 1 FROM fx_cand r WHERE r.job_id = c.job_id AND r.person_id = c.person_id AND r.rejection_reason <> '')""")
def exclude_rejected(cand):
    from kinforge.operators.linking import exclude_rejected as op, rejected_people

    return op(cand, rejected_people(cand)).select(*_KEYS, "rnk", "person_id")


@query("distinct_rejected", "fx_cand", sql="SELECT DISTINCT job_id, person_id FROM fx_cand WHERE rejection_reason <> '' AND person_id <> ''")
def distinct_rejected(cand):
    from kinforge.operators.linking import rejected_people

    return rejected_people(cand)
