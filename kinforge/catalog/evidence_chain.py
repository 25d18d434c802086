"""The evidence loop, step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.catalog import duck as D
from kinforge.catalog.base import query
from kinforge.catalog.civil import _resolved
from kinforge.functions import places
from kinforge.functions.dates import date_year
from kinforge.operators import evidence_chain as ops
from kinforge.operators import gazetteer, linking, merge

c = F.col
_KEYS = ["job_id", "asc_no"]


def _num():
    return F.substring("person_id", 2, 30).cast("bigint")


def _cand(cand):
    """Search results with the parents' surnames and death years they may carry."""
    rej = linking.rejected_people(cand).withColumn("rejected", F.lit(True))
    rows = gazetteer.read_once(cand, "birth_place", c_place=places.sanitize_place).join(rej, ["job_id", "person_id"], "left")
    year = date_year(c("birth_date"))
    father, mother = F.when(_num() % 2 == 0, c("surname")).otherwise(""), F.when(_num() % 3 == 0, "Smith").otherwise("")
    return rows.select(*_KEYS, "rnk", "person_id", c("given_name").alias("c_given"), F.concat_ws(" ", "given_name", "surname").alias("c_name"), year.alias("c_year"), "c_place",
                       father.alias("c_father_surname"), mother.alias("c_mother_surname"), F.when(_num() % 2 == 0, year + 62).alias("death_year"), F.coalesce("rejected", F.lit(False)).alias("rejected"))


def _household_cand(cand):
    return _cand(cand).withColumnsRenamed({"c_father_surname": "father_surname", "c_mother_surname": "mother_surname"})


def _census(fact):
    return ops.census_years(fact).withColumn("person_id", F.concat(F.lit("C"), F.substring("person_id", 2, 30)))


_PPL = f"""p0 AS (SELECT a.job_id, a.asc_no, a.gen, a.confidence_level, a.given_name AS given, a.surname, {D.year('a.birth_date')} AS y, a.birth_place, {D.district('a.birth_place')} AS dt, coalesce(f.given_name, '') AS fg, coalesce(f.surname, '') AS fs, coalesce(m.given_name, '') AS mg, coalesce(m.surname, '') AS ms
 FROM fx_anc a LEFT JOIN fx_anc f ON f.job_id = a.job_id AND f.asc_no = 2 * a.asc_no LEFT JOIN fx_anc m ON m.job_id = a.job_id AND m.asc_no = 2 * a.asc_no + 1),
dm AS (SELECT dt, {_resolved('dt')} AS dk FROM (SELECT DISTINCT dt FROM p0) u), pl AS (SELECT p0.*, dm.dk FROM p0 JOIN dm ON dm.dt = p0.dt)"""

_VARS = D.spelt('s')
_PASSES = f"""q AS (SELECT DISTINCT lower(surname) AS s, lower(given) AS g, y - 5 AS y0, y + 5 AS y1, lower(dk) AS d FROM pl WHERE y IS NOT NULL),
bi AS (SELECT *, lower(surname) AS ls, string_split(lower(trim(forenames)), ' ') AS lt, lower(district) AS ld FROM fx_civil WHERE entry_type = 'birth'),
n1 AS (SELECT q.*, 1 AS pass_no, 0 AS nth, bi.* FROM q JOIN bi ON bi.ls = q.s AND list_contains(bi.lt, q.g) AND bi.year BETWEEN q.y0 AND q.y1 AND (q.d = '' OR q.d = bi.ld)),
nw AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY s, g, y0, d) AS hits FROM n1) t),
fq AS (SELECT q.* FROM q LEFT JOIN (SELECT s, g, y0, d, count(*) AS n FROM nw GROUP BY 1, 2, 3, 4) k ON k.s = q.s AND k.g = q.g AND k.y0 = q.y0 AND k.d = q.d WHERE coalesce(n, 0) < 3 AND q.d <> ''),
br AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY s, g, y0, d) AS hits FROM (SELECT fq.*, 2 AS pass_no, 0 AS nth, bi.* FROM fq JOIN bi ON bi.ls = fq.s AND list_contains(bi.lt, fq.g) AND bi.year BETWEEN fq.y0 AND fq.y1) z) t),
nq AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.s = q.s AND nw.g = q.g AND nw.y0 = q.y0 AND nw.d = q.d) AND NOT EXISTS (SELECT 1 FROM br WHERE br.s = q.s AND br.g = q.g AND br.y0 = q.y0 AND br.d = q.d)),
vq AS (SELECT *, unnest({_VARS}) AS v, generate_subscripts({_VARS}, 1) - 1 AS vn FROM nq),
vr AS (SELECT vq.s, vq.g, vq.y0, vq.y1, vq.d, 3 AS pass_no, vq.vn AS nth, bi.*, 0 AS hits FROM vq JOIN bi ON bi.ls = vq.v AND list_contains(bi.lt, vq.g) AND bi.year BETWEEN vq.y0 AND vq.y1),
al AS (SELECT *, row_number() OVER (PARTITION BY s, g, y0, d, volume, page ORDER BY pass_no, nth, entry_id) AS again FROM (SELECT * FROM nw UNION ALL SELECT * FROM br UNION ALL SELECT * FROM vr) u),
pu AS (SELECT * FROM al WHERE pass_no = 1 OR volume = '' OR again = 1)"""

_HYP = f"""hy0 AS (SELECT pl.job_id, pl.asc_no, pu.pass_no, pu.nth, pu.entry_id, pu.surname AS h_surname, pu.forenames AS h_forenames, pu.year AS h_year, pu.district AS h_district, pu.spouse_surname AS h_maiden,
  CASE WHEN {D.similar('pu.forenames', 'pl.given')} THEN 20 WHEN starts_with(lower(pu.forenames), lower(split_part(pl.given, ' ', 1))) THEN 15 ELSE 0 END + CASE abs(pu.year - pl.y) WHEN 0 THEN 20 WHEN 1 THEN 15 WHEN 2 THEN 10 WHEN 3 THEN 10 ELSE 5 END
  + CASE WHEN pl.dt = '' THEN 0 WHEN lower(pl.dt) = lower(pu.district) THEN 15 WHEN contains(lower(pl.dt), lower(pu.district)) OR contains(lower(pu.district), lower(pl.dt)) THEN 10 WHEN {D.district_match('pl.dt', 'pu.district')} THEN 8 ELSE 0 END
  + CASE WHEN pl.ms = '' OR pu.spouse_surname = '' THEN 0 WHEN lower(pl.ms) = lower(pu.spouse_surname) THEN 30 WHEN contains(lower(pl.ms), lower(pu.spouse_surname)) OR contains(lower(pu.spouse_surname), lower(pl.ms)) THEN 15 ELSE 0 END AS score
  FROM pl JOIN pu ON pu.s = lower(pl.surname) AND pu.g = lower(pl.given) AND pu.y0 = pl.y - 5 AND pu.d = lower(pl.dk)),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY score DESC, pass_no, nth, entry_id) AS hyp FROM hy0) t WHERE hyp <= 15)"""


@query("pass_union", "fx_anc", "fx_civil", sql=f"WITH {_PPL}, {_PASSES} SELECT s AS surname_key, g AS given_key, y0 AS year_from, d AS district_key, pass_no, entry_id FROM pu")
def pass_union(anc, civil):
    return ops.pass_union(ops.people_of(anc, civil), civil).select("surname_key", "given_key", "year_from", "district_key", "pass_no", "entry_id")


@query("birth_hypotheses", "fx_anc", "fx_civil", sql=f"WITH {_PPL}, {_PASSES}, {_HYP} SELECT job_id, asc_no, hyp, score, pass_no, entry_id, h_surname, h_forenames, h_year, h_district, h_maiden FROM hy")
def birth_hypotheses(anc, civil):
    return ops.birth_hypotheses(ops.people_of(anc, civil), civil)


_HH = f"""rjc AS (SELECT DISTINCT job_id, person_id FROM fx_cand WHERE rejection_reason <> ''),
cd AS (SELECT c.job_id, c.asc_no, c.rnk, c.person_id, c.given_name AS cg, c.given_name || ' ' || c.surname AS c_name, {D.year('c.birth_date')} AS cy, c.birth_place AS cpl, CASE WHEN CAST(substr(c.person_id, 2) AS BIGINT) % 2 = 0 THEN c.surname ELSE '' END AS cfs, CASE WHEN CAST(substr(c.person_id, 2) AS BIGINT) % 3 = 0 THEN 'Smith' ELSE '' END AS cms,
  CASE WHEN CAST(substr(c.person_id, 2) AS BIGINT) % 2 = 0 THEN {D.year('c.birth_date')} + 62 END AS death_year, rjc.person_id IS NOT NULL AS rejected FROM fx_cand c LEFT JOIN rjc ON rjc.job_id = c.job_id AND rjc.person_id = c.person_id),
cn AS (SELECT 'C' || substr(person_id, 2) AS person_id, list(year ORDER BY seq) AS census FROM (SELECT person_id, TRY_CAST(regexp_extract(fact_date, '(\\d{{4}})', 1) AS INT) AS year, min(seq) AS seq FROM fx_fact WHERE fact_type LIKE '%Census' AND fact_date <> '' GROUP BY 1, 2) z GROUP BY 1),
hr AS (SELECT hy.*, cd.rnk, cd.person_id, cd.c_name, cd.death_year, cn.census, cd.person_id IS NOT NULL AND NOT cd.rejected AND NOT ({D.foreign('cd.cpl')} AND NOT {D.uk('cd.cpl')}) AS usable, list_filter(cn.census, lambda v: v - hy.h_year BETWEEN 0 AND 15)[1] AS child,
  CASE WHEN {D.similar("split_part(cd.cg, ' ', 1)", 'hy.h_forenames')} THEN 20 ELSE 0 END + CASE WHEN cd.cpl = '' OR cd.cpl IS NULL THEN 0 WHEN contains(lower(cd.cpl), lower(hy.h_district)) THEN 15 WHEN {D.district_match('hy.h_district', D.district('cd.cpl'))} THEN 10 ELSE 0 END
  + CASE WHEN abs(cd.cy - hy.h_year) <= 1 THEN 15 WHEN abs(cd.cy - hy.h_year) <= 2 THEN 10 WHEN abs(cd.cy - hy.h_year) <= 3 THEN 5 ELSE 0 END + CASE WHEN cd.cfs <> '' AND lower(cd.cfs) = lower(hy.h_surname) THEN 15 ELSE 0 END
  + CASE WHEN cd.cms <> '' AND hy.h_maiden <> '' AND lower(cd.cms) = lower(hy.h_maiden) THEN 25 ELSE 0 END + CASE WHEN list_filter(cn.census, lambda v: v - hy.h_year BETWEEN 0 AND 15)[1] IS NOT NULL THEN 10 ELSE 0 END AS hs
  FROM hy LEFT JOIN cd ON cd.job_id = hy.job_id AND cd.asc_no = hy.asc_no LEFT JOIN cn ON cn.person_id = cd.person_id),
hg AS (SELECT job_id, asc_no, hyp, count(person_id) AS results, count(CASE WHEN usable THEN child END) AS census_hits, coalesce(list(CASE WHEN usable THEN child END) FILTER (WHERE usable AND child IS NOT NULL), CAST([] AS INT[])) AS census_seen FROM hr GROUP BY 1, 2, 3),
hb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no, hyp ORDER BY hs DESC, rnk) AS n FROM hr WHERE usable AND hs > 0) t WHERE n = 1),
mt AS (SELECT hy.*, hg.census_hits, hg.census_seen, coalesce(hb.hs, 0) AS household_score, hb.person_id, hb.c_name, hb.death_year, hb.census, CASE WHEN hg.results = 0 THEN 'hypothesis' WHEN coalesce(hb.hs, 0) >= 60 THEN 'primary' WHEN coalesce(hb.hs, 0) >= 30 THEN 'alternate' ELSE 'discarded' END AS status
  FROM hy JOIN hg ON hg.job_id = hy.job_id AND hg.asc_no = hy.asc_no AND hg.hyp = hy.hyp LEFT JOIN hb ON hb.job_id = hy.job_id AND hb.asc_no = hy.asc_no AND hb.hyp = hy.hyp)"""


@query("household_match", "fx_anc", "fx_civil", "fx_cand", "fx_fact", sql=f"WITH {_PPL}, {_PASSES}, {_HYP}, {_HH} SELECT job_id, asc_no, hyp, status, household_score, person_id, census_hits FROM mt")
def household_match(anc, civil, cand, fact):
    people = ops.people_of(anc, civil)
    hyps = ops.settled(lambda: ops.birth_hypotheses(people, civil))
    return ops.household_match(hyps, _household_cand(cand), _census(fact)).select(*_KEYS, "hyp", "status", "household_score", "person_id", "census_hits")


def _gap_sql(y: str, e: str) -> str:
    return f"CASE WHEN {y} - {e} BETWEEN 0 AND 5 THEN 20 WHEN {y} - {e} BETWEEN 0 AND 10 THEN 15 WHEN {y} - {e} BETWEEN 0 AND 15 THEN 10 ELSE 0 END"


def _couple_side(rows: str, who: str, given: str, spouse: str, side: int) -> str:
    return (f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY job_id, asc_no, hyp) AS hits, row_number() OVER (PARTITION BY job_id, asc_no, hyp ORDER BY score DESC, entry_id) AS rn FROM (SELECT a.job_id, a.asc_no, a.hyp, {side} AS side, e.entry_id, e.surname AS e_s, e.spouse_surname AS e_sp, e.year AS e_y, e.district AS e_d, "
            f"25 + CASE WHEN lower(e.spouse_surname) = lower({spouse}) THEN 30 ELSE 0 END + CASE WHEN {given} <> '' AND {D.similar('e.forenames', given)} THEN 15 ELSE 0 END + {_gap_sql('a.h_year', 'e.year')} + CASE WHEN lower(e.district) = lower(a.h_district) THEN 10 WHEN {D.district_match('lower(a.h_district)', 'e.district')} THEN 5 ELSE 0 END AS score "
            f"FROM {rows} a JOIN fx_civil e ON e.entry_type = 'marriage' AND lower(e.surname) = lower({who}) AND ({given} = '' OR {D.has_name('e.forenames', D.first_word(given))}) AND e.year BETWEEN a.h_year - 15 AND a.h_year AND lower(e.district) = lower(a.h_district)) z) t WHERE rn = 1")


_WED = f"""lv AS (SELECT mt.*, pl.fg, pl.mg, CASE WHEN mt.h_maiden <> '' THEN mt.h_maiden ELSE pl.ms END AS wife FROM mt JOIN pl ON pl.job_id = mt.job_id AND pl.asc_no = mt.asc_no WHERE status <> 'discarded'),
lw AS (SELECT * FROM lv WHERE wife <> ''), gm AS ({_couple_side('lw', 'a.h_surname', 'a.fg', 'a.wife', 1)}),
lb AS (SELECT * FROM lw WHERE mg <> '' AND NOT EXISTS (SELECT 1 FROM gm WHERE gm.job_id = lw.job_id AND gm.asc_no = lw.asc_no AND gm.hyp = lw.hyp AND gm.score >= 60)), bd AS ({_couple_side('lb', 'a.wife', 'a.mg', 'a.h_surname', 2)}),
wd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no, hyp ORDER BY score DESC, side) AS n FROM (SELECT * FROM gm UNION ALL SELECT * FROM bd) u WHERE score >= 40) t WHERE n = 1)"""


@query("parent_couple", "fx_anc", "fx_civil", "fx_cand", "fx_fact", sql=f"WITH {_PPL}, {_PASSES}, {_HYP}, {_HH}, {_WED} SELECT job_id, asc_no, hyp, side, score, entry_id, e_y AS entry_year FROM wd")
def parent_couple(anc, civil, cand, fact):
    people = ops.people_of(anc, civil)
    hyps = ops.settled(lambda: ops.birth_hypotheses(people, civil, parents=True))
    matched = ops.settled(lambda: ops.household_match(hyps, _household_cand(cand), _census(fact)).select(*hyps.columns, "status"))  # no more of it is read further on
    return ops.parent_couple(matched.where("status <> 'discarded'"), people, civil).select(*_KEYS, "hyp", "side", "score", "entry_id", "entry_year")


_CROSS = f"""cr AS (SELECT lv.job_id, lv.asc_no, lv.hyp, CASE WHEN lower(lv.h_surname) = lower(wd.e_s) THEN 15 ELSE 0 END + CASE WHEN lv.h_maiden <> '' AND lower(lv.h_maiden) = lower(wd.e_sp) THEN 15 ELSE 0 END + CASE WHEN lower(lv.h_district) = lower(wd.e_d) THEN 10 WHEN {D.district_match('lv.h_district', 'wd.e_d')} THEN 5 ELSE 0 END
  + CASE WHEN lv.h_year - wd.e_y BETWEEN 0 AND 15 THEN 10 ELSE 0 END AS crosscheck FROM lv JOIN wd ON wd.job_id = lv.job_id AND wd.asc_no = lv.asc_no AND wd.hyp = lv.hyp)"""

_REINF = f"""dq AS (SELECT DISTINCT split_part(c_name, ' ', 1) AS f, split_part(c_name, ' ', -1) AS l, death_year AS dy FROM lv WHERE person_id IS NOT NULL AND death_year BETWEEN 1837 AND 1983),
dc AS (SELECT f, l, dy, count(*) AS n, max(40 + CASE WHEN starts_with(lower(e.forenames), lower(f)) THEN 30 ELSE 0 END + CASE WHEN e.year = dy THEN 20 ELSE 0 END) AS best FROM dq JOIN fx_civil e ON e.entry_type = 'death' AND lower(e.surname) = lower(l) AND {D.has_name('e.forenames', 'f')} AND e.year BETWEEN dy - 1 AND dy + 1 GROUP BY 1, 2, 3),
sw AS (SELECT DISTINCT lower(h_surname) AS s, lower(h_district) AS d, h_year AS y FROM lv), sc AS (SELECT sw.s, sw.d, sw.y, count(*) AS n FROM sw JOIN fx_civil e ON e.entry_type = 'birth' AND lower(e.surname) = sw.s AND lower(e.district) = sw.d AND abs(e.year - sw.y) <= 8 GROUP BY 1, 2, 3),
re AS (SELECT lv.*, coalesce(lv.h_maiden <> '' AND EXISTS (SELECT 1 FROM fx_civil e WHERE e.entry_type = 'birth' AND lower(e.surname) = lower(lv.h_surname) AND lower(e.district) = lower(lv.h_district) AND lower(e.spouse_surname) = lower(lv.h_maiden) AND abs(e.year - lv.h_year) <= 8 AND (e.year <> lv.h_year OR lower(e.forenames) <> lower(lv.h_forenames))), false) AS sibling,
  coalesce(dc.best >= 50, false) AS death, lv.person_id IS NOT NULL AND len(list_filter(coalesce(lv.census, CAST([] AS INT[])), lambda v: len(list_filter(lv.census_seen, lambda e: abs(e - v) < 8)) = 0)) > 0 AS later_census
  FROM lv LEFT JOIN sc ON sc.s = lower(lv.h_surname) AND sc.d = lower(lv.h_district) AND sc.y = lv.h_year LEFT JOIN dc ON lv.person_id IS NOT NULL AND dc.f = split_part(lv.c_name, ' ', 1) AND dc.l = split_part(lv.c_name, ' ', -1) AND dc.dy = lv.death_year)"""

_TRI = """CAST(CASE WHEN NOT marriage THEN least(65, raw) WHEN NOT verified THEN least(60, raw) ELSE raw END AS INT)"""
_SCORE = f"""ev AS (SELECT re.job_id, re.asc_no, re.hyp, re.entry_id, re.status, re.household_score, re.person_id, re.census_hits, re.sibling, re.death, re.later_census, wd.entry_id IS NOT NULL AS marriage, coalesce(cr.crosscheck >= 25, false) AS verified, coalesce(cr.crosscheck, 0) AS crosscheck,
   CASE WHEN re.pass_no = 3 THEN 20 ELSE 25 END + 15 * re.census_hits + CASE WHEN wd.entry_id IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN re.sibling THEN 15 ELSE 0 END + CASE WHEN re.death THEN 10 ELSE 0 END + CASE WHEN re.later_census THEN 10 ELSE 0 END AS w
   FROM re LEFT JOIN wd ON wd.job_id = re.job_id AND wd.asc_no = re.asc_no AND wd.hyp = re.hyp LEFT JOIN cr ON cr.job_id = re.job_id AND cr.asc_no = re.asc_no AND cr.hyp = re.hyp),
e2 AS (SELECT *, marriage AND (census_hits > 0 OR later_census OR sibling) AS closed FROM ev),
e3 AS (SELECT *, CASE WHEN closed AND (sibling OR death OR later_census) THEN least(100, 85 + least(15, w - 55)) WHEN closed THEN least(89, 75 + least(14, w - 40)) WHEN marriage OR sibling OR death THEN least(74, 50 + least(24, w - 25)) ELSE least(49, 25 + least(24, w - 10)) END AS raw FROM e2),
e4 AS (SELECT *, {_TRI} AS confidence FROM e3)"""
_ALL = f"{_PPL}, {_PASSES}, {_HYP}, {_HH}, {_WED}, {_CROSS}, {_REINF}, {_SCORE}"
_CHAIN_IN = ("fx_anc", "fx_civil", "fx_cand", "fx_fact")


def _kept(sql: str) -> str:
    """Each step worked out once, however often it is read."""
    return sql.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


def _chain(anc, civil, cand, fact):
    return ops.chain(ops.people_of(anc, civil), _household_cand(cand), _census(fact), civil)


@query("family_crosscheck", *_CHAIN_IN, sql=f"WITH {_ALL} SELECT job_id, asc_no, hyp, crosscheck, verified FROM e4 WHERE marriage")
def family_crosscheck(anc, civil, cand, fact):
    return _chain(anc, civil, cand, fact)[0].where("marriage").select(*_KEYS, "hyp", "crosscheck", "verified")


@query("reinforcements", *_CHAIN_IN, sql=f"WITH {_ALL} SELECT job_id, asc_no, hyp, sibling, death, later_census FROM e4")
def reinforcements(anc, civil, cand, fact):
    return _chain(anc, civil, cand, fact)[0].select(*_KEYS, "hyp", "sibling", "death", "later_census")


@query("evidence_strength", *_CHAIN_IN, sql=f"WITH {_ALL} SELECT job_id, asc_no, hyp, confidence, closed AS triangle, 1 + CASE WHEN marriage THEN 1 ELSE 0 END + CASE WHEN sibling THEN 1 ELSE 0 END + CASE WHEN death THEN 1 ELSE 0 END AS independent FROM e4")
def evidence_strength(anc, civil, cand, fact):
    t = c("marriage") & ((c("census_hits") > 0) | c("later_census") | c("sibling"))
    ind = F.lit(1) + c("marriage").cast("int") + c("sibling").cast("int") + c("death").cast("int")
    return _chain(anc, civil, cand, fact)[0].select(*_KEYS, "hyp", "confidence", t.alias("triangle"), ind.alias("independent"))


@query("triangle_confidence", *_CHAIN_IN, sql=_kept(f"""WITH {_ALL}, gd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY hyp) AS n FROM e4 WHERE confidence >= 50) t WHERE n = 1),
al2 AS (SELECT job_id, asc_no, entry_id, confidence FROM gd UNION ALL SELECT job_id, asc_no, entry_id, least(49, 25 + least(24, CASE WHEN pass_no = 3 THEN 20 ELSE 25 END + 15 * census_hits - 10)) FROM mt WHERE hyp = 1 AND NOT EXISTS (SELECT 1 FROM gd WHERE gd.job_id = mt.job_id AND gd.asc_no = mt.asc_no))
SELECT job_id, asc_no, entry_id, CAST(confidence AS INT) AS confidence, {D.level('confidence')} AS level FROM al2"""))
def triangle_confidence(anc, civil, cand, fact):
    return _chain(anc, civil, cand, fact)[1].select(*_KEYS, "entry_id", "confidence", "level")


_LEFT = "lf AS (SELECT pl.* FROM pl WHERE NOT EXISTS (SELECT 1 FROM hy WHERE hy.job_id = pl.job_id AND hy.asc_no = pl.asc_no))"


@query("lead_only", *_CHAIN_IN, sql=f"""WITH {_PPL}, {_PASSES}, {_HYP}, {_HH}, {_LEFT},
lr AS (SELECT lf.job_id, lf.asc_no, cd.person_id, cd.c_name, cd.rnk, CASE WHEN {D.similar("split_part(cd.cg, ' ', 1)", 'lf.given')} THEN 20 ELSE 0 END + CASE WHEN abs(cd.cy - lf.y) <= 3 THEN 15 ELSE 0 END + CASE WHEN cd.cpl <> '' AND lf.birth_place <> '' AND contains(lower(cd.cpl), lower(lf.dt)) THEN 10 ELSE 0 END
  + CASE WHEN lf.fs <> '' AND lower(cd.cfs) = lower(lf.fs) THEN 15 ELSE 0 END + CASE WHEN lf.ms <> '' AND lower(cd.cms) = lower(lf.ms) THEN 20 ELSE 0 END AS sc FROM lf JOIN cd ON cd.job_id = lf.job_id AND cd.asc_no = lf.asc_no AND NOT cd.rejected AND NOT ({D.foreign('cd.cpl')} AND NOT {D.uk('cd.cpl')})),
lb2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY sc DESC, rnk) AS n FROM lr WHERE sc >= 25) t WHERE n = 1),
o AS (SELECT lf.job_id, lf.asc_no, coalesce(lb2.person_id, '') AS person_id, coalesce(lb2.c_name, lf.given || ' ' || lf.surname || ' (not found)') AS name, CASE WHEN lb2.sc IS NULL THEN 0 ELSE least(49, 25 + lb2.sc) END AS confidence FROM lf LEFT JOIN lb2 ON lb2.job_id = lf.job_id AND lb2.asc_no = lf.asc_no)
SELECT *, {D.level('confidence')} AS level FROM o""")
def lead_only(anc, civil, cand, fact):
    people = ops.people_of(anc, civil)
    return ops.lead_only(people, ops.settled(lambda: ops.birth_hypotheses(people, civil)), _cand(cand))


@query("enrich_known", *_CHAIN_IN, sql=f"""WITH {_PPL}, {_PASSES}, {_HYP}, {_HH},
ku AS (SELECT * FROM pl WHERE confidence_level = 'Customer Data'),
be AS (SELECT * FROM (SELECT ku.job_id, ku.asc_no, bi.entry_id, row_number() OVER (PARTITION BY ku.job_id, ku.asc_no ORDER BY bi.entry_id) AS n FROM ku JOIN bi ON bi.ls = lower(ku.surname) AND list_contains(bi.lt, {D.first_word('ku.given')}) AND bi.year BETWEEN ku.y - 2 AND ku.y + 2 AND (ku.dk = '' OR bi.district = ku.dk) AND {D.similar('bi.forenames', 'ku.given')}) t WHERE n = 1),
le AS (SELECT * FROM (SELECT ku.job_id, ku.asc_no, cd.person_id, row_number() OVER (PARTITION BY ku.job_id, ku.asc_no ORDER BY cd.rnk) AS n FROM ku JOIN cd ON cd.job_id = ku.job_id AND cd.asc_no = ku.asc_no AND NOT cd.rejected AND NOT ({D.foreign('cd.cpl')} AND NOT {D.uk('cd.cpl')}) AND {D.similar("split_part(cd.cg, ' ', 1)", 'ku.given')} AND NOT coalesce(abs(cd.cy - ku.y) > 5, false)) t WHERE n = 1)
SELECT ku.job_id, ku.asc_no, 100 AS confidence, be.entry_id AS birth_entry, le.person_id AS lead_id FROM ku LEFT JOIN be ON be.job_id = ku.job_id AND be.asc_no = ku.asc_no LEFT JOIN le ON le.job_id = ku.job_id AND le.asc_no = ku.asc_no WHERE be.entry_id IS NOT NULL OR le.person_id IS NOT NULL""")
def enrich_known(anc, civil, cand, fact):
    return ops.enrich_known(ops.people_of(anc, civil), _cand(cand), civil)


@query("parent_profile", "fx_anc", "fx_civil", sql=f"""WITH {_PPL},
r AS (SELECT job_id, asc_no, 2 * asc_no AS parent_slot, fg AS given, CASE WHEN fs <> '' THEN fs ELSE surname END AS surname, y - 28 AS year, birth_place AS place FROM pl WHERE fg <> '' OR fs <> '' UNION ALL SELECT job_id, asc_no, 2 * asc_no + 1, mg, ms, y - 25, birth_place FROM pl WHERE mg <> '' OR ms <> ''),
an AS (SELECT job_id, asc_no, given, surname, y FROM pl WHERE confidence_level = 'Customer Data')
SELECT r.job_id, r.asc_no, r.parent_slot, coalesce(an.given, r.given) AS given, coalesce(an.surname, r.surname) AS surname, coalesce(an.y, r.year) AS year, r.place FROM r LEFT JOIN an ON an.job_id = r.job_id AND an.asc_no = r.parent_slot""")
def parent_profile(anc, civil):
    people = ops.people_of(anc, civil)
    return ops.parent_profiles(people, people.where("confidence_level = 'Customer Data'"))


def _cm_side(rows: str, who: str, given: str, spouse: str, side: int, gap: str) -> str:
    return (f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY job_id, asc_no) AS hits, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY score DESC, entry_id) AS rn FROM (SELECT a.job_id, a.asc_no, {side} AS side, e.entry_id, e.year AS e_y, e.district AS e_d, "
            f"20 + CASE WHEN {given} <> '' AND {D.similar('e.forenames', given)} THEN 20 ELSE 0 END + CASE WHEN lower(e.spouse_surname) = lower({spouse}) THEN 30 ELSE 0 END + {gap} + CASE WHEN a.dt2 <> '' AND lower(e.district) = lower(a.dt2) THEN 10 WHEN {D.district_match('a.dt2', 'e.district')} THEN 5 ELSE 0 END AS score "
            f"FROM {rows} a JOIN fx_civil e ON e.entry_type = 'marriage' AND lower(e.surname) = lower({who}) AND ({given} = '' OR {D.has_name('e.forenames', D.first_word(given))}) AND e.year BETWEEN a.lo AND a.hi AND (a.dk2 = '' OR e.district = a.dk2)) z) t WHERE rn = 1")


_G1 = "CASE WHEN a.ky IS NOT NULL THEN CASE WHEN a.ky - e.year BETWEEN 0 AND 5 THEN 15 WHEN a.ky - e.year BETWEEN 0 AND 10 THEN 10 WHEN a.ky - e.year BETWEEN 0 AND 15 THEN 5 ELSE 0 END WHEN e.year - a.y BETWEEN 20 AND 35 THEN 10 ELSE 0 END"
_G2 = "CASE WHEN a.ky IS NOT NULL THEN CASE WHEN a.ky - e.year BETWEEN 0 AND 5 THEN 15 WHEN a.ky - e.year BETWEEN 0 AND 10 THEN 10 ELSE 0 END WHEN e.year - a.wy BETWEEN 18 AND 35 THEN 10 ELSE 0 END"


@query("couple_marriage", "fx_anc", "fx_civil", sql=f"""WITH {_PPL},
c0 AS (SELECT h.job_id, h.asc_no, h.surname AS man, h.given AS mgn, w.surname AS wife, w.given AS wgn, h.y, w.y AS wy, k.y AS ky, {D.district("CASE WHEN h.birth_place <> '' THEN h.birth_place ELSE w.birth_place END")} AS dt2, coalesce(k.y - 15, h.y + 18) AS lo, coalesce(k.y, h.y + 45) AS hi
  FROM pl h JOIN pl w ON w.job_id = h.job_id AND h.asc_no % 2 = 0 AND w.asc_no = h.asc_no + 1 LEFT JOIN pl k ON k.job_id = h.job_id AND k.asc_no = h.asc_no // 2 WHERE k.y IS NOT NULL OR h.y IS NOT NULL),
c1 AS (SELECT c0.*, coalesce(dm.dk, '') AS dk2 FROM c0 LEFT JOIN dm ON dm.dt = c0.dt2), g1 AS ({_cm_side('c1', 'a.man', 'a.mgn', 'a.wife', 1, _G1)}),
c2 AS (SELECT * FROM c1 WHERE NOT EXISTS (SELECT 1 FROM g1 WHERE g1.job_id = c1.job_id AND g1.asc_no = c1.asc_no AND g1.score >= 50)), g2 AS ({_cm_side('c2', 'a.wife', 'a.wgn', 'a.man', 2, _G2)}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY score DESC, side) AS n FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2) u WHERE score >= 40) t WHERE n = 1)
SELECT job_id, asc_no + s.o AS asc_no, score, side, entry_id, e_y AS marriage_year, e_d AS marriage_district FROM b CROSS JOIN (VALUES (0), (1)) s(o)""")
def couple_marriage(anc, civil):
    return ops.couple_marriage(ops.people_of(anc, civil), civil)


@query("multi_source_bonus", "fx_src", sql="""
SELECT person_id, count(DISTINCT title) AS n, CASE WHEN count(DISTINCT title) >= 3 THEN 15 WHEN count(DISTINCT title) = 2 THEN 10 ELSE 0 END AS bonus FROM fx_src GROUP BY 1""")
def multi_source_bonus(src):
    from kinforge.functions.evidence import multi_source_bonus as rule

    # Two steps, so a person with many repeated titles is reduced before it is counted.
    n = src.groupBy("person_id", "title").agg(F.lit(1).alias("one")).groupBy("person_id").agg(F.sum("one").alias("n"))
    return n.select("person_id", "n", rule(c("n")).alias("bonus"))


def _results(cand):
    """Search results of three sources in arrival order; two of them spell some names their own way."""
    which = (c("rnk") % 3).cast("int")
    src = F.element_at(F.array(F.lit("tree"), F.lit("profiles"), F.lit("civil")), which + 1)
    given = F.when((which == 1) & (c("given_name") == "Walter"), "Walt").otherwise(F.substring_index("given_name", " ", 1))
    return cand.select("job_id", "asc_no", "rnk", "person_id", F.concat_ws(" ", given, "surname").alias("name"), "birth_date", "birth_place", src.alias("source"),
                       F.when(c("rnk") % 2 == 0, F.concat(F.lit("19"), 50 + c("rnk"))).otherwise("").alias("death_date"), F.when(c("rnk") % 3 == 0, "Belper").otherwise("").alias("death_place"),
                       F.when(c("rnk") % 4 == 1, F.concat_ws(" ", F.lit("John"), "surname")).otherwise("").alias("father_name"), F.when(c("rnk") % 4 == 2, "Ann Cox").otherwise("").alias("mother_name"))


_MORE = ("death_date", "death_place", "father_name", "mother_name")
_MORE_SQL = ", ".join(f"arg_min({x}, rnk) FILTER (WHERE {x} <> '') AS {x}" for x in _MORE)
_ALIKE = "(starts_with({a}, {b}) OR starts_with({b}, {a}) OR (length({a}) >= 3 AND length({b}) >= 3 AND left({a}, 3) = left({b}, 3)))"
_HIT = ("list_filter(w.leaders, lambda l: " + _ALIKE.format(a="e.f", b="l.f") + " AND " + _ALIKE.format(a="e.k", b="l.k") + " AND (e.y IS NULL OR l.y IS NULL OR abs(e.y - l.y) <= 3))[1]")
_MERGE = f"""r AS (SELECT job_id, asc_no, rnk, person_id, CASE WHEN rnk % 3 = 1 AND given_name = 'Walter' THEN 'Walt' ELSE split_part(given_name, ' ', 1) END || ' ' || surname AS name, birth_date, birth_place, ['tree', 'profiles', 'civil'][rnk % 3 + 1] AS source,
  CASE WHEN rnk % 2 = 0 THEN '19' || (50 + rnk) ELSE '' END AS death_date, CASE WHEN rnk % 3 = 0 THEN 'Belper' ELSE '' END AS death_place, CASE WHEN rnk % 4 = 1 THEN 'John ' || surname ELSE '' END AS father_name, CASE WHEN rnk % 4 = 2 THEN 'Ann Cox' ELSE '' END AS mother_name FROM fx_cand),
kr AS (SELECT *, split_part(lower(name), ' ', 1) AS f, split_part(lower(name), ' ', -1) AS k, TRY_CAST(regexp_extract(birth_date, '(\\d{{4}})', 1) AS INT) AS y FROM r),
ex AS (SELECT job_id, asc_no, f, k, y, min(rnk) AS seq, arg_min(name, rnk) AS name, arg_min(birth_date, rnk) FILTER (WHERE birth_date <> '') AS birth_date, arg_min(birth_place, rnk) FILTER (WHERE birth_place <> '') AS birth_place, {_MORE_SQL} FROM kr GROUP BY 1, 2, 3, 4, 5),
eo AS (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY seq) AS pos FROM ex),
w0 AS (SELECT job_id, asc_no, CAST(0 AS BIGINT) AS pos, CAST(NULL AS INT) AS seq, CAST(NULL AS INT) AS lead, CAST([] AS STRUCT(f VARCHAR, k VARCHAR, y INT, seq INT)[]) AS leaders FROM (SELECT DISTINCT job_id, asc_no FROM ex) j),
wk AS (SELECT * FROM w0 UNION ALL SELECT w.job_id, w.asc_no, e.pos, e.seq, coalesce({_HIT}.seq, e.seq), CASE WHEN {_HIT} IS NULL THEN list_append(w.leaders, {{'f': e.f, 'k': e.k, 'y': e.y, 'seq': e.seq}}) ELSE w.leaders END FROM wk w JOIN eo e ON e.job_id = w.job_id AND e.asc_no = w.asc_no AND e.pos = w.pos + 1),
ld AS (SELECT job_id, asc_no, seq, lead FROM wk WHERE seq IS NOT NULL), al AS (SELECT kr.job_id, kr.asc_no, ld.lead, kr.source, min(kr.rnk) AS s FROM kr JOIN ex ON ex.job_id = kr.job_id AND ex.asc_no = kr.asc_no AND ex.f = kr.f AND ex.k = kr.k AND ex.y IS NOT DISTINCT FROM kr.y JOIN ld ON ld.job_id = ex.job_id AND ld.asc_no = ex.asc_no AND ld.seq = ex.seq GROUP BY 1, 2, 3, 4),
sr AS (SELECT job_id, asc_no, lead, string_agg(source, ',' ORDER BY s) AS sources, count(*) AS n_ids FROM al GROUP BY 1, 2, 3)"""


@query("merge_results", "fx_cand", sql=f"""WITH RECURSIVE {_MERGE}
SELECT sr.job_id, sr.asc_no, sr.lead AS leader_rnk, ex.name, ex.birth_date, ex.birth_place, {', '.join('ex.' + x for x in _MORE)}, sr.sources, sr.n_ids FROM sr JOIN ex ON ex.job_id = sr.job_id AND ex.asc_no = sr.asc_no AND ex.seq = sr.lead""")
def merge_results(cand):
    m = merge.merge_results(_results(cand))
    return m.select("job_id", "asc_no", "leader_rnk", "name", "birth_date", "birth_place", *_MORE, F.array_join("sources", ",").alias("sources"), F.size("source_ids").alias("n_ids"))
