"""Linking, assignment and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.catalog import duck as D
from kinforge.catalog.base import query
from kinforge.functions import names
from kinforge.functions.dates import date_year
from kinforge.operators import gazetteer, linking, scoring
from kinforge.sources import tree_api

c = F.col
_KEYS = ["job_id", "asc_no"]

_REJ = "rj AS (SELECT DISTINCT job_id, person_id FROM fx_cand WHERE rejection_reason <> '')"
_VER = f"vf AS (SELECT person_id, CAST(count(*) FILTER (WHERE {D.category('title')} IN ('Civil Registration', 'Census', '1939 Register', 'Parish Register')) AS INT) AS pc FROM fx_src GROUP BY 1)"


def _verify(src, prefix="C"):
    """Primary source counts; search results carry their own id prefix."""
    v = scoring.source_verify(src)
    return v.withColumn("person_id", F.concat(F.lit(prefix), F.substring("person_id", 2, 30)))


def _gazetteer(town):
    return gazetteer.gazetteer_table(town.sparkSession, town)


def _num(col="person_id"):
    return F.substring(col, 2, 30).cast("bigint")


@query("name_parts_explode", "fx_anc", sql="""
SELECT row_id, unnest(string_split(surname, '-') || CASE WHEN row_id % 3 = 0 THEN ['Griffin'] ELSE [] END) AS part FROM fx_anc""")
def name_parts_explode(anc):
    double = F.when(c("row_id") % 3 == 0, F.concat("surname", F.lit("-Griffin"))).otherwise(c("surname"))
    return anc.select("row_id", F.explode(names.surname_halves(double)).alias("part"))


@query("newly_found", "fx_anc", sql="SELECT job_id, asc_no, person_id FROM fx_anc WHERE person_id <> '' AND gen = 4")
def newly_found(anc):
    return linking.newly_found(anc.where("gen <= 4"), anc.where("gen <= 3")).select(*_KEYS, "person_id")


_SIG = f"""t AS (SELECT job_id, asc_no, lower(surname) AS s, lower(given_name) AS g, {D.year('birth_date')} AS y, lower({D.district('birth_place')}) AS d FROM fx_anc WHERE person_id = '' AND {D.year('birth_date')} IS NOT NULL),
p AS (SELECT person_id, lower(surname) AS k, lower(given_name) AS g, {D.year('birth_date')} AS py, lower({D.district('birth_place')}) AS d FROM fx_anc WHERE person_id <> '' AND {D.year('birth_date')} IS NOT NULL),
wn AS (SELECT DISTINCT s FROM t), hn AS (SELECT DISTINCT k FROM p), hv AS (SELECT s, unnest(list_distinct([s] || string_split(s, '-') || {D.spelt('s')})) AS key FROM wn), hk AS (SELECT k, unnest(list_distinct([k] || string_split(k, '-'))) AS key FROM hn),
ks AS (SELECT s, k, min(far) AS far FROM (SELECT s, k, 0 AS far FROM hv JOIN hk USING (key) UNION ALL SELECT s, k, 1 FROM wn JOIN hn ON s <> k AND least(length(s), length(k)) >= 3 AND (contains(s, k) OR contains(k, s))) u GROUP BY 1, 2),
q AS (SELECT DISTINCT s, g, y, d FROM t), m AS (SELECT q.*, p.person_id, ks.far, p.d = q.d AND q.d <> '' AS same_place, abs(p.py - q.y) AS off FROM q JOIN ks ON ks.s = q.s JOIN p ON p.k = ks.k AND p.g = q.g AND abs(p.py - q.y) <= 5),
k AS (SELECT *, bool_or(same_place) OVER (PARTITION BY s, g, y, d) AS narrow FROM (SELECT DISTINCT * FROM m) z), r AS (SELECT *, row_number() OVER (PARTITION BY s, g, y, d ORDER BY far, off, person_id) AS rnk FROM k WHERE same_place = narrow OR NOT narrow)"""


@query("block_candidates", "fx_anc", sql=f"WITH {_SIG} SELECT t.job_id, t.asc_no, r.rnk, r.person_id, r.narrow AS same_place, r.off AS years_off FROM t JOIN r ON r.s = t.s AND r.g = t.g AND r.y = t.y AND r.d = t.d AND r.rnk <= 10")
def block_candidates(anc):
    rows = anc.select(*_KEYS, "person_id", "surname", c("given_name").alias("given"), date_year(c("birth_date")).alias("year"), c("birth_place").alias("place"))
    return linking.block_candidates(rows.where("person_id = ''"), rows.where("person_id <> ''"))


_FAM = f"""b AS (SELECT a.job_id, a.asc_no, a.gen, a.person_id, a.given_name AS given, a.surname, a.birth_place, {D.year('a.birth_date')} AS y, {D.year('ch.birth_date')} AS cy, ch.birth_place AS cp, {D.year('su.birth_date')} AS sy
 FROM fx_anc a LEFT JOIN fx_anc ch ON ch.job_id = a.job_id AND ch.asc_no = a.asc_no // 2 LEFT JOIN fx_anc su ON su.job_id = a.job_id AND su.asc_no = 1),
cd AS (SELECT c.job_id, c.asc_no, c.rnk, c.person_id, c.given_name AS cg, c.surname AS cs, c.gender AS cgen, {D.year('c.birth_date')} AS c_y, c.birth_place AS c_p FROM fx_cand c WHERE NOT EXISTS (SELECT 1 FROM rj WHERE rj.job_id = c.job_id AND rj.person_id = c.person_id))"""
_COMPAT = "(contains(lower(cs), lower(surname)) OR contains(lower(surname), lower(cs)))"


@query("link_known_people", "fx_anc", "fx_cand", "fx_src", "fx_town", sql=f"""WITH {_REJ}, {_VER}, {_FAM},
r AS (SELECT cd.*, b.gen, b.given, b.surname, b.birth_place, b.y, CASE WHEN b.y IS NULL AND b.asc_no > 1 THEN b.cy - 28 END AS est, coalesce(b.y, CASE WHEN b.asc_no > 1 THEN b.cy - 28 END, CASE WHEN b.gen >= 1 THEN b.sy - 28 * b.gen END) AS ex,
  CASE WHEN b.birth_place <> '' THEN b.birth_place ELSE coalesce(b.cp, '') END AS ref, {D.common('b.surname')} AS com, coalesce(vf.pc, 0) AS pc, CAST(substr(cd.person_id, 2) AS BIGINT) % 2 = 0 AS hp
  FROM cd JOIN b ON b.job_id = cd.job_id AND b.asc_no = cd.asc_no AND b.asc_no <= 15 AND b.person_id = '' LEFT JOIN vf ON vf.person_id = 'P' || substr(cd.person_id, 2)),
r2 AS (SELECT *, {D.county('c_p')} AS k1, {D.county('ref')} AS k2 FROM r), r3 AS (SELECT *, CASE WHEN c_p <> '' AND ref <> '' THEN {D.proximity('k1', 'k2')} END AS px FROM r2),
ok AS (SELECT *, 50 + coalesce(greatest(0, 30 - 3 * abs(c_y - ex)), 0) + CASE WHEN c_y IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN c_p <> '' THEN 10 ELSE 0 END + CASE px WHEN 'same' THEN 20 WHEN 'adjacent' THEN 10 ELSE 0 END + CASE WHEN com THEN 5 * pc ELSE 0 END + CASE WHEN hp THEN 10 ELSE 0 END AS score FROM r3
 WHERE NOT ({D.foreign('c_p')} AND NOT {D.uk('c_p')}) AND {D.similar("split_part(cg, ' ', 1)", 'given')} AND {_COMPAT} AND NOT coalesce(abs(y - c_y) > CASE WHEN gen >= 3 THEN 8 ELSE 5 END, false) AND NOT coalesce(y >= 1837 AND c_y IS NULL AND (com OR c_p = '' OR ref = ''), false)
 AND NOT coalesce(y IS NULL AND abs(c_y - ex) > 35, false) AND NOT (y IS NULL AND c_y IS NULL AND est IS NOT NULL AND (com OR c_p = '')) AND coalesce(px, '') <> 'distant' AND NOT (c_p <> '' AND ref <> '' AND k1 IS NULL AND k2 IS NOT NULL) AND NOT (com AND pc < 2))
SELECT job_id, asc_no, person_id, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY score DESC, rnk) AS n FROM ok) t WHERE n = 1""")
def link_known_people(anc, cand, src, town):
    return linking.link_known_people(anc, cand.withColumn("has_parents", _num() % 2 == 0), _verify(src), gazetteer=_gazetteer(town))


@query("find_child_person", "fx_anc", "fx_cand", "fx_town", sql=f"""WITH {_REJ}, {_FAM},
r AS (SELECT cd.*, b.given, b.surname, b.birth_place, coalesce(b.y, b.cy - 28) AS y FROM cd JOIN b ON b.job_id = cd.job_id AND b.asc_no = cd.asc_no AND b.person_id = ''),
r2 AS (SELECT *, {D.county('c_p')} AS k1, {D.county('birth_place')} AS k2 FROM r),
ok AS (SELECT * FROM r2 WHERE NOT ({D.foreign('c_p')} AND NOT {D.uk('c_p')}) AND {D.similar('given', 'cg')} AND {_COMPAT} AND NOT coalesce(abs(y - c_y) > 5, false) AND NOT coalesce(y >= 1837 AND c_y IS NULL, false) AND NOT coalesce(c_p <> '' AND birth_place <> '' AND {D.proximity('k1', 'k2')} = 'distant', false))
SELECT job_id, asc_no, person_id, 'linked' AS how FROM fx_anc WHERE person_id <> '' UNION ALL SELECT job_id, asc_no, person_id, 'searched' FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY rnk) AS n FROM ok) t WHERE n = 1""")
def find_child_person(anc, cand, town):
    return linking.find_person(anc, cand, _gazetteer(town))


def _valid_sql(sex: str, py: str, pd: str, pp: str, ky: str, kp: str, want: str) -> str:
    bad = {"gender": f"{sex} <> '' AND {sex} <> {want}", "birth gap": f"coalesce({ky} - {py} < 12 OR {ky} - {py} > 55, false)", "died before birth": f"coalesce({pd} < {ky} - 1, false)", "foreign": f"{D.foreign(pp)} AND NOT {D.uk(pp)}"}
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {b} THEN '{k}' END" for k, b in bad.items()) + "], lambda x: x IS NOT NULL), ', ')"


def _prox_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> '' AND {b} <> '' THEN {D.proximity(D.county(a), D.county(b))} END"


@query("validate_parent", "fx_anc", "fx_town", sql=f"""
WITH y AS (SELECT *, {D.year('birth_date')} AS yr, {D.year('death_date')} AS dy FROM fx_anc), v AS (SELECT p.job_id, p.asc_no, {_valid_sql('p.gender', 'p.yr', 'p.dy', 'p.birth_place', 'k.yr', 'k.birth_place', "CASE WHEN p.asc_no % 2 = 0 THEN 'Male' ELSE 'Female' END")} AS reasons,
  {_prox_sql('p.birth_place', 'k.birth_place')} AS proximity FROM y p JOIN y k ON k.job_id = p.job_id AND p.asc_no > 1 AND k.asc_no = p.asc_no // 2)
SELECT *, reasons = '' AS valid FROM v""")
def validate_parent(anc, town):
    return linking.validate_parents(anc, _gazetteer(town))


@query("exclude_used", "fx_cand", sql=f"""WITH RECURSIVE {_REJ},
us AS (SELECT DISTINCT job_id, person_id FROM fx_cand WHERE asc_no <= 3 AND rnk = 1),
ps AS (SELECT c.job_id, c.asc_no, c.person_id, min(c.rnk) AS rnk FROM fx_cand c WHERE NOT EXISTS (SELECT 1 FROM rj WHERE rj.job_id = c.job_id AND rj.person_id = c.person_id) AND NOT EXISTS (SELECT 1 FROM us WHERE us.job_id = c.job_id AND us.person_id = c.person_id) GROUP BY 1, 2, 3),
sl AS (SELECT job_id, asc_no, row_number() OVER (PARTITION BY job_id ORDER BY asc_no) AS pos, list(person_id ORDER BY rnk, person_id) AS people FROM ps GROUP BY 1, 2),
wk AS (SELECT job_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS INT) AS asc_no, CAST(NULL AS VARCHAR) AS person_id, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT job_id FROM sl) j
 UNION ALL SELECT w.job_id, s.pos, s.asc_no, list_filter(s.people, lambda x: NOT list_contains(w.used, x))[1], list_append(w.used, list_filter(s.people, lambda x: NOT list_contains(w.used, x))[1]) FROM wk w JOIN sl s ON s.job_id = w.job_id AND s.pos = w.pos + 1)
SELECT job_id, asc_no, person_id FROM wk WHERE person_id IS NOT NULL""")
def exclude_used(cand):
    passing = linking.exclude_rejected(cand, linking.rejected_people(cand))
    return linking.ordered_assignment(passing, cand.where("asc_no <= 3 and rnk = 1")).select(*_KEYS, "person_id")


_PEOPLE = f"""pp AS (SELECT job_id, person_id, name, gender, {D.year('birth_date')} AS yr, {D.year('death_date')} AS dy, birth_place FROM fx_anc WHERE person_id <> ''),
pe AS (SELECT job_id, dst AS child_id, src AS person_id, src_gender, row_number() OVER (PARTITION BY job_id, dst, src_gender ORDER BY kind <> 'Biological', ord) AS n FROM fx_edge WHERE rel = 'ParentChild'),
fa AS (SELECT pe.job_id, pe.child_id, pe.src_gender = 'Male' AS is_father, pp.*  EXCLUDE (job_id), coalesce(vf.pc, 0) AS pc FROM pe JOIN pp ON pp.job_id = pe.job_id AND pp.person_id = pe.person_id AND pe.n = 1 LEFT JOIN vf ON vf.person_id = pe.person_id)"""


def _round_sql(i: int, prev: str, top: int) -> str:
    return (f"g{i} AS (SELECT * FROM (SELECT k.job_id, CAST(2 * k.asc_no + CASE WHEN f.is_father THEN 0 ELSE 1 END AS INT) AS asc_no, f.person_id, f.name, f.yr AS year, f.birth_place AS place, f.pc, {_valid_sql('f.gender', 'f.yr', 'f.dy', 'f.birth_place', 'k.year', 'k.place', chr(67) + 'ASE WHEN f.is_father THEN ' + D.q('Male') + ' ELSE ' + D.q('Female') + ' END')} AS bad, {_prox_sql('f.birth_place', 'k.place')} AS px"
            f" FROM {prev} k JOIN fa f ON f.job_id = k.job_id AND f.child_id = k.person_id) z WHERE bad = '' AND NOT (coalesce(px, '') = 'distant' AND pc < 4) AND asc_no < {top})")


def _discover_sql(start: str, rounds: int, top: int) -> str:
    steps = [_round_sql(1, "st", top)] + [_round_sql(i, f"g{i - 1}", top) for i in range(2, rounds + 1)]
    union = " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(1, rounds + 1))
    return f"WITH {_VER}, {_PEOPLE}, st AS ({start}), {', '.join(steps)} SELECT job_id, asc_no, person_id, pc AS primary_count, CASE WHEN pc > 0 THEN 'tree_parents_verified' ELSE 'tree_parents_unverified' END AS discovery_method FROM ({union}) u"


def _start(anc, town):
    placed = gazetteer.with_place(anc, linking.known_places(anc, gazetteer=_gazetteer(town)), "birth_place", seat="clean_seat")
    return placed.select(*_KEYS, "person_id", date_year(c("birth_date")).alias("year"), "seat")


@query("tree_parent_discovery", "fx_anc", "fx_edge", "fx_src", "fx_town", sql=_discover_sql(f"SELECT job_id, asc_no, person_id, {D.year('birth_date')} AS year, birth_place AS place FROM fx_anc WHERE asc_no IN (2, 3) AND person_id <> ''", 6, 128))
def tree_parent_discovery(anc, edge, src, town):
    given = anc.where("asc_no <= 3")
    facts = linking.parent_facts(anc, tree_api.parents(edge), scoring.source_verify(src), _gazetteer(town))
    start = _start(given.where("asc_no > 1 and person_id <> ''"), town)
    return linking.discover_parents(start, facts, given.where("person_id <> ''"), given, 6).select(*_KEYS, "person_id", "primary_count", "discovery_method")


@query("second_pass", "fx_anc", "fx_edge", "fx_src", "fx_town", sql=_discover_sql(f"SELECT job_id, asc_no, person_id, {D.year('birth_date')} AS year, birth_place AS place FROM fx_anc WHERE gen = 4 AND person_id <> ''", 2, 128))
def second_pass(anc, edge, src, town):
    before, after = anc.where("gen <= 3"), anc.where("gen <= 4")
    facts = linking.parent_facts(anc, tree_api.parents(edge), scoring.source_verify(src), _gazetteer(town))
    start = _start(linking.newly_found(after, before), town)
    found = linking.discover_parents(start, facts, after.where("person_id <> ''"), after, 6)
    return found.select(*_KEYS, "person_id", "primary_count", "discovery_method")


_EMPTY = f"""em AS (SELECT t.job_id, t.asc_no, {D.year('k.birth_date')} AS ky, k.birth_place AS kp, CASE WHEN t.asc_no % 2 = 0 THEN k.surname ELSE t.surname END AS ss, CASE WHEN t.asc_no % 3 = 0 THEN t.given_name ELSE '' END AS kg FROM fx_anc t JOIN fx_anc k ON k.job_id = t.job_id AND k.asc_no = t.asc_no // 2 WHERE t.gen = 5)"""


@query("direct_parent_search", "fx_anc", "fx_cand", "fx_src", "fx_town", sql=f"""WITH RECURSIVE {_REJ}, {_VER}, {_EMPTY},
r AS (SELECT c.job_id, c.asc_no, c.rnk, c.person_id, c.given_name AS cg, c.surname AS cs, c.gender, {D.year('c.birth_date')} AS c_y, c.birth_place AS c_p, em.ky, em.kp, em.ss, em.kg, coalesce(vf.pc, 0) AS pc, CAST(substr(c.person_id, 2) AS BIGINT) % 5 = 0 AS hid, CAST(substr(c.person_id, 2) AS BIGINT) % 3 = 0 AS conf, {D.common('em.ss')} AS com
  FROM fx_cand c JOIN em ON em.job_id = c.job_id AND em.asc_no = c.asc_no LEFT JOIN vf ON vf.person_id = 'P' || substr(c.person_id, 2) WHERE NOT EXISTS (SELECT 1 FROM rj WHERE rj.job_id = c.job_id AND rj.person_id = c.person_id)),
r2 AS (SELECT *, coalesce({_prox_sql('c_p', 'kp')} = 'distant', false) AS far, {_valid_sql('gender', 'c_y', 'CAST(NULL AS INT)', 'c_p', 'ky', 'kp', "CASE WHEN asc_no % 2 = 0 THEN 'Male' ELSE 'Female' END")} AS bad FROM r),
ok AS (SELECT * FROM r2 WHERE bad = '' AND (c_p = '' OR (NOT {D.foreign('c_p')} AND {D.uk('c_p')})) AND (asc_no % 2 = 1 OR contains(lower(cs), lower(ss)) OR contains(lower(ss), lower(cs))) AND NOT coalesce(ky >= 1837 AND c_y IS NULL, false)
  AND CASE WHEN hid THEN NOT far AND CASE WHEN kg <> '' THEN {D.similar('cg', 'kg')} ELSE conf OR NOT com END ELSE pc >= greatest(CASE WHEN c_y < 1837 THEN 0 ELSE 1 END, CASE WHEN far THEN CASE WHEN asc_no % 2 = 1 THEN 2 ELSE 4 END ELSE 0 END) END),
ps AS (SELECT job_id, asc_no, person_id, min(rnk) AS rnk, any_value(CASE WHEN hid THEN 'direct_search_unverified' ELSE 'direct_search_verified' END) AS meth FROM ok GROUP BY 1, 2, 3),
ex AS (SELECT * FROM ps WHERE NOT EXISTS (SELECT 1 FROM fx_anc a WHERE a.job_id = ps.job_id AND a.person_id = ps.person_id AND a.gen <= 4)),
sl AS (SELECT job_id, asc_no, row_number() OVER (PARTITION BY job_id ORDER BY asc_no) AS pos, list(person_id ORDER BY rnk, person_id) AS people FROM ex GROUP BY 1, 2),
wk AS (SELECT job_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS INT) AS asc_no, CAST(NULL AS VARCHAR) AS person_id, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT job_id FROM sl) j
 UNION ALL SELECT w.job_id, s.pos, s.asc_no, list_filter(s.people, lambda x: NOT list_contains(w.used, x))[1], list_append(w.used, list_filter(s.people, lambda x: NOT list_contains(w.used, x))[1]) FROM wk w JOIN sl s ON s.job_id = w.job_id AND s.pos = w.pos + 1)
SELECT wk.job_id, wk.asc_no, wk.person_id, ps.meth AS discovery_method FROM wk JOIN ps ON ps.job_id = wk.job_id AND ps.asc_no = wk.asc_no AND ps.person_id = wk.person_id""")
def direct_parent_search(anc, cand, src, town):
    kid = anc.where("gen = 4").select("job_id", c("asc_no").alias("_c"), date_year(c("birth_date")).alias("child_year"), c("birth_place").alias("child_place"), c("surname").alias("_ks"))
    hole = anc.where("gen = 5").withColumn("_c", F.shiftright("asc_no", 1)).join(kid, ["job_id", "_c"])
    empty = hole.select(*_KEYS, "child_year", "child_place", F.when(c("asc_no") % 2 == 0, c("_ks")).otherwise(c("surname")).alias("search_surname"), F.when(c("asc_no") % 3 == 0, c("given_name")).otherwise("").alias("known_given"))
    rows = cand.withColumn("sources_hidden", _num() % 5 == 0).withColumn("civil_confirmed", _num() % 3 == 0)
    used = anc.where("gen <= 4 and person_id <> ''")
    return linking.direct_parent_search(empty, rows, _verify(src), used, _gazetteer(town)).select(*_KEYS, "person_id", "discovery_method")


def _walk(ranked: str) -> str:
    """Slots in order, each its first free person: ``ranked`` has job_id, asc_no, person_id, rnk."""
    free = "list_filter(s.people, lambda x: NOT list_contains(w.used, x))[1]"
    return (f"sl AS (SELECT job_id, asc_no, row_number() OVER (PARTITION BY job_id ORDER BY asc_no) AS pos, list(person_id ORDER BY rnk, person_id) AS people FROM {ranked} GROUP BY 1, 2), "
            "wk AS (SELECT job_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS INT) AS asc_no, CAST(NULL AS VARCHAR) AS person_id, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT job_id FROM sl) j "
            f"UNION ALL SELECT w.job_id, s.pos, s.asc_no, {free}, list_append(w.used, {free}) FROM wk w JOIN sl s ON s.job_id = w.job_id AND s.pos = w.pos + 1)")


@query("spouse_triangulation", "fx_anc", "fx_edge", "fx_cand", "fx_src", "fx_town", sql=f"""WITH RECURSIVE {_REJ}, {_VER}, {_PEOPLE}, {_FAM},
nd AS (SELECT m.job_id, m.asc_no, {D.year('k.birth_date')} AS ky, k.birth_place AS kp FROM fx_anc m JOIN fx_anc k ON k.job_id = m.job_id AND k.asc_no = m.asc_no // 2 WHERE m.asc_no > 1 AND m.asc_no % 2 = 1 AND (m.person_id = '' OR m.row_id % 3 = 0)),
cp AS (SELECT job_id, src AS man_id, dst AS person_id FROM fx_edge WHERE rel = 'Couple' UNION ALL SELECT c.job_id, c.person_id, w.person_id FROM fx_cand c JOIN fx_anc w ON w.job_id = c.job_id AND w.asc_no % 2 = 1 AND w.asc_no = c.asc_no + 1 + 2 * (c.rnk % 3) AND w.person_id <> '' WHERE c.asc_no % 2 = 0),
fr AS (SELECT cd.job_id, cd.asc_no, cd.rnk, cd.person_id FROM cd JOIN b ON b.job_id = cd.job_id AND b.asc_no = cd.asc_no AND b.person_id = '' AND b.asc_no % 2 = 0 WHERE NOT ({D.foreign('c_p')} AND NOT {D.uk('c_p')}) AND {D.similar("split_part(cg, ' ', 1)", 'b.given')} AND NOT coalesce(abs(y - c_y) > 5, false)
  AND EXISTS (SELECT 1 FROM cp WHERE cp.job_id = cd.job_id AND cp.man_id = cd.person_id)),
mn AS (SELECT job_id, asc_no, person_id FROM fx_anc WHERE asc_no % 2 = 0 AND person_id <> '' UNION ALL SELECT job_id, asc_no, person_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY rnk, person_id) AS n FROM fr) t WHERE n = 1),
rw AS (SELECT nd.job_id, nd.asc_no, cp.person_id, coalesce(vf.pc, 0) AS pc, pp.yr, nd.ky, CAST(substr(pp.person_id, 2) AS BIGINT) % 5 = 0 AS hid, {_valid_sql('pp.gender', 'pp.yr', 'pp.dy', 'pp.birth_place', 'nd.ky', 'nd.kp', D.q('Female'))} AS bad, coalesce({_prox_sql('pp.birth_place', 'nd.kp')} = 'distant', false) AS far
  FROM nd JOIN mn f ON f.job_id = nd.job_id AND f.asc_no = nd.asc_no - 1 JOIN cp ON cp.job_id = nd.job_id AND cp.man_id = f.person_id JOIN pp ON pp.job_id = nd.job_id AND pp.person_id = cp.person_id LEFT JOIN vf ON vf.person_id = cp.person_id),
ok AS (SELECT DISTINCT job_id, asc_no, person_id, 1 AS rnk FROM rw WHERE bad = '' AND CASE WHEN hid THEN NOT far ELSE pc >= greatest(CASE WHEN yr < 1837 THEN 0 WHEN asc_no >= 16 THEN 1 ELSE 2 END, CASE WHEN far THEN CASE WHEN asc_no >= 16 THEN 2 ELSE 4 END ELSE 0 END) END
  AND NOT EXISTS (SELECT 1 FROM rj WHERE rj.job_id = rw.job_id AND rj.person_id = rw.person_id) AND NOT EXISTS (SELECT 1 FROM fx_anc a WHERE a.job_id = rw.job_id AND a.person_id = rw.person_id AND a.row_id % 4 = 2)),
{_walk('ok')} SELECT job_id, asc_no, person_id, 'spouse_triangulation' AS discovery_method FROM wk WHERE person_id IS NOT NULL""")
def spouse_triangulation(anc, edge, cand, src, town):
    kid = anc.select("job_id", c("asc_no").alias("_c"), date_year(c("birth_date")).alias("child_year"), c("birth_place").alias("child_place"))
    need = anc.where("asc_no > 1 and asc_no % 2 = 1 and (person_id = '' or row_id % 3 = 0)").select(*_KEYS, F.shiftright("asc_no", 1).alias("_c")).join(kid, ["job_id", "_c"]).drop("_c")
    men = anc.where("asc_no % 2 = 0 and person_id <> ''").select(*_KEYS, "person_id")
    # Search results carry spouses too: women of the same tree. Every fourth person stands in it already.
    women = anc.where("asc_no % 2 = 1 and person_id <> ''").select("job_id", c("asc_no").alias("_w"), c("person_id").alias("spouse_id"))
    also = cand.where("asc_no % 2 = 0").select("job_id", "person_id", (c("asc_no") + 1 + 2 * (c("rnk") % 3)).alias("_w")).join(women, ["job_id", "_w"]).drop("_w")
    spouses = tree_api.spouses(edge, anc).select("job_id", "person_id", "spouse_id").unionByName(also)
    people, names_ = anc.withColumn("sources_hidden", (c("person_id") != "") & (_num() % 5 == 0)), _gazetteer(town)
    return linking.spouse_triangulation(need, men, spouses, people, scoring.source_verify(src), anc.where("person_id <> '' and row_id % 4 = 2"), linking.rejected_people(cand), names_, linking.father_results(anc, cand, names_))


_MAIDEN = f"""{_REJ}, {_SIG.split("q AS (")[0].replace("WHERE person_id = '' AND " + D.year('birth_date') + " IS NOT NULL", "WHERE false").rstrip().rstrip(",")},
nd AS (SELECT m.job_id, m.asc_no, m.surname AS maiden, {D.year('k.birth_date')} - 26 AS y, k.birth_place AS kp, lower({D.district('k.birth_place')}) AS d FROM fx_anc m JOIN fx_anc k ON k.job_id = m.job_id AND k.asc_no = m.asc_no // 2 WHERE m.asc_no % 2 = 1 AND m.asc_no > 1 AND m.person_id = '' AND {D.year('k.birth_date')} IS NOT NULL),
q AS (SELECT DISTINCT lower(maiden) AS s, y, d, kp FROM nd),
mm AS (SELECT q.*, p.person_id, p.d = q.d AND q.d <> '' AS same_place, abs(p.py - q.y) AS off FROM q JOIN p ON p.k = q.s AND abs(p.py - q.y) <= 15 JOIN fx_anc a ON a.person_id = p.person_id
  WHERE a.gender IN ('', 'Female') AND NOT ({D.foreign('a.birth_place')} AND NOT {D.uk('a.birth_place')}) AND coalesce({_prox_sql('a.birth_place', 'q.kp')}, '') <> 'distant'),
kn AS (SELECT *, bool_or(same_place) OVER (PARTITION BY s, y, d, kp) AS narrow FROM mm), rr AS (SELECT *, row_number() OVER (PARTITION BY s, y, d, kp ORDER BY off, person_id) AS rnk FROM kn WHERE same_place OR NOT narrow),
ok AS (SELECT nd.job_id, nd.asc_no, rr.person_id, rr.rnk FROM nd JOIN rr ON rr.s = lower(nd.maiden) AND rr.y = nd.y AND rr.d = nd.d AND rr.kp = nd.kp
  WHERE NOT EXISTS (SELECT 1 FROM rj WHERE rj.job_id = nd.job_id AND rj.person_id = rr.person_id) AND NOT EXISTS (SELECT 1 FROM fx_anc u WHERE u.job_id = nd.job_id AND u.person_id = rr.person_id)),
{_walk('ok')}, got AS (SELECT wk.job_id, wk.asc_no, wk.person_id, a.name FROM wk JOIN fx_anc a ON a.person_id = wk.person_id AND wk.person_id IS NOT NULL)"""


@query("mother_from_maiden", "fx_anc", "fx_cand", "fx_town", sql=f"""WITH RECURSIVE {_MAIDEN}
SELECT job_id, asc_no, person_id, name, 'maiden_name_search' AS discovery_method FROM got UNION ALL SELECT nd.job_id, nd.asc_no, '', '? ' || nd.maiden, 'maiden_name_only' FROM nd WHERE NOT EXISTS (SELECT 1 FROM got WHERE got.job_id = nd.job_id AND got.asc_no = nd.asc_no)""")
def mother_from_maiden(anc, cand, town):
    kid = anc.select("job_id", c("asc_no").alias("_c"), date_year(c("birth_date")).alias("child_year"), c("birth_place").alias("child_place"))
    # Mothers whose surname a birth entry gave, but nobody is linked to the slot yet.
    need = anc.where("asc_no % 2 = 1 and asc_no > 1 and person_id = ''").select(*_KEYS, c("surname").alias("maiden_name"), F.shiftright("asc_no", 1).alias("_c")).join(kid, ["job_id", "_c"]).drop("_c").where("child_year is not null")
    pool = anc.where("person_id <> ''").select("person_id", "name", "gender", "surname", c("given_name").alias("given"), date_year(c("birth_date")).alias("year"), c("birth_place").alias("place"))
    return linking.mother_from_maiden(need, pool, linking.rejected_people(cand), anc.where("person_id <> ''"), _gazetteer(town))


@query("other_decade_census", "fx_fact", "fx_src", sql="""
WITH f AS (SELECT person_id, seq, TRY_CAST(regexp_extract(fact_date, '(\\d{4})', 1) AS INT) AS year FROM fx_fact WHERE fact_type LIKE '%Census'), h AS (SELECT person_id, CAST(regexp_extract(title, '(\\d{4})', 1) AS INT) AS year FROM fx_src WHERE title LIKE '%Census%')
SELECT person_id, arg_min(year, seq) AS census_year FROM f WHERE year IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.person_id = f.person_id AND abs(h.year - f.year) < 8) GROUP BY 1""")
def other_decade_census(fact, src):
    year = F.regexp_extract("fact_date", r"(\d{4})", 1).try_cast("int")
    have = src.where(c("title").contains("Census")).select("person_id", F.regexp_extract("title", r"(\d{4})", 1).try_cast("int").alias("year"))
    return linking.other_decade_census(fact.where(c("fact_type").contains("Census")).select("person_id", "seq", year.alias("year")), have)


@query("gazetteer_lookup", "fx_anc", "fx_town", sql=f"SELECT row_id, birth_place, {D.county('birth_place')} AS county FROM fx_anc")
def gazetteer_lookup(anc, town):
    return gazetteer.lookup_counties(anc.select("row_id", "birth_place"), "birth_place", _gazetteer(town))


@query("adjacency_lookup", "fx_pair", "fx_town", sql=f"""
SELECT job_id, asc_no, rnk, {D.proximity('c1', 'c2')} AS proximity FROM (SELECT job_id, asc_no, rnk, {D.county('cand_place')} AS c1, {D.county('anc_place')} AS c2 FROM fx_pair) s""")
def adjacency_lookup(pair, town):
    two = gazetteer.lookup_counties(gazetteer.lookup_counties(pair, "cand_place", _gazetteer(town), "c1"), "anc_place", _gazetteer(town), "c2")
    return gazetteer.lookup_proximity(two, "c1", "c2", gazetteer.border_table(pair.sparkSession)).select(*_KEYS, "rnk", "proximity")
