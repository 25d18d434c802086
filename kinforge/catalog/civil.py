"""Civil index: reading it, searching it, confirming and discovering people through it."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.catalog import duck as D
from kinforge.catalog.base import query
from kinforge.functions import values as V
from kinforge.functions.dates import date_year
from kinforge.operators import civil as ops
from kinforge.sources import civil_index as src

c = F.col


@query("civil_dump_parse", "fx_dump", sql="""
WITH h AS (SELECT *, last_value(CASE WHEN starts_with(line, ';') THEN TRY_CAST(split_part(line, ';', 3) AS INT) END IGNORE NULLS) OVER w AS q,
    last_value(CASE WHEN starts_with(line, ';') THEN TRY_CAST(split_part(line, ';', 4) AS INT) END IGNORE NULLS) OVER w AS y FROM fx_dump WINDOW w AS (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc, line_no, entry_type, split_part(line, ';', 2) AS surname, trim(replace(replace(split_part(line, ';', 3), '+', ' '), '%2E', '.')) AS forenames, split_part(line, ';', 4) AS spouse_surname, y AS year,
  ['Mar', 'Jun', 'Sep', 'Dec'][q + 1] AS quarter, split_part(line, ';', 6) AS district, split_part(line, ';', 7) AS volume, split_part(line, ';', 8) AS page FROM h WHERE NOT starts_with(line, ';')""")
def civil_dump_parse(dump):
    return src.parse_dump(dump)


@query("html_table_rows", "pages", sql="""
WITH w AS (SELECT page_id, concat('<table><tr class="r"><td>Surname</td><td>Given</td><td>Year</td><td>Qtr</td></tr><tr><td><b>Hunt</b></td><td>Norman</td><td>', CAST(1900 + page_id % 80 AS VARCHAR), '</td><td>Jun</td><td>Derby</td><td>7b</td><td>', CAST(page_id AS VARCHAR), '</td></tr>',
  repeat(concat('<TR><td>Cox</td><td>Ida <i>May</i></td>', chr(10), '<td>Dec</td><td>', CAST(1850 + page_id % 90 AS VARCHAR), '</td><td>Belper</td><td>', CAST(page_id % 30 AS VARCHAR), '</td></TR>'), CAST(page_id % 4 AS BIGINT)), '<tr><td>Short</td><td>row</td></tr><tr><td>Fox</td><td></td><td>', CASE WHEN page_id % 2 = 0 THEN 'Leek' ELSE '' END, '</td><td>9d</td><td>12</td></tr></table>', html) AS html FROM pages),
r AS (SELECT page_id, unnest(rows) AS row, generate_subscripts(rows, 1) - 1 AS row_no FROM (SELECT page_id, regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS rows FROM w) a),
k AS (SELECT page_id, row_no, list_transform(regexp_extract_all(row, '(?is)<td[^>]*>(.*?)</td>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))) AS cells FROM r),
n AS (SELECT *, list_filter(cells[3:], lambda x: regexp_matches(x, '(?i)^\\d+[a-z]?$') AND NOT regexp_matches(x, '^\\d{4}$')) AS nums FROM k WHERE len(cells) >= 4 AND lower(cells[1]) NOT IN ('surname', 'type', ''))
SELECT page_id, row_no, cells[1] AS surname, cells[2] AS forenames, CAST(list_filter(cells[3:], lambda x: regexp_matches(x, '^\\d{4}$'))[-1] AS INT) AS year,
  list_filter(cells[3:], lambda x: x IN ('Mar', 'Jun', 'Sep', 'Dec'))[-1] AS quarter, nums[1] AS volume, CASE WHEN len(nums) > 1 THEN nums[-1] END AS page,
  list_filter(cells[3:], lambda x: x <> '' AND NOT regexp_matches(x, '^\\d{4}$') AND x NOT IN ('Mar', 'Jun', 'Sep', 'Dec') AND NOT regexp_matches(x, '(?i)^\\d+[a-z]?$'))[1] AS district FROM n""")
def html_table_rows(pages):
    """Beside each page's own tables: a header, a full row, rows in other order with inner tags and line ends, one too short, one without a year."""
    more = F.concat(F.lit("<TR><td>Cox</td><td>Ida <i>May</i></td>\n<td>Dec</td><td>"), (1850 + c("page_id") % 90).cast("string"), F.lit("</td><td>Belper</td><td>"), (c("page_id") % 30).cast("string"), F.lit("</td></TR>"))
    row = F.concat(F.lit('<table><tr class="r"><td>Surname</td><td>Given</td><td>Year</td><td>Qtr</td></tr><tr><td><b>Hunt</b></td><td>Norman</td><td>'),
                   (1900 + c("page_id") % 80).cast("string"), F.lit("</td><td>Jun</td><td>Derby</td><td>7b</td><td>"), c("page_id").cast("string"), F.lit("</td></tr>"), F.repeat(more, (c("page_id") % 4).cast("int")),
                   F.lit("<tr><td>Short</td><td>row</td></tr><tr><td>Fox</td><td></td><td>"), F.when(c("page_id") % 2 == 0, "Leek").otherwise(""), F.lit("</td><td>9d</td><td>12</td></tr></table>"), c("html"))
    return src.html_rows(pages.select("page_id", row.alias("html")))


@query("district_resolve", "fx_anc", "fx_civil", sql=f"""
WITH a AS (SELECT DISTINCT {D.district('birth_place')} AS district FROM fx_anc UNION SELECT DISTINCT left(district, 4) AS district FROM fx_civil), k AS (SELECT DISTINCT district AS district_id FROM fx_civil),
m AS (SELECT a.district, k.district_id, CASE WHEN lower(a.district) = lower(k.district_id) THEN 0 ELSE 2 END AS how FROM a JOIN k ON a.district <> '' AND (starts_with(lower(a.district), lower(k.district_id)) OR starts_with(lower(k.district_id), lower(a.district))))
SELECT district, how, district_id FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY how, district_id) AS n FROM m) t WHERE n = 1""")
def district_resolve(anc, civil):
    from kinforge.functions.places import district_of

    asked = anc.select(district_of(c("birth_place")).alias("district")).unionByName(civil.select(F.substring("district", 1, 4).alias("district")))
    known = civil.select(c("district").alias("district_name"), c("district").alias("district_id")).distinct()
    return src.resolve_district(asked, known)


def _birth_searches(anc):
    y = date_year(c("birth_date"))
    return src.searches_of(src.with_search(anc, c("surname"), c("given_name"), y - 1, y + 1, F.lit("")))


_SEARCHES = f"""q AS (SELECT DISTINCT lower(surname) AS surname_key, lower(given_name) AS given_key, {D.year('birth_date')} - 1 AS year_from, {D.year('birth_date')} + 1 AS year_to, '' AS district_key FROM fx_anc WHERE {D.year('birth_date')} IS NOT NULL),
hit AS (SELECT q.*, e.* FROM q JOIN fx_civil e ON e.entry_type = 'birth' AND lower(e.surname) = q.surname_key AND {D.has_name('e.forenames', 'q.given_key')} AND e.year BETWEEN q.year_from AND q.year_to)"""


@query("civil_search", "fx_anc", "fx_civil", sql=f"""WITH {_SEARCHES}
SELECT surname_key, given_key, year_from, year_to, entry_id, district, volume, page FROM (SELECT *, count(*) OVER (PARTITION BY surname_key, given_key, year_from, year_to) AS n FROM hit) t""")
def civil_search(anc, civil):
    return src.civil_search(_birth_searches(anc), civil, "birth").select("surname_key", "given_key", "year_from", "year_to", "entry_id", "district", "volume", "page")


@query("search_overflow", "fx_anc", "fx_civil", sql=f"""WITH {_SEARCHES}, n AS (SELECT surname_key, given_key, year_from, count(*) AS matches FROM hit GROUP BY 1, 2, 3)
SELECT q.*, coalesce(matches, 0) AS matches, coalesce(matches, 0) > 20 AS overflow FROM q LEFT JOIN n ON n.surname_key = q.surname_key AND n.given_key = q.given_key AND n.year_from = q.year_from""")
def search_overflow(anc, civil):
    return src.search_overflow(_birth_searches(anc), civil, "birth", limit=20)


_NAMED = f"""p AS (SELECT job_id, asc_no, name, birth_place, split_part(name, ' ', 1) AS first, split_part(name, ' ', -1) AS last, {D.bounded_year('birth_date')} AS by_, {D.bounded_year('death_date')} AS dy FROM fx_anc)"""


def _best_sql(asked: str, etype: str, score: str, on: str, at: int, extra: str = "") -> str:
    """Best index entry per row of ``asked``."""
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY score DESC, entry_id) AS rn FROM (SELECT *, count(*) OVER (PARTITION BY job_id, asc_no) AS hits FROM ("
            f"SELECT a.*, e.entry_id, e.surname AS e_surname, e.forenames AS e_forenames, e.spouse_surname AS e_spouse, e.year AS e_year, e.district AS e_district, {score} AS score, {extra or 'true'} AS fits FROM {asked} a JOIN fx_civil e ON e.entry_type = '{etype}' AND {on}"
            f") z) y WHERE fits AND score >= {at}) x WHERE rn = 1)")


_ON_NAME = "lower(e.surname) = lower(a.last) AND " + D.has_name("e.forenames", "a.first")
_BIRTH = _best_sql("(SELECT * FROM p WHERE by_ BETWEEN 1837 AND 1983)", "birth",
                   "40 + CASE WHEN starts_with(lower(e.forenames), lower(a.first)) THEN 30 WHEN contains(lower(a.first), lower(e.forenames)) OR contains(lower(e.forenames), lower(a.first)) THEN 20 ELSE 0 END + CASE WHEN e.year = a.by_ THEN 20 ELSE 10 END + CASE WHEN a.birth_place <> '' AND (contains(lower(a.birth_place), lower(e.district)) OR contains(lower(e.district), lower(a.birth_place))) THEN 10 ELSE 0 END",
                   _ON_NAME + " AND e.year BETWEEN a.by_ - 1 AND a.by_ + 1", 50)
_DEATH = _best_sql("(SELECT * FROM p WHERE dy BETWEEN 1837 AND 1983)", "death",
                   "40 + CASE WHEN starts_with(lower(e.forenames), lower(a.first)) THEN 30 ELSE 0 END + CASE WHEN e.year = a.dy THEN 20 ELSE 0 END",
                   _ON_NAME + " AND e.year BETWEEN a.dy - 1 AND a.dy + 1", 50)
_COUPLES = "cp AS (SELECT a.*, s.last AS spouse_last, greatest(a.by_ + 16, coalesce(s.by_, a.by_) + 16) AS yf, least(a.by_ + 45, coalesce(a.dy, a.by_ + 45)) AS yt FROM p a JOIN p s ON s.job_id = a.job_id AND a.asc_no > 1 AND s.asc_no = xor(a.asc_no, 1) WHERE a.by_ IS NOT NULL)"
_WED = _best_sql("cp", "marriage", "30 + CASE WHEN starts_with(lower(e.forenames), lower(a.first)) THEN 25 WHEN contains(lower(a.first), lower(e.forenames)) THEN 15 ELSE 0 END + CASE WHEN e.spouse_surname <> '' AND lower(e.spouse_surname) = lower(a.spouse_last) THEN 50 WHEN e.spouse_surname <> '' AND contains(lower(a.spouse_last), lower(e.spouse_surname)) THEN 25 ELSE 0 END",
                 _ON_NAME + " AND e.year BETWEEN a.yf AND a.yt", 45)


@query("confirm_birth", "fx_anc", "fx_civil", sql=f"WITH {_NAMED} SELECT job_id, asc_no, score, entry_id, e_year AS entry_year, e_district AS entry_district FROM {_BIRTH} b")
def confirm_birth(anc, civil):
    return ops.confirm_birth(ops.named(anc), civil).select("job_id", "asc_no", "score", "entry_id", "entry_year", "entry_district")


@query("confirm_death", "fx_anc", "fx_civil", sql=f"WITH {_NAMED} SELECT job_id, asc_no, score, entry_id, e_year AS entry_year FROM {_DEATH} b")
def confirm_death(anc, civil):
    return ops.confirm_death(ops.named(anc), civil).select("job_id", "asc_no", "score", "entry_id", "entry_year")


@query("find_marriage", "fx_anc", "fx_civil", sql=f"WITH {_NAMED}, {_COUPLES} SELECT job_id, asc_no, score, entry_id, e_year AS entry_year, e_spouse AS entry_spouse_surname FROM {_WED} b")
def find_marriage(anc, civil):
    return ops.find_marriage(ops.couples(anc), civil).select("job_id", "asc_no", "score", "entry_id", "entry_year", "entry_spouse_surname")


@query("civil_crossref", "fx_anc", "fx_civil", sql=f"""WITH {_NAMED}, {_COUPLES}
SELECT p.job_id, p.asc_no, CASE WHEN p.by_ < 1837 THEN 'before registration' ELSE '' END AS note, b.e_year AS birth_entry_year, b.e_district AS birth_entry_district,
  CASE WHEN p.by_ < 1837 THEN NULL ELSE d.e_year END AS death_entry_year, CASE WHEN p.by_ < 1837 THEN NULL ELSE w.e_year END AS marriage_year, CASE WHEN p.by_ < 1837 THEN NULL ELSE w.e_spouse END AS marriage_spouse
FROM p LEFT JOIN {_BIRTH} b ON b.job_id = p.job_id AND b.asc_no = p.asc_no LEFT JOIN {_DEATH} d ON d.job_id = p.job_id AND d.asc_no = p.asc_no LEFT JOIN {_WED} w ON w.job_id = p.job_id AND w.asc_no = p.asc_no WHERE p.asc_no > 1""")
def civil_crossref(anc, civil):
    return ops.civil_crossref(anc, civil)


def _resolved(name: str) -> str:
    known = "(SELECT DISTINCT district AS k FROM fx_civil)"
    return f"coalesce((SELECT k FROM {known} kk WHERE {name} <> '' AND (starts_with(lower({name}), lower(k)) OR starts_with(lower(k), lower({name}))) ORDER BY lower(k) <> lower({name}), k LIMIT 1), '')"


_CONF = f"cw AS (SELECT *, split_part(given, ' ', 1) AS first FROM (SELECT job_id, asc_no, given_name AS given, surname AS last, {D.year('birth_date')} AS by_, {D.year('death_date')} AS dy, {D.district('birth_place')} AS dt FROM fx_anc) z), dm AS (SELECT dt, {_resolved('dt')} AS dk FROM (SELECT DISTINCT dt FROM cw) u), cr AS (SELECT cw.*, dm.dk FROM cw JOIN dm ON dm.dt = cw.dt)"
_CONF_BIRTH = _best_sql("(SELECT * FROM cr WHERE by_ BETWEEN 1837 AND 1983)", "birth",
                        f"CASE WHEN {D.similar('e.forenames', 'a.given')} THEN 30 ELSE 0 END + CASE WHEN e.year = a.by_ THEN 20 WHEN abs(e.year - a.by_) <= 1 THEN 15 ELSE 0 END + CASE WHEN a.dt <> '' AND lower(e.district) = lower(a.dt) THEN 15 WHEN {D.district_match('a.dt', 'e.district')} THEN 10 ELSE 0 END",
                        _ON_NAME + " AND e.year BETWEEN a.by_ - 2 AND a.by_ + 2 AND (a.dk = '' OR a.dk = e.district)", 40)
_CONF_DEATH = _DEATH.replace("FROM p WHERE", "FROM cr WHERE")


@query("confirm_with_civil", "fx_anc", "fx_civil", sql=f"""WITH {_CONF}
SELECT cr.job_id, cr.asc_no, b.e_year AS birth_entry_year, b.score AS birth_score, d.e_year AS death_entry_year, CASE WHEN b.e_year IS NULL THEN 0 ELSE 15 END + CASE WHEN d.e_year IS NULL THEN 0 ELSE 10 END AS bonus
FROM cr LEFT JOIN {_CONF_BIRTH} b ON b.job_id = cr.job_id AND b.asc_no = cr.asc_no LEFT JOIN {_CONF_DEATH} d ON d.job_id = cr.job_id AND d.asc_no = cr.asc_no""")
def confirm_with_civil(anc, civil):
    return ops.confirm_with_civil(anc, civil)


@query("birth_range_join", "fx_anc", "fx_civil", sql=f"""
SELECT a.job_id, a.asc_no, count(*) FILTER (WHERE abs(e.year - a.y) <= 1) AS within_1, count(*) FILTER (WHERE abs(e.year - a.y) <= 2) AS within_2, count(*) AS within_5, min(e.entry_id) AS first_entry
FROM (SELECT *, {D.year('birth_date')} AS y FROM fx_anc) a JOIN fx_civil e ON e.entry_type = 'birth' AND lower(e.surname) = lower(a.surname) AND lower(e.forenames) = lower(a.given_name) AND abs(e.year - a.y) <= 5 GROUP BY 1, 2""")
def birth_range_join(anc, civil):
    return ops.birth_range(anc, civil)


@query("marriage_window_join", "fx_anc", "fx_civil", sql=f"""
WITH y AS (SELECT job_id, asc_no, surname, {D.year('birth_date')} AS yr FROM fx_anc),
pr AS (SELECT h.job_id, h.asc_no, h.surname, w.surname AS wife, coalesce(ch.yr - 15, h.yr + 18) AS lo, coalesce(ch.yr, h.yr + 45) AS hi FROM y h JOIN y w ON w.job_id = h.job_id AND w.asc_no = h.asc_no + 1 AND h.asc_no % 2 = 0 LEFT JOIN y ch ON ch.job_id = h.job_id AND ch.asc_no = h.asc_no // 2)
SELECT pr.job_id, pr.asc_no, lo AS year_from, hi AS year_to, count(*) AS marriages, arg_min(e.entry_id, e.year * 1000000000000 + e.entry_id) AS first_entry FROM pr
JOIN fx_civil e ON e.entry_type = 'marriage' AND lower(e.surname) = lower(pr.surname) AND lower(e.spouse_surname) = lower(pr.wife) AND e.year BETWEEN pr.lo AND pr.hi GROUP BY 1, 2, 3, 4""")
def marriage_window_join(anc, civil):
    return ops.marriage_window(anc, civil)


@query("sibling_births", "fx_civil", sql="""
WITH b AS (SELECT lower(surname) AS s, lower(district) AS d, lower(spouse_surname) AS m, year, lower(forenames) AS f, entry_id FROM fx_civil WHERE entry_type = 'birth' AND spouse_surname <> '' AND district <> ''), p AS (SELECT DISTINCT s, d, m, year, f FROM b)
SELECT p.s AS surname, p.d AS district, p.m AS maiden, p.year, p.f AS forenames, count(*) AS siblings, min(b.entry_id) AS first_sibling FROM p JOIN b ON b.s = p.s AND b.d = p.d AND b.m = p.m AND abs(b.year - p.year) <= 8 AND (b.year <> p.year OR b.f <> p.f) GROUP BY 1, 2, 3, 4, 5""")
def sibling_births(civil):
    return ops.sibling_births(civil)


@query("marriage_two_sided", "fx_civil", sql="""
WITH g AS (SELECT lower(surname) AS gs, lower(spouse_surname) AS bs, year, volume, min(entry_id) AS groom_entry FROM fx_civil WHERE entry_type = 'marriage' AND spouse_surname <> '' AND forenames <> '' GROUP BY 1, 2, 3, 4)
SELECT b.entry_id, b.year, b.volume, g.groom_entry FROM fx_civil b JOIN g ON b.entry_type = 'marriage' AND b.spouse_surname <> '' AND lower(b.surname) = g.bs AND lower(b.spouse_surname) = g.gs AND b.year = g.year AND b.volume = g.volume""")
def marriage_two_sided(civil):
    return ops.two_sided(civil).select("entry_id", "year", "volume", c("groom.entry_id").alias("groom_entry"))


_NEED = f"""n0 AS (SELECT a.job_id, a.asc_no, a.given_name AS given, a.surname AS last, split_part(a.given_name, ' ', 1) AS first, {D.year('a.birth_date')} AS y, {D.district('a.birth_place')} AS dt, f.name AS father_name, m.name AS mother_name, m.surname AS mother_last
  FROM fx_anc a LEFT JOIN fx_anc f ON f.job_id = a.job_id AND f.asc_no = 2 * a.asc_no LEFT JOIN fx_anc m ON m.job_id = a.job_id AND m.asc_no = 2 * a.asc_no + 1 WHERE a.gen < 6 AND (f.name IS NULL OR m.name IS NULL)),
dm AS (SELECT dt, {_resolved('dt')} AS dk FROM (SELECT DISTINCT dt FROM n0) u), need AS (SELECT n0.*, dm.dk FROM n0 JOIN dm ON dm.dt = n0.dt)"""
_IN_D = "(a.dk = '' OR a.dk = e.district)"
_MAIDEN = _best_sql("(SELECT * FROM need WHERE mother_name IS NULL AND y BETWEEN 1911 AND 1983)", "birth", "1", _ON_NAME + " AND e.year BETWEEN a.y - 1 AND a.y + 1 AND " + _IN_D, 1,
                    f"e.spouse_surname <> '' AND (starts_with(lower(e.forenames), lower(a.given)) OR {D.similar(D.first_word('e.forenames'), 'a.given')})")


@query("maiden_name_discovery", "fx_anc", "fx_civil", sql=f"WITH {_NEED} SELECT job_id, asc_no, e_spouse AS maiden_name, e_year AS entry_year, entry_id FROM {_MAIDEN} b")
def maiden_name_discovery(anc, civil):
    return ops.maiden_names(ops.children_missing_parents(anc, civil), civil)


_WIFE = f"w AS (SELECT need.*, lower(coalesce(mn.e_spouse, need.mother_last, '')) AS wife FROM need LEFT JOIN {_MAIDEN} mn ON mn.job_id = need.job_id AND mn.asc_no = need.asc_no WHERE need.y IS NOT NULL)"
_MD = _best_sql("w", "marriage", "1", "lower(e.surname) = lower(a.last) AND e.year BETWEEN greatest(a.y - 7, 1837) AND a.y + 1 AND " + _IN_D, 1,
                f"e.forenames <> '' AND e.spouse_surname <> '' AND {D.first_word('e.forenames')} NOT IN {D.in_list(V.FEMALE_NAMES)} AND (a.wife = '' OR lower(e.spouse_surname) = a.wife)")


@query("marriage_discovery", "fx_anc", "fx_civil", sql=f"""WITH {_NEED}, {_WIFE}
SELECT job_id, asc_no, 2 * asc_no AS father_slot, e_forenames || ' ' || e_surname AS father_name, e_year - 25 AS father_birth, e_spouse AS mother_surname, e_year AS marriage_year, father_name IS NULL AS fills_father, entry_id FROM {_MD} b""")
def marriage_discovery(anc, civil):
    need = ops.children_missing_parents(anc, civil)
    return ops.marriage_discovery(need, ops.maiden_names(need, civil), civil)


_UF = "u AS (SELECT *, lower(mother_last) AS wife FROM need WHERE father_name IS NULL AND coalesce(mother_last, '') <> '' AND y IS NOT NULL)"
_UF_ON = "lower(e.surname) = lower(a.last) AND e.year BETWEEN greatest(a.y - 10, 1837) AND a.y + 2"
_UF1 = _best_sql("u", "marriage", f"80 + CASE WHEN {D.district_match('lower(a.dk)', 'e.district')} THEN 20 ELSE 0 END", _UF_ON + " AND " + _IN_D, 45, "lower(e.spouse_surname) = a.wife")
_UF3 = _best_sql("(SELECT * FROM u WHERE dk <> '')", "marriage", "80", _UF_ON, 45, "lower(e.spouse_surname) = a.wife")


@query("unknown_father", "fx_anc", "fx_civil", sql=f"""WITH {_NEED}, {_UF},
gr AS (SELECT lower(surname) AS gs, lower(spouse_surname) AS bs, year, volume, district, arg_min(forenames, entry_id) AS gf FROM fx_civil WHERE entry_type = 'marriage' AND spouse_surname <> '' AND forenames <> '' GROUP BY 1, 2, 3, 4, 5),
br AS (SELECT b.entry_id, b.surname, b.spouse_surname, b.year, b.district, g.gf FROM fx_civil b JOIN gr g ON b.entry_type = 'marriage' AND lower(b.surname) = g.bs AND lower(b.spouse_surname) = g.gs AND b.year = g.year AND b.volume = g.volume AND b.district = g.district),
two AS (SELECT * FROM (SELECT u.job_id, u.asc_no, br.gf || ' ' || br.spouse_surname AS father_name, br.year AS e_year, br.entry_id, row_number() OVER (PARTITION BY u.job_id, u.asc_no ORDER BY br.entry_id) AS rn FROM u JOIN br ON lower(br.surname) = u.wife AND lower(br.spouse_surname) = lower(u.last) AND br.year BETWEEN greatest(u.y - 10, 1837) AND u.y + 2 AND (u.dk = '' OR u.dk = br.district)) t WHERE rn = 1),
al AS (SELECT job_id, asc_no, 1 AS pass_no, 'father_surname' AS searched_by, e_forenames || ' ' || e_surname AS father_name, e_year AS entry_year, entry_id FROM {_UF1} a UNION ALL
 SELECT job_id, asc_no, 2, 'mother_maiden_name', father_name, e_year, entry_id FROM two UNION ALL SELECT job_id, asc_no, 3, 'father_surname_no_district', e_forenames || ' ' || e_surname, e_year, entry_id FROM {_UF3} a)
SELECT job_id, asc_no, pass_no, searched_by, father_name, entry_year, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, asc_no ORDER BY pass_no) AS n FROM al) t WHERE n = 1""")
def unknown_father(anc, civil):
    return ops.unknown_father(ops.children_missing_parents(anc, civil), civil)
