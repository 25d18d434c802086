"""Evidence points and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.catalog import duck as D
from kinforge.catalog.base import query
from kinforge.functions import values as V
from kinforge.operators import scoring
from kinforge.operators.gazetteer import gazetteer_table

c = F.col

_KEPT = f"""kept AS (SELECT person_id, seq, title, url, category, key FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id, key ORDER BY seq) AS kn FROM (
    SELECT *, {D.category('title')} AS category, {D.source_key('title')} AS key FROM (
      SELECT *, row_number() OVER (PARTITION BY person_id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) ORDER BY seq) AS tn FROM fx_src) a WHERE tn = 1) b) d WHERE kn = 1),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, category ORDER BY seq) AS nth FROM kept) k WHERE nth <= {D.category_cap('category')})"""

_BUCKET = "(CASE " + " ".join(f"WHEN strpos(lower(fact_type), '{k}') > 0 THEN '{v}'" for k, v in (
    ("census", "census"), ("birth", "birth"), ("christening", "birth"), ("marriage", "marriage"), ("death", "death"), ("residence", "residence"),
    ("baptism", "baptism"), ("burial", "burial"))) + " ELSE 'other' END)"

_FACTS = f"""fb AS (SELECT *, {_BUCKET} AS b FROM fx_fact),
fp AS (SELECT person_id, CAST(least(33, max(CASE WHEN b IN ('birth', 'baptism') AND fact_date <> '' THEN 5 ELSE 0 END) + max(CASE WHEN b IN ('birth', 'baptism') AND fact_place <> '' THEN 5 ELSE 0 END)
  + max(CASE WHEN b = 'death' AND fact_date <> '' THEN 3 ELSE 0 END) + max(CASE WHEN b = 'death' AND fact_place <> '' THEN 3 ELSE 0 END) + max(CASE WHEN b = 'marriage' THEN 5 ELSE 0 END)
  + 3 * least(2, count(*) FILTER (WHERE b = 'residence' AND fact_place <> '')) + 3 * least(2, count(*) FILTER (WHERE b = 'census' AND (fact_date <> '' OR fact_place <> '')))) AS INT) AS fact_points FROM fb GROUP BY 1)"""

_PLACED = f"""cp AS (SELECT person_id, fact_place FROM (SELECT person_id, fact_place, row_number() OVER (PARTITION BY person_id ORDER BY CASE b WHEN 'birth' THEN 0 WHEN 'baptism' THEN 1 WHEN 'residence' THEN 2 WHEN 'burial' THEN 3 ELSE 4 END, seq) AS n
  FROM fb WHERE fact_place <> '' AND b IN ('birth', 'baptism', 'residence', 'burial', 'census')) t WHERE n = 1),
cc AS (SELECT person_id, county FROM (SELECT person_id, county, row_number() OVER (PARTITION BY person_id ORDER BY seq) AS n FROM (SELECT person_id, seq,
    list_filter([{', '.join(D.q(x) for x in V.CITED_COUNTIES)}], lambda x: contains(regexp_replace(lower(concat(citation, ' ', title)), '<[^>]+>', '', 'g'), x))[1] AS county FROM fx_src) s WHERE county IS NOT NULL) t WHERE n = 1),
pl AS (SELECT a.*, CASE WHEN a.birth_place <> '' THEN a.birth_place WHEN a.confidence_level <> 'Customer Data' THEN coalesce(cp.fact_place, cc.county) END AS place
  FROM fx_anc a LEFT JOIN cp ON cp.person_id = a.person_id LEFT JOIN cc ON cc.person_id = a.person_id),
pp AS (SELECT *, {D.parts("regexp_replace(lower(place), '[^a-z\\s,]', '', 'g')")} AS ps, {D.year('birth_date')} AS yr FROM pl),
pc AS (SELECT * EXCLUDE (ps), list_filter(ps, lambda p: p IN {D.in_list(V.CITED_COUNTIES)})[-1] AS stated, coalesce(list_filter(ps, lambda p: p IN {D.in_list(V.CITED_COUNTIES)})[-1], {D.county('place')}) AS county,
  list_filter(ps, lambda p: p NOT IN {D.in_list(V.CITED_COUNTIES)} AND p NOT IN {D.in_list(V.UK_COUNTRIES)} AND length(p) > 1)[1] AS town FROM pp),
pd AS (SELECT p.*, ch.name AS ch_name, ch.surname AS ch_surname, ch.confidence_level AS ch_level, CASE WHEN p.asc_no = 1 OR ch.name IS NULL THEN 0 ELSE least(17,
    CASE {D.proximity('p.county', 'ch.county')} WHEN 'same' THEN 5 + CASE WHEN p.town = ch.town THEN 3 ELSE 0 END WHEN 'adjacent' THEN 2 WHEN 'distant' THEN -15 ELSE 0 END
  + CASE WHEN ch.yr - p.yr < 0 THEN -50 WHEN ch.yr - p.yr < 15 OR ch.yr - p.yr > 55 THEN -30 WHEN ch.yr - p.yr BETWEEN 22 AND 35 THEN 7 WHEN ch.yr - p.yr BETWEEN 18 AND 45 THEN 5 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM pc o WHERE o.job_id = p.job_id AND o.gen = p.gen AND o.asc_no < p.asc_no AND o.stated = p.county) THEN 2 ELSE 0 END) END AS place_points
  FROM pc p LEFT JOIN pc ch ON ch.job_id = p.job_id AND ch.asc_no = p.asc_no // 2)"""


@query("source_points", "fx_src", sql=f"""WITH {_KEPT}
SELECT person_id, CAST(sum({D.category_points('category')}) AS INT) AS source_points, CAST(count(*) AS INT) AS records FROM capped GROUP BY 1""")
def source_points(src):
    return scoring.source_points(src)


@query("category_cap", "fx_src", sql=f"""WITH {_KEPT} SELECT person_id, seq, title, category, nth, {D.category_points('category')} AS weight FROM capped""")
def category_cap(src):
    return scoring.category_cap(src).select("person_id", "seq", "title", "category", "nth", "weight")


@query("distinct_sources", "fx_src", sql=f"""WITH {_KEPT} SELECT person_id, array_to_string(list(DISTINCT category ORDER BY category), ', ') AS categories, count(*) AS kept FROM kept GROUP BY 1""")
def distinct_sources(src):
    return scoring.distinct_sources(src).groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"), F.count("*").alias("kept"))


@query("fact_points", "fx_fact", sql=f"WITH {_FACTS} SELECT * FROM fp")
def fact_points(fact):
    return scoring.fact_points(fact)


@query("source_verify", "fx_src", sql=f"""
SELECT person_id, CAST(count(*) FILTER (WHERE category IN {D.in_list(V.PRIMARY_CATEGORIES)}) AS INT) AS primary_count, CAST(sum({D.category_points('category')}) AS INT) AS raw_points, CAST(count(*) AS INT) AS citations
FROM (SELECT person_id, {D.category('title')} AS category FROM fx_src) s GROUP BY 1""")
def source_verify(src):
    return scoring.source_verify(src)


@query("earlier_same_county", "fx_anc", "fx_src", "fx_fact", "fx_town", sql=f"""WITH {_FACTS}, {_PLACED}
SELECT job_id, asc_no, county, EXISTS (SELECT 1 FROM pc o WHERE o.job_id = p.job_id AND o.gen = p.gen AND o.asc_no < p.asc_no AND o.stated = p.county) AS earlier_same_county FROM pc p""")
def earlier_same_county(anc, src, fact, town):
    from kinforge.operators.tree import earlier_same_county as op

    return op(scoring.with_places(anc, src, fact, gazetteer_table(town.sparkSession, town))).select("job_id", "asc_no", "county", "earlier_same_county")


@query("place_date_points", "fx_anc", "fx_src", "fx_fact", "fx_town", sql=f"WITH {_FACTS}, {_PLACED} SELECT job_id, asc_no, CAST(place_points AS INT) AS place_points FROM pd")
def place_date_points(anc, src, fact, town):
    return scoring.place_date_points(scoring.with_places(anc, src, fact, gazetteer_table(town.sparkSession, town))).select("job_id", "asc_no", "place_points")


_FIXED = """CASE WHEN ch_name IS NULL OR asc_no = 1 OR coalesce(surname, '') = '' THEN 0 WHEN asc_no % 2 = 1 THEN 3 WHEN coalesce(ch_surname, '') = '' THEN 0 WHEN lower(surname) = lower(ch_surname) THEN 5 ELSE -15 END
  + CASE discovery_method WHEN 'tree_parents_verified' THEN 8 WHEN 'direct_search_verified' THEN 8 WHEN 'tree_parents_unverified' THEN 3 ELSE 0 END"""

_BASE = f"""base AS (SELECT pd.*, coalesce(sp.pts, 0) AS src_pts, coalesce(fp.fact_points, 0) AS fact_pts, {_FIXED} AS fixed FROM pd
  LEFT JOIN (SELECT person_id, CAST(sum({D.category_points('category')}) AS INT) AS pts FROM capped GROUP BY 1) sp ON sp.person_id = pd.person_id LEFT JOIN fp ON fp.person_id = pd.person_id)"""


def _generation_sql(g: int) -> str:
    child = "NULL" if g == 0 else "(SELECT s.score FROM s%d s WHERE s.job_id = b.job_id AND s.asc_no = b.asc_no // 2)" % (g - 1)
    fam = "0" if g == 0 else "least(23, fixed + CASE WHEN ch_level = 'Customer Data' THEN 10 WHEN cs >= 90 THEN 8 WHEN cs >= 75 THEN 6 WHEN cs >= 50 THEN 3 WHEN cs IS NOT NULL THEN 1 ELSE 0 END)"
    return (f"s{g} AS (SELECT *, CASE WHEN confidence_level = 'Customer Data' THEN 100 ELSE CASE WHEN length(trim(surname)) > 1 THEN raw WHEN birth_date = '' AND place IS NULL THEN least(raw, 35) ELSE least(raw, 49) END END AS score FROM ("
            f"SELECT *, src_pts + fact_pts + fam + place_points AS total, {D.from_points('(src_pts + fact_pts + fam + place_points)')} AS raw FROM (SELECT *, {fam} AS fam FROM (SELECT b.*, {child} AS cs FROM base b WHERE gen = {g}) x) y) z)")


_SCORED = f"{_KEPT}, {_FACTS}, {_PLACED}, {_BASE}, " + ", ".join(_generation_sql(g) for g in range(7)) + ", sc AS (" + " UNION ALL ".join(f"SELECT * FROM s{g}" for g in range(7)) + ")"
_LEVEL = f"CASE WHEN confidence_level = 'Customer Data' THEN 'Customer Data' ELSE {D.level('score')} END"


@query("record_scoring", "fx_anc", "fx_src", "fx_fact", "fx_town", sql=f"""WITH {_SCORED}
SELECT job_id, asc_no, CASE WHEN cust THEN NULL ELSE src_pts END AS source_points, CASE WHEN cust THEN NULL ELSE fact_pts END AS fact_points, CASE WHEN cust THEN NULL ELSE CAST(fam AS INT) END AS family_points,
  CASE WHEN cust THEN NULL ELSE CAST(place_points AS INT) END AS place_points, CASE WHEN cust THEN NULL ELSE CAST(total AS INT) END AS total_points, CAST(score AS INT) AS score, level, CASE WHEN score >= 75 THEN 1 ELSE 0 END AS accepted,
  CASE WHEN cust THEN '' ELSE array_to_string(list_filter([CASE WHEN place IS NULL AND score < 75 THEN 'location' END, CASE WHEN birth_date = '' AND score < 75 THEN 'date' END, CASE WHEN src_pts = 0 AND person_id <> '' THEN 'records' END, CASE WHEN score < 50 THEN 'confidence' END], lambda x: x IS NOT NULL), ', ') END AS missing
FROM (SELECT *, confidence_level = 'Customer Data' AS cust, {_LEVEL} AS level FROM sc) f""")
def record_scoring(anc, src, fact, town):
    return scoring.record_scoring(anc, src, fact, gazetteer_table(town.sparkSession, town))


@query("level_counts", "fx_anc", "fx_src", "fx_fact", "fx_town", sql=f"""WITH {_SCORED}, lv AS (SELECT job_id, {_LEVEL} AS level FROM sc)
SELECT job_id, count(*) AS total, count(*) FILTER (WHERE level IN ('Verified', 'Customer Data')) AS verified, count(*) FILTER (WHERE level = 'Probable') AS probable,
  count(*) FILTER (WHERE level = 'Possible') AS possible, count(*) FILTER (WHERE level = 'Suggested') AS suggested FROM lv GROUP BY 1""")
def level_counts(anc, src, fact, town):
    return scoring.level_counts(scoring.record_scoring(anc, src, fact, gazetteer_table(town.sparkSession, town)))


@query("family_points", "fx_anc", sql="""
SELECT a.job_id, a.asc_no, CASE WHEN a.asc_no = 1 THEN 0 ELSE CAST(least(23, CASE WHEN ch.confidence_level = 'Customer Data' THEN 10 WHEN ch.confidence_score >= 90 THEN 8 WHEN ch.confidence_score >= 75 THEN 6 WHEN ch.confidence_score >= 50 THEN 3 WHEN ch.confidence_score IS NOT NULL THEN 1 ELSE 0 END
  + CASE WHEN ch.name IS NULL THEN 0 WHEN a.asc_no % 2 = 1 THEN 3 WHEN a.surname = ch.surname THEN 5 ELSE -15 END
  + CASE a.discovery_method WHEN 'tree_parents_verified' THEN 8 WHEN 'direct_search_verified' THEN 8 WHEN 'tree_parents_unverified' THEN 3 ELSE 0 END) AS INT) END AS family_points
FROM fx_anc a LEFT JOIN fx_anc ch ON ch.job_id = a.job_id AND ch.asc_no = a.asc_no // 2""")
def family_points(anc):
    return scoring.family_points(anc.withColumnRenamed("confidence_score", "score"), anc)
