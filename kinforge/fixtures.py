"""Family-tree shaped tables derived from the given parquet tables.

The text runs unchanged on Spark SQL and on DuckDB, so one definition serves both the
queries (as temp views) and their check (as CTEs). Every table grows with its inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_LINES = (
    "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,"
    " l_shipdate, l_extendedprice) AS INT) AS seq FROM lineitem)"
)

# A town's name by number: the table of towns and the places that cite them follow the same rule.
_FIRST = "Ash|Bar|Cal|Den|Elm|Far|Gal|Hol|Ing|Kel|Lan|Mar|Nor|Oak|Pen|Rad|Sel|Tid|Ull|Wal|Yar|Thor|Brad|Stan|Whit|Mil|Lang|Hart|Wood|Black"
_LAST = "ton|ham|by|ford|wick|well|stead|bury|field|ley|thorpe|mouth"
_BESIDE = " Magna| Parva| St Mary| on the Hill| by the Sea"
_SHIRES = "derbyshire|nottinghamshire|leicestershire|yorkshire|kent|cornwall|devon|norfolk|durham|lancashire|staffordshire|cheshire|surrey|essex|rutland|anglesey|wales|middlesex"


def town_name(number: str) -> str:
    """SQL text: the name of a town for a number from 0 on; every 360th one has another ending."""
    part = lambda words, n: f"split_part('{words}', '|', CAST({n} AS INT) + 1)"
    return (f"concat({part(_FIRST, f'({number}) % 30')}, {part(_LAST, f'floor(({number}) / 30) % 12')}, "
            f"CASE WHEN ({number}) < 360 THEN '' ELSE {part(_BESIDE, f'floor(({number}) / 360) % 5')} END)")


# name: (tables it reads, SQL)
FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    # The towns of a gazetteer, one a supplier.
    "fx_town": (("supplier",), f"""
SELECT town, county FROM (SELECT {town_name('s_suppkey')} AS town, split_part('{_SHIRES}', '|', CAST((s_suppkey * 7) % 18 + 1 AS INT)) AS county FROM supplier) t"""),
    "fx_anc": (("orders",), f"""
SELECT job_id, asc_no, CAST(length(bin(asc_no)) - 1 AS INT) AS gen, k AS row_id,
  CASE WHEN k % 7 = 6 THEN '' ELSE concat('P', CAST(k AS STRING)) END AS person_id,
  given_name, surname, concat(given_name, ' ', surname) AS name, gender, birth_date, birth_place,
  CASE WHEN k % 5 = 2 THEN '' ELSE CAST(1980 - 28 * (length(bin(asc_no)) - 1) + 56 + k % 23 AS STRING) END AS death_date,
  confidence_level, CASE WHEN asc_no <= 3 THEN 100 ELSE CAST(k * 37 % 101 AS INT) END AS confidence_score,
  discovery_method
FROM (
SELECT job_id, asc_no, k,
  CASE WHEN asc_no % 2 = 0 THEN CASE k % 8 WHEN 0 THEN 'William' WHEN 1 THEN 'Bill' WHEN 2 THEN 'Thomas' WHEN 3 THEN 'Thos' WHEN 4 THEN 'Henry' WHEN 5 THEN 'Harry' WHEN 6 THEN 'John' ELSE 'Jack' END
       ELSE CASE k % 8 WHEN 0 THEN 'Elizabeth' WHEN 1 THEN 'Betty' WHEN 2 THEN 'Sarah' WHEN 3 THEN 'Sally' WHEN 4 THEN 'Mary' WHEN 5 THEN 'Polly' WHEN 6 THEN 'Ann' ELSE 'Annie' END END AS given_name,
  CASE WHEN k % 17 = 0 THEN 'Jelley' WHEN k % 19 = 4 THEN 'Hunt-Smith' WHEN k % 23 = 7 THEN 'Whitehunt' ELSE CASE (length(regexp_replace(bin(asc_no), '0+$', '')) * 5 + job_id) % 6 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Ahlfors' WHEN 2 THEN 'Hunt' WHEN 3 THEN 'Skinner' WHEN 4 THEN 'Jackson' ELSE 'MacDonald' END END AS surname,
  CASE WHEN asc_no = 1 THEN 'Unknown' WHEN asc_no % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  CASE WHEN k % 13 = 5 THEN '' ELSE CASE k % 4
    WHEN 0 THEN concat('1 September ', CAST(1980 - 28 * (length(bin(asc_no)) - 1) + k % 9 - 4 AS STRING))
    WHEN 1 THEN concat('07/03/', CAST(1980 - 28 * (length(bin(asc_no)) - 1) + k % 9 - 4 AS STRING))
    WHEN 2 THEN concat('abt ', CAST(1980 - 28 * (length(bin(asc_no)) - 1) + k % 9 - 4 AS STRING))
    ELSE concat('Sep ', CAST(1980 - 28 * (length(bin(asc_no)) - 1) + k % 9 - 4 AS STRING)) END END AS birth_date,
  CASE k % 6 WHEN 0 THEN 'Derby, Derbyshire, England' WHEN 1 THEN 'Shardlow, Derbyshire' WHEN 2 THEN CASE k % 12 WHEN 2 THEN 'Nottingham' ELSE concat({town_name('floor(k / 12) % 1000')}, ', England') END WHEN 3 THEN 'Kensington, Middlesex, England' WHEN 4 THEN 'Springfield, IL' ELSE '' END AS birth_place,
  CASE WHEN asc_no <= 3 THEN 'Customer Data' ELSE 'Pending' END AS confidence_level,
  CASE k % 4 WHEN 0 THEN 'tree_parents_verified' WHEN 1 THEN 'direct_search_verified' WHEN 2 THEN 'tree_parents_unverified' ELSE '' END AS discovery_method
FROM (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 127.0) AS BIGINT) AS job_id, CAST(o_orderkey % 127 + 1 AS INT) AS asc_no
      FROM orders WHERE NOT (o_orderkey % 11 = 3 AND o_orderkey % 127 > 0)) s) t"""),
    "fx_job": (("orders",), """
SELECT job_id, concat('Customer ', CAST(job_id AS STRING)) AS customer_name,
  CASE job_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'completed' END AS status,
  6 AS generations, created_on
FROM (SELECT CAST(floor(o_orderkey / 127.0) AS BIGINT) AS job_id, CAST(min(o_orderdate) AS DATE) AS created_on FROM orders
      GROUP BY CAST(floor(o_orderkey / 127.0) AS BIGINT)) j"""),
    "fx_src": (("lineitem",), f"""
SELECT concat('P', CAST(l_orderkey AS STRING)) AS person_id, seq,
  CASE l_partkey % 10 WHEN 0 THEN 'England Birth Registration Index' WHEN 1 THEN 'England Marriage Registration Index' WHEN 2 THEN 'England Death Register'
    WHEN 3 THEN 'England Census, 1881' WHEN 4 THEN 'England Census, 1891' WHEN 5 THEN '1939 Register' WHEN 6 THEN 'Derbyshire Parish Register 1799'
    WHEN 7 THEN 'Army Medal Roll' WHEN 8 THEN 'Probate Calendar' ELSE concat('Family note ', CAST(l_suppkey AS STRING)) END AS title,
  concat('https://example.org/s/', CAST(l_partkey AS STRING)) AS url,
  CASE WHEN l_suppkey % 3 = 0 THEN 'Held at <b>Derbyshire</b> Record Office' ELSE '' END AS citation
FROM {_LINES} l"""),
    "fx_fact": (("lineitem",), f"""
SELECT concat('P', CAST(l_orderkey AS STRING)) AS person_id, seq,
  CASE l_suppkey % 8 WHEN 0 THEN 'http://gedcomx.org/Birth' WHEN 1 THEN 'http://gedcomx.org/Christening' WHEN 2 THEN 'http://gedcomx.org/Death' WHEN 3 THEN 'http://gedcomx.org/Marriage'
    WHEN 4 THEN 'http://gedcomx.org/Residence' WHEN 5 THEN 'http://gedcomx.org/Census' WHEN 6 THEN 'http://gedcomx.org/Burial' ELSE 'http://gedcomx.org/Occupation' END AS fact_type,
  CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('12 May ', CAST(1820 + l_partkey % 120 AS STRING)) END AS fact_date,
  CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Derby, Derbyshire' WHEN 2 THEN 'Belper' ELSE 'Leicester, Leicestershire' END AS fact_place
FROM {_LINES} l"""),
    "fx_civil": (("lineitem", "fx_anc"), f"""
SELECT CASE l_linenumber % 3 WHEN 0 THEN 'death' WHEN 1 THEN 'birth' ELSE 'marriage' END AS entry_type,
  a.surname, CASE l_suppkey % 7 WHEN 1 THEN concat('Herbert ', a.given_name) WHEN 2 THEN concat(a.given_name, ' May') ELSE a.given_name END AS forenames,
  CASE (l_suppkey + a.job_id) % 6 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Ahlfors' WHEN 2 THEN 'Hunt' WHEN 3 THEN 'Skinner' WHEN 4 THEN 'Jackson' ELSE '' END AS spouse_surname,
  CAST(1980 - 28 * a.gen + CASE l_linenumber % 3 WHEN 0 THEN 60 WHEN 1 THEN 0 ELSE 24 END + l_partkey % 9 - 4 AS INT) AS year,
  CASE l_partkey % 4 WHEN 0 THEN 'Mar' WHEN 1 THEN 'Jun' WHEN 2 THEN 'Sep' ELSE 'Dec' END AS quarter,
  CASE l_suppkey % 5 WHEN 0 THEN 'Derby' WHEN 1 THEN 'Shardlow' WHEN 2 THEN 'Belper' WHEN 3 THEN 'Nottingham' ELSE 'Kensington' END AS district,
  concat(CAST(7 + l_suppkey % 3 AS STRING), 'b') AS volume, CAST(l_partkey AS STRING) AS page, l_orderkey * 1000 + seq AS entry_id
FROM {_LINES} l JOIN fx_anc a ON a.row_id = l_orderkey"""),
    "fx_cand": (("lineitem", "fx_anc"), f"""
SELECT a.job_id, a.asc_no, seq AS rnk, concat('C', CAST(l_partkey AS STRING)) AS person_id,
  CASE l_suppkey % 4 WHEN 0 THEN a.given_name WHEN 1 THEN concat(a.given_name, ' Herbert') WHEN 2 THEN 'Walter' ELSE 'Bill' END AS given_name,
  CASE WHEN l_suppkey % 9 = 0 THEN 'Taylor' ELSE a.surname END AS surname, a.gender,
  CASE WHEN l_partkey % 7 = 0 THEN '' ELSE CAST(1980 - 28 * a.gen + l_partkey % 21 - 10 AS STRING) END AS birth_date,
  CASE l_partkey % 5 WHEN 0 THEN 'Derby, Derbyshire, England' WHEN 1 THEN 'Leicester, Leicestershire' WHEN 2 THEN 'Truro, Cornwall' WHEN 3 THEN 'Ohio, United States' ELSE CASE WHEN l_partkey % 2 = 0 THEN {town_name('floor(l_partkey / 10) % 1000')} ELSE '' END END AS birth_place,
  CASE WHEN l_suppkey % 11 = 0 THEN 'Manually rejected by admin' ELSE '' END AS rejection_reason
FROM {_LINES} l JOIN fx_anc a ON a.row_id = l_orderkey"""),
    # The same candidates beside the slot they were found for.
    "fx_pair": (("fx_cand", "fx_anc"), """
SELECT c.job_id, c.asc_no, c.rnk, c.person_id, c.given_name AS cand_given, c.surname AS cand_surname, c.birth_date AS cand_birth,
  c.birth_place AS cand_place, c.gender AS cand_gender, c.rejection_reason, a.given_name AS anc_given, a.surname AS anc_surname,
  a.birth_date AS anc_birth, a.birth_place AS anc_place, a.gen
FROM fx_cand c JOIN fx_anc a ON a.job_id = c.job_id AND a.asc_no = c.asc_no"""),
    "fx_edge": (("fx_anc",), """
SELECT 'ParentChild' AS rel, p.job_id, p.person_id AS src, c.person_id AS dst, p.gender AS src_gender,
  CASE WHEN p.row_id % 10 = 0 THEN 'Adoptive' ELSE 'Biological' END AS kind, '' AS marriage_date, p.asc_no AS ord
FROM fx_anc p JOIN fx_anc c ON c.job_id = p.job_id AND c.asc_no = CAST(floor(p.asc_no / 2.0) AS INT)
WHERE p.asc_no > 1 AND p.person_id <> '' AND c.person_id <> ''
UNION ALL
SELECT 'Couple' AS rel, f.job_id, f.person_id AS src, m.person_id AS dst, f.gender AS src_gender, '' AS kind,
  concat('4 June ', CAST(2004 - 28 * f.gen AS STRING)) AS marriage_date, f.asc_no AS ord
FROM fx_anc f JOIN fx_anc m ON m.job_id = f.job_id AND m.asc_no = f.asc_no + 1
WHERE f.asc_no % 2 = 0 AND f.person_id <> '' AND m.person_id <> ''"""),
    "fx_union": (("fx_anc",), """
SELECT p.job_id * 1000 + CAST(floor(p.asc_no / 2.0) AS BIGINT) AS union_id, 'partner' AS role, p.person_id AS node_id, p.gender
FROM fx_anc p WHERE p.asc_no > 1 AND p.person_id <> ''
UNION ALL
SELECT c.job_id * 1000 + c.asc_no AS union_id, 'child' AS role, c.person_id AS node_id, c.gender
FROM fx_anc c WHERE c.person_id <> '' AND c.asc_no < 64"""),
    # One document per record type and year. Line numbers rise with the text, with gaps.
    "fx_dump": (("fx_civil",), """
SELECT concat(entry_type, '-', CAST(year AS STRING)) AS doc, entry_type,
  CAST(CASE quarter WHEN 'Mar' THEN 0 WHEN 'Jun' THEN 1 WHEN 'Sep' THEN 2 ELSE 3 END AS BIGINT) * 1000000000000 AS line_no,
  concat(';;', CASE quarter WHEN 'Mar' THEN '0' WHEN 'Jun' THEN '1' WHEN 'Sep' THEN '2' ELSE '3' END, ';', CAST(year AS STRING)) AS line
FROM (SELECT DISTINCT entry_type, year, quarter FROM fx_civil) h
UNION ALL
SELECT concat(entry_type, '-', CAST(year AS STRING)) AS doc, entry_type,
  CAST(CASE quarter WHEN 'Mar' THEN 0 WHEN 'Jun' THEN 1 WHEN 'Sep' THEN 2 ELSE 3 END AS BIGINT) * 1000000000000 + entry_id + 1 AS line_no,
  concat('1;', surname, ';', forenames, '+H%2E;', spouse_surname, ';;', district, ';', volume, ';', page) AS line FROM fx_civil"""),
    "fx_review": (("fx_anc",), """
SELECT job_id, asc_no, CAST(row_id % 61 - 50 AS INT) AS adj_a, CAST((row_id * 7) % 61 - 50 AS INT) AS adj_b,
  concat('birth year should be ', CAST(1980 - 28 * gen AS STRING)) AS fix_a,
  CASE row_id % 3 WHEN 0 THEN concat('Birth year should be ', CAST(1980 - 28 * gen AS STRING), '.') WHEN 1 THEN 'birth place should be Derby, Derbyshire' ELSE '' END AS fix_b
FROM fx_anc WHERE row_id % 2 = 0"""),
    # The flags of both reviewers, one row each.
    "fx_flag": (("fx_anc",), """
SELECT job_id, asc_no, reviewer, pos, severity, suggestion FROM (
SELECT job_id, asc_no, 'a' AS reviewer, 1 AS pos, CASE row_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'confirmation' END AS severity,
  concat('birth year should be ', CAST(1980 - 28 * gen AS STRING)) AS suggestion FROM fx_anc WHERE row_id % 2 = 0
UNION ALL
SELECT job_id, asc_no, 'a' AS reviewer, 2 AS pos, 'warning' AS severity, 'death place should be Belper, Derbyshire' AS suggestion FROM fx_anc WHERE row_id % 6 = 2
UNION ALL
SELECT job_id, asc_no, 'b' AS reviewer, 1 AS pos, CASE row_id % 4 WHEN 0 THEN 'error' ELSE 'warning' END AS severity,
  CASE row_id % 5 WHEN 0 THEN 'birth place should be Derby, Derbyshire' WHEN 1 THEN 'no change needed' ELSE concat('The birth year should be ', CAST(1980 - 28 * gen AS STRING), '.') END AS suggestion FROM fx_anc WHERE row_id % 3 = 0
UNION ALL
SELECT job_id, asc_no, 'b' AS reviewer, 2 AS pos, 'confirmation' AS severity, 'Death place should be Belper, Derbyshire.' AS suggestion FROM fx_anc WHERE row_id % 4 = 2
) f"""),
    "fx_feedback": (("events",), """
SELECT event_id AS id, user_id AS job_id, ts AS created_at,
  CASE event_type WHEN 'view' THEN 'accept' WHEN 'click' THEN 'correct' WHEN 'error' THEN 'reject' ELSE 'select_alternative' END AS action_type,
  CASE event_id % 6 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Ahlfors' WHEN 2 THEN 'Hunt' WHEN 3 THEN 'Skinner' WHEN 4 THEN '' ELSE 'MacDonald' END AS surname,
  CAST(1800 + event_id % 180 AS INT) AS birth_year,
  CASE event_id % 3 WHEN 0 THEN 'Derby, Derbyshire' WHEN 1 THEN '' ELSE 'Nottingham' END AS location
FROM events"""),
    "fx_intake": (("customer",), """
SELECT c_custkey AS submission_id,
  concat('{"has_children":"', CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END,
    '","user_role":"', CASE WHEN c_custkey % 4 = 0 THEN 'Dad' ELSE 'Mum' END,
    '","customer_full_name":"', c_name,
    '","child1_first_name":"', CASE WHEN c_custkey % 14 = 0 THEN '' ELSE 'Alan' END, '","child1_last_name_at_birth":"Hunt","child2_first_name":"', CASE WHEN c_custkey % 6 = 0 THEN 'Joan' ELSE '' END,
    '","child2_last_name_at_birth":"Hunt","add_child_2":"', CASE WHEN c_custkey % 12 = 0 THEN 'No' ELSE 'Yes' END,
    '","child3_first_name":"', CASE WHEN c_custkey % 10 = 0 THEN 'Tim' ELSE '' END,
    '","root_first_name":"', CASE WHEN c_custkey % 5 = 1 THEN '' ELSE 'Norman' END,
    '","root_last_name_at_birth":"Hunt","user_first_name":"Brian","user_last_name_at_birth":"Hunt","user_birth_date":"', CAST(1940 + c_custkey % 30 AS STRING),
    '","partner_first_name":"Julie","partner_middle_names":"Ann","partner_last_name_at_birth":"Jackson","user_dad_first_name":"Norman","user_dad_last_name_at_birth":"Hunt","user_dad_birth_year":"', CAST(1900 + c_custkey % 30 AS STRING),
    '","user_dad_birth_place_town":"Derby","user_dad_birth_place_county":"Derbyshire","partner_mum_first_name":"Ethel","partner_mum_known":"', CASE WHEN c_custkey % 3 = 0 THEN 'No' ELSE 'Yes' END,
    '","user_pat_gf_first_name":"Frederick","user_pat_gf_last_name_at_birth":"Hunt","root_dad_first_name":"Brian","root_dad_last_name_at_birth":"Hunt","root_pat_gf_first_name":"Fred","root_pat_gf_last_name_at_birth":"Hunt","root_pat_gf_ggf_first_name":"Walter","root_pat_gf_ggf_birth_year":"1870","user_pat_gf_ggf_first_name":"Amos","user_pat_gf_ggf_last_name_at_birth":"Hunt","user_pat_gf_ggf_birth_year":"', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '1841' END,
    '","partner_mat_gf_ggm_first_name":"', CASE WHEN c_custkey % 5 = 0 THEN 'Ida' ELSE '' END, '","partner_mat_gf_ggm_middle_names":"Ann","partner_mat_gm_ggm_first_name":"Eve","partner_mat_gm_ggm_birth_place_town":"Belper","partner_mat_gm_ggm_birth_place_county":"Derbyshire","user_pat_gm_ggf_first_name":"', CASE WHEN c_custkey % 7 = 0 THEN 'Seth' ELSE '' END, '"}') AS raw_request
FROM customer"""),
    "fx_notes": (("documents",), """
SELECT doc_id, concat(text, chr(10), CASE doc_id % 4 WHEN 0 THEN concat('Paternal GP: Norman Hunt (', CAST(1900 + doc_id % 40 AS STRING), '-', CAST(1970 + doc_id % 30 AS STRING), ') and Ivy Skinner (1902-1980)')
    WHEN 1 THEN 'Maternal grandfather: Albert Jackson, Derby' WHEN 2 THEN 'Paternal grandmother was Ethel Skinner (1905-1980), Belper' ELSE 'Mother: Julie Ann Jackson (1942-present)' END, chr(10),
  CASE doc_id % 3 WHEN 0 THEN 'Great-grandfather (paternal paternal): Frederick Hunt, born 1875, died 1950' WHEN 1 THEN 'GGP15: Gertrude May Griffin' ELSE 'Maternal maternal great-grandmother: Jessie Mayne (1880-1959)' END, chr(10),
  CASE doc_id % 5 WHEN 0 THEN 'Gertrude May Griffin of Belper was born on 3 May 1881' WHEN 1 THEN 'Albert Jackson b. 01.02.1911, Belper, d. 1970' ELSE 'Nothing more is known' END, chr(10),
  'Father: Brian Jackson (', CAST(1930 + doc_id % 20 AS STRING), '-', CASE WHEN doc_id % 2 = 0 THEN 'living' ELSE '2001' END, ')') AS notes
FROM documents"""),
}


def closure(names) -> list[str]:
    """The fixtures asked for and those they need, in dependency order."""
    out: list[str] = []

    def visit(name: str) -> None:
        for dep in FIXTURES[name][0] if name in FIXTURES else ():
            visit(dep)
        if name in FIXTURES and name not in out:
            out.append(name)

    for n in names:
        visit(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived fixture as a DataFrame."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for step in closure([name]):
        for dep in FIXTURES[step][0]:
            if dep not in FIXTURES:
                spark.read.parquet(f"{sf_dir}/{dep}.parquet").createOrReplaceTempView(dep)
        if step != name:
            spark.sql(FIXTURES[step][1]).createOrReplaceTempView(step)
    return spark.sql(FIXTURES[name][1])


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table written once per application and read back, for queries that read it several times.

    A stored table would simply be read; deriving it anew for each use would cost more than the query.
    """
    if name not in FIXTURES:
        return table(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        from kinforge.session import materialized

        for dep in FIXTURES[name][0]:
            staged(spark, sf_dir, dep).createOrReplaceTempView(dep)
        _STAGED[key] = materialized(spark.sql(FIXTURES[name][1]), for_all=True)
    return _STAGED[key]


def with_fixtures(names, body: str, *more: str) -> str:
    """DuckDB text: the fixtures, and more CTEs on them, in front of a query."""
    ctes = [f"{n} AS ({FIXTURES[n][1].strip()})" for n in closure(names)] + list(more)
    body = body.strip()
    recursive = ""
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            recursive = "RECURSIVE " if "RECURSIVE" in head else ""
            if not ctes:
                return body
            return f"WITH {recursive}" + ",\n".join(ctes) + ",\n" + body[len(head):]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
