"""DuckDB SQL for the queries: common tables over the driver's views, and a way to put a body after them."""

from __future__ import annotations

BASE = """
SELECT
  l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
  CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) AS raw_id,
  CAST(row_number() OVER (PARTITION BY l.l_orderkey, l.l_linenumber
       ORDER BY l.l_partkey, l.l_suppkey, l.l_extendedprice) AS BIGINT) AS occurrence,
  CAST(o.o_orderkey AS STRING) AS article_id,
  CAST(extract(year FROM o.o_orderdate) AS BIGINT) AS article_year,
  cn.n_name AS country, cr.r_name AS continent,
  CASE o.o_orderstatus WHEN 'O' THEN 'Cross-sectional studies' WHEN 'F' THEN 'Longitudinal' ELSE 'N.A.' END AS study_type,
  CASE l.l_returnflag WHEN 'R' THEN '+' WHEN 'A' THEN '-' ELSE 'NS' END AS relation_direction,
  CASE WHEN l.l_linestatus = 'O' THEN 'Simple analyses' ELSE 'Complex analyses' END AS complexity,
  CASE c.c_mktsegment WHEN 'MACHINERY' THEN 'Male' WHEN 'FURNITURE' THEN 'Female' WHEN 'BUILDING' THEN 'Mixed' ELSE 'N.A.' END AS gender,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Individual sport' WHEN '2-HIGH' THEN 'Team sport' WHEN '3-MEDIUM' THEN 'Mixed sport' WHEN '4-NOT SPECIFIED' THEN 'Aesthetic sport' ELSE 'N.A.' END AS practice_type,
  split_part(p.p_name, ' ', 2) AS sport_name,
  'urn:kg/vocab/' || replace(p.p_name, ' ', '_') AS vi_iri,
  'urn:kg/vocab/' || s.s_name AS vd_iri,
  CASE WHEN l.l_suppkey % 7 = 0 THEN 'Mediator ' || p.p_brand WHEN l.l_suppkey % 5 = 0 THEN 'N.A.' END AS mediator,
  CASE WHEN l.l_suppkey % 11 = 0 THEN 'Moderator ' || p.p_type END AS moderator,
  CASE WHEN l.l_linenumber = 1 THEN 'N.A.' ELSE 'M=' || CAST(CAST(l.l_quantity AS INT) AS STRING) || ',' || CAST(CAST(round(l.l_discount * 100) AS INT) % 10 AS STRING) || ' (SD=2,1)' END AS age_mean_raw,
  CASE WHEN l.l_linenumber = 2 THEN 'N.A.' ELSE '[' || CAST(p.p_size AS STRING) || '-' || CAST(p.p_size + 5 AS STRING) || ']' END AS age_range_raw,
  CASE WHEN l.l_linenumber = 3 THEN 'N.A.' ELSE CAST(CAST(l.l_quantity AS INT) AS STRING) || ',5' END AS freq_mean_raw,
  CAST(CAST(l.l_quantity AS INT) AS STRING) AS freq_min_raw,
  CAST(CAST(l.l_quantity AS INT) + 4 AS STRING) AS freq_max_raw,
  CASE l.l_suppkey % 5 WHEN 0 THEN 'hours' WHEN 1 THEN 'minutes' WHEN 2 THEN 'days' WHEN 3 THEN 'sessions' END AS freq_unit,
  CASE WHEN l.l_partkey % 3 = 0 THEN 'day' ELSE 'week' END AS freq_base,
  CAST(p.p_size AS STRING) || ',0' AS exp_mean_raw,
  CAST(p.p_size AS STRING) AS exp_min_raw, CAST(p.p_size + 3 AS STRING) AS exp_max_raw,
  CASE l.l_partkey % 5 WHEN 0 THEN 'years' WHEN 1 THEN 'months' WHEN 2 THEN 'weeks' WHEN 3 THEN 'days' END AS exp_unit,
  CAST(CAST(floor(o.o_totalprice / 250) AS BIGINT) AS STRING) AS sample_size_raw,
  CASE WHEN CAST(round(l.l_discount * 100) AS INT) < 5 THEN '-' ELSE '' END ||
    CASE WHEN abs(CAST(round(l.l_discount * 100) AS INT) - 5) = 5 THEN '1,0' ELSE '0,' || CAST(abs(CAST(round(l.l_discount * 100) AS INT) - 5) * 2 AS STRING) END AS degree_r_raw,
  '0,0' || CAST(CAST(round(l.l_tax * 100) AS INT) AS STRING) AS degree_p_raw
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey
JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""

EDGES = """
SELECT DISTINCT 'urn:kg/vocab/' || s.s_name AS child, 'urn:kg/vocab/' || n.n_name AS parent FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
UNION SELECT 'urn:kg/vocab/' || n.n_name, 'urn:kg/vocab/' || replace(r.r_name, ' ', '_') FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
UNION SELECT 'urn:kg/vocab/' || replace(p.p_name, ' ', '_'), 'urn:kg/vocab/Type_' || p.p_type FROM part p
UNION SELECT 'urn:kg/vocab/Type_' || p.p_type, CASE WHEN p.p_type IN ('SMALL','MEDIUM','LARGE') THEN 'urn:kg/vocab/Size_factor' ELSE 'urn:kg/vocab/Market_factor' END FROM part p
"""


def number(x: str) -> str:
    return f"CAST(try_cast(replace({x}, ',', '.') AS DECIMAL(18,6)) AS DOUBLE)"


def parsed(column: str, form: str, group: int) -> str:
    return number(f"regexp_extract({column}, '{form}', {group})")


def hours(v: str) -> str:
    u, b = "coalesce(freq_unit, '')", "coalesce(freq_base, '')"
    return f"""CASE WHEN {u} = 'minutes' AND {b} = 'week' THEN {v} / 60.0 WHEN {u} = 'minutes' AND {b} = 'day' THEN {v} / 60.0 * 7.0
    WHEN {u} = 'hours' AND {b} = 'day' THEN {v} * 7.0 WHEN {u} = 'hours' AND {b} = 'week' THEN {v} WHEN {u} = 'days' AND {b} = 'week' THEN {v} * 24.0
    WHEN {u} = 'sessions' AND {b} = 'week' THEN {v} * 1.5 WHEN {v} < 50 THEN {v} ELSE {v} / 60.0 END"""


def hours4(v: str) -> str:
    return f"CASE WHEN coalesce(freq_unit, '') = 'minutes' AND coalesce(freq_base, '') = 'week' THEN {v} / 60.0 WHEN coalesce(freq_unit, '') = 'days' AND coalesce(freq_base, '') = 'week' THEN {v} * 24.0 ELSE {v} END"


def years(v: str) -> str:
    return f"CASE coalesce(exp_unit, '') WHEN 'months' THEN {v} / 12.0 WHEN 'weeks' THEN {v} / 52.0 WHEN 'days' THEN {v} / 365.0 ELSE {v} END"


A1 = f"""SELECT *, CASE WHEN occurrence = 1 THEN raw_id ELSE raw_id || '.' || CAST(occurrence - 1 AS STRING) END AS analysis_id,
  regexp_replace(vi_iri, '.*vocab/', '') AS vi, regexp_replace(vd_iri, '.*vocab/', '') AS vd,
  replace(regexp_replace(vi_iri, '.*vocab/', ''), '_', ' ') AS vi_label, replace(regexp_replace(vd_iri, '.*vocab/', ''), '_', ' ') AS vd_label,
  {parsed("age_mean_raw", "^M=([0-9.,]+)", 1)} AS age_mean,
  {parsed("age_range_raw", r"^\[([0-9.,]+)-([0-9.,]+)\]", 1)} AS age_lo, {parsed("age_range_raw", r"^\[([0-9.,]+)-([0-9.,]+)\]", 2)} AS age_hi,
  {number("freq_mean_raw")} AS freq_mean, {number("freq_min_raw")} AS freq_min, {number("freq_max_raw")} AS freq_max,
  {number("exp_mean_raw")} AS exp_mean, {number("exp_min_raw")} AS exp_min, {number("exp_max_raw")} AS exp_max,
  try_cast(sample_size_raw AS BIGINT) AS sample_size, {number("degree_r_raw")} AS degree_r, {number("degree_p_raw")} AS degree_p
FROM kg_base"""
A = f"""SELECT *, {hours("freq_mean")} AS freq_hours, {hours4("freq_mean")} AS freq_mean4, {hours4("freq_min")} AS freq_min4, {hours4("freq_max")} AS freq_max4,
  {years("exp_mean")} AS exp_years, {years("exp_min")} AS exp_min_years, {years("exp_max")} AS exp_max_years FROM a1"""
CLOSURE = "SELECT child AS descendant, parent AS ancestor FROM kg_edges UNION SELECT c.descendant, e.parent FROM closure c JOIN kg_edges e ON c.ancestor = e.child"
LABEL = "replace(regexp_replace({}, '.*vocab/', ''), '_', ' ')"
CATEGORY = f"SELECT {LABEL.format('child')} AS label, min(replace(regexp_replace(parent, '.*/', ''), '%20', ' ')) AS category FROM kg_edges GROUP BY 1"
C = "SELECT a.*, a.raw_id AS reference, i.category AS category_vi, d.category AS category_vd FROM a LEFT JOIN mincat i ON a.vi_label = i.label LEFT JOIN mincat d ON a.vd_label = d.label"
TRIPLES = (
    "SELECT DISTINCT s, p, o FROM (SELECT 'urn:kg/data/Analysis_' || analysis_id AS s, 'urn:kg/rdf/type' AS p, 'urn:kg/ontology/Analysis' AS o FROM a"
    + "".join(f" UNION ALL SELECT 'urn:kg/data/Analysis_' || analysis_id, 'urn:kg/ontology/{c}', {c} FROM a" for c in ("relation_direction", "complexity", "gender", "practice_type", "sport_name", "mediator", "moderator", "country", "study_type", "vi_iri", "vd_iri", "age_mean_raw", "article_id"))
    + ") WHERE o IS NOT NULL AND o <> ''"
)
VIA = """SELECT analysis_id, 'factor_' || vi AS source, CASE WHEN m THEN 'mediator_' || mediator WHEN o THEN 'moderator_' || moderator ELSE 'acad_' || vd END AS target,
  CASE WHEN m THEN 'mediator' WHEN o THEN 'moderator' ELSE coalesce(relation_direction, 'NS') END AS relation FROM (SELECT *, coalesce(mediator <> 'N.A.', false) AS m, coalesce(moderator <> 'N.A.', false) AS o FROM a)
UNION ALL SELECT analysis_id, CASE WHEN m THEN 'mediator_' || mediator ELSE 'moderator_' || moderator END, 'acad_' || vd, coalesce(relation_direction, 'NS')
  FROM (SELECT *, coalesce(mediator <> 'N.A.', false) AS m, coalesce(moderator <> 'N.A.', false) AS o FROM a) WHERE m OR o"""
GROUPED = "SELECT source, target, relation, count(*) AS n, min(analysis_id) AS representative FROM via GROUP BY ALL"

TABLES = {"kg_base": BASE, "kg_edges": EDGES, "a1": A1, "a": A, "closure": CLOSURE, "mincat": CATEGORY, "c": C, "t": TRIPLES, "via": VIA, "grouped": GROUPED}
NEEDS = {"a1": ("kg_base",), "a": ("a1",), "closure": ("kg_edges",), "mincat": ("kg_edges",), "c": ("a", "mincat"), "t": ("a",), "via": ("a",), "grouped": ("via",)}


def over(body: str, *tables: str) -> str:
    """body after the definitions of the tables it reads."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        for x in NEEDS.get(name, ()):
            add(x)
        wanted.add(name)

    for t in tables:
        add(t)
    # The triples are read more than once: made once.
    parts = ", ".join(f"{k} AS {'MATERIALIZED ' if k == 't' else ''}({v.strip()})" for k, v in TABLES.items() if k in wanted)
    return f"WITH {'RECURSIVE ' if 'closure' in wanted else ''}{parts} {body}" if parts else body
