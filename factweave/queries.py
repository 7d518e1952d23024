"""The registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave import entity_queries
from factweave.functions import numbers, text
from factweave.operators import hierarchy, network, questions, reports, shapes, statistics, updates
from factweave.operators.search import AGE, RESULT, Filters, Statistic, contains_any, search, with_categories
from factweave.plans import patterns
from factweave.plans.oracle import LABEL, over
from factweave.sources import binding, files
from factweave.sources.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None, *tables: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = over(sql, *tables)


A = binding.analyses
E = binding.edges
C = hierarchy.closure_of
ONT, DATA = binding.ONTOLOGY, binding.DATA
ANALYSIS = ONT + "Analysis"


def T(spark: SparkSession, d: str, *properties: str) -> DataFrame:
    """The triples of analyses; with properties (type: the class) only theirs."""
    names = tuple(p for p in properties if p != "type")
    names = names or binding.PROPERTIES if not properties else names
    return binding.triples(binding.stored_analyses(spark, d, "analysis_id", *names), names, not properties or "type" in properties)


def AC(spark: SparkSession, d: str) -> DataFrame:
    return with_categories(A(spark, d), E(spark, d))


def doc(spark: SparkSession, d: str, name: str) -> DataFrame:
    return binding.table(spark, d, name)


def _by_ancestor(spark: SparkSession, d: str, concept: str) -> DataFrame:
    """ancestor, n: the analyses below each concept. Counted by concept first, so no analysis is copied for each of its ancestors; an analysis has one concept, so nothing counts twice."""
    counts = A(spark, d).groupBy(F.col(concept).alias("descendant")).agg(F.count(F.lit(1)).alias("k"))
    return counts.join(C(spark, d), "descendant").groupBy("ancestor").agg(F.sum("k").alias("n"))


# Search: the filters, and the same condition in SQL.
def _ranges(mean: str, lo: str, hi: str, bounds: list[tuple[float, float]], overlap: bool) -> str:
    one = lambda a, b: f"{mean} BETWEEN {a} AND {b}" + (f" OR ({hi} >= {a} AND {lo} <= {b})" if overlap else "")
    return "(" + " OR ".join(one(*b) for b in bounds) + ")"


SEARCHES: dict[str, tuple[Filters, str]] = {
    "base": (Filters(), "true"),
    "mean_age_pm1": (Filters(age=Statistic(mean=21)), "age_mean BETWEEN 20 AND 22"),
    "age_categories_overlap": (Filters(age=Statistic(categories=("adolescent", "adulte"))), _ranges("age_mean", "age_lo", "age_hi", [(15, 19), (26, 35)], True)),
    "age_categories_strict": (Filters(age=Statistic(categories=("jeune-adulte", "senior"), overlap=False)), _ranges("age_mean", "age_lo", "age_hi", [(18, 26), (50, 80)], False)),
    "age_range_strict": (Filters(age=Statistic(low=18, high=25, by_mean=True)), "age_mean BETWEEN 18 AND 25"),
    "age_range_inclusive": (Filters(age=Statistic(low=18, high=25, by_mean=True, inclusive=True)), _ranges("age_mean", "age_lo", "age_hi", [(18, 25)], True)),
    "age_containment": (Filters(age=Statistic(low=18, high=30)), "age_lo >= 18 AND age_hi <= 30"),
    "age_min_only": (Filters(age=Statistic(low=40)), "age_lo >= 40"),
    "age_max_only": (Filters(age=Statistic(high=12)), "age_hi <= 12"),
    "freq_mean_pm1": (Filters(frequency=Statistic(mean=10)), "freq_hours BETWEEN 9 AND 11"),
    "freq_categories_overlap": (Filters(frequency=Statistic(categories=("faible", "elevee"))), _ranges("freq_mean4", "freq_min4", "freq_max4", [(0, 4.9), (10.1, 15)], True)),
    "freq_categories_strict": (Filters(frequency=Statistic(categories=("moderee", "intensive"), overlap=False)), _ranges("freq_mean4", "freq_min4", "freq_max4", [(5, 10), (15.1, 50)], False)),
    "freq_range_strict": (Filters(frequency=Statistic(low=5, high=12, by_mean=True)), "freq_mean4 BETWEEN 5 AND 12"),
    "freq_range_inclusive": (Filters(frequency=Statistic(low=5, high=12, by_mean=True, inclusive=True)), _ranges("freq_mean4", "freq_min4", "freq_max4", [(5, 12)], True)),
    "freq_containment": (Filters(frequency=Statistic(low=8, high=20)), "freq_min >= 8 AND freq_max <= 20"),
    "exp_mean_pm1": (Filters(experience=Statistic(mean=3)), "exp_years BETWEEN 2 AND 4"),
    "exp_categories_overlap": (Filters(experience=Statistic(categories=("debutant", "expert"))), _ranges("exp_years", "exp_min_years", "exp_max_years", [(0, 1.9), (15.1, 50)], True)),
    "exp_categories_strict": (Filters(experience=Statistic(categories=("intermediaire",), overlap=False)), "exp_years BETWEEN 2 AND 7"),
    "exp_range_strict": (Filters(experience=Statistic(low=2, high=6, by_mean=True)), "exp_years BETWEEN 2 AND 6"),
    "exp_range_inclusive": (Filters(experience=Statistic(low=2, high=6, by_mean=True, inclusive=True)), _ranges("exp_years", "exp_min_years", "exp_max_years", [(2, 6)], True)),
    "exp_containment": (Filters(experience=Statistic(low=5, high=20)), "exp_min >= 5 AND exp_max <= 20"),
    "gender": (Filters(gender="Female"), "gender = 'Female'"),
    "category_vd": (Filters(category_vd="ASIA"), f"vd_iri IN (SELECT descendant FROM closure WHERE {LABEL.format('ancestor')} = 'ASIA')"),
    "category_vi": (Filters(category_vi="Type_SMALL"), "category_vi = 'Type_SMALL'"),
    "category_vi_ancestor": (Filters(category_vi="Size factor", category_vi_mode="ancestor"), f"vi_iri IN (SELECT descendant FROM closure WHERE {LABEL.format('ancestor')} = 'Size factor')"),
    "sport_categories": (Filters(practice_types=("Team sport", "Mixed sport")), "practice_type IN ('Team sport', 'Mixed sport')"),
    "sports": (Filters(sports=("GEAR", "bolt")), "(contains(lower(sport_name), 'gear') OR contains(lower(sport_name), 'bolt'))"),
    "sport_type": (Filters(sport_type="gear"), "contains(lower(sport_name), 'gear')"),
    "selected_vi": (Filters(vi="small_gear"), "vi = 'small_gear'"),
    "selected_vd": (Filters(vd="Supplier#000000001"), "vd = 'Supplier#000000001'"),
    "direction": (Filters(direction="-"), "relation_direction = '-'"),
    "combined_profile": (Filters(gender="Female", category_vd="EUROPE", age=Statistic(mean=21)), f"gender = 'Female' AND age_mean BETWEEN 20 AND 22 AND vd_iri IN (SELECT descendant FROM closure WHERE {LABEL.format('ancestor')} = 'EUROPE')"),
}
for _name, (_f, _sql) in SEARCHES.items():
    add(f"search_{_name}", lambda s, d, f=_f: search(A(s, d), E(s, d), C(s, d) if f.category_vd or f.category_vi_mode == "ancestor" else None, f), f"SELECT {', '.join(RESULT)} FROM c WHERE complexity IN ('Simple analyses', 'simple analyses') AND ({_sql})", "c", *(("closure",) if "closure" in _sql else ()))

# Competency questions.
for _k, _q in questions.QUESTIONS.items():
    _cond = [f"{c} = '{v}'" for c, v in _q.equal]
    if _q.sports:
        _cond.append("(" + " OR ".join(f"contains(lower(sport_name), '{x}')" for x in _q.sports) + ")")
    if _q.mean_age:
        _cond.append("age_mean BETWEEN {} AND {}".format(*_q.mean_age))
    if _q.has_sport:
        _cond.append("sport_name IS NOT NULL")
    if _q.vi_below:
        _cond.append(f"vi_iri IN (SELECT descendant FROM closure WHERE {LABEL.format('ancestor')} = '{_q.vi_below}')")
    _cols = ", ".join(dict.fromkeys((*questions.BASE, *_q.extra)))
    add(f"cq_{_k}", lambda s, d, k=_k: questions.answer(A(s, d), E(s, d), C(s, d), k), f"SELECT DISTINCT {_cols} FROM c WHERE {' AND '.join(_cond) or 'true'}", "c", *(("closure",) if _q.vi_below else ()))
add("cq_by_dimension", lambda s, d: A(s, d).groupBy("relation_direction", "practice_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vi").alias("n_vi")), "SELECT relation_direction, practice_type, count(*) AS n, count(DISTINCT vi) AS n_vi FROM a GROUP BY ALL", "a")

# Hierarchies.
add("hier_closure", lambda s, d: C(s, d).select("descendant", "ancestor"), "SELECT descendant, ancestor FROM closure", "closure")
add("hier_roots", lambda s, d: hierarchy.roots(E(s, d)), "SELECT DISTINCT parent AS root FROM kg_edges WHERE parent NOT IN (SELECT child FROM kg_edges)", "kg_edges")
add("hier_roots_namespaced", lambda s, d: hierarchy.roots_within(E(s, d), "vocab/NATION"), "SELECT DISTINCT parent AS root FROM kg_edges WHERE contains(parent, 'vocab/NATION') AND parent NOT IN (SELECT child FROM kg_edges WHERE contains(parent, 'vocab/NATION'))", "kg_edges")
add("hier_descendants_of_label", lambda s, d: hierarchy.descendants_of(C(s, d), "ASIA"), f"SELECT DISTINCT descendant FROM closure WHERE {LABEL.format('ancestor')} = 'ASIA'", "closure")
add("hier_min_category", lambda s, d: hierarchy.min_category(E(s, d)), "SELECT label, category FROM mincat", "mincat")
add("hier_parents_by_level", lambda s, d: C(s, d).groupBy("depth").agg(F.count(F.lit(1)).alias("n")).select(F.col("depth").cast("long").alias("level"), "n"), "SELECT level, count(*) AS n FROM (SELECT descendant, ancestor, CAST(min(depth) AS BIGINT) AS level FROM w GROUP BY 1, 2) GROUP BY 1")
ORACLES["hier_parents_by_level"] = over("", "kg_edges").replace("WITH ", "WITH RECURSIVE ", 1) + ", w AS (SELECT child AS descendant, parent AS ancestor, 1 AS depth FROM kg_edges UNION SELECT w.descendant, e.parent, w.depth + 1 FROM w JOIN kg_edges e ON w.ancestor = e.child WHERE w.depth < 20) SELECT level, count(*) AS n FROM (SELECT descendant, ancestor, CAST(min(depth) AS BIGINT) AS level FROM w GROUP BY 1, 2) GROUP BY 1"
_NEAR = """SELECT 'urn:kg/vocab/NATION_1' AS concept, relation, related, replace(regexp_replace(related, '.*vocab/', ''), '_', ' ') AS related_label, CAST(level AS BIGINT) AS level FROM (
SELECT 'parent' AS relation, parent AS related, 1 AS level FROM kg_edges WHERE child = 'urn:kg/vocab/NATION_1'
UNION ALL SELECT 'child', child, 1 FROM kg_edges WHERE parent = 'urn:kg/vocab/NATION_1' UNION ALL SELECT DISTINCT 'self', 'urn:kg/vocab/NATION_1', 0 FROM kg_edges WHERE 'urn:kg/vocab/NATION_1' IN (child, parent))"""
add("hier_neighbourhood", lambda s, d: hierarchy.neighbourhood(E(s, d), C(s, d), "NATION 1"), _NEAR, "kg_edges")
add("hier_display_levels", lambda s, d: hierarchy.display_levels(hierarchy.neighbourhood(E(s, d), C(s, d), "NATION 1")), f"SELECT related_label, level, 'N' || CAST(row_number() OVER (ORDER BY level, related) AS STRING) AS display FROM ({_NEAR}) WHERE relation = 'parent'", "kg_edges")
add("hier_stats", lambda s, d: hierarchy.summary(hierarchy.neighbourhood(E(s, d), C(s, d), "NATION 1")), f"SELECT count(*) FILTER (relation = 'parent') AS n_parent, count(*) FILTER (relation = 'child') AS n_child, count(*) AS n_nodes, count(*) <= 1 AS is_empty FROM ({_NEAR})", "kg_edges")

# Filters and projections.
add("proj_bind_local_name", lambda s, d: A(s, d).select("analysis_id", "vi", "vi_label"), "SELECT analysis_id, vi, vi_label FROM a", "a")
add("filter_gender", lambda s, d: A(s, d).where("gender = 'Male'").select("analysis_id", "gender"), "SELECT analysis_id, gender FROM a WHERE gender = 'Male'", "a")
add("filter_complexity_in", lambda s, d: A(s, d).where(F.col("complexity").isin("Simple analyses", "simple analyses")).select("analysis_id"), "SELECT analysis_id FROM a WHERE complexity IN ('Simple analyses', 'simple analyses')", "a")
add("filter_not_na", lambda s, d: A(s, d).where("mediator <> 'N.A.'").select("analysis_id", "mediator"), "SELECT analysis_id, mediator FROM a WHERE mediator <> 'N.A.'", "a")
add("filter_numeric_text_range", lambda s, d: A(s, d).where(F.col("degree_r").between(0.2, 0.6)).select("analysis_id", "degree_r"), "SELECT analysis_id, degree_r FROM a WHERE degree_r BETWEEN 0.2 AND 0.6", "a")
add("filter_contains_ci", lambda s, d: doc(s, d, "documents").where(contains_any(F.col("text"), ("TOKEN",))).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'token')")
add("filter_contains_any", lambda s, d: doc(s, d, "documents").where(contains_any(F.col("text"), ("license", "password", "Stupid"))).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'password') OR contains(lower(text), 'stupid')")
add("filter_is_analysis_id", lambda s, d: A(s, d).where(text.is_analysis_id(F.col("article_id"))).groupBy("article_id").agg(F.count(F.lit(1)).alias("n")), "SELECT article_id, count(*) AS n FROM a WHERE regexp_matches(article_id, '(?i)^(A\\d+|Analysis_?\\d+|\\d+)$') GROUP BY 1", "a")
add("filter_nonempty_stats", lambda s, d: network.record(A(s, d)).where(text.present(F.col("value")).isNotNull()).groupBy("property").agg(F.count(F.lit(1)).alias("n")), "SELECT property, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS property, CAST({c} AS STRING) AS value FROM a" for cs in network.ENTITIES.values() for c in cs) + ") WHERE trim(value) NOT IN ('', 'NA', 'N.A.', 'N/A') GROUP BY 1", "a")

# Joins.
add("join_bgp_star", lambda s, d: patterns.match(T(s, d, "type", "vi_iri", "vd_iri"), ("?analysis", binding.TYPE, ANALYSIS), ("?analysis", ONT + "vi_iri", "?vi"), ("?analysis", ONT + "vd_iri", "?vd")), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS analysis, vi_iri AS vi, vd_iri AS vd FROM a", "a")
add("join_optional", lambda s, d: patterns.optional(patterns.match(T(s, d, "type", "moderator"), ("?analysis", binding.TYPE, ANALYSIS)), T(s, d, "type", "moderator"), ("?analysis", ONT + "moderator", "?moderator")), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS analysis, moderator FROM a", "a")
add("join_optional_group", lambda s, d: patterns.optional(patterns.match(T(s, d, "type", "mediator", "moderator"), ("?analysis", binding.TYPE, ANALYSIS)), T(s, d, "type", "mediator", "moderator"), ("?analysis", ONT + "mediator", "?mediator"), ("?analysis", ONT + "moderator", "?moderator")), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS analysis, CASE WHEN moderator IS NOT NULL THEN mediator END AS mediator, CASE WHEN mediator IS NOT NULL THEN moderator END AS moderator FROM a", "a")
add("join_left_preagg", lambda s, d: AC(s, d).select("analysis_id", "category_vi", "category_vd"), "SELECT analysis_id, category_vi, category_vd FROM c", "c")
add("join_label_key", lambda s, d: A(s, d).select("vd_label").distinct().join(hierarchy.min_category(E(s, d)), F.col("vd_label") == F.col("label")).select("vd_label", "category"), "SELECT DISTINCT vd_label, category FROM a JOIN mincat ON vd_label = label", "a", "mincat")
add("join_anti_roots", lambda s, d: doc(s, d, "orders").join(doc(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
add("join_anti_filtered", lambda s, d: A(s, d).where(F.coalesce(F.col("age_hi") >= 18, F.lit(False)) & ~F.coalesce(F.col("age_mean").between(18, 25), F.lit(False))).select("analysis_id"), "SELECT analysis_id FROM a WHERE age_hi >= 18 AND NOT coalesce(age_mean BETWEEN 18 AND 25, false)", "a")
_AGES = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in AGE.items())
add("join_range_overlap", lambda s, d: A(s, d).join(F.broadcast(s.createDataFrame([(k, float(a), float(b)) for k, (a, b) in AGE.items()], "category string, lo double, hi double")), (F.col("age_hi") >= F.col("lo")) & (F.col("age_lo") <= F.col("hi"))).groupBy("category").agg(F.count(F.lit(1)).alias("n")), f"SELECT category, count(*) AS n FROM a JOIN (VALUES {_AGES}) v(category, lo, hi) ON age_hi >= lo AND age_lo <= hi GROUP BY 1", "a")
add("join_reverse_link", lambda s, d: A(s, d).select("article_id", "analysis_id").join(doc(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("article_id"), "o_orderstatus"), "article_id").select("article_id", "analysis_id", "o_orderstatus"), "SELECT article_id, analysis_id, o_orderstatus FROM a JOIN orders ON CAST(o_orderkey AS STRING) = article_id", "a")
add("join_reverse_any", lambda s, d: patterns.match(T(s, d), ("?x", ONT + "vd_iri", "urn:kg/vocab/Supplier#000000001"), ("?x", "?property", "?value")), "SELECT s AS x, p AS property, o AS value FROM t", "t")
# Only the analyses that point to it make triples.
ORACLES["join_reverse_any"] = ORACLES["join_reverse_any"].replace(" FROM a1)", " FROM a1 WHERE vd_iri = 'urn:kg/vocab/Supplier#000000001')", 1)
add("join_flexible_id", lambda s, d: A(s, d).select("analysis_id", text.flexible_id(F.concat(F.lit(" Analysis_"), F.col("article_id"), F.lit(",0"))).alias("key")).join(doc(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), "o_orderkey"), "key").select("analysis_id", "o_orderkey"), "SELECT analysis_id, o_orderkey FROM a JOIN orders ON CAST(o_orderkey AS STRING) = article_id", "a")

# Graph patterns.
add("pattern_bgp", lambda s, d: patterns.match(T(s, d, "gender", "practice_type"), ("?a", ONT + "gender", "Male"), ("?a", ONT + "practice_type", "Team sport")), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS a FROM a WHERE gender = 'Male' AND practice_type = 'Team sport'", "a")
add("pattern_optional", lambda s, d: patterns.optional(patterns.match(T(s, d, "gender", "mediator"), ("?a", ONT + "gender", "?g")), T(s, d, "gender", "mediator"), ("?a", ONT + "mediator", "?m")), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS a, gender AS g, mediator AS m FROM a", "a")
add("pattern_union", lambda s, d: patterns.either(patterns.match(T(s, d, "mediator", "moderator"), ("?a", ONT + "mediator", "?m")), patterns.match(T(s, d, "mediator", "moderator"), ("?a", ONT + "moderator", "?o"))), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS a, mediator AS m, CAST(NULL AS STRING) AS o FROM a WHERE mediator IS NOT NULL UNION ALL SELECT 'urn:kg/data/Analysis_' || analysis_id, NULL, moderator FROM a WHERE moderator IS NOT NULL", "a")
add("pattern_not_exists", lambda s, d: patterns.without(patterns.match(T(s, d, "type", "mediator"), ("?a", binding.TYPE, ANALYSIS)), T(s, d, "type", "mediator"), ("?a", ONT + "mediator", "?m")), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS a FROM a WHERE mediator IS NULL", "a")
add("pattern_path_plus", lambda s, d: patterns.match(T(s, d, "vd_iri"), ("?a", ONT + "vd_iri", "?vd")).join(hierarchy.descendants_of(C(s, d), "AFRICA").withColumnRenamed("descendant", "vd"), "vd", "left_semi"), f"SELECT 'urn:kg/data/Analysis_' || analysis_id AS a, vd_iri AS vd FROM a WHERE vd_iri IN (SELECT descendant FROM closure WHERE {LABEL.format('ancestor')} = 'AFRICA')", "a", "closure")
add("pattern_group_by", lambda s, d: patterns.match(T(s, d, "country"), ("?a", ONT + "country", "?country")).groupBy("country").agg(F.count(F.lit(1)).alias("n")), "SELECT country, count(*) AS n FROM a GROUP BY 1", "a")
add("pattern_subselect", lambda s, d: patterns.match(T(s, d, "vi_iri"), ("?a", ONT + "vi_iri", "?vi")).join(E(s, d).groupBy(F.col("child").alias("vi")).agg(F.min("parent").alias("up")), "vi", "left"), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS a, vi_iri AS vi, up FROM a LEFT JOIN (SELECT child, min(parent) AS up FROM kg_edges GROUP BY 1) ON child = vi_iri", "a", "kg_edges")
add("scan_class_instances", lambda s, d: patterns.match(T(s, d, "type"), ("?analysis", binding.TYPE, ANALYSIS)), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS analysis FROM a", "a")
add("scan_total_triples", lambda s, d: T(s, d).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM t", "t")
add("load_guard_count", lambda s, d: T(s, d).limit(1001).agg((F.count(F.lit(1)) > 1000).alias("loaded")), "SELECT count(*) > 1000 AS loaded FROM t", "t")

# Aggregates.
R = lambda e, n: F.round(e, 6).alias(n)
add("agg_count_star", lambda s, d: A(s, d).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM a", "a")
add("agg_count_distinct_class", lambda s, d: reports.distincts(A(s, d), {f"n_{c}": F.col(c) for c in ("article_id", "vi", "vd", "sport_name", "country")}), "SELECT " + ", ".join(f"count(DISTINCT {c}) AS n_{c}" for c in ("article_id", "vi", "vd", "sport_name", "country")) + " FROM a", "a")
for _n, _c in {"agg_by_gender": "gender", "agg_by_study_type": "study_type", "agg_by_relation": "relation_direction", "agg_vd_types": "vd", "agg_vi_types": "vi"}.items():
    add(_n, lambda s, d, c=_c: statistics.counts_by(A(s, d), c), f"SELECT {_c}, count(*) AS n FROM a WHERE {_c} IS NOT NULL GROUP BY 1", "a")
for _n, _c, _k in (("agg_top_countries", "country", 10), ("agg_top_sports", "sport_name", 15), ("topk_limit", "vi", 20)):
    add(_n, lambda s, d, c=_c, k=_k: statistics.top(statistics.counts_by(A(s, d), c), c, k), f"SELECT {_c}, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, {_c} LIMIT {_k}", "a")
add("agg_filtered_distinct", lambda s, d: A(s, d).where("gender = 'Female' and relation_direction = '+'").agg(F.countDistinct("article_id").alias("n")), "SELECT count(DISTINCT article_id) AS n FROM a WHERE gender = 'Female' AND relation_direction = '+'", "a")
add("agg_combined_profile", lambda s, d: A(s, d).where((F.col("gender") == "Male") & contains_any(F.col("sport_name"), ("gear",)) & F.col("age_mean").between(18, 22)).agg(F.countDistinct("analysis_id").alias("n")), "SELECT count(DISTINCT analysis_id) AS n FROM a WHERE gender = 'Male' AND contains(lower(sport_name), 'gear') AND age_mean BETWEEN 18 AND 22", "a")
add("agg_avg_age", lambda s, d: A(s, d).agg(R(F.avg("age_mean"), "mean_age"), F.count("age_mean").alias("n")), "SELECT round(avg(age_mean), 6) AS mean_age, count(age_mean) AS n FROM a", "a")
add("agg_avg_sample", lambda s, d: A(s, d).groupBy("gender").agg(R(F.avg("sample_size"), "mean_size"), F.count("sample_size").alias("n")), "SELECT gender, round(avg(sample_size), 6) AS mean_size, count(sample_size) AS n FROM a GROUP BY 1", "a")
add("agg_min_max_sample", lambda s, d: A(s, d).agg(F.min("sample_size").alias("least"), F.max("sample_size").alias("most")), "SELECT min(sample_size) AS least, max(sample_size) AS most FROM a", "a")
add("agg_strong_correlations", lambda s, d: A(s, d).where(F.abs("degree_r") >= 0.5).groupBy("degree_r").agg(F.count(F.lit(1)).alias("n")), "SELECT degree_r, count(*) AS n FROM a WHERE abs(degree_r) >= 0.5 GROUP BY 1", "a")
add("agg_significant", lambda s, d: A(s, d).where("degree_p < 0.05").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM a WHERE degree_p < 0.05", "a")
add("agg_ns_synonyms", lambda s, d: A(s, d).where(F.col("relation_direction").isin("NS", "N.S.")).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM a WHERE relation_direction IN ('NS', 'N.S.')", "a")
add("agg_categorisation_rate", lambda s, d: A(s, d).agg(statistics.rate(F.count(F.when(F.col("mediator") != "N.A.", 1)), F.count("mediator")).alias("percent")), "SELECT CAST(round_even(count(*) FILTER (mediator <> 'N.A.') * 100.0 / count(mediator), 0) AS BIGINT) AS percent FROM a", "a")
add("agg_by_top_category", lambda s, d: _by_ancestor(s, d, "vd_iri").join(hierarchy.roots(E(s, d)), F.col("ancestor") == F.col("root")).select("root", "n"), "SELECT ancestor AS root, count(DISTINCT analysis_id) AS n FROM a JOIN closure ON vd_iri = descendant WHERE ancestor NOT IN (SELECT child FROM kg_edges) GROUP BY 1", "a", "closure")
add("agg_topn_with_others", lambda s, d: statistics.top_with_others(statistics.counts_by(A(s, d), "sport_name"), "sport_name", 5), "WITH k AS (SELECT sport_name, count(*) AS n FROM a2 GROUP BY 1) SELECT * FROM k")
ORACLES["agg_topn_with_others"] = over("SELECT sport_name, n FROM (SELECT sport_name, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, sport_name LIMIT 5) UNION ALL SELECT '… others', greatest(count(DISTINCT sport_name) - 5, 0) FROM a", "a")
add("agg_numeric_profile", lambda s, d: statistics.numeric_profile(A(s, d), F.col("freq_mean")), "SELECT count(freq_mean) AS n, round(avg(freq_mean), 6) AS mean, min(freq_mean) AS least, max(freq_mean) AS most FROM a", "a")
add("agg_sample_buckets", lambda s, d: statistics.buckets(A(s, d), F.col("sample_size"), (50, 100, 500, 1000)), "SELECT CASE WHEN sample_size < 50 THEN '<50' WHEN sample_size < 100 THEN '50-100' WHEN sample_size < 500 THEN '100-500' WHEN sample_size < 1000 THEN '500-1000' ELSE '>=1000' END AS bucket, count(*) AS n FROM a GROUP BY 1", "a")
add("agg_summary_report", lambda s, d: reports.summary(A(s, d)).select("analyses", "articles", "factors", "outcomes", "risk", "protective", "mean_age", "participants"), "SELECT count(*) AS analyses, count(DISTINCT article_id) AS articles, count(DISTINCT vi) AS factors, count(DISTINCT vd) AS outcomes, count(*) FILTER (relation_direction = '+') AS risk, count(*) FILTER (relation_direction = '-') AS protective, round(avg(age_mean), 6) AS mean_age, CAST(sum(sample_size) AS BIGINT) AS participants FROM a", "a")
_CMP = ("mediator", "moderator", "freq_unit", "exp_unit", "age_mean", "age_lo")
add("agg_completeness", lambda s, d: statistics.completeness(A(s, d), _CMP), " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n_present, round(count({c}) * 100.0 / count(*), 1) AS percent FROM a" for c in _CMP), "a")
add("agg_result_statistics", lambda s, d: A(s, d).agg(F.countDistinct("country").alias("countries"), F.countDistinct("sport_name").alias("sports"), F.min("article_year").alias("first_year"), F.max("article_year").alias("last_year"), F.floor(F.avg("article_year") + 0.5).alias("mean_year")), "SELECT count(DISTINCT country) AS countries, count(DISTINCT sport_name) AS sports, min(article_year) AS first_year, max(article_year) AS last_year, CAST(floor(avg(article_year) + 0.5) AS BIGINT) AS mean_year FROM a", "a")
add("agg_competency_statistics", lambda s, d: A(s, d).groupBy("relation_direction").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation_direction").limit(1), "SELECT relation_direction, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, relation_direction LIMIT 1", "a")
add("agg_category_breakdown", lambda s, d: A(s, d).select("analysis_id", F.explode(F.array(F.concat(F.lit("VD:"), "vd"), F.concat(F.lit("Relation:"), "relation_direction"), F.concat(F.lit("Sport:"), "sport_name"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "SELECT key, count(*) AS n FROM (SELECT 'VD:' || vd AS key FROM a UNION ALL SELECT 'Relation:' || relation_direction FROM a UNION ALL SELECT 'Sport:' || sport_name FROM a) GROUP BY 1", "a")
add("agg_duplicate_ids", lambda s, d: A(s, d).groupBy("raw_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "SELECT raw_id, count(*) AS n FROM a GROUP BY 1 HAVING count(*) > 1", "a")
add("agg_distinct_articles", lambda s, d: A(s, d).agg(F.countDistinct(F.coalesce(text.present(F.col("article_id")), F.col("analysis_id"))).alias("n")), "SELECT count(DISTINCT article_id) AS n FROM a", "a")
add("agg_detect_types", lambda s, d: A(s, d).agg(*[F.when(F.count(c) == 0, "empty").when(F.count(numbers.number(F.col(c))) == F.count(c), "numeric").when(F.count(F.when(F.col(c).startswith("urn:"), 1)) == F.count(c), "uri").otherwise("categorical").alias(c) for c in ("gender", "sample_size_raw", "vi_iri", "freq_unit")]), "SELECT 'categorical' AS gender, 'numeric' AS sample_size_raw, 'uri' AS vi_iri, 'categorical' AS freq_unit")
add("events_profile", lambda s, d: doc(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), R(F.avg("value"), "mean"), F.countDistinct("user_id").alias("users")), "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1")

# Facets.
for _n, _c in {"facet_vi": "vi_label", "facet_vd": "vd_label", "facet_countries": "country", "facet_sports": "sport_name", "facet_sport_categories": "practice_type"}.items():
    add(_n, lambda s, d, c=_c: A(s, d).groupBy(c).agg(F.count(F.lit(1)).alias("n")), f"SELECT {_c}, count(DISTINCT analysis_id) AS n FROM a GROUP BY 1", "a")
for _n, _c in {"facet_categories_vi": "vi_iri", "facet_categories_vd": "vd_iri"}.items():
    add(_n, lambda s, d, c=_c: _by_ancestor(s, d, c), f"SELECT ancestor, count(DISTINCT analysis_id) AS n FROM a JOIN closure ON {_c} = descendant GROUP BY 1", "a", "closure")
#: Facets with a closed vocabulary: their values fit in one list.
CLOSED = ("gender", "country", "practice_type")


def _value_lists(s: SparkSession, d: str) -> DataFrame:
    """A row for each closed facet: its values in order, how many they are, and how many analyses have one."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in CLOSED])).alias("x")
    counts = A(s, d).select(cells).select("x.*").where("value IS NOT NULL").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("k"))
    lists = F.array_join(F.sort_array(F.collect_list("value")), "|")
    return counts.groupBy("facet").agg(lists.alias("value_list"), F.count(F.lit(1)).alias("n_values"), F.sum("k").alias("n"))


add(
    "facet_value_lists",
    _value_lists,
    "SELECT facet, string_agg(value, '|' ORDER BY value) AS value_list, count(*) AS n_values, CAST(sum(k) AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS k FROM a WHERE {c} IS NOT NULL GROUP BY 2" for c in CLOSED)
    + ") GROUP BY 1",
    "a",
)
add("facet_vi_filtered", lambda s, d: A(s, d).join(hierarchy.descendants_of(C(s, d), "Size factor").withColumnRenamed("descendant", "vi_iri"), "vi_iri", "left_semi").groupBy("vi_label").agg(F.count(F.lit(1)).alias("n")), f"SELECT vi_label, count(DISTINCT analysis_id) AS n FROM a WHERE vi_iri IN (SELECT descendant FROM closure WHERE {LABEL.format('ancestor')} = 'Size factor') GROUP BY 1", "a", "closure")

# Order, distinct, union, suggestions.
add("sort_multi_key", lambda s, d: A(s, d).select("vd", "vi", "analysis_id").orderBy("vd", F.desc("vi"), "analysis_id"), "SELECT vd, vi, analysis_id FROM a ORDER BY vd, vi DESC, analysis_id", "a")
add("distinct_pairs", lambda s, d: A(s, d).select("vi", "vd").distinct(), "SELECT DISTINCT vi, vd FROM a", "a")
add("distinct_values_sorted", lambda s, d: A(s, d).select("mediator").where(text.present(F.col("mediator")).isNotNull()).distinct().orderBy("mediator"), "SELECT DISTINCT mediator FROM a WHERE mediator <> 'N.A.' ORDER BY 1", "a")
add("ids_from_results", lambda s, d: A(s, d).select(F.explode(F.array("analysis_id", "article_id")).alias("id")).where(text.is_analysis_id(F.col("id"))).distinct(), "SELECT DISTINCT id FROM (SELECT analysis_id AS id FROM a UNION ALL SELECT article_id FROM a) WHERE regexp_matches(id, '(?i)^(A\\d+|Analysis_?\\d+|\\d+)$')", "a")
add("union_entity_properties", lambda s, d: network.record(A(s, d)).groupBy("entity", "property").agg(F.count(F.lit(1)).alias("n")), "SELECT entity, property, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{e}' AS entity, '{c}' AS property, CAST({c} AS STRING) AS value FROM a" for e, cs in network.ENTITIES.items() for c in cs) + ") WHERE value IS NOT NULL GROUP BY ALL", "a")
add("suggest_field_values", lambda s, d: A(s, d).select(F.col("country").alias("value")).where(text.present(F.col("country")).isNotNull()).distinct().orderBy("value").limit(200), "SELECT DISTINCT country AS value FROM a ORDER BY 1 LIMIT 200", "a")
add("suggest_contains", lambda s, d: A(s, d).select(F.col("vi_label").alias("value")).where(contains_any(F.col("vi_label"), ("GE",))).distinct().orderBy("value").limit(20), "SELECT DISTINCT vi_label AS value FROM a WHERE contains(lower(vi_label), 'ge') ORDER BY 1 LIMIT 20", "a")
add("suggest_prefix_first", lambda s, d: A(s, d).select(F.col("vd_label").alias("value")).where(contains_any(F.col("vd_label"), ("s",))).distinct().orderBy(F.when(F.lower("value").startswith("s"), 0).otherwise(1), F.lower("value"), "value").limit(10), "SELECT value FROM (SELECT DISTINCT vd_label AS value FROM a WHERE contains(lower(vd_label), 's')) ORDER BY NOT starts_with(lower(value), 's'), lower(value), value LIMIT 10", "a")
add("search_by_id", lambda s, d: A(s, d).where(contains_any(F.col("analysis_id"), ("12-",))).select("analysis_id", "article_id"), "SELECT analysis_id, article_id FROM a WHERE contains(lower(analysis_id), '12-')", "a")

# Scalar functions over the tables.
add("fn_parse_mean", lambda s, d: A(s, d).groupBy("age_mean_raw", "age_mean").agg(F.count(F.lit(1)).alias("n")), "SELECT age_mean_raw, age_mean, count(*) AS n FROM a GROUP BY ALL", "a")
add("fn_parse_range", lambda s, d: A(s, d).groupBy("age_range_raw", "age_lo", "age_hi").agg(F.count(F.lit(1)).alias("n")), "SELECT age_range_raw, age_lo, age_hi, count(*) AS n FROM a GROUP BY ALL", "a")
add("fn_try_decimal", lambda s, d: A(s, d).groupBy("degree_r_raw", "degree_r").agg(F.count(F.lit(1)).alias("n")), "SELECT degree_r_raw, degree_r, count(*) AS n FROM a GROUP BY ALL", "a")
add("norm_frequency_7way", lambda s, d: A(s, d).select("analysis_id", R(F.col("freq_hours"), "hours")), "SELECT analysis_id, round(freq_hours, 6) AS hours FROM a", "a")
add("norm_frequency_4way", lambda s, d: A(s, d).select("analysis_id", R(F.col("freq_min4"), "least"), R(F.col("freq_max4"), "most")), "SELECT analysis_id, round(freq_min4, 6) AS least, round(freq_max4, 6) AS most FROM a", "a")
add("norm_experience", lambda s, d: A(s, d).select("analysis_id", R(F.col("exp_years"), "years")), "SELECT analysis_id, round(exp_years, 6) AS years FROM a", "a")
def _by_table(s: SparkSession, d: str) -> DataFrame:
    """Frequencies by the table of factors, and experience by its own."""
    hours = F.broadcast(s.createDataFrame(list(numbers.HOURS.items()), "unit_key string, factor double"))
    years = F.broadcast(s.createDataFrame(list(numbers.YEARS.items()), "exp_key string, exp_factor double"))
    keys = {"unit_key": numbers.unit_key(F.col("freq_unit"), F.col("freq_base")), "exp_key": numbers.unit_key(F.col("exp_unit"))}
    rows = A(s, d).withColumns(keys).join(hours, "unit_key", "left").join(years, "exp_key", "left")
    frequency = [R(numbers.converted(F.col(c), F.col("unit_key"), F.col("factor")), c) for c in ("freq_mean", "freq_min", "freq_max")]
    return rows.select("analysis_id", *frequency, *[R(numbers.converted(F.col(c), F.col("exp_key"), F.col("exp_factor")), c) for c in ("exp_mean", "exp_min", "exp_max")])


def _values(table: dict[str, float]) -> str:
    return ", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in table.items())


_UNIT_SQL = (
    "SELECT analysis_id, "
    + ", ".join(f"round(CASE WHEN freq_unit IS NOT NULL AND {c} <> 0 THEN {c} * coalesce(factor, 1.0) END, 6) AS {c}" for c in ("freq_mean", "freq_min", "freq_max"))
    + ", "
    + ", ".join(f"round(CASE WHEN exp_unit IS NOT NULL AND {c} <> 0 THEN {c} * coalesce(exp_factor, 1.0) END, 6) AS {c}" for c in ("exp_mean", "exp_min", "exp_max"))
    + f" FROM a LEFT JOIN (VALUES {_values(numbers.HOURS)}) u(unit_key, factor) ON unit_key = freq_unit || '/' || freq_base LEFT JOIN (VALUES {_values(numbers.YEARS)}) y(exp_key, exp_factor) ON exp_key = exp_unit"
)
add("norm_unit_range", _by_table, _UNIT_SQL, "a")
#: Units that a caller adds to the table.
_MORE = {"days/week": 24.0, "days/month": 24.0 / 4.33}


def _by_extended_table(s: SparkSession, d: str) -> DataFrame:
    units = F.broadcast(numbers.unit_table(s, "frequency", _MORE))
    rows = A(s, d).withColumn("unit_key", numbers.unit_key(F.col("freq_unit"), F.col("freq_base"))).join(units, "unit_key", "left")
    return rows.select("analysis_id", R(numbers.converted(F.col("freq_mean"), F.col("unit_key"), F.col("factor")), "freq_mean"))


def _supported(s: SparkSession, d: str) -> DataFrame:
    """Every unit of the tables, and in how many analyses it stands."""
    used = {"frequency": numbers.unit_key(F.col("freq_unit"), F.col("freq_base")), "experience": numbers.unit_key(F.col("exp_unit"))}
    parts = []
    for kind, key in used.items():
        n = A(s, d).groupBy(key.alias("unit_key")).agg(F.count(F.lit(1)).alias("n"))
        rows = numbers.unit_table(s, kind, _MORE if kind == "frequency" else None).join(n, "unit_key", "left")
        parts.append(rows.select(F.lit(kind).alias("kind"), "unit_key", R(F.col("factor"), "factor"), F.coalesce("n", F.lit(0)).alias("n")))
    return parts[0].unionByName(parts[1])


add(
    "norm_unit_table_extended",
    _by_extended_table,
    f"SELECT analysis_id, round(CASE WHEN freq_unit IS NOT NULL AND freq_mean <> 0 THEN freq_mean * coalesce(factor, 1.0) END, 6) AS freq_mean FROM a LEFT JOIN (VALUES {_values(numbers.HOURS | _MORE)}) u(unit_key, factor) ON unit_key = freq_unit || '/' || freq_base",
    "a",
)
add(
    "norm_supported_units",
    _supported,
    f"SELECT kind, unit_key, round(factor, 6) AS factor, count(analysis_id) AS n FROM (SELECT 'frequency' AS kind, * FROM (VALUES {_values(numbers.HOURS | _MORE)}) u(unit_key, factor) UNION ALL SELECT 'experience', * FROM (VALUES {_values(numbers.YEARS)}) y(unit_key, factor)) LEFT JOIN a ON unit_key = CASE kind WHEN 'frequency' THEN freq_unit || '/' || freq_base ELSE exp_unit END GROUP BY 1, 2, 3",
    "a",
)
add("norm_unit_table", lambda s, d: _by_table(s, d).select("analysis_id", "freq_mean"), f"SELECT analysis_id, freq_mean FROM ({_UNIT_SQL})", "a")
add("fn_local_name", lambda s, d: doc(s, d, "pages").select("page_id", text.last_segment(F.col("url")).alias("name")), "SELECT page_id, regexp_extract(url, '[^#/]*$') AS name FROM pages")
add("fn_prop_name", lambda s, d: doc(s, d, "pages").select("page_id", text.property_name(F.col("url")).alias("name")), "SELECT page_id, coalesce(nullif(regexp_extract(url, '#(.*)', 1), ''), regexp_extract(url, '[^/]*$')) AS name FROM pages")
add("fn_slug", lambda s, d: doc(s, d, "pages").select("page_id", text.slug(F.col("url")).alias("slug")), "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g') AS slug FROM pages")
add("fn_regex_replace", lambda s, d: doc(s, d, "pages").select("page_id", F.regexp_replace("url", "([a-z]+)([0-9]+)", "$2-$1").alias("swapped")), r"SELECT page_id, regexp_replace(url, '([a-z]+)([0-9]+)', '\2-\1', 'g') AS swapped FROM pages")
add("fn_iri_encode", lambda s, d: doc(s, d, "part").select("p_partkey", text.iri_encode(F.concat("p_name", F.lit(" (#"), "p_brand", F.lit(")"))).alias("iri")), "SELECT p_partkey, url_encode(p_name || ' (#' || p_brand || ')') AS iri FROM part")
add("fn_label_normalise", lambda s, d: A(s, d).select("vi", text.label(F.col("vi")).alias("label")).distinct(), "SELECT DISTINCT vi, replace(replace(vi, '_', ' '), '%20', ' ') AS label FROM a", "a")
add("fn_label_to_iri", lambda s, d: doc(s, d, "part").select(text.label_to_iri(F.concat(F.lit("  "), "p_name", F.lit(" ")), binding.VOCAB).alias("iri")).distinct(), "SELECT DISTINCT 'urn:kg/vocab/' || regexp_replace(trim(p_name), '\\s+', '_', 'g') AS iri FROM part")
add("fn_readable_label", lambda s, d: E(s, d).select("parent", text.readable_label(F.col("parent")).alias("label")).distinct(), "SELECT DISTINCT parent, trim(regexp_replace(regexp_replace(replace(regexp_extract(parent, '[^#/]*$'), '_', ' '), '([A-Z])', ' \\1', 'g'), ' +', ' ', 'g')) AS label FROM kg_edges", "kg_edges")
add("fn_analysis_id", lambda s, d: T(s, d).select(text.analysis_id(F.col("s")).alias("id")).distinct(), "SELECT analysis_id AS id FROM a", "a")
add("fn_relation_label", lambda s, d: A(s, d).groupBy("relation_direction", text.relation_label(F.col("relation_direction")).alias("label")).agg(F.count(F.lit(1)).alias("n")), "SELECT relation_direction, CASE relation_direction WHEN '+' THEN 'Facteur de risque' WHEN '-' THEN 'Facteur protecteur' WHEN 'NS' THEN 'Relation non significative' ELSE relation_direction END AS label, count(*) AS n FROM a GROUP BY ALL", "a")
add("fn_strength_label", lambda s, d: A(s, d).groupBy(text.strength_label(F.col("degree_r_raw"), F.col("degree_p_raw")).alias("strength")).agg(F.count(F.lit(1)).alias("n")), "SELECT 'r=' || degree_r_raw || ', p=' || degree_p_raw AS strength, count(*) AS n FROM a GROUP BY 1", "a")
add("fn_stats_line", lambda s, d: A(s, d).select("analysis_id", F.concat_ws(" | ", text.present(F.col("mediator")), text.present(F.col("moderator")), text.strength_label(F.col("degree_r_raw"), F.col("degree_p_raw"))).alias("line")), "SELECT analysis_id, concat_ws(' | ', nullif(mediator, 'N.A.'), moderator, 'r=' || degree_r_raw || ', p=' || degree_p_raw) AS line FROM a", "a")
_PALETTE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.RELATION_COLOURS.items())
add("fn_category_colour", lambda s, d: A(s, d).groupBy("relation_direction", text.looked_up(F.col("relation_direction"), text.RELATION_COLOURS, F.lit(text.OTHER_COLOUR)).alias("colour")).agg(F.count(F.lit(1)).alias("n")), f"SELECT relation_direction, CASE relation_direction {_PALETTE} ELSE '{text.OTHER_COLOUR}' END AS colour, count(*) AS n FROM a GROUP BY ALL", "a")
add("fn_gender_label", lambda s, d: A(s, d).groupBy("gender", text.looked_up(F.col("gender"), text.GENDER_LABELS, F.col("gender")).alias("label")).agg(F.count(F.lit(1)).alias("n")), "SELECT gender, CASE gender WHEN 'Male' THEN 'Hommes' WHEN 'Female' THEN 'Femmes' WHEN 'Mixed' THEN 'Mixte' ELSE gender END AS label, count(*) AS n FROM a GROUP BY ALL", "a")
add("fn_clean_value", lambda s, d: doc(s, d, "conversations").select("conv_id", "turn", text.escaped(F.col("text")).alias("clean")), "SELECT conv_id, turn, coalesce(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), 'N.A.') AS clean FROM conversations")
add("fn_default_na", lambda s, d: A(s, d).groupBy(text.default_missing(F.col("moderator")).alias("moderator")).agg(F.count(F.lit(1)).alias("n")), "SELECT coalesce(nullif(trim(moderator), ''), 'N.A.') AS moderator, count(*) AS n FROM a GROUP BY 1", "a")
add("fn_typed_value", lambda s, d: network.record(A(s, d), "article_year", "sample_size_raw").groupBy("property").agg(F.sum(F.col("value").try_cast("long")).alias("total")), "SELECT 'article_year' AS property, CAST(sum(article_year) AS BIGINT) AS total FROM a UNION ALL SELECT 'sample_size_raw', CAST(sum(sample_size) AS BIGINT) FROM a", "a")
add("fn_apa_reference", lambda s, d: A(s, d).select("analysis_id", text.reference_text(F.concat("vd_label", F.lit(", "), "vi_label", F.lit(", "), "country", F.lit(", "), "continent", F.lit(", "), "mediator"), F.col("article_year"), F.col("article_id"), F.col("country")).alias("reference")), "SELECT analysis_id, CASE WHEN length(x) > 50 THEN substr(x, 1, 47) || '...' ELSE x END || ' (' || CAST(article_year AS STRING) || '). ' || article_id || '. ' || country || '.' AS reference FROM (SELECT *, vd_label || ', ' || vi_label || ', ' || country || ', ' || continent || ', ' || mediator AS x FROM a)", "a")
add("fn_filters_text", lambda s, d: A(s, d).select(F.concat_ws(", ", F.concat(F.lit("Genre: "), "gender"), F.concat(F.lit("Sport: "), "sport_name")).alias("filters")).distinct(), "SELECT DISTINCT 'Genre: ' || gender || ', Sport: ' || sport_name AS filters FROM a", "a")
add("fn_question_title", lambda s, d: A(s, d).select(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, q in questions.QUESTIONS.items() for x in (k, q.title)]), F.when(F.col("relation_direction") == "-", "q2_protective").otherwise("q9")), F.lit("Question")).alias("title")).groupBy("title").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN relation_direction = '-' THEN 'relation_direction = -' ELSE 'Question' END AS title, count(*) AS n FROM a GROUP BY 1", "a")

# Network.
add("net_nodes", lambda s, d: network.nodes(AC(s, d)), "SELECT type || '_' || label AS id, type, label, min(category) AS category, count(DISTINCT analysis_id) AS n_analyses FROM (SELECT 'factor' AS type, vi AS label, category_vi AS category, analysis_id FROM c UNION ALL SELECT 'acad', vd, category_vd, analysis_id FROM c UNION ALL SELECT 'mediator', mediator, 'mediator', analysis_id FROM c WHERE mediator <> 'N.A.' UNION ALL SELECT 'moderator', moderator, 'moderator', analysis_id FROM c WHERE moderator IS NOT NULL) GROUP BY type, label", "c")
add("net_edges_raw", lambda s, d: network.links(A(s, d)), "SELECT analysis_id, source, target, relation FROM via", "via")
add("net_edges_grouped", lambda s, d: network.grouped_links(network.links(A(s, d))), "SELECT source, target, relation, n, representative, CASE WHEN n > 1 THEN relation || ' (' || CAST(n AS STRING) || ' analyses)' ELSE relation END AS label FROM grouped", "grouped")
add("net_link_curves", lambda s, d: network.curves(network.grouped_links(network.links(A(s, d)))), "SELECT source, target, relation, place, total, CASE WHEN total > 1 THEN (place - (total - 1) / 2.0) * 60.0 / (total - 1) ELSE 0.0 END AS offset FROM (SELECT source, target, relation, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY least(source, target), greatest(source, target)) AS total FROM grouped WINDOW w AS (PARTITION BY least(source, target), greatest(source, target) ORDER BY source, target, relation))".replace("AS offset", 'AS "offset"'), "grouped")
add("net_simple", lambda s, d: A(s, d).select("vi", "vd", "relation_direction").distinct(), "SELECT DISTINCT vi, vd, relation_direction FROM a", "a")
add("net_node_analyses", lambda s, d: A(s, d).where("vi = 'small_gear'").select("analysis_id"), "SELECT analysis_id FROM a WHERE vi = 'small_gear'", "a")
add("drill_all_properties", lambda s, d: network.record(A(s, d).where("article_id = '7'")), "SELECT analysis_id, entity, property, value FROM (" + " UNION ALL ".join(f"SELECT analysis_id, '{e}' AS entity, '{c}' AS property, CAST({c} AS STRING) AS value FROM a WHERE article_id = '7'" for e, cs in network.ENTITIES.items() for c in cs) + ") WHERE value IS NOT NULL", "a")
_FIELDS = {"gender": "sexe", "sport_name": "sport", "country": "pays"}
add("drill_mapped_fields", lambda s, d: network.record(A(s, d), *_FIELDS).join(F.broadcast(s.createDataFrame(list(_FIELDS.items()), "property string, field string")), "property").select("analysis_id", "entity", "field", "value"), " UNION ALL ".join(f"SELECT analysis_id, '{next(e for e, cs in network.ENTITIES.items() if k in cs)}' AS entity, '{v}' AS field, {k} AS value FROM a WHERE {k} IS NOT NULL" for k, v in _FIELDS.items()), "a")
_WIDE = [c for cs in network.ENTITIES.values() for c in cs]
add("drill_wide_record", lambda s, d: network.wide_record(A(s, d)), "SELECT analysis_id, " + ", ".join(f"coalesce(CAST({c} AS STRING), 'N/A') AS {c}" for c in _WIDE) + ", " + " + ".join(f"CAST({c} IS NOT NULL AS BIGINT)" for c in _WIDE) + " AS n_properties FROM a", "a")

# ETL.
add("etl_unique_ids", lambda s, d: files.with_unique_ids(A(s, d), "raw_id", "l_partkey", "l_suppkey", "occurrence").select("raw_id", "unique_id"), "SELECT raw_id, analysis_id AS unique_id FROM a", "a")
add("etl_drop_blank_rows", lambda s, d: files.without_blank_rows(A(s, d).select("mediator", "moderator")).groupBy("mediator", "moderator").agg(F.count(F.lit(1)).alias("n")), "SELECT mediator, moderator, count(*) AS n FROM a WHERE mediator IS NOT NULL OR moderator IS NOT NULL GROUP BY ALL", "a")
add("etl_nonempty_columns", lambda s, d: files.without_empty_columns(A(s, d).select("analysis_id", F.lit(None).cast("string").alias("nothing"), F.lit(" ").alias("blank"), "gender")), "SELECT analysis_id, gender FROM a", "a")
add("etl_rml_subject_map", lambda s, d: T(s, d, "vi_iri").where(F.col("p") == ONT + "vi_iri").select("s", "o"), "SELECT s, o FROM t WHERE p = 'urn:kg/ontology/vi_iri'", "t")
add("etl_rml_triples_count_by_predicate", lambda s, d: T(s, d).groupBy("p").agg(F.count(F.lit(1)).alias("n")), "SELECT p, count(*) AS n FROM t GROUP BY 1", "t")
add("src_csv_drop_na_id", lambda s, d: A(s, d).where(text.present(F.col("mediator")).isNotNull()).select("analysis_id", "mediator"), "SELECT analysis_id, mediator FROM a WHERE trim(mediator) NOT IN ('', 'NA', 'N.A.')", "a")
add("src_header_rename", lambda s, d: files.renamed(A(s, d).select(F.col("analysis_id").alias("Analysis ID"), F.col("sport_name").alias("Sport name"))), 'SELECT analysis_id AS "Analysis_ID", sport_name AS "Sport_name" FROM a', "a")


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    """Analyses written as semicolon text and read again."""
    path = new_path(s, "csv")
    files.write_delimited(A(s, d).select("analysis_id", "vi", "vd", "age_mean_raw", "gender"), path, ";")
    return files.read_delimited(s, path, ";")


add("src_csv_semicolon", _round_trip, "SELECT analysis_id, vi, vd, age_mean_raw, gender FROM a", "a")


def _separators(s: SparkSession, d: str) -> DataFrame:
    """The semicolon text written again with commas, where only values that hold one are quoted, and read."""
    path = new_path(s, "csv")
    files.write_delimited(_round_trip(s, d), path, ",")
    return files.read_delimited(s, path, ",")


add("src_csv_comma", _separators, "SELECT analysis_id, vi, vd, age_mean_raw, gender FROM a", "a")


def _ntriples(s: SparkSession, d: str) -> DataFrame:
    """Triples written as N-Triples lines and read again."""
    path = new_path(s, "nt")
    o = F.when(F.col("o").startswith("urn:"), F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), text.escaped(F.col("o")), F.lit('"')))
    rows = binding.triples(A(s, d))
    rows.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" ."))).write.text(path, compression="gzip")
    return files.read_ntriples(s, path).select("s", "p", "o")


add("src_ntriples_parse", _ntriples, "SELECT s, p, o FROM t", "t")

# Exports.
def _turtle(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("article_id").orderBy("analysis_id")
    rows = A(s, d).select(F.concat(F.lit("export:result_"), "article_id", F.lit("_"), F.row_number().over(w).cast("string")).alias("s"), "vi", "vd", "gender")
    cells = [F.struct(F.lit(f"export:{c}").alias("p"), F.concat(F.lit('"'), text.escaped(F.col(c)), F.lit('"')).alias("o")) for c in ("vi", "vd", "gender")]
    return rows.select("s", F.explode(F.array(*cells)).alias("x")).select("s", "x.*")


add("export_turtle_triples", _turtle, "SELECT s, p, '\"' || o || '\"' AS o FROM (SELECT 'export:result_' || article_id || '_' || CAST(row_number() OVER (PARTITION BY article_id ORDER BY analysis_id) AS STRING) AS s, vi, vd, gender FROM a), LATERAL (VALUES ('export:vi', vi), ('export:vd', vd), ('export:gender', gender)) x(p, o)", "a")
def _pivoted(s: SparkSession, d: str) -> DataFrame:
    """A column for some properties; an analysis without any of them has an empty row."""
    wanted = ("gender", "sport_name", "country")
    cells = F.array(F.struct(F.lit(None).cast("string").alias("property"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(c).alias("property"), F.col(c).alias("value")) for c in wanted])
    rows = A(s, d).select("analysis_id", F.explode(cells).alias("x")).select("analysis_id", "x.*")
    # The cells of an analysis lie together, so one aggregate brings them to one row before the shuffle.
    return rows.groupBy("analysis_id").agg(*[F.max(F.when(F.col("property") == c, F.col("value"))).alias(c) for c in wanted])


add("export_pivot_wide", _pivoted, "SELECT analysis_id, gender, sport_name, country FROM a", "a")
def _json(s: SparkSession, d: str) -> DataFrame:
    """JSON lines: one that describes the result, then one for each of its rows."""
    whole = {"ignoreNullFields": "false"}
    rows = A(s, d).where("relation_direction = '+'").select("analysis_id", "vi", "vd", "gender", "moderator")
    about = F.to_json(F.struct(F.lit("risk factors").alias("question"), F.lit(",".join(rows.columns)).alias("columns"), F.count(F.lit(1)).alias("n")), whole)
    head = rows.agg(about.alias("line")).select(F.lit("metadata").alias("kind"), "line")
    return head.unionByName(rows.select(F.lit("row").alias("kind"), F.to_json(F.struct(*rows.columns), whole).alias("line")))


add(
    "export_json_lines",
    _json,
    "SELECT 'metadata' AS kind, CAST(to_json({'question': 'risk factors', 'columns': 'analysis_id,vi,vd,gender,moderator', 'n': count(*)}) AS STRING) AS line FROM a WHERE relation_direction = '+' "
    "UNION ALL SELECT 'row', CAST(to_json({'analysis_id': analysis_id, 'vi': vi, 'vd': vd, 'gender': gender, 'moderator': moderator}) AS STRING) FROM a WHERE relation_direction = '+'",
    "a",
)
add("export_csv_quoted", lambda s, d: A(s, d).select(F.concat_ws(",", *[F.concat(F.lit('"'), F.coalesce(F.col(c), F.lit("")), F.lit('"')) for c in ("analysis_id", "vi", "moderator")]).alias("line")), "SELECT '\"' || analysis_id || '\",\"' || vi || '\",\"' || coalesce(moderator, '') || '\"' AS line FROM a", "a")

# Updates.
_NEW = "SELECT s, 'urn:kg/ontology/gender' AS p, 'Male' AS o FROM t WHERE p = 'urn:kg/ontology/gender' AND o = 'N.A.'"


def _new(t: DataFrame) -> DataFrame:
    return t.where((F.col("p") == ONT + "gender") & (F.col("o") == "N.A.")).select("s", "p", F.lit("Male").alias("o"))


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The analyses with all properties, joined once, and the triples of some of these (type: the class)."""
    rows = binding.stored_analyses(s, d, "analysis_id", *binding.PROPERTIES)
    return rows, lambda *names, of=rows: binding.triples(of, tuple(n for n in names if n != "type"), "type" in names)


def _inserted(s: SparkSession, d: str) -> DataFrame:
    _, part = _parts(s, d)
    return updates.inserted(part("type", *binding.PROPERTIES), _new(part("gender")), part("gender"))


def _replaced(s: SparkSession, d: str) -> DataFrame:
    _, part = _parts(s, d)
    return updates.replaced(part("type", *binding.PROPERTIES), _new(part("gender")), ANALYSIS, part("type"))


def _cascade(s: SparkSession, d: str) -> DataFrame:
    """Subjects go as rows, before a row becomes a triple for each property."""
    rows, part = _parts(s, d)
    ids = part("gender").where((F.col("p") == ONT + "gender") & (F.col("o") == "Female")).select("s")
    left = updates.without_subjects(rows.withColumn("s", binding.subject()), ids)
    return updates.without_ends(part("type", *binding.PROPERTIES, of=left), ids)


add("upd_insert_entities", _inserted, f"SELECT s, p, o FROM t UNION {_NEW}", "t")
add("upd_replace_properties", _replaced, f"SELECT s, p, o FROM t WHERE NOT (p = 'urn:kg/ontology/gender' AND o = 'N.A.') UNION {_NEW}", "t")
add("upd_cascade_delete", _cascade, "SELECT s, p, o FROM t", "t")
# An analysis of women goes with all its triples.
ORACLES["upd_cascade_delete"] = ORACLES["upd_cascade_delete"].replace(" FROM a1)", " FROM a1 WHERE gender <> 'Female')", 1)


def _inferred(s: SparkSession, d: str) -> DataFrame:
    e = E(s, d)
    t = e.select(F.col("child").alias("s"), F.lit("broader").alias("p"), F.col("parent").alias("o"))
    labels = e.select(F.col("child").alias("s"), hierarchy.labelled("child").alias("label")).distinct()
    return updates.inferred(t, labels.unionByName(labels.select(F.concat("s", F.lit("/copy")).alias("s"), "label")), "broader")


add("upd_infer_broader", _inferred, "SELECT child AS s, 'broader' AS p, parent AS o FROM kg_edges UNION SELECT child || '/copy', 'broader', parent FROM kg_edges", "kg_edges")

# Shapes.
P = lambda c: ONT + c
add("dq_min_count", lambda s, d: shapes.count_violations(T(s, d, "type", "mediator"), ANALYSIS, P("mediator"), 1), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS focus, 'urn:kg/ontology/mediator' AS path, 'min_count' AS \"constraint\" FROM a WHERE mediator IS NULL", "a")
add("dq_max_count", lambda s, d: shapes.count_violations(updates.inserted(T(s, d, "type", "gender"), _new(T(s, d, "type", "gender"))), ANALYSIS, P("gender"), 1, 1), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS focus, 'urn:kg/ontology/gender' AS path, 'max_count' AS \"constraint\" FROM a WHERE gender = 'N.A.'", "a")
add("dq_value_in", lambda s, d: shapes.value_violations(T(s, d, "type", "gender"), ANALYSIS, P("gender"), F.col("o").isin("Male", "Female", "Mixed"), "in"), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS focus, 'urn:kg/ontology/gender' AS path, 'in' AS \"constraint\" FROM a WHERE gender NOT IN ('Male', 'Female', 'Mixed')", "a")
add("dq_pattern", lambda s, d: shapes.value_violations(T(s, d, "type", "age_mean_raw"), ANALYSIS, P("age_mean_raw"), F.col("o").rlike("^M="), "pattern"), "SELECT 'urn:kg/data/Analysis_' || analysis_id AS focus, 'urn:kg/ontology/age_mean_raw' AS path, 'pattern' AS \"constraint\" FROM a WHERE NOT starts_with(age_mean_raw, 'M=')", "a")
add("dq_class_ref", lambda s, d: shapes.class_violations(T(s, d, "type", "vd_iri"), ANALYSIS, P("vd_iri"), hierarchy.descendants_of(C(s, d), "ASIA").withColumnRenamed("descendant", "o")), f"SELECT 'urn:kg/data/Analysis_' || analysis_id AS focus, 'urn:kg/ontology/vd_iri' AS path, 'class' AS \"constraint\" FROM a WHERE vd_iri NOT IN (SELECT descendant FROM closure WHERE {LABEL.format('ancestor')} = 'ASIA')", "a", "closure")
add("dq_violation_summary", lambda s, d: QUERIES["dq_min_count"](s, d).unionByName(QUERIES["dq_value_in"](s, d)).unionByName(QUERIES["dq_pattern"](s, d)).groupBy("path", "constraint").agg(F.count(F.lit(1)).alias("n")), "SELECT 'urn:kg/ontology/mediator' AS path, 'min_count' AS \"constraint\", count(*) AS n FROM a WHERE mediator IS NULL UNION ALL SELECT 'urn:kg/ontology/gender', 'in', count(*) FROM a WHERE gender NOT IN ('Male', 'Female', 'Mixed') UNION ALL SELECT 'urn:kg/ontology/age_mean_raw', 'pattern', count(*) FROM a WHERE NOT starts_with(age_mean_raw, 'M=')", "a")

# Typed entities: mapping, full records, updates, shapes, exports.
QUERIES |= entity_queries.QUERIES
ORACLES |= entity_queries.ORACLES
