"""Queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from factweave import queries
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each family; the driver compares all of them.
NAMES = (
    "cq_q1", "cq_q3_a", "cq_q7_profile", "cq_q8_team", "search_base", "search_age_range_inclusive", "search_freq_categories_overlap", "search_exp_mean_pm1", "search_category_vd", "search_category_vi",
    "search_combined_profile", "hier_closure", "hier_roots", "hier_neighbourhood", "hier_stats", "join_optional_group", "join_range_overlap", "join_flexible_id", "agg_by_top_category", "agg_completeness",
    "agg_topn_with_others", "agg_sample_buckets", "facet_categories_vi", "suggest_prefix_first", "norm_unit_range", "fn_apa_reference", "fn_clean_value", "net_nodes", "net_edges_grouped", "net_link_curves",
    "drill_wide_record", "etl_unique_ids", "src_csv_semicolon", "src_ntriples_parse", "export_turtle_triples", "upd_replace_properties", "upd_infer_broader", "dq_violation_summary", "pattern_path_plus",
    "map_entities", "drill_full_record", "upd_cascade_satellites", "upd_store_versions", "dq_shape_violations", "export_result_triples", "export_wide_dynamic", "report_competency", "net_node_pages", "src_turtle_round_trip", "src_ragged_text",
    "suggest_index_ati", "cq_by_direction_and_dimension", "upd_cascade_delete", "join_reverse_any", "facet_categories_vd",
    "norm_unit_table_extended", "norm_supported_units", "facet_value_lists", "src_csv_comma", "export_json_lines",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert "cq_q1" in __spark_entry__.queries()


def test_paths_agree(spark):
    """The property-table path and the triple path give the same rows."""
    a = queries.A(spark, SF).where("gender = 'Male' and practice_type = 'Team sport'").count()
    assert a == queries.QUERIES["pattern_bgp"](spark, SF).count() > 0
