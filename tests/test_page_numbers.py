"""Members are dealt out once to be numbered and once to be listed, and pages are counted where they lie."""

import re

from tests.conftest import SF

from factweave.entity_queries import QUERIES
from factweave.operators import pages


def test_groups_with_nulls_and_repeated_members(spark):
    rows = [(a, b, f"m{i % 37}") for i in range(300) for a, b in (("x", None), (None, "y"), ("x", "y"))] + [("x", None, None), ("z", "z", "only")]
    df = spark.createDataFrame(rows, "a string, b string, m string").repartition(5)
    every = pages.paged(df, ("a", "b"), "m", page=10, stripes=4)
    # However a group is numbered, its pages are the same.
    listed = lambda x: sorted(map(tuple, x.collect()), key=str)
    assert listed(every) == listed(pages.paged(df, ("a", "b"), "m", page=10, stripes=4, hot=20)) == listed(pages.paged(df, ("a", "b"), "m", page=10, stripes=4, hot=0))
    got = {}
    for r in every.collect():
        assert r.n_pages == (4 if r.n_members == 37 else 1) and len(r.members) <= 10
        got.setdefault((r.a, r.b), []).extend(r.members)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted({m for a, b, m in rows if (a, b) == k and m}) for k in {("x", None), (None, "y"), ("x", "y"), ("z", "z")}}
    summed = {(r.a, r.b): tuple(r)[2:] for r in pages.summary(every, "a", "b").collect()}
    assert summed == {k: (4, 37, 4, 37, 37, "m0", "m9") for k in (("x", None), (None, "y"), ("x", "y"))} | {("z", "z"): (1, 1, 1, 1, 1, "only", "only")}


def test_members_are_not_dealt_out_for_their_count(spark):
    for name in ("net_link_pages", "net_node_pages", "facet_value_pages"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan
        assert not re.search(r"hashpartitioning\([^)]*\bm#", plan) and len(re.findall(r"hashpartitioning\([^)]*\bmember#", plan)) == 0
