"""Cascades read off the rows give what cascades over the triples give."""

import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from factweave.entity_queries import QUERIES
from factweave.operators import entity_updates as updates
from factweave.sources.mapping import Constant, Entity, Ref, Template, triples

A, B, C, S, O = (Template(f"urn:{k}/{{{c}}}") for k, c in (("A", "a"), ("B", "a"), ("C", "c"), ("S", "s"), ("O", "a")))
ENTITIES = (
    Entity("A", A, ("urn:A",), {"own1": B, "own2": S, "see": O, "name": Ref("a")}, own=True), Entity("B", B, ("urn:B",), {"own3": C, "x": Ref("x"), "k": Constant("urn:K", "iri")}, own=True), Entity("C", C, ("urn:C",), {"x": Ref("x")}, own=True),
    Entity("S", S, ("urn:S",), {"label": Ref("s")}), Entity("O", O, ("urn:O",), {"own2": S, "about": A}, own=True),
)
OWNING = ("own1", "own2", "own3")


@pytest.mark.parametrize("entities", [ENTITIES[:4], ENTITIES])
def test_same_as_over_triples(spark, entities):
    rows = [("1", "c1", "s1", "f"), ("2", None, "s1", "m"), ("3", "c3", "s2", "f"), ("4", "c4", "s2", "f"), ("5", "c5", None, None), (None, "c6", "s3", "f"), ("7", " ", "s4", "f"), ("8", "c8", "s5", " ")]
    table = spark.createDataFrame(rows, "a string, c string, s string, x string")
    g = triples(table, entities).localCheckpoint()
    roots = table.where("x = 'f' AND a IS NOT NULL").select(F.concat(F.lit("urn:A/"), "a").alias("s"))
    nodes = sorted(r.node for r in updates.mapped_doomed(table, F.col("x") == "f", A, entities, OWNING).collect())
    assert nodes == sorted(r.node for r in updates.doomed(g, roots, OWNING).collect())
    left = updates.cascaded(g, roots, OWNING).groupBy("p").agg(F.count(F.lit(1)), F.min("s"), F.max("s"), F.countDistinct("o"))
    predicates = {r.p for r in g.select("p").distinct().collect()}
    got = updates.mapped_left(table, F.col("x") == "f", A, predicates, entities, OWNING)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.collect()))


def test_what_rows_do_not_tell_is_refused(spark):
    with pytest.raises(ValueError):
        updates.cascade((*ENTITIES[:3], Entity("S", S, (), {"own3": C})), A, OWNING)  # a shared node owns a row's node
    with pytest.raises(ValueError):
        updates.cascade((*ENTITIES[:4], Entity("T", Template("urn:T/{a}"), (), {"own1": B}, own=True)), A, OWNING)  # a second owner


def test_no_triple_is_kept_or_dealt_out(spark):
    plan = QUERIES["upd_cascade_satellites"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "kept-" not in plan
