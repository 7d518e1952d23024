"""What queries read, deal out and write: the size of it, and results on odd inputs where less is dealt out."""

from tests.conftest import SF

from pyspark.sql import functions as F

from factweave import queries
from factweave.operators import entity_updates, node_shapes, records, suggestions, updates
from factweave.sources import binding, files, mapping, shared, sheet, store, turtle
from factweave.sources.mapping import TERMS, Entity, Ref, Template


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_analyses_read_and_number_only_what_is_asked_for(spark):
    text = plan(binding.analyses(spark, SF).select("age_range_raw"))
    assert "Window" not in text and "p_name" not in text and "l_tax" not in text
    assert "Window" in plan(binding.analyses(spark, SF).select("analysis_id", "vi", "country"))


def test_stored_analyses_hold_their_columns_only(spark):
    assert binding.stored_analyses(spark, SF, "vi_iri", "analysis_id").columns == ["analysis_id", "vi_iri"]


def test_distinct_rows(spark):
    rows = [("a", 1), ("a", 1), ("b", None), ("b", None), (None, 2), ("c", 3)]
    df = spark.createDataFrame(rows, "x string, y int")
    assert sorted(map(tuple, shared.distinct_rows(df).collect()), key=str) == sorted(set(rows), key=str)
    assert shared.distinct_rows(df.limit(0)).count() == 0
    assert "Aggregate" not in plan(shared.distinct_rows(df.distinct().where("x = 'c'").localCheckpoint()))


def test_ntriples_lines_are_dealt_out_by_digest_only(spark, tmp_path):
    (tmp_path / "x.nt").write_text('<urn:a> <urn:p> "1" .\n\t_:b\t<urn:p> <urn:o>  . \n# no\n<urn:a> <urn:p> "x . \\"y\\""@en .\n<urn:a> <urn:q>\n')
    df = files.read_ntriples(spark, str(tmp_path))
    assert "Aggregate" not in plan(df)
    assert sorted((r.s, r.p, r.o, r.o_lang) for r in df.collect()) == sorted([("urn:a", "urn:p", "1", None), ("_:b", "urn:p", "urn:o", None), ("urn:a", "urn:p", 'x . "y"', "en")], key=str)


def test_turtle_is_dealt_out_once_and_compressed(spark, tmp_path):
    rows = [(f"urn:ex/s{i % 50}", "urn:ex/p", str(i), "literal", None, None) for i in range(400)]
    triples = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TERMS))
    turtle.write_turtle(triples, str(tmp_path / "out"), {"ex": "urn:ex/"})
    assert list((tmp_path / "out").glob("part-*.gz")) and not list((tmp_path / "out").glob("part-*.txt"))
    assert sorted(map(tuple, turtle.read_turtle(spark, str(tmp_path / "out")).collect()), key=str) == sorted(rows, key=str)


def test_trigrams_name_blocks(spark):
    rows = spark.range(3000).select(F.concat(F.lit("value "), F.col("id").cast("string")).alias("v"))
    index = suggestions.Index.built(rows.coalesce(1), {"f": "v"})
    n_blocks = index.values.select("block").distinct().count()
    assert index.postings.where("gram = 'val'").count() == n_blocks < 50
    assert [r.value for r in index.search("VALUE 299", cap=3).orderBy("place").collect()] == ["value 299", "value 2990", "value 2991"]


def test_pivot_reads_only_its_properties(spark):
    assert "p_size" not in plan(queries.QUERIES["export_pivot_wide"](spark, SF))
    assert "p_size" not in plan(queries.QUERIES["drill_mapped_fields"](spark, SF))


def test_replaced_leaves_other_predicates_alone(spark):
    rows = [("a", updates.TYPE, "C"), ("b", updates.TYPE, "C"), ("a", "p", "1"), ("b", "p", "2"), ("x", "p", "3"), ("a", "q", "1"), (None, None, None)]
    t = spark.createDataFrame(rows, "s string, p string, o string")
    new = spark.createDataFrame([("a", "p", "9"), ("x", "p", "8")], "s string, p string, o string")
    got = sorted(map(tuple, updates.replaced(t, new, "C").collect()), key=str)
    assert got == sorted([r for r in rows if r != ("a", "p", "1")] + [("a", "p", "9")], key=str)
    assert sorted(map(tuple, updates.replaced(t, new.limit(0), "C").collect()), key=str) == sorted(rows, key=str)


def test_cascade_drops_ends_between_least_and_greatest(spark):
    rows = [("a", "p", "m"), ("b", "p", "a"), ("c", "p", "b"), ("d", "p", "c"), ("e", "p", "z"), ("f", "p", None), ("m", "p", "1")]
    t = spark.createDataFrame(rows, "s string, p string, o string")
    ids = spark.createDataFrame([("a",), ("c",)], "s string")
    assert sorted(map(tuple, updates.cascade_deleted(t, ids).collect()), key=str) == sorted([("e", "p", "z"), ("f", "p", None), ("m", "p", "1")], key=str)
    assert updates.cascade_deleted(t, ids.limit(0)).count() == 7


def test_forms_of_one_id_make_a_set(spark):
    entities = (Entity("A", Template("urn:a/{id}"), ("urn:A",), {"urn:p": Ref("x"), "urn:q": Ref("y")}, own=True), Entity("L", Template("urn:b/{x}"), (), {"urn:has": Template("urn:a/{id}")}, own=True), Entity("S", Template("urn:s/{x}"), ("urn:S",), {}))
    forms = spark.createDataFrame([("1", "x", "u"), ("1", "x", "u"), ("1", "x", "v"), ("2", "x", None)], "id string, x string, y string")
    assert entity_updates.named_by_all(entities) == ["id"]
    got = sorted((r.s, r.p, r.o) for r in entity_updates.form_triples(forms, entities).collect())
    a = lambda i, y: [(f"urn:a/{i}", "urn:p", "x"), *[(f"urn:a/{i}", "urn:q", v) for v in y], (f"urn:a/{i}", "urn:kg/rdf/type", "urn:A"), ("urn:b/x", "urn:has", f"urn:a/{i}")]
    assert got == sorted([*a(1, ("u", "v")), *a(2, ("N.A.",)), ("urn:s/x", "urn:kg/rdf/type", "urn:S")])


_ENTITIES = (
    Entity("A", Template("urn:a/{id}"), ("urn:A",), {"urn:p": Ref("x", "urn:int"), "urn:has": Template("urn:s/{x}"), "urn:also": Template("urn:z/{x}")}, own=True),
    Entity("S", Template("urn:s/{x}"), ("urn:S",), {"urn:p": Ref("y"), "urn:to": Template("urn:a/{id}")}),
    Entity("L", Template("urn:s/{x}"), (), {"urn:near": Template("urn:a/{id}")}, own=True),
)
_ROWS = [("1", "u", "k"), ("2", "u", "k"), ("3", "u", "l m"), ("4", None, "k"), ("5", " ", "k"), ("6", "v w", None), (None, "u", "k")]


def test_only_subjects_of_one_row_are_alone():
    assert [mapping.alone(e, _ENTITIES) for e in _ENTITIES] == [True, False, False]
    assert mapping.surely_of(Template("urn:s/{x}"), "urn:S", _ENTITIES) and not mapping.surely_of(Template("urn:z/{x}"), "urn:S", _ENTITIES)


def test_predicates_are_counted_without_making_triples_of_single_rows(spark):
    rows = spark.createDataFrame(_ROWS, "id string, x string, y string")
    whole = mapping.triples(rows, _ENTITIES).groupBy("p", "o_kind", "o_datatype", "o_lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("n_subjects"), F.min("o").alias("least"), F.max("o").alias("most"))
    assert sorted(map(tuple, mapping.by_predicate(rows, _ENTITIES).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert mapping.by_predicate(rows.limit(0), _ENTITIES).count() == 0


def test_shapes_of_single_rows_are_judged_in_their_row(spark):
    rows = spark.createDataFrame(_ROWS, "id string, x string, y string")
    shapes = (
        node_shapes.Shape("A", "urn:A", (node_shapes.Rule("urn:p", 1, 1, datatype="urn:other", pattern="^u$"), node_shapes.Rule("urn:has", 1, cls="urn:S"), node_shapes.Rule("urn:also", 0, 0, node_kind="literal", cls="urn:S"), node_shapes.Rule("urn:none", 2))),
        node_shapes.Shape("S", "urn:S", (node_shapes.Rule("urn:p", 2, 1, values=("k",)), node_shapes.Rule("urn:near", 1, 2, cls="urn:A"), node_shapes.Rule("urn:to", 0, 1, cls="urn:S"))),
    )
    whole = sorted(map(tuple, node_shapes.violations(mapping.triples(rows, _ENTITIES), shapes).collect()))
    assert sorted(map(tuple, node_shapes.mapped_violations(rows, _ENTITIES, shapes).collect())) == whole
    assert ("A", "urn:a/4", "urn:p", "min_count", 1) in whole and ("S", "urn:s/u", "urn:near", "max_count", 1) in whole and ("A", "urn:a/1", "urn:also", "class", 1) in whole
    # The own part of a shape deals nothing out.
    own = node_shapes.mapped_violations(rows, _ENTITIES[:1], (node_shapes.Shape("A", "urn:A", (node_shapes.Rule("urn:p", 1, pattern="^u$"),)),))
    assert "hashpartitioning" not in plan(own)


def test_branches_of_single_rows_are_counted_in_their_row(spark):
    """As the walk over all triples gives them; repeated and missing nodes included."""
    sheet_rows = sheet.sheet(spark, SF).where("l_orderkey < 60")
    whole = records.record(g := mapping.triples(sheet_rows, sheet.ENTITIES).cache(), g.where((F.col("p") == mapping.TYPE) & F.col("o").endswith("/Analysis")).select("s"))
    whole = whole.groupBy("analysis", "entity", "entity_type").agg(F.count(F.lit(1)), F.countDistinct("sub_entity"), F.min("property"), F.sum(F.char_length("value")))
    root = next(e.subject for e in sheet.ENTITIES if e.name == "Analysis")
    got = records.mapped_branches(sheet_rows, sheet.ENTITIES, root)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert records.resolved(sheet.ENTITIES, root, (records.Path("x", "nested", ("hasSport", "inScheme")),)) is None
    g.unpersist()


def test_full_records_without_the_triples(spark):
    """Fields and their counts as the walk over all triples gives them, with rows that disagree on a shared node, blank ids and missing links; no triple is dealt out."""
    rows = sheet.sheet(spark, SF).where("l_orderkey < 60")
    odd = F.col("l_linenumber") == 2
    rows = rows.withColumns({
        "country": F.when(odd, "Elsewhere").otherwise(F.col("country")),
        "article_id": F.when(F.col("l_linenumber") == 3, " ").otherwise(F.col("article_id")),
        "sport_name": F.when(F.col("l_linenumber") == 4, None).otherwise(F.col("sport_name")),
        "mediator_name": F.when(odd, F.col("moderator")).otherwise(F.col("mediator_name")),
        "analysis_id": F.when(F.col("l_linenumber") == 5, "").otherwise(F.col("analysis_id")),
    }).localCheckpoint()
    whole = records.record(g := mapping.triples(rows, sheet.ENTITIES).cache(), g.where((F.col("p") == mapping.TYPE) & F.col("o").endswith("/Analysis")).select("s")).cache()
    root = next(e.subject for e in sheet.ENTITIES if e.name == "Analysis")
    wide, got = records.wide(whole), records.mapped_wide(rows, sheet.ENTITIES, root)
    assert got.columns == wide.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, wide.collect()))
    fields = records.with_fields(whole).groupBy("entity", "field").agg(F.count(F.lit(1)), F.countDistinct("value"), F.min("value"), F.max("value"))
    assert sorted(map(tuple, records.mapped_fields(rows, sheet.ENTITIES, root).collect())) == sorted(map(tuple, fields.collect()))
    none = rows.limit(0)
    assert records.mapped_wide(none, sheet.ENTITIES, root).count() == records.mapped_fields(none, sheet.ENTITIES, root).count() == 0
    g.unpersist(), whole.unpersist()


def test_store_deals_out_only_what_a_change_can_meet(spark, tmp_path, monkeypatch):
    """Additions are one more part, old rows of other stems aren't dealt out, and all versions are read in one pass."""
    t = lambda *rows: spark.createDataFrame([(s, p, o, "literal", None, None) for s, p, o in rows], ", ".join(f"{c} string" for c in TERMS))
    written = []
    whole = store.Store._with
    monkeypatch.setattr(store.Store, "_with", lambda self, rows, kept: written.append(plan(rows)) or whole(self, rows, kept))
    one = store.Store.created(t(("a1", "p", "x"), ("a2", "p", "y"), ("b1", "p", "x"), ("a1", "q", "z")), str(tmp_path / "store"))
    assert "Exchange" not in written[0]
    two = one.changed(new=t(("a2", "p", "y"), ("a3", "p", "y"), ("a3", "p", "y"), ("c1", "p", "w")))
    three = two.changed(new=t(("a1", "p", "v"), ("a3", "p", "u")), replaced=True)
    four = three.changed(new=t(("b1", "p", "x"), ("b2", "p", "x")), gone=t(("c1", "p", "w"), ("a1", "p", "other")))
    assert two.chains == {"p": (1, 2), "q": (1,)} and three.chains == {"p": (3,), "q": (1,)}
    facts = lambda s: sorted(map(tuple, s.read().select("s", "p", "o").collect()))
    v2 = [("a1", "p", "x"), ("a1", "q", "z"), ("a2", "p", "y"), ("a3", "p", "y"), ("b1", "p", "x"), ("c1", "p", "w")]
    assert facts(two) == v2 and len(facts(one)) == 4
    assert facts(three) == [("a1", "p", "v"), ("a1", "q", "z"), ("a2", "p", "y"), ("a3", "p", "u"), ("b1", "p", "x"), ("c1", "p", "w")]
    assert facts(four) == [("a1", "p", "v"), ("a1", "q", "z"), ("a2", "p", "y"), ("a3", "p", "u"), ("b1", "p", "x"), ("b2", "p", "x")]
    each = four.through(1, 2, 3, 4).select("s", "p", "o", F.explode("versions").alias("v"))
    assert [sorted(map(tuple, each.where(F.col("v") == k).select("s", "p", "o").collect())) for k in (1, 2, 3, 4)] == [facts(s) for s in (one, two, three, four)]
    near, far = shared.apart(t(("a7", "p", "x"), ("ab", "p", "x"), ("a7", "q", "x"), (None, "p", "x")), t(("a1", "p", "x")))
    assert [r.p for r in near.collect()] == ["p"] and far.count() == 3
