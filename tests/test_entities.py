"""Mapping, records, updates, shapes and exports on small made-up graphs: blanks, repetitions, shared satellites, cycles, empty tables."""

import re

import pytest
from pyspark.sql import functions as F

from factweave.functions import text
from factweave.operators import entity_updates, exports, node_shapes, records
from factweave.sources import mapping
from factweave.sources.mapping import TERMS, TYPE, Constant, Entity, Ref, Template
from factweave.sources.sheet import P
from factweave.sources.store import Store

SCHEMA = ", ".join(f"{c} string" for c in TERMS)


def graph(spark, *rows):
    """Triples (s, p, o) whose o is an IRI where it begins with a capital."""
    return spark.createDataFrame([(s, p if p == TYPE else P(p), P(o) if p == TYPE else o, "iri" if p == TYPE or o[:1].isupper() else "literal", None, None) for s, p, o in rows], SCHEMA)


def set_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_mapping(spark):
    rows = spark.createDataFrame([("a b", "x/1", "v", None), ("a b", "x/1", "v", "w"), ("", "y", "v", "w"), (None, "z", " ", "w"), ("é", None, "q", "")], "a string, b string, c string, d string")
    entities = [
        Entity("Pair", Template("urn:{a}/{b}"), ("urn:Pair",), {"c": Ref("c", "urn:int"), "d": Ref("d", lang="fr"), "to": Template("urn:C/{c}"), "says": Template("{c}-{d}!", "literal", lang="en"), "k": Constant("K")}),
        Entity("C", Template("urn:C/{c}"), ("urn:C1", "urn:C2")),
    ]
    got = mapping.triples(rows, entities)
    assert set_of(got, *TERMS) == sorted([
        ("urn:a%20b/x%2F1", TYPE, "urn:Pair", "iri", None, None), ("urn:a%20b/x%2F1", "c", "v", "literal", "urn:int", None), ("urn:a%20b/x%2F1", "d", "w", "literal", None, "fr"),
        ("urn:a%20b/x%2F1", "to", "urn:C/v", "iri", None, None), ("urn:a%20b/x%2F1", "says", "v-w!", "literal", None, "en"), ("urn:a%20b/x%2F1", "k", "K", "literal", None, None),
        *[(f"urn:C/{c}", TYPE, t, "iri", None, None) for c in "vq" for t in ("urn:C1", "urn:C2")]], key=str)
    assert set_of(mapping.triples(rows, entities, ["to"]), "s", "p", "o") == [("urn:a%20b/x%2F1", "to", "urn:C/v")]
    assert set_of(mapping.unmapped(rows, entities), "entity", "n") == [("C", 1), ("Pair", 3)]
    assert mapping.triples(rows.limit(0), entities).count() == 0
    with pytest.raises(ValueError):
        mapping.triples(rows, entities, ["nothing"])
    # Only the columns that the wanted predicates need are read.
    assert re.search(r"Project \[a#\d+, b#\d+, c#\d+\]", mapping.triples(rows, entities, ["to"])._jdf.queryExecution().optimizedPlan().toString())


def test_records_walk_all_branches(spark):
    g = graph(
        spark, ("A1", TYPE, "Analysis"), ("A1", "analysisId", "1"), ("A1", "hasPopulation", "Pop"), ("A1", "hasRelation", "R1"), ("A1", "hasRelation", "R2"), ("R1", "hasDependentVariable", "V"), ("R2", "hasIndependentVariable", "W"),
        ("V", "measure", "M"), ("W", "measure", "M"), ("M", "prefLabel", "m"), ("Pop", "ageStats", "Age"), ("Age", "meanAge", "20"), ("Art", "hasAnalysis", "A1"), ("Art", "title", "t"), ("X", "quotes", "A1"), ("Y", "says", "a1"), ("A2", TYPE, "Analysis"))
    got = records.record(g, g.where(F.col("p") == TYPE).select("s"))
    short = F.substring_index("property", "/", -1)
    rows = set_of(got.where("analysis = 'A1'").select("entity", "entity_type", "sub_entity", short.alias("p"), "value"), "entity", "entity_type", "sub_entity", "p", "value")
    art = f"Art -> {P('hasAnalysis')}"
    assert rows == sorted([
        *[("analysis", "direct", "", p, o) for p, o in (("type", P("Analysis")), ("analysisId", "1"), ("hasPopulation", "Pop"), ("hasRelation", "R1"), ("hasRelation", "R2"))],
        ("population", "linked", "Pop", "ageStats", "Age"), ("relation", "linked", "R1", "hasDependentVariable", "V"), ("relation", "linked", "R2", "hasIndependentVariable", "W"), ("variableVD", "nested", "V", "measure", "M"), ("variableVI", "nested", "W", "measure", "M"),
        ("measure", "nested", "M", "prefLabel", "m"), ("measure", "nested", "M", "prefLabel", "m"), ("ageStats", "nested", "Age", "meanAge", "20"), ("article", "linked", "Art", "hasAnalysis", "A1"), ("article", "linked", "Art", "title", "t"),
        ("reverse_linked", "reverse", art, "hasAnalysis", "A1"), ("reverse_linked", "reverse", art, "title", "t"), ("reverse_linked", "reverse", f"X -> {P('quotes')}", "quotes", "A1")], key=str)
    wide = {r["analysis"]: r for r in records.wide(got).collect()}
    assert wide["A1"]["mean_age"] == "20" and wide["A1"]["title"] == "t" and wide["A1"]["doi"] == "N/A" and wide["A2"]["n_properties"] == 1 and wide["A2"]["entities_found"] == "analysis"
    assert wide["A1"]["entities_found"] == "ageStats, analysis, article, measure, population, relation, reverse_linked, variableVD, variableVI"
    assert records.record(g, g.limit(0).select("s")).count() == 0
    assert len({f for *_, f in records.FIELDS}) >= 42


def test_cascade_spares_shared_satellites(spark):
    rows = (
        ("A1", "hasPopulation", "P1"), ("A1", "hasSport", "Shared"), ("A2", "hasSport", "Shared"), ("Shared", "hasRelation", "Below"), ("P1", "ageStats", "Age1"), ("P1", "bmiStats", "Both"), ("A1", "hasRelation", "R1"), ("R1", "hasDependentVariable", "Both"),
        ("R1", "hasIndependentVariable", "Loop"), ("Loop", "hasRelation", "Loop2"), ("Loop2", "hasRelation", "Loop"), ("Loop2", "hasRelation", "A1"), ("Art", "hasAnalysis", "A1"), ("Art", "title", "A1"), ("Art", "note", "age1"), ("A1", "cites", "Far"), ("Far", "note", "x"))
    g = graph(spark, *rows)
    g = g.withColumn("o_kind", F.when(F.col("p") == P("title"), "literal").otherwise(F.col("o_kind")))
    ids = spark.createDataFrame([("A1",), ("A1",), ("None",)], "s string")
    doomed = {"A1", "P1", "Age1", "Both", "R1", "Loop", "Loop2"}
    assert {r["node"] for r in entity_updates.doomed(g, ids).collect()} - {"None"} == doomed
    left = set_of(entity_updates.cascaded(g, ids), "s", "p", "o")
    assert left == sorted([(s, P(p), o) for s, p, o in rows if s not in doomed and (o not in doomed or p == "title")], key=str)
    both = spark.createDataFrame([("A1",), ("A2",)], "s string")
    assert {"Shared", "Below"} <= {r["node"] for r in entity_updates.doomed(g, both).collect()}
    assert entity_updates.cascaded(g, ids.limit(0)).count() == g.count()


def test_replace_needs_the_class_and_takes_subclasses(spark):
    g = graph(spark, ("V", TYPE, "VariableDependante"), ("W", TYPE, "Population"), ("V", "measure", "old"), ("W", "measure", "old"), ("V", "VD", "v"))
    new = graph(spark, ("V", "measure", "new"), ("W", "measure", "new"), ("Z", "measure", "new"), ("Z", "note", "n"))
    got = entity_updates.guarded(new, g, {P("measure"): P("Variable")})
    assert set_of(got, "s", "p", "o") == [("V", P("measure"), "new"), ("Z", P("note"), "n")]


def test_store_rewrites_only_what_is_touched(spark, tmp_path):
    g = graph(spark, ("A", "x", "1"), ("A", "y", "1"), ("B", "x", "2"), ("B", "x", "3"))
    path = str(tmp_path / "store")
    one = Store.created(g, path)
    two = one.changed(new=graph(spark, ("A", "x", "9"), ("C", "x", "9"), ("C", "x", "9")), replaced=True)
    three = two.changed(gone=graph(spark, ("B", "x", "2"), ("A", "y", "0")))
    four = three.changed(gone=graph(spark, ("B", "x", "?")).select("s", "p"))
    short = lambda store: [(s, p[-1], o) for s, p, o in set_of(store.read(), "s", "p", "o")]
    assert short(one.at(1)) == [("A", "x", "1"), ("A", "y", "1"), ("B", "x", "2"), ("B", "x", "3")]
    assert short(two) == [("A", "x", "9"), ("A", "y", "1"), ("B", "x", "2"), ("B", "x", "3"), ("C", "x", "9")] and two.parts[P("y")] == 1 and two.parts[P("x")] == 2
    assert short(three) == [("A", "x", "9"), ("A", "y", "1"), ("B", "x", "3"), ("C", "x", "9")]
    assert short(four) == [("A", "x", "9"), ("A", "y", "1"), ("C", "x", "9")]
    assert four.changed(new=g.limit(0)) is four and set_of(four.read({P("y")}), "s") == [("A",)]
    emptied = four.changed(gone=four.read().select("s", "p"))
    assert emptied.read().count() == 0 and Store.created(g.limit(0), str(tmp_path / "none")).read().count() == 0
    assert [k.name for k in sorted((tmp_path / "store" / "part=2").iterdir()) if k.name.startswith("p=")] == [f"p={P('x').replace(':', '%3A').replace('/', '%2F')}"]


def test_form_fills_blanks(spark):
    rows = spark.createDataFrame([("1", None), ("1", None), ("2", " ")], "id string, x string")
    got = entity_updates.form_triples(rows, (Entity("E", Template("urn:{id}"), ("urn:E",), {"x": Ref("x")}, own=True),))
    assert set_of(got, "s", "o") == [("urn:1", "N.A."), ("urn:1", "urn:E"), ("urn:2", "N.A."), ("urn:2", "urn:E")]


def test_shapes(spark):
    shapes = (
        node_shapes.Shape("S", P("T"), (node_shapes.Rule(P("a"), 1, 2, datatype="urn:int", pattern="^[0-9]+$"), node_shapes.Rule(P("b"), 2, node_kind="iri", cls=P("U")), node_shapes.Rule(P("c"), 0, 0, values=("x", "y")))),
        node_shapes.Shape("S2", P("T2"), (node_shapes.Rule(P("a"), 3),)),
    )
    g = graph(spark, ("N", TYPE, "T"), ("N", TYPE, "T2"), ("M", TYPE, "T"), ("N", "a", "1"), ("N", "a", "z"), ("N", "a", "3"), ("N", "b", "B1"), ("N", "b", "b2"), ("B1", TYPE, "U"), ("N", "c", "x"), ("N", "c", "q"), ("Stranger", "c", "q"))
    g = g.withColumn("o_datatype", F.when(F.col("o").isin("1", "z"), "urn:int"))
    got = set_of(node_shapes.violations(g, shapes).withColumn("path", F.substring_index("path", "/", -1)), "shape", "focus", "path", "constraint", "n")
    assert got == sorted([
        ("S", "N", "a", "max_count", 1), ("S", "N", "a", "datatype", 1), ("S", "N", "a", "pattern", 1), ("S", "N", "b", "node_kind", 1), ("S", "N", "b", "class", 1), ("S", "N", "c", "max_count", 2), ("S", "N", "c", "in", 1),
        ("S", "M", "a", "min_count", 1), ("S", "M", "b", "min_count", 2)], key=str)
    assert node_shapes.violations(g.limit(0), shapes).count() == 0


def test_index_runs_over_the_whole_result(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 > 0, F.lit("same")).alias("t")).repartition(8)
    got = exports.indexed(rows, "k", ranges=5).collect()
    assert sorted(r["index"] for r in got) == list(range(1, 1001))
    assert [r["k"] for r in sorted(got, key=lambda r: r["index"])] == sorted(r["k"] for r in got)
    assert exports.indexed(rows.limit(0), "k").count() == 0


def test_result_triples(spark):
    rows = spark.createDataFrame([("b", 'say "x"\n', "urn:1"), ("a", None, "urn:2")], "id string, t string, iri string")
    got = set_of(exports.result_triples(rows, ("id",), ("iri",), {"format": "turtle"}), "s", "p", "o")
    assert got == sorted([
        ("export:metadata", "export:format", '"turtle"'), ("export:metadata", "export:resultCount", "2"), ("export:result_1", "export:id", '"a"'), ("export:result_1", "export:iri", "<urn:2>"), ("export:result_1", "export:resultIndex", "1"),
        ("export:result_2", "export:id", '"b"'), ("export:result_2", "export:t", '"say \\"x\\"\\n"'), ("export:result_2", "export:iri", "<urn:1>"), ("export:result_2", "export:resultIndex", "2")], key=str)
    assert set_of(exports.result_triples(rows.limit(0), ("id",)), "s", "o") == [("export:metadata", "0")]


def test_wide_columns_come_from_the_data(spark):
    rows = spark.createDataFrame([("1", "zeta", "z"), ("1", "title", "t2"), ("1", "title", "t1"), ("1", "title", "t1"), ("2", "alpha", None), ("3", None, "x")], "id string, property string, value string")
    got = exports.wide(rows, "id")
    assert got.columns == ["id", "title", "alpha", "zeta"]
    assert set_of(got, *got.columns) == [("1", "t1 | t2", None, "z"), ("2", None, None, None), ("3", None, None, None)]
    assert exports.wide(rows.limit(0), "id").columns == ["id"]
    with pytest.raises(ValueError):
        exports.wide(rows.withColumnRenamed("id", "title"), "title")


def test_closure_doubles_paths(spark):
    from factweave.operators import hierarchy

    chain = [(f"n{k}", f"n{k + 1}") for k in range(11)]
    edges = [*chain, ("n0", "n5"), ("a", "b"), ("b", "a"), ("z", "z"), ("n3", "n4")]
    depth = {}
    for start in {c for c, _ in edges}:
        seen, todo, d = {}, {start}, 0
        while todo:
            d += 1
            todo = {p for c, p in edges if c in todo} - seen.keys()
            seen |= dict.fromkeys(todo, d)
        depth |= {(start, x): k for x, k in seen.items()}
    got = hierarchy.closure(spark.createDataFrame(edges, "child string, parent string"))
    assert {(r["descendant"], r["ancestor"]): r["depth"] for r in got.collect()} == depth and got.count() == len(depth)
    assert hierarchy.closure(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_values_and_lines(spark):
    rows = spark.createDataFrame([("1,5", "x:decimal"), ("7", "x:integer"), ("true", "x:boolean"), ("t", None), ("bad", "x:integer"), (None, "x:double")], "v string, d string")
    got = [tuple(r["t"]) for r in rows.select(text.typed_value(F.col("v"), F.col("d")).alias("t")).collect()]
    assert got == [(1.5, None, None, None), (None, 7, None, None), (None, None, True, None), (None, None, None, "t"), (None, None, None, None), (None, None, None, None)]
    lines = spark.createDataFrame([("K", "0,5", "<", "0,05", "0,3"), (None, "N.A.", None, "0,05", None), ("", None, None, None, None)], "k string, r string, s string, p string, b string")
    line = text.statistics_line([F.col("k")], F.col("r"), F.col("s"), F.col("p"), F.col("b"))
    assert [r[0] for r in lines.select(line).collect()] == ["K | r=0,5, p<0,05, β=0,3", "p=0,05", ""]
    filters = spark.createDataFrame([("Male", "gear", 15, 20), (None, "N.A.", None, 20), (None, None, None, None)], "g string, s string, a int, b int")
    assert [r[0] for r in filters.select(text.filters_text(F.col("g"), F.col("s"), F.col("a"), F.col("b"))).collect()] == ["Genre: Male, Sport: gear, Âge: 15-20", "Âge: ?-20", ""]


def test_tables_are_made_once_for_each_state_of_the_files(spark, tmp_path):
    import shutil

    from factweave.sources import shared

    path, made = str(tmp_path / "t.parquet"), []

    def get():
        def make():
            made.append(1)
            return spark.read.parquet(path)

        return sorted(r[0] for r in shared.once(spark, "probe", [path], make).collect())

    spark.range(3).coalesce(1).write.parquet(path)
    assert get() == get() == [0, 1, 2] and len(made) == 1
    spark.range(3, 5).coalesce(1).write.mode("append").parquet(path)  # the files changed
    assert get() == [0, 1, 2, 3, 4] and len(made) == 2
    key = max((k for k in shared._made if k[1] == "probe"), key=lambda k: k[2])
    shutil.rmtree(shared._made[key][0].removeprefix("file:"))  # cleared away
    assert get() == [0, 1, 2, 3, 4] and len(made) == 3
