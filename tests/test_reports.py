"""Reports, page lists, Turtle, careless text and suggestions on small made-up tables."""

import pytest
from pyspark.sql import functions as F

from factweave.operators import pages, reports, suggestions
from factweave.sources import ragged, turtle
from factweave.sources.mapping import DECIMAL, INTEGER, TERMS, TYPE


def test_distincts_and_mode(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 2), ("N.A.", None), (" ", 3)], "x string, y int")
    assert tuple(reports.distincts(rows, {"x": F.col("x"), "y": F.col("y")}).first()) == (1, 3)
    assert tuple(reports.distincts(rows.limit(0), {"x": F.col("x"), "y": F.col("y")}).first()) == (0, 0)
    ties = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("NA",), ("NA",), ("NA",)], "x string")
    assert tuple(reports.mode(ties, "x").first()) == ("a", 2)
    assert tuple(reports.mode(ties.limit(0), "x").first()) == (None, 0)


def test_reports_of_results(spark):
    rows = spark.createDataFrame([("a", "b", "+", 2000, "FR", "J", "s"), ("a", None, "+", 2001, "DE", "J", "s"), ("c", "d", "-", 2004, "FR", "", "t"), ("e", "f", "+", None, "FR", "K", "N.A.")], "vi string, vd string, relation_direction string, article_year long, country string, journal string, sport_name string")
    got = reports.competency(rows, reports.is_valid()).first().asDict()
    assert got == {"results": 4, "valid": 3, "errors": 1, "success_percent": 75.0, "first_year": 2000, "last_year": 2004, "mean_year": 2002, "countries": 1, "journals": 2, "sports": 2, "relation_types": 2, "mode": "+", "mode_n": 2}
    empty = reports.results(rows.limit(0), reports.is_valid()).first().asDict()
    assert empty["results"] == empty["valid"] == 0 and empty["success_percent"] == 0.0 and empty["mean_year"] is None
    parts = {r["key"]: (r["n"], r["percent"]) for r in reports.breakdown(rows, {"VD": "vd", "Relation": "relation_direction"}).collect()}
    assert parts == {"VD:b": (1, 25.0), "VD:d": (1, 25.0), "VD:f": (1, 25.0), "Relation:+": (3, 75.0), "Relation:-": (1, 25.0)}
    assert reports.breakdown(rows.limit(0), {"VD": "vd"}).count() == 0


def test_pages(spark):
    rows = spark.range(2500).select(F.when(F.col("id") < 2400, "hot").otherwise(F.when(F.col("id") < 2450, "small")).alias("node"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("m"))
    rows = rows.unionByName(rows).unionByName(spark.createDataFrame([("hot", None)], "node string, m string"))
    got = pages.paged(rows, ("node",), "m", page=100, stripes=7).collect()
    for node, n in (("hot", 2400), ("small", 50), (None, 50)):
        own = sorted((r for r in got if r["node"] == node), key=lambda r: r["page"])
        assert [r["page"] for r in own] == list(range(1, -(-n // 100) + 1)) and {r["n_pages"] for r in own} == {-(-n // 100)} and {r["n_members"] for r in own} == {n}
        assert all(len(r["members"]) == 100 for r in own[:-1]) and len({m for r in own for m in r["members"]}) == n == sum(len(r["members"]) for r in own)
    assert pages.paged(rows.limit(0), ("node",), "m").count() == 0


def read(spark, tmp_path, text):
    (tmp_path / "x.ttl").write_text(text, encoding="utf-8")
    return sorted(map(tuple, turtle.read_turtle(spark, str(tmp_path)).collect()), key=str), sorted(map(tuple, turtle.bad_statements(spark, str(tmp_path)).collect()))


def test_turtle_is_read(spark, tmp_path):
    got, bad = read(spark, tmp_path, """﻿# A comment; with a point.
@prefix ex: <urn:ex/> .
@prefix : <urn:d/> .
ex:a a ex:T , :U ;
    ex:p "x; y, z. # no comment \\"quoted\\" \\\\ \\u00e9\\n"@en-GB , 12 , -1.5 , true ;  # a comment, within
    ex:q <urn:i#j> ; ex:q _:b1 ;
    .
_:b1 ex:p "5"^^<urn:int> , "6"^^ex:int.

<urn:s> <urn:p> <urn:o> .
<urn:s> <urn:p> <urn:o> .
""")  # fmt: skip
    lit = lambda s, p, o, d=None, lang=None: (s, p, o, "literal", d, lang)
    assert got == sorted([
        ("urn:ex/a", TYPE, "urn:ex/T", "iri", None, None), ("urn:ex/a", TYPE, "urn:d/U", "iri", None, None), lit("urn:ex/a", "urn:ex/p", 'x; y, z. # no comment "quoted" \\ é\n', None, "en-GB"), lit("urn:ex/a", "urn:ex/p", "12", INTEGER),
        lit("urn:ex/a", "urn:ex/p", "-1.5", DECIMAL), lit("urn:ex/a", "urn:ex/p", "true", turtle.BOOLEAN), ("urn:ex/a", "urn:ex/q", "urn:i#j", "iri", None, None), ("urn:ex/a", "urn:ex/q", "_:b1", "bnode", None, None),
        lit("_:b1", "urn:ex/p", "5", "urn:int"), lit("_:b1", "urn:ex/p", "6", "urn:ex/int"), ("urn:s", "urn:p", "urn:o", "iri", None, None)], key=str)
    assert bad == []


def test_turtle_says_what_it_leaves_out(spark, tmp_path):
    got, bad = read(spark, tmp_path, '@prefix ex: <urn:ex/> .\nex:a ex:p [ ex:q 1 ] .\nex:a no:p 1 .\nex:a ex:p no:o , 2 .\nex:a ex:p """long""" .\nex:only .\n')
    assert got == [("urn:ex/a", "urn:ex/p", "2", "literal", INTEGER, None)]
    assert [b[0].split(" ", 1)[0] + " " + str(b[1]) for b in bad] == ["ex:a 1", "ex:a 1", "ex:a 1", "ex:a 1", "ex:only 1"] or len(bad) == 5


def test_turtle_round_trip(spark, tmp_path):
    rows = [
        ("urn:ex/a", TYPE, "urn:ex/T", "iri", None, None), ("urn:ex/a", "urn:ex/p", 'a "b"; c, d. e\n.\n\\n', "literal", None, "fr"), ("urn:ex/a", "urn:ex/p", "1", "literal", INTEGER, None), ("urn:ex/a", "urn:ex/p", "1", "literal", None, None),
        ("_:b", "urn:ex/with.point", "_:c", "bnode", None, None), ("urn:other x".replace(" ", "%20"), "urn:ex/p", "", "literal", None, None)]
    triples = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TERMS))
    turtle.write_turtle(triples, str(tmp_path / "out"), {"ex": "urn:ex/", "x": "urn:xsd/"})
    assert sorted(map(tuple, turtle.read_turtle(spark, str(tmp_path / "out")).collect()), key=str) == sorted(rows, key=str)
    assert turtle.bad_statements(spark, str(tmp_path / "out")).count() == 0
    turtle.write_turtle(triples.limit(0), str(tmp_path / "none"), {"ex": "urn:ex/"})
    assert turtle.read_turtle(spark, str(tmp_path / "none")).count() == 0


def test_ragged_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿id;"name";n\r\n1;"a;b";2\n2;c\n\n  \nN.A.;d;3\n;e\n3;"x;5\n4; y ;6\nid;"name";n\r\n4; y ;6\n', encoding="utf-8")
    rows = ragged.read_ragged(spark, str(tmp_path), "id")
    got = sorted(tuple(r) for r in rows.collect())
    assert got == sorted([("1", "a", "b", ["2"], "long"), ("2", "c", "", [], "short"), ("N.A.", "d", "3", [], "no id"), ("", "e", "", [], "no id"), ("3", "x", "5", [], "stray quotes"), ("4", "y", "6", [], ""), ("4", "y", "6", [], "")])
    assert ragged.taken(rows).count() == 5 and ragged.taken(rows).columns == ["id", "name", "n"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("")
    assert ragged.read_ragged(spark, str(tmp_path / "none"), "id").count() == 0
    with pytest.raises(ValueError):
        ragged.read_ragged(spark, str(tmp_path), "missing")


def test_suggestions_equal_a_scan(spark):
    words = ["Gear", "gear", "Small gear", "gearing up", "EAR", "ea", "N.A.", "", None, "éclair", "ÉCLAIR", "a%b_c", "aaaa", "small  gear"]
    rows = spark.createDataFrame([(w, v) for w in words for v in ("x", "Gear x")], "a string, b string")
    index = suggestions.Index.built(rows, {"first": "a", "second": "b"})
    for text in ("gear", "EAR", "ea", "", "écl", "%b_", "aaa", "zzz", "small gear"):
        for cap in (2, 20):
            expected = []
            for field, column in (("first", 0), ("second", 1)):
                values = {(w, v)[column] for w in words for v in ("x", "Gear x")} - {None, "", "N.A."}
                found = sorted((v for v in values if text.lower() in v.lower()), key=lambda v: (not v.lower().startswith(text.lower()), v.lower(), v))
                expected += [(field, v, k + 1) for k, v in enumerate(found[:cap])]
            assert sorted(map(tuple, index.search(text, cap).select("field", "value", "place").collect())) == sorted(expected), (text, cap)
    assert index.search("gear", fields=("second",)).select("field").distinct().collect() == [("second",)]
    assert suggestions.Index.built(rows.limit(0), {"first": "a"}).search("gear").count() == 0
