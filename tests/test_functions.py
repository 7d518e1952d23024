"""Column functions against tables of cases."""

import pytest
from pyspark.sql import functions as F

from factweave.functions import numbers, text
from factweave.operators import hierarchy
from factweave.operators.search import Statistic
from factweave.plans import patterns
from factweave.sources import files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "expected"), [("M=21,5 (SD=2,1)", 21.5), ("M=21", 21.0), ("21.5", None), ("N.A.", None), ("", None), (None, None), ("M=1.2.3", None)])
def test_mean(spark, raw, expected):
    assert one(spark, numbers.mean_of, raw) == expected


@pytest.mark.parametrize(("raw", "expected"), [("[15-20]", (15.0, 20.0)), ("[15.5-20,5]", (15.5, 20.5)), ("15-20", (None, None)), ("N.A.", (None, None)), (None, (None, None))])
def test_range(spark, raw, expected):
    lo, hi = numbers.range_of(F.col("x"))
    assert tuple(spark.createDataFrame([(raw,)], "x string").select(lo, hi).first()) == expected


@pytest.mark.parametrize(("v", "unit", "base", "expected"), [(120.0, "minutes", "week", 2), (30.0, "minutes", "day", 3.5), (2.0, "hours", "day", 14), (3.0, "days", "week", 72), (4.0, "sessions", "week", 6), (40.0, None, None, 40), (120.0, None, None, 2)])
def test_weekly_hours(spark, v, unit, base, expected):
    row = spark.createDataFrame([(v, unit, base)], "v double, u string, b string")
    assert row.select(numbers.weekly_hours(F.col("v"), F.col("u"), F.col("b"))).first()[0] == expected


@pytest.mark.parametrize(("v", "unit", "expected"), [(24.0, "months", 2), (52.0, "weeks", 1), (365.0, "days", 1), (5.0, None, 5)])
def test_years(spark, v, unit, expected):
    assert spark.createDataFrame([(v, unit)], "v double, u string").select(numbers.years(F.col("v"), F.col("u"))).first()[0] == expected


@pytest.mark.parametrize(("label", "expected"), [(" Body  image ", "urn:x/Body_image"), ("Self-esteem", "urn:x/Self-esteem"), ("", None), ("  ", None), ("A\tB", "urn:x/A_B")])
def test_label_to_iri(spark, label, expected):
    assert one(spark, lambda c: text.label_to_iri(c, "urn:x/"), label) == expected


@pytest.mark.parametrize(("iri", "expected"), [("http://x/a#bodyImage", "body Image"), ("http://x/Sub_Class", "Sub Class"), ("x", "x")])
def test_readable_label(spark, iri, expected):
    assert one(spark, text.readable_label, iri) == expected


@pytest.mark.parametrize(("raw", "expected"), [("Analysis_12,1", "12.1"), ("12.0", "12"), (" analysis_7 ", "7")])
def test_flexible_id(spark, raw, expected):
    assert one(spark, text.flexible_id, raw) == expected


@pytest.mark.parametrize(("raw", "expected"), [('a"b', 'a\\"b'), ("a\nb", "a\\nb"), ("a\\b", "a\\\\b"), (None, "N.A.")])
def test_escaped(spark, raw, expected):
    assert one(spark, text.escaped, raw) == expected


@pytest.mark.parametrize(("edges", "expected"), [
    ([("a", "b"), ("b", "c")], {("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}),
    ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], {("a", "b", 1), ("a", "c", 1), ("b", "d", 1), ("c", "d", 1), ("a", "d", 2)}),
    ([("a", "b"), ("b", "a")], {("a", "b", 1), ("b", "a", 1), ("a", "a", 2), ("b", "b", 2)}),
    ([("a", "a")], {("a", "a", 1)}),
    ([], set()),
])
def test_closure(spark, edges, expected):
    assert {tuple(r) for r in hierarchy.closure(spark.createDataFrame(edges, "child string, parent string")).collect()} == expected


def test_unique_ids(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (" a", 4), ("", 5), ("", 6)], "k string, n int")
    assert [r["unique_id"] for r in files.with_unique_ids(rows, "k", "n").orderBy("n").collect()] == ["a", "a.1", "b", "a.2", "", ""]


def test_statistic_bounds():
    with pytest.raises(ValueError, match="low"):
        Statistic(low=5, high=5)


def test_patterns(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "p", "b"), ("b", "q", "c")], "s string, p string, o string")
    assert {tuple(r) for r in patterns.match(t, ("?x", "p", "?y"), ("?y", "q", "?z")).select("x", "y", "z").collect()} == {("a", "b", "c"), ("b", "b", "c")}
    assert [r["x"] for r in patterns.match(t, ("?x", "p", "?x")).collect()] == ["b"]
    assert {tuple(r) for r in patterns.optional(patterns.match(t, ("?x", "p", "?y")), t, ("?x", "q", "?z")).collect()} == {("a", "b", None), ("b", "b", "c")}
    with pytest.raises(ValueError, match="in common"):
        patterns.match(t, ("?x", "p", "?y"), ("?v", "q", "?w"))
    assert [r["x"] for r in patterns.without(patterns.match(t, ("?x", "p", "?y")), t, ("?x", "q", "?z")).collect()] == ["a"]


def test_ntriples(spark, tmp_path):
    (tmp_path / "x.nt").write_text('<urn:a> <urn:p> "l\\"x"@fr .\n<urn:a> <urn:p> "1"^^<urn:int> .\n# no\n\n<urn:a> <urn:q> <urn:b> .\n<urn:a> <urn:q> <urn:b> .\n')
    got = {(r.s, r.p, r.o, r.o_kind, r.o_datatype, r.o_lang) for r in files.read_ntriples(spark, str(tmp_path)).collect()}
    assert got == {("urn:a", "urn:p", 'l"x', "literal", None, "fr"), ("urn:a", "urn:p", "1", "literal", "urn:int", None), ("urn:a", "urn:q", "urn:b", "iri", None, None)}


def test_delimited(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('﻿Analysis ID;b\n1;"x;y"\n;\n'.encode())
    rows = files.without_blank_rows(files.renamed(files.read_delimited(spark, str(tmp_path))))
    assert [tuple(r) for r in rows.select("Analysis_ID", "b").collect()] == [("1", "x;y")]


def test_ntriples_escapes(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<a> <b> "say \\"hi\\" \\\\n and\\nline \\u00e9 \\U0001F600 end"@en .\n')
    assert [r.o for r in files.read_ntriples(spark, str(tmp_path)).collect()] == ['say "hi" \\n and\nline é \U0001f600 end']


def test_blank_keys_take_no_number(spark):
    table = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "a"), (5, " ")], "n int, k string")
    assert [r.unique_id for r in files.with_unique_ids(table, "k", "n").orderBy("n").collect()] == ["a", "", None, "a.1", ""]
