"""N-Triples lines that are cut at their marks, and lines that are matched by patterns, give the same triples."""

from factweave.sources import files


def test_plain_and_odd_lines(spark, tmp_path):
    lines = [
        '<urn:a> <urn:p> "x y" .', '<urn:a>\t<urn:p>  "x y" . ', '<urn:a> <urn:p> "x\\u0020y" .', '<urn:a> <urn:p> "x y"@en .', '<urn:a> <urn:p> "x y"^^<urn:t> .', "<urn:a> <urn:p> <urn:b> .", "<urn:a> <urn:p> <urn:b>.",
        "<urn:a> <urn:p> _:b1 .", "_:a <urn:p> <urn:b> .", '<urn:a> <urn:p> "" .', '<urn:a> <urn:p> " " .', '<urn:a> <urn:p> " "@fr .', '<urn:a> <urn:p> "> <a> ." .', "<urn:a> <urn:p> .", "# <urn:a> <urn:p> <urn:b> .", "", "<urn:a> <urn:p>",
        '<urn:a> <urn:p> "u\u2028v" .', '<urn:a> <urn:p> "u\u2028v"@en .',
    ]
    (tmp_path / "a.nt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    got = sorted(map(tuple, files.read_ntriples(spark, str(tmp_path)).collect()), key=str)
    said = [("x y", "literal", None, None), ("x y", "literal", None, "en"), ("x y", "literal", "urn:t", None), ("urn:b", "iri", None, None), ("_:b1", "bnode", None, None), ("", "literal", None, None), (" ", "literal", None, None), (" ", "literal", None, "fr"), ("> <a> .", "literal", None, None), ("u\u2028v", "literal", None, None), ("u\u2028v", "literal", None, "en")]
    assert got == sorted([("urn:a", "urn:p", *x) for x in said] + [("_:a", "urn:p", "urn:b", "iri", None, None)], key=str)


def test_plain_lines_are_cut_at_their_marks(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<urn:a> <urn:p> "x" .\n')
    plan = files.read_ntriples(spark, str(tmp_path)).select("s", "p", "o")._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN plain" in plan and "xxhash64" not in plan
