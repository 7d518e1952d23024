"""The token pattern goes over a statement once, and nothing that isn't understood is lost."""

from factweave.sources import turtle


def test_tokens_are_made_once(spark, tmp_path):
    text = '# head\n@prefix a: <urn:a/> .\n# of a\n@prefix b: <urn:b/> .\n# next\na:s a:p "x # y ; z ." , 5 ;\n  b:q a:o .\n\n# end .\n???  .\na:s b:r "u" !! .\n'
    (tmp_path / "x.ttl").write_text(text)
    df = turtle.read_turtle(spark, str(tmp_path))
    assert sorted((r.s, r.p, r.o) for r in df.collect()) == [("urn:a/s", "urn:a/p", "5"), ("urn:a/s", "urn:a/p", "x # y ; z ."), ("urn:a/s", "urn:b/q", "urn:a/o")]
    assert sorted(r.statement.strip() for r in turtle.bad_statements(spark, str(tmp_path)).collect()) == ["???", 'a:s b:r "u" !!']
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4  # three of them meet the prefixes only
