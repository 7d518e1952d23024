"""The pipeline end to end on a small table, and its stages on one with nulls, empty texts, repeated rows and clashing columns."""

import corpus_pipeline
from factweave.llm import near_join, quality, secrets
from factweave.llm.base import table

SF = "/root/testdata/sf0.001"


def test_stages_and_end_to_end(spark):
    docs = table(spark, SF, "documents")
    all_ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    before = all_ids
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = corpus_pipeline.written(out, name)
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before, name
        docs, before = out, set(ids)
    assert before and before < all_ids
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == before
    total = sum(r["length"] for r in pieces)
    assert total == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())
    assert {r["sequence_id"] for r in pieces} == set(range(-(-total // 2048)))


def test_row_stages_keep_odd_rows_apart(spark):
    text = "a text of several plain words that stands here in two rows of the table"
    rows = [(1, text), (1, text), (2, None), (None, ""), (3, "x " * 3000)]
    odd = spark.createDataFrame([(i, t, "en", "s", None, "r", "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rid string, label string")
    assert near_join.deduplicated(odd).count() == 3  # the null and the empty text are equal
    field = secrets.Field({}, [[0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, secrets.NEVER, 9.0]])
    assert sorted(map(str, secrets.redact(odd, field).drop("n_chars").collect())) == sorted(map(str, odd.drop("n_chars").collect()))
    model = quality.train(quality.np.zeros((0, len(quality.NAMES))), quality.np.zeros(0), 0.5)
    assert quality.kept(odd, model).count() == len(rows) and quality.kept(odd.limit(0), model).count() == 0
