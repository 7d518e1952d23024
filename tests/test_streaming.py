from factweave.sources import binding
from factweave.streaming import ingest

COLUMNS = ("analysis_id", "gender", "mediator")


def test_append(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        rows = ingest.stream(spark, str(source), COLUMNS)
        ingest.append_triples(rows, ("gender", "mediator"), str(target), str(tmp_path / "state")).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(target)).select("s", "p", "o").collect())

    (source / "a.csv").write_text("analysis_id;gender;mediator\n1;Male;\n2;Female;x\n")
    s, p = binding.DATA + "Analysis_", binding.ONTOLOGY
    first = [(s + "1", p + "gender", "Male"), (s + "1", binding.TYPE, p + "Analysis"), (s + "2", p + "gender", "Female"), (s + "2", p + "mediator", "x"), (s + "2", binding.TYPE, p + "Analysis")]
    assert run() == sorted(first)
    (source / "b.csv").write_text("analysis_id;gender;mediator\n2;Female;x\n3;Mixed;\n3;Mixed;\n")
    assert run() == sorted([*first, (s + "3", p + "gender", "Mixed"), (s + "3", binding.TYPE, p + "Analysis")])
