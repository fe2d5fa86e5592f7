import corpus_pipeline
import pytest

import __spark_entry__


def test_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.staged(stage(spark, docs, folder), name)
        assert docs.columns == columns and 0 < docs.count() <= before
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert tokens.count() == docs.count() and tokens.filter("NOT round_trip").count() == 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_stand_odd_and_empty_rows(spark, odd, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd, odd.limit(0)):
        got = stage(spark, docs, folder)
        assert name == "tokens" or got.columns == docs.columns
        assert got.count() <= docs.count()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
    assert set(__spark_entry__.oracle_sql()) <= set(names)
