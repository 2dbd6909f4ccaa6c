"""Each stage of the pipeline works on what its predecessor kept."""

import corpus_pipeline
from ratebook.llm.common import read_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    assert len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert 0.5 * before < len(rows) <= before and {"doc_id", "ids", "text"} <= set(out.columns)
    assert len({r.doc_id for r in rows}) == len(rows)
    ids = {r.doc_id for r in rows}
    assert ids <= {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == columns, name


def test_stages_without_rows(spark):
    """An empty table passes the stages after the model's, with its columns."""
    docs = read_table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() == 0, name
