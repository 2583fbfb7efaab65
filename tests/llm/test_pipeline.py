"""The pipeline on sf0.001: each stage on its own input, and the whole run."""

import corpus_pipeline
from tabulon.llm.common import read

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_run_gives_the_last_stage(spark):
    docs = read(spark, FOLDER, "documents")
    names, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == names, name
        kept = out.collect()
        counts.append(len(kept))
        docs = spark.createDataFrame(kept, out.schema)
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    last = corpus_pipeline.run(spark, FOLDER)
    rows = last.collect()
    assert len(rows) == counts[-1]
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept}
    assert all(r.round_trip for r in rows)
