import corpus_pipeline
from newsloom.llm import pii, quality_classifier, quality_rules
from newsloom.llm.arrow import written
from tests.conftest import SF_SMALL
from tests.llm import fixtures as fx


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    model = quality_classifier.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if model.score(quality_classifier.statistics(t.encode())[None])[0] >= 0.7]
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    rows = [(d, t) for d, t in rows if d in kept]
    groups = fx.components(rows, 5, 80)
    rows = {d: pii.replace_all(t.encode(), pii.session_key(spark))[0] for d, t in rows if groups[d][1] == d}
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {d: len(fx.words(t)) for d, t in rows.items()}
    assert len(got) == len(rows)
    places = {(r.bucket, r.batch, r.slot) for r in got}
    assert len(places) == len(got)


def test_every_stage_takes_awkward_and_empty_tables(spark):
    for table in (fx.table(spark), fx.table(spark).limit(0)):
        docs = written(table, "t-stage")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = written(stage(spark, docs, SF_SMALL), "t-stage")
            assert out.count() <= docs.count()
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == table.columns
                docs = out
            else:
                assert out.count() == docs.count()
