from municipia.llm import decontamination, jaccard_join, language_id, quality_rules, sentencepiece_codec
from municipia.llm.queries import PIECE_MODEL, QUERIES
from municipia.llm.shared import table, written

SF = "/root/testdata/sf0.001"


def test_run_is_its_stages(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = written(stage(spark, docs, SF))
        if k < 4:
            assert docs.columns == before.columns and docs.join(before, docs.columns, "left_anti").count() == 0
    want = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, QUERIES["pipeline"](spark, SF).collect())) == want


def test_each_stage_decides_as_its_operator_says(spark):
    docs = table(spark, SF, "documents")
    told = written(language_id.language_report(docs, PIECE_MODEL))
    kept = written(language_id.keep_identified(docs, PIECE_MODEL))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(kept) == ids(told.where("lang_pred <> 'und' and score >= 0.5"))
    good = written(quality_rules.keep_good(kept))
    assert ids(good) == ids(quality_rules.quality_report(kept).where("kept"))
    single = written(jaccard_join.keep_first(good))
    assert ids(single) == ids(jaccard_join.near_duplicates(good).where("doc_id = component_id"))
    clean = written(decontamination.keep_uncontaminated(single, table(spark, SF, "benchmark")))
    assert ids(clean) == ids(decontamination.contamination(single, table(spark, SF, "benchmark")).where("not contaminated"))
    assert sentencepiece_codec.encode_digests(clean, PIECE_MODEL).count() == clean.count()
