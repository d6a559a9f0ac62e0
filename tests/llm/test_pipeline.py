import corpus_pipeline
from brute import classes, lines
from test_llm_operators import corpus, frame


def test_stages_keep_the_columns(spark, tmp_path):
    docs = frame(spark, corpus(3)).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such passage in any of these documents at all, none")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, str(tmp_path))
        assert after.columns == list(corpus_pipeline.COLUMNS)
        ids = {r.doc_id for r in after.collect()}
        assert ids <= {r.doc_id for r in held.select("doc_id").collect()}
        held = after.cache()
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in done.collect()} == ids


def test_line_stage_is_the_operator(spark):
    docs = corpus(5)
    after = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame(spark, docs), "").collect()}
    told = lines(docs)
    assert all(told[d][1] == 0 or d not in after or len(after[d].split("\n")) == told[d][0] - told[d][1] for d, _ in docs)


def test_one_of_each_class_stays(spark):
    docs = corpus(6)
    after = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, docs), "").collect()}
    assert after == set(classes(docs, 5, 80).values())
