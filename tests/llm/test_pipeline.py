import corpus_pipeline

from cases import SCHEMA, awkward, documents, prose
from gaugeweave.llm.tables import rows, without

SF = "/root/testdata/sf0.001"


def test_stages_over_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "decontamination", "bpe"]
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns
    assert all(r["decoded_equal"] and len(r["token_ids"]) == r["n_tokens"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(texts[r["doc_id"]] == r["text"] for r in rows)
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in r["text"] for b in bench for r in rows)


def test_each_stage_on_awkward_and_empty_rows(spark):
    for docs in (awkward(spark), spark.createDataFrame([], SCHEMA)):
        count = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert (out.count() == 0) == (count == 0) and out.count() <= count
            if name != "bpe":
                assert out.columns == docs.columns


def _shuffled(plan):
    """Rows of each shuffle of a plan that ran."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _shuffled(plan.executedPlan())
    if "QueryStage" in name:
        own = [int(str(plan.getRuntimeStatistics().rowCount().get()))] if name.startswith("ShuffleQueryStage") else []
        return own + _shuffled(plan.plan())
    return [n for i in range(plan.children().size()) for n in _shuffled(plan.children().apply(i))]


def test_texts_that_stay_are_not_moved(spark):
    texts = [(i if i % 50 else None, prose(i, 20)) for i in range(2000)]
    docs = documents(spark, texts)
    gone = spark.createDataFrame([(i,) for i in [*range(1, 101), 1, 2, 90_000]], "id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = without(docs, docs["doc_id"], gone)
        got = left.collect()
        moved = _shuffled(left._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == sorted((d or -1, t) for d, t in texts if d is None or d > 100)
    assert moved and max(moved) < 200
    empty = without(docs, docs["doc_id"], gone.limit(0))
    assert empty.count() == 2000


def test_batches_of_long_texts_are_bounded(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(CAST(id % 10 AS STRING), 10000) AS text")
    sizes = rows(docs, lambda batches: ([(b.num_rows, b.nbytes)] for b in batches), "n long, size long").collect()
    assert sum(r["n"] for r in sizes) == 3000 and max(r["size"] for r in sizes) < 5_000_000
