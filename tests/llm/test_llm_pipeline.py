import corpus_pipeline
from postmill.llm import toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        assert rows.columns == docs.columns
        kept.append({r["doc_id"]: r["text"] for r in rows.collect()})
        rows = spark.createDataFrame(rows.collect(), docs.schema)
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(kept[0]) == {r["doc_id"] for r in docs.collect() if chain.score(r["text"])[-1] < 0.5}
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    assert len({low(t) for t in kept[2].values()}) == len(kept[2]) == len({low(t) for t in kept[1].values()})
    assert set(kept[3]) <= set(kept[2]) <= set(kept[1]) <= set(kept[0])
    packed = corpus_pipeline.packed(spark, rows, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept[3])


def test_empty(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows, sf).count() == 0
