import corpus_pipeline
from tests.llm.test_ngram_join import brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    for (name, stage), cols in zip(corpus_pipeline.STAGES, [docs.columns] * 4 + [None], strict=True):
        before = docs
        out = stage(spark, before, DATA)
        if cols:
            assert out.columns == cols, name
        rows = out.collect()
        assert rows
        if name == "ngram_jaccard":
            held = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in rows} == {d for d, _, c in brute(held, 5, 80, 100) if d == c}
        docs = spark.createDataFrame(rows, out.schema)
    got = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, got.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        (r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows
    )
