"""The pipeline's stages against their operators and plain checks."""

import corpus_pipeline
from sievework.llm import mixing, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.cut(stage(spark, docs, SF))
        kept.append(docs)
        if name != "packing":
            assert docs.columns == first.columns and docs.count() <= before.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r["doc_id"] for r in toxicity.toxic_documents(first, labels).filter("_toxic_predicted = 1").collect()}
    assert {r["doc_id"] for r in kept[0].collect()} == {r["doc_id"] for r in first.collect()} - rejected
    groups = {r["component_id"] for r in simhash.near_duplicates(kept[0]).collect()}
    assert {r["doc_id"] for r in kept[1].collect()} == groups
    assert all(not secrets.base_spans(r["text"] or "") for r in kept[2].collect()) and kept[2].count() == kept[1].count()
    assert {r["doc_id"] for r in kept[3].collect()} == {r["doc_id"] for r in mixing.mixed_documents(kept[2]).filter("_sampled").collect()}
    assert {r["doc_id"] for r in kept[4].collect()} == {r["doc_id"] for r in kept[3].collect()}
    plain = sorted(map(str, docs.drop("sequence_id").collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, SF).drop("sequence_id").collect())) == plain


def test_stages_take_edge_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (3, "a b c", "en", "src1", 5), (3, "a b c", "en", "src1", 5), (None, "token = abcdefghij", None, "src1", 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").selectExpr("*", "1 AS `_tokens`", "'x' AS `a.b`")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.cut(stage(spark, now, str(tmp_path)))
            if name == "secrets":
                assert all("abcdefghij" not in (r["text"] or "") for r in now.collect())
        assert (now.count() == 0) == (start.count() == 0) or start is docs


def test_columns_of_the_user_come_through(spark, tmp_path):
    """Names of helper columns, dots and maps: values stay with their documents up to packing."""
    names = ["_tokens", "_spans", "_toxic_score", "_hash", "_kept_id", "_kept_hash", "_copies", "_weight", "column_0", "a.b"]
    texts = ["one two three %d %s" % (i, " ".join("w%d" % (i * j) for j in range(9))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names], "map('k', doc_id) AS m")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.cut(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns
        found = now.collect()
        assert found
        for r in found:
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names] and r["m"] == {"k": r["doc_id"]}
