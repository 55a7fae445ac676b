import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before[name] = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = ids(before["ngram_jaccard_join"])
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    from tests.llm.test_jaccard import brute

    rows = [(r.doc_id, r.text) for r in before["ngram_jaccard_join"].collect()]
    assert ids(before["secret_scan"]) == {c for _, _, c in brute(rows)}
    assert before["mixing"].count() == before["secret_scan"].count()
    final = {r.doc_id for r in docs.collect()}
    assert final <= ids(before["mixing"]) and docs.count() == before["byte_bpe"].count()


def test_awkward_rows_and_clashing_names(spark, sf):
    from tessera.llm.textbatch import pick
    from tests.llm.fixtures import SCHEMA, documents

    df = pick(spark.createDataFrame(documents(), SCHEMA), doc_id="doc_id", text="text", lang="lang", source="source", key="key", row="Text", score="lang", n="n_chars", copies="source")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, df, sf).columns == df.columns
    out = pipeline.drop_near_duplicates(spark, df, sf).collect()
    assert len([r for r in out if r.doc_id == 3]) == 1
    assert len({r.text for r in out if r.doc_id is None}) == 1
    assert {r.key for r in out} <= {"k", None}
    assert pipeline.mix_sources(spark, df, sf).count() > 0 and pipeline.redact_secrets(spark, df, sf).count() == df.count()
    assert pipeline.drop_toxic(spark, df, sf).count() <= df.count()


def test_clashing_names_and_rows_that_differ_in_other_columns_alone(spark, sf):
    from tests.llm.fixtures import SCHEMA, documents

    rows = documents()
    rows += [(7000 + i, f"own words number {i} " * (9 + i), "en", s, 1, e, "k") for i in range(4) for s in ("src1", "src2") for e in ("a", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, stage in pipeline.STAGES:
        out = stage(spark, df, sf)
        got = out.collect()
        assert name == "byte_bpe" or out.columns == df.columns
        assert set(map(tuple, got)) <= set(rows) or name in ("secret_scan", "byte_bpe")
    near = [tuple(r) for r in pipeline.drop_near_duplicates(spark, df, sf).collect()]
    assert sum(r[0] == 7000 for r in near) == 1
    mixed = [tuple(r) for r in pipeline.mix_sources(spark, df, sf).collect()]
    sources = {r[3] for r in mixed if r[0] is not None and r[0] >= 7000}
    assert sources == {"src1", "src2"}


def test_empty_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, df, sf).count() == 0
