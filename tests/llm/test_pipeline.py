"""The pipeline against its stages in SQL, fed with the classifier's choice."""

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from spotweave.llm import oracles  # noqa: E402
from tests.conftest import SF  # noqa: E402


def test_pipeline_equals_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    con = duckdb.connect()
    con.register("kept0", kept.toArrow())
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    con.sql(f"CREATE TABLE l AS WITH src AS (SELECT *, source AS host, doc_id AS doc, text AS t FROM kept0), {oracles.LINES.format(ratio='0.1::DOUBLE', min_pages=5)} SELECT doc_id, kept AS text, source FROM kept")
    con.sql(f"CREATE TABLE n AS WITH docs AS (SELECT * FROM l), {oracles.jaccard(5, 80, 100)} SELECT doc_id, text, source FROM comp WHERE doc_id = component_id")
    con.sql(f"CREATE TABLE b AS WITH docs AS (SELECT * FROM n), {oracles.HITS} SELECT doc_id, text, source FROM dw LEFT JOIN words USING (drow) WHERE n_hit IS NULL")
    want = con.sql(f"WITH docs AS (SELECT * FROM b), {oracles.MIX} SELECT doc_id, text, source, size, taken FROM mixed WHERE taken > 0").fetchall()
    out = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, out.select("doc_id", "text", "source", "size", "taken").collect())) == sorted(want)


def test_stages_return_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a word or two", "en", None, 13), (3, "a word or two", "en", None, 13)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out.collect()
