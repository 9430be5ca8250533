"""What holds for every operator: odd and empty tables, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from comparing import FOLDER, of_spark, of_sql
from veinstone.llm import registry
from veinstone.llm.common import written

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd_folder, name):
    rows = QUERIES[name](spark, odd_folder).collect()
    table = {"op8_warc_salvage": "pages", "op12_ball_tree": "embeddings", "op13_exponion": "embeddings"}.get(name, "documents")
    left_out = {"op12_ball_tree": 6, "op13_exponion": 4}.get(name, 0)
    assert len(rows) == spark.read.parquet(f"{odd_folder}/{table}.parquet").count() - left_out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).collect() == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert of_spark(QUERIES[name](spark, FOLDER)) == of_sql(SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_clashing_columns(spark, odd, tmp_path, name):
    extra = ["size", "kept", "count", "bits", "shard", "label", "page", "score", "block", "source_size", "target", "word_chars", "spans", "ids", "row", "group", "place", "part", "bucket", "node", "set"]
    few = odd.limit(40).withColumns({c: F.lit("clash") for c in extra})
    few.write.parquet(f"{tmp_path}/documents.parquet")
    pages = few.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *extra, *(F.lit(1).alias(c) for c in ("payload", "key", "first", "pages", "refers_to", "archive")))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0, 1, "x"), (2, 0, 0, "x")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    vectors = spark.range(40).selectExpr("id AS vec_id", "transform(sequence(1, 64), k -> float(sin(id * k))) AS embedding", "int(id % 3) AS label")
    vectors.withColumns({c: F.lit("clash") for c in (*extra, "vector", "cluster", "distance", "code", "codes", "error", "n", "sums", "digest", "centroid_sha256")}).write.parquet(f"{tmp_path}/embeddings.parquet")
    items = few.select(F.col("doc_id").alias("item_id"), "text", *extra, *(F.lit("clash").alias(c) for c in ("class", "n", "mark", "hash", "digest", "id")))
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 40


def test_pipeline(spark, odd_folder, empty_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, odd_folder), "stage")
        assert docs.columns == columns, name
    assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd_folder).count() == docs.count()
    assert corpus_pipeline.run(spark, empty_folder).collect() == []
    wide = spark.read.parquet(f"{odd_folder}/documents.parquet").limit(30).withColumns({c: F.lit(1) for c in ("kept", "_nth", "size", "_key", "shards", "n_words")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide = written(stage(spark, wide, odd_folder), "stage")
    assert "n_words" in wide.columns
