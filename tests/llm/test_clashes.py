"""Operators and stages on tables whose other columns carry internal names, on maps, null and repeated ids and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barlab.llm import exact_dedup, quality
from tests.llm.conftest import DOCS, ODD

NAMES = ("__weight", "__quality", "__h", "__key", "__repeats", "__segment", "__k", "__b", "__words", "h", "key", "row", "best", "n", "label", "words",
         "component_id", "class_id", "a", "b", "hash", "block", "item_id")


@pytest.fixture(scope="module")
def wide(make):
    texts = ODD + ["one two three four five six seven"] * 3 + [None]
    ids = [*range(len(ODD)), None, 70, 70, None]
    return make(texts, ids=ids).withColumns({c: F.lit("x") for c in NAMES}).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(12)] + [(1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("q1", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("q2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, wide, sf_dir, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, wide, sf_dir)
    assert out.schema.names == wide.schema.names
    rows = out.collect()
    assert rows and all(r["__weight"] == "x" and r["row"] == "x" for r in rows)
    plain = wide.select(*DOCS.names)
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str(tuple(r)) for r in dict(corpus_pipeline.STAGES)[name](spark, plain, sf_dir).select("doc_id", "text").collect())
    assert dict(corpus_pipeline.STAGES)[name](spark, plain.limit(0), sf_dir).collect() == []


def test_one_row_stays_for_each_text(spark, wide):
    rows = exact_dedup.drop_exact_copies(wide).collect()
    texts = [r.text or "" for r in rows]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in wide.collect()})
    assert next(r.doc_id for r in rows if r.text == "one two three four five six seven") == 70


def test_repeated_labelled_ids_come_to_the_driver_as_counts(spark, make):
    texts = ["good prose about things " * 5, "buy $$$ now !!! " * 5] * 400
    docs = make(texts, ids=[i % 2 for i in range(800)])
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    rows = quality.importance_resample(docs, labels).select("doc_id", "__quality.*").collect()
    assert len(rows) == 800 and len({(r.doc_id, r.weight, r.kept) for r in rows}) == 2
    assert {r.doc_id for r in rows if r.kept} == {0}
