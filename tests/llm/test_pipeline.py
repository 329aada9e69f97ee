import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import odd_rows, words

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, docs_of, tmp_path_factory):
    rng = random.Random(15)
    where = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, words(rng, 60, 4000)) for i in range(150)]
    for i in range(100, 150):
        rows[i] = (i, rows[i][1] + " dreadful rotten")
    passage = words(rng, 30, 9000)
    rows += [(200, rows[0][1]), (201, rows[1][1].replace(" ", "  ")), (202, f"{passage} tail words here"), (203, words(rng, 40, 4000) + " mail me at x.y@z.org or 10.1.2.3")]
    rows += [(300 + k if i is not None else None, t) for k, (i, t) in enumerate(odd_rows())]
    docs_of(rows).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, dict(rows)


def test_stages(spark, corpus):
    where, rows = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where).cache()
        seen.append((name, {r.doc_id for r in docs.select("doc_id").collect()}))
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "personal_data":
            text = {r.doc_id: r.text for r in docs.collect()}
            assert text[203].endswith("mail me at [EMAIL] or [IP]")
    kept = dict(seen)
    assert not kept["toxicity"] & set(range(100, 150)) and set(range(100)) <= kept["toxicity"]
    assert {200, 201} <= kept["toxicity"] and not {200, 201} & kept["near_duplicates"] and {0, 1} <= kept["near_duplicates"]
    assert 202 in kept["near_duplicates"] and 202 not in kept["decontamination"]
    assert kept["personal_data"] == kept["decontamination"] == kept["bpe"]
    assert set(range(100)) <= kept["bpe"] and None in kept["bpe"]
    assert all(r.lossless for r in docs.collect())


def test_run(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.count() > 100 and "ids" in got.columns


def test_columns_of_any_name_pass_unchanged(spark, corpus):
    where, _ = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    names = ["t1", "t2", "hash", "toxicity", "Toxicity_", "pii", "pii_", "place", "kept", "id", "score", "component_id", "sig", "key"]
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    wide = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, where), name)
        assert docs.columns == wide.columns
    plain = {r.doc_id for r in corpus_pipeline.run(spark, where).select("doc_id").collect()}
    rows = docs.collect()
    assert {r.doc_id for r in rows} == plain and rows
    assert all(r[n] == f"{n} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for n in names)


def test_stages_on_no_rows(spark, corpus):
    where, _ = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where)
        assert docs.count() == 0


def test_repeated_ids_stay_once(spark, corpus, docs_of):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "seven eight nine ten eleven"), (2, "other words of the same id here"), (None, "a b c"), (None, "a b c"), (3, "one two three four five six")]
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), corpus[0]).collect() if r.doc_id is not None)
    assert got == [1, 2] and corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), corpus[0]).filter("doc_id is null").count() == 2
