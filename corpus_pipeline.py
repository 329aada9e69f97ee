"""The corpus pipeline: documents in, token ids of the clean ones out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, decontaminate, minhash, pii, toxicity
from tesserae.llm.common import parted, short_batches, unused, written
from tesserae.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learnt from all labels, is below the threshold.

    Null and empty texts stay, repeated rows are judged alike, and a text of any length is scored whole.
    An empty table gives no rows. Columns beyond those of documents pass unchanged, whatever their names.
    """
    short_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = unused(docs.columns, "toxicity")
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), out=out)
    return scored.filter((F.col(out) < toxicity.THRESHOLD) | (F.coalesce(F.octet_length("text"), F.lit(0)) == 0)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (of the least id) of each group that links of 0.8 on 5-word shingles join; repeated ids once.

    Documents without words are in no group and stay, and so do those with a null id. An empty table gives
    no rows. Columns beyond those of documents pass unchanged. Only texts of documents that go, or whose id
    repeats, are shuffled.
    """
    short_batches(spark)
    groups = minhash.near_duplicates(docs, shingle=5, percent=80).select(F.col("doc_id").alias("id"), "kept").filter("id is not null")
    looked = written(groups.groupBy("id").agg(F.bool_or(~F.col("kept")).alias("goes"), F.count(F.lit(1)).alias("n")).filter("goes or n > 1"), "near-duplicates").select("id", "goes", F.xxhash64("id").alias("hash"))
    touched, others = parted(docs, F.xxhash64("doc_id"), looked, "hash")
    goes = looked.filter("goes").select(F.col("id").alias("doc_id"))
    left = touched.filter("doc_id is not null").join(goes, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return others.unionByName(left).unionByName(touched.filter("doc_id is null")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in 20 lies in a 13-word window of the benchmark, or none does.

    Null, empty and wordless texts stay; equal texts go or stay together. An empty table, or an empty
    benchmark, drops nothing. Columns beyond those of documents pass unchanged. Only texts that may go are shuffled.
    """
    short_batches(spark)
    counts, spans = decontaminate.shared_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = written(decontaminate.contaminated(counts, spans).filter("contaminated").select("t1", "t2").distinct(), "contaminated")
    text = F.coalesce(F.col("text"), F.lit(""))
    touched, others = parted(docs, F.xxhash64(text), bad, "t1")
    a, b = unused(docs.columns, "t1"), unused(docs.columns, "t2")
    named = touched.withColumns({a: F.xxhash64(text), b: F.xxhash64(F.lit(1), text)})
    left = named.join(bad.select(F.col("t1").alias(a), F.col("t2").alias(b)), [a, b], "left_anti")
    return others.unionByName(left.select(*docs.columns)).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars follows the text.

    Null texts stay null and keep their n_chars. Repeated rows are masked alike, texts of any length whole.
    An empty table gives no rows. Columns beyond those of documents pass unchanged.
    """
    short_batches(spark)
    found = pii.find(docs, mask=True, out=unused(docs.columns, "pii"))
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and lossless (the ids decode to the text) of all documents.

    Null and empty texts have no ids and count as lossless. Repeated rows give equal rows; other columns are dropped.
    """
    short_batches(spark)
    return bpe.tokenized(docs, tokenizer_path(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("bpe", tokenize),
]

#: SQL cannot express the classifier, the field or the merges; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
