"""The side index of vectors: rows (id, model, content_hash, vector), read only where they are of the text as it is now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import vector

MODEL = "local-hash-384"


def put(index: DataFrame | None, memories: DataFrame, model: str = MODEL) -> DataFrame:
    """The index with vectors for memories (id, content): a row for each id and model, the new one in place of an older."""
    fresh = memories.select("id", F.lit(model).alias("model"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), vector.local_embedding(F.col("content")).alias("vector"))
    return fresh if index is None else index.join(fresh.select("id", "model"), ["id", "model"], "left_anti").unionByName(fresh)


def with_vectors(memories: DataFrame, index: DataFrame, model: str = MODEL) -> DataFrame:
    """memories with the column vector: null where there is none of this model for the content as it is now."""
    known = index.filter(F.col("model") == model).select("id", "content_hash", "vector")
    return memories.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256)).join(known, ["id", "content_hash"], "left").drop("content_hash")


def prepared(memories: DataFrame, index: DataFrame, model: str = MODEL) -> DataFrame:
    """The index with vectors for those memories that lack a current one; what is current isn't made again."""
    stale = with_vectors(memories, index, model).filter("vector is null").drop("vector")
    return put(index, stale, model)


def reconciled(index: DataFrame, memories: DataFrame) -> DataFrame:
    """The index without vectors of ids that no memory has."""
    return index.join(memories.select("id"), "id", "left_semi")


def coverage(memories: DataFrame, index: DataFrame, model: str = MODEL) -> DataFrame:
    """One row: total, ready and pending memories."""
    ready = F.count("vector")
    return with_vectors(memories, index, model).agg(F.count(F.lit(1)).alias("total"), ready.alias("ready"), (F.count(F.lit(1)) - ready).alias("pending"))
