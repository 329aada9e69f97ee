"""Constraints as queries that must be empty, diffs of two stores, and hash chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import stored_once


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """check, n: the rows of each query that should have none."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose (non-null) key no parent has."""
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().filter("count > 1")


def outside(rows: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return rows.filter(~F.col(column).between(low, high))


def diff(source: DataFrame, mirror: DataFrame, key: str, compared: dict[str, str]) -> DataFrame:
    """key and code of each difference: MISSING_FACT, UNEXPECTED_ACTIVE_FACT, DUPLICATE_FACT or a code of ``compared`` {code: column}."""
    m = mirror.groupBy(key).agg(F.count(F.lit(1)).alias("copies_"), F.first(F.struct(*compared.values())).alias("m_"))
    both = source.select(key, F.struct(*compared.values()).alias("s_")).join(m, key, "full_outer")
    codes = F.array(
        F.when(F.col("copies_").isNull(), F.lit("MISSING_FACT")),
        F.when(F.col("s_").isNull(), F.lit("UNEXPECTED_ACTIVE_FACT")),
        F.when(F.col("copies_") > 1, F.lit("DUPLICATE_FACT")),
        *[F.when(F.col("s_").isNotNull() & F.col("m_").isNotNull() & ~F.col(f"s_.{c}").eqNullSafe(F.col(f"m_.{c}")), F.lit(code)) for code, c in compared.items()],
    )
    return both.select(key, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def chained(journal: DataFrame, group: Column, seq: str, payload: Column) -> DataFrame:
    """Adds hash (of the payload) and previous_hash (of the entry before in its group; '' for the first)."""
    w = Window.partitionBy(group).orderBy(seq)
    hashed = journal.withColumn("hash", F.sha2(payload.cast("binary"), 256))
    return hashed.withColumn("previous_hash", F.coalesce(F.lag("hash").over(w), F.lit("")))


def broken_links(journal: DataFrame, group: str, seq: str, payload: Column) -> DataFrame:
    """Entries whose hash isn't their payload's, whose previous hash isn't the hash before, or that don't follow by one."""
    w = Window.partitionBy(group).orderBy(seq)
    checked = journal.withColumns({"want_": F.coalesce(F.lag("hash").over(w), F.lit("")), "step_": F.col(seq) - F.lag(seq).over(w)})
    return checked.filter((F.col("hash") != F.sha2(payload.cast("binary"), 256)) | (F.col("previous_hash") != F.col("want_")) | (F.coalesce("step_", F.lit(1)) != 1)).drop("want_", "step_")


def cycles(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Nodes on a cycle, of any length, where each node has at most one edge out (supersession chains).

    Pointers are doubled: after k rounds each node knows where 2^k steps lead, and one that leaves the
    graph is dropped. Once 2^k is the number of nodes or more, only nodes that lead into a cycle are
    left, and where they lead to is on it; each node of a cycle is led to, as steps permute the cycle.
    Steps are stored tables: a checkpoint's estimate of its size would be squared in each round.
    """
    step = stored_once(edges.select(F.col(src).alias("node"), F.col(dst).alias("at")), "steps")
    n, length = step.count(), 1
    while length < n:
        step = stored_once(step.join(step.select(F.col("node").alias("at"), F.col("at").alias("far")).hint("merge"), "at").select("node", F.col("far").alias("at")), "steps")
        length *= 2
        n = min(n, step.count())  # what leads into no cycle doesn't lengthen a walk
    return step.select("at").join(step.select(F.col("node").alias("at")), "at", "left_semi").select(F.col("at").alias("node")).distinct()
