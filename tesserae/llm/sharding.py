"""Sharding: contiguous shards of nearly equal bytes, by prefix sums over range partitions.

Only DataFrame functions run. Rows are put in one global order (content key, then id), so that
equal texts lie side by side. Each range partition reports its bytes and rows; the prefix sums of
those few totals (one row for each partition) place every partition in the global byte line, and a
running sum inside the partition places each row. The line is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import checkpointed

#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (none for null) plus ROW_BYTES."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 40, keep: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """One row for each row of ``df``: id, size, text_crc32, ``keep``, shard (0-based) and slot (its place in the shard).

    A row goes to the shard in which the middle of its bytes falls, so a shard misses its target by
    less than one row at either end. A run of equal texts that is no larger than the largest row moves
    as one row would, and so stays whole under the same bound; a larger one may be cut.

    Null text: no bytes, checksum 0. Null id: a row like others, first among equal texts. Repeated rows
    and ties get places of their own, in an order that is arbitrary but fixed once written. An empty
    table gives no rows. Other columns are dropped unless named in ``keep``.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"),
        text_size(F.col(f"`{text_col}`")).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("key"),
        *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)],
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The partition bounds are sampled, so the dealt rows are fixed by a checkpoint before totals are taken of them.
    dealt = checkpointed(rows.repartitionByRange(n, "key", "crc", "id").withColumn("part", F.spark_partition_id()))

    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = (
        dealt.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("largest"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(everything).alias("bytes_all"),
            F.max("largest").over(everything).alias("largest"),
        )
    )
    run = Window.partitionBy("part").orderBy("key", "crc", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("part", "key", "crc")
    placed = (
        dealt.withColumns({"end": F.sum("size").over(run), "nth": F.row_number().over(run)})
        .withColumns({"run_bytes": F.sum("size").over(same), "run_end": F.max("end").over(same)})
        .join(F.broadcast(totals), "part")  # a row for each range partition
        .withColumn(
            "middle",  # twice the middle of the bytes that move together
            F.when(F.col("run_bytes") <= F.col("largest"), 2 * F.col("run_end") - F.col("run_bytes")).otherwise(2 * F.col("end") - F.col("size")) + 2 * F.col("bytes_before"),
        )
        .withColumn("shard", F.expr(f"cast(least(middle * {n_shards} div (2 * bytes_all), {n_shards - 1}) as int)"))
        .withColumn("nth", F.col("nth") + F.col("rows_before"))
    )
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # n_shards rows
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
        "shard",
        (F.col("nth") - F.col("first")).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 40) -> None:
    """Write all columns of ``df`` as one Parquet folder for each shard, rows in slot order."""
    others = tuple(c for c in df.columns if c != id_col)
    placed = assign_shards(df, id_col, text_col, n_shards, keep=others)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
