"""Upkeep of rollups by change sets: each run reads what arrived since the last one and builds only the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row for each finished run; ``mark`` is how far it has read.
CONTROL = "mark string, rows_read long, touched long, members long, rebuilt long, waiting long"


def digest(*columns: str) -> list[Column]:
    """Aggregates that tell sets of rows apart whatever their order: the count, and two folds of hashes."""
    h = F.xxhash64(*columns)
    return [F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string")).alias("members_hash")]


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The control table: finished runs, numbered from 0."""
    return _read(spark, f"{folder}/control", f"{CONTROL}, run int")


def due(last_ms: int | None, now_ms: int, idle: bool, cooldown_ms: int = 600_000) -> bool:
    """Whether an idle host should start a run: not before the cooldown since the start of the last one."""
    return idle and (last_ms is None or now_ms - last_ms >= cooldown_ms)


def advance(spark: SparkSession, folder: str, source: DataFrame, key: str, arrived: str, bucket: str, build: Callable[[DataFrame], DataFrame], slices: int = 64, budget: int | None = None) -> dict:
    """One run over ``source`` (with columns key, arrived, bucket and what ``build`` needs); returns its row of the control table.

    ``build`` aggregates members to rows of (bucket, ...), with ``members_hash`` from ``digest``. Read are the rows not
    older than the last run's mark, so that rows which arrive at the very mark count too; what was read before
    is known by its key. Members are kept in slices by bucket, and a run reads the slices of its buckets. A bucket
    whose members are as they were isn't written. With a budget the first buckets are built, the others wait for the next
    run and none is lost. A run that fails has no row in the control table; the next one takes its number and writes over it.
    Rows without ``arrived`` are not read, rows without a bucket are not kept.
    """
    done = runs(spark, folder).select("run", "mark").orderBy(F.col("run").desc()).first() if _there(spark, f"{folder}/control") else None
    number, mark = (0, None) if done is None else (done.run + 1, done.mark)
    kind = source.schema[arrived].dataType.simpleString()
    news = source if mark is None else source.filter(F.col(arrived) >= F.lit(mark).cast(kind))
    upto = news.agg(F.max(arrived).cast("string").alias("mark"), F.count(arrived).alias("n")).first()
    if mark is not None and upto.mark is None:
        return {"run": number, "mark": mark, "rows_read": 0, "touched": 0, "members": 0, "rebuilt": 0, "waiting": 0}
    slice_ = F.pmod(F.xxhash64(bucket), F.lit(slices)).cast("int")
    news = news.filter(F.col(bucket).isNotNull() & (F.col(arrived) <= F.lit(upto.mark).cast(kind))).withColumn("slice_", slice_)
    news.hint("rebalance", "slice_").write.mode("overwrite").partitionBy("slice_").parquet(f"{folder}/members/run={number}")

    layout = f"{source.schema.toDDL()}, run int, slice_ int"
    held = _read(spark, f"{folder}/members", layout).filter(F.col("run") <= number)
    touched = held.filter(F.col("run") == number).select(bucket, "slice_").distinct()
    if number and _there(spark, f"{folder}/waiting/run={number - 1}"):
        touched = touched.unionByName(_read(spark, f"{folder}/waiting/run={number - 1}", f"{bucket} {source.schema[bucket].dataType.simpleString()}, slice_ int")).distinct()
    n_touched, waiting = touched.count(), 0
    if budget is not None and n_touched > budget:
        first = [r[0] for r in touched.orderBy(bucket).limit(budget).collect()]
        touched.filter(~F.col(bucket).isin(first)).write.mode("overwrite").parquet(f"{folder}/waiting/run={number}")
        touched, waiting = touched.filter(F.col(bucket).isin(first)), n_touched - budget
    read = [r.slice_ for r in touched.select("slice_").distinct().collect()]  # at most ``slices`` numbers
    members = held.filter(F.col("slice_").isin(read)).join(touched.select(bucket), bucket, "left_semi").dropDuplicates([key]).drop("run", "slice_")
    built = build(members)
    schema = built.schema.toDDL()
    if number:
        before = _current(_read(spark, f"{folder}/artifacts", f"{schema}, run int").filter(F.col("run") < number), bucket).select(bucket, F.col("members_hash").alias("old_"))
        built = built.join(before, bucket, "left").filter(~F.col("members_hash").eqNullSafe(F.col("old_"))).drop("old_")
    path = f"{folder}/artifacts/run={number}"
    built.write.mode("overwrite").parquet(path)
    row = {"mark": upto.mark, "rows_read": upto.n, "touched": n_touched, "members": members.count(), "rebuilt": spark.read.schema(schema).parquet(path).count(), "waiting": waiting}
    spark.range(1).select(*[F.lit(row[c.split()[0]]).cast(c.split()[1]).alias(c.split()[0]) for c in CONTROL.split(", ")]).write.mode("overwrite").parquet(f"{folder}/control/run={number}")
    return {"run": number, **row}


def artifacts(spark: SparkSession, folder: str, bucket: str) -> DataFrame:
    """The latest artifact of each bucket over the finished runs; ``run`` is the one that built it."""
    last = runs(spark, folder).agg(F.max("run")).first()[0]
    return _current(spark.read.parquet(f"{folder}/artifacts").filter(F.col("run") <= last), bucket)


def _current(rows: DataFrame, bucket: str) -> DataFrame:
    return rows.groupBy(bucket).agg(F.max_by(F.struct("*"), "run").alias("a_")).select("a_.*")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a folder of the store exists, on whatever file system it lies."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
