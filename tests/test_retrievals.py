import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import retrievals
from tesserae.streaming import jobs

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
REPORT = "id long, scope string, query_hash string, at timestamp, adopted array<string>, corrected array<string>, denied array<string>"


def made(seed):
    """Entries and reports in order of time; scope 'hot' has half of them, and some have no scope or no query."""
    random.seed(seed)
    log, reports = [], []
    for i in range(400):
        scope, query, at = random.choice(["hot", "hot", "b", None]), random.choice(["q1", "q2", "q3", None]), BASE + dt.timedelta(minutes=i // 2)
        facts = [random.choice(["f1", "f2", None, "f1"]) for _ in range(random.randint(0, 4))]
        if random.random() < 0.5:
            log.append((i, scope, query, at, facts))
        else:
            reports.append((i, scope, query, at, facts, random.choice([None, ["x", "x"]]), None))
    return log, reports


def plain(log, reports):
    held = {r[0]: [None, [], [], []] for r in log}
    for r in sorted(reports, key=lambda r: (r[3], r[0])):
        before = [e for e in log if None not in (e[1], e[2]) and e[1:3] == r[1:3] and (e[3], e[0]) < (r[3], r[0])]
        if before:
            held[max(before, key=lambda e: (e[3], e[0]))[0]] = [r[0], *(sorted({f for f in part or [] if f}) for part in r[4:])]
    return {(k, *map(str, v)) for k, v in held.items()}


def found(df):
    return {(r.id, str(r.report), str(r.adopted), str(r.corrected), str(r.denied)) for r in df.collect()}


def frames(spark, log, reports):
    return spark.createDataFrame(log, retrievals.EVENT), spark.createDataFrame(reports, REPORT)


def test_the_last_report_holds(spark):
    log, reports = made(1)
    events, told = frames(spark, log, reports)
    assert found(retrievals.outcomes(events, retrievals.changes(events, told))) == plain(log, reports)


def test_no_reports_and_no_log(spark):
    log, reports = made(2)
    events, told = frames(spark, log, reports)
    none, nothing = frames(spark, [], [])
    assert found(retrievals.outcomes(events, retrievals.changes(events, nothing))) == plain(log, [])
    assert retrievals.changes(none, told).count() == 0


def test_batches_delivered_again_change_nothing(spark, tmp_path):
    log, reports = made(3)
    cuts = [BASE + dt.timedelta(minutes=m) for m in (0, 60, 130, 300)]
    part = lambda rows, i, back=0: [r for r in rows if cuts[i] - dt.timedelta(minutes=back) <= r[3] < cuts[i + 1]]
    for number, back in ((0, 0), (1, 0), (1, 0), (2, 40)):
        retrievals.deliver(spark, str(tmp_path), number, *frames(spark, part(log, number, back), part(reports, number, back)), slices=4)
    assert found(retrievals.stored(spark, str(tmp_path))) == plain(log, reports)
    for name, key in (("log", "id"), ("changes", "report")):
        written = spark.read.parquet(f"{tmp_path}/{name}")
        assert written.count() == written.select(key).distinct().count()


def test_a_failed_batch_of_a_stream_is_taken_once(spark, tmp_path):
    log, reports = made(4)
    events, told = frames(spark, log, reports)
    rows = events.select("*", F.lit(None).cast("struct<a:array<string>,c:array<string>,d:array<string>>").alias("r")).unionByName(
        told.select("id", "scope", "query_hash", "at", F.lit(None).cast("array<string>").alias("retrieved"), F.struct(F.col("adopted").alias("a"), F.col("corrected").alias("c"), F.col("denied").alias("d")).alias("r"))
    )
    failed = []

    def write(batch, number):
        retrievals.deliver(spark, f"{tmp_path}/store", number, batch.filter("r is null").drop("r"), batch.filter("r is not null").select("id", "scope", "query_hash", "at", "r.a", "r.c", "r.d").toDF(*[c.split()[0] for c in REPORT.split(", ")]), slices=2)
        if not failed:
            failed.append(number)
            raise RuntimeError("after the write, before the stream knows of it")

    rows.coalesce(1).write.parquet(f"{tmp_path}/source")
    stream = lambda: jobs.micro_batches(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/source"), write, f"{tmp_path}/marks")
    with pytest.raises(Exception, match="after the write"):
        stream().awaitTermination()
    stream().awaitTermination()
    assert failed == [0]
    assert found(retrievals.stored(spark, f"{tmp_path}/store")) == plain(log, reports)


def test_a_batch_reads_its_reports_once_and_its_entries_twice(spark, tmp_path):
    log, reports = made(5)
    seen = {name: spark.sparkContext.accumulator(0) for name in ("log", "reports")}

    def counted(df, name):
        def count(scope, n=seen[name]):
            n.add(1)
            return scope

        return df.withColumn("scope", F.udf(count, "string")("scope"))

    events, told = frames(spark, log, reports)
    for number in (0, 1):
        retrievals.deliver(spark, str(tmp_path), number, counted(events, "log"), counted(told, "reports"), slices=4)
    assert seen["reports"].value == 2 * len(reports) and seen["log"].value <= 4 * len(log)
    assert found(retrievals.stored(spark, str(tmp_path))) == plain(log, reports)
