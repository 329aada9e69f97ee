"""The log of retrievals, and reports on them: as-of matches that are written back as change rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import prefix
from tesserae.session import settled

OUTCOMES = ["adopted", "corrected", "denied"]
#: Rows of the log and of the changes; facts are arrays without repeats, in order.
EVENT = "id long, scope string, query_hash string, at timestamp, retrieved array<string>"
CHANGE = "report long, at timestamp, event long, scope string, query_hash string, " + ", ".join(f"{o} array<string>" for o in OUTCOMES)


def query_hash(query: Column) -> Column:
    return F.sha2(query.cast("string").cast("binary"), 256)


def fact_set(facts: Column) -> Column:
    """Facts once each, in order, without nulls; of null none."""
    none = F.array().cast("array<string>")
    return F.sort_array(F.array_except(F.coalesce(facts.cast("array<string>"), none), F.array(F.lit(None).cast("string"))))


def matched(log: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports (id, scope, query_hash, at and others) with ``event``: the last entry of the log with their scope and query
    before them, by (at, id). Reports without one, or without a scope or a query, are left out.

    Log and reports are merged in order over ranges of (scope, query, time), so that a scope that holds a
    third of all rows is split between tasks.
    """
    by, order = ["scope", "query_hash"], ["at", "id"]
    hashed = ["hash_", *by]
    payload = [c for c in reports.columns if c not in (*by, *order)]
    told = reports.select(*by, *order, F.lit(None).cast("long").alias("event_"), F.struct(F.lit(True).alias("is_report_"), *payload).alias("r_"))
    empty = F.lit(None).cast(told.schema["r_"].dataType)
    rows = log.select(*by, *order, F.col("id").cast("long").alias("event_"), empty.alias("r_")).unionByName(told)
    # A number before the texts: sorting seldom has to compare them.
    rows = rows.filter(" and ".join(f"{c} is not null" for c in (*by, *order))).withColumn("hash_", F.xxhash64(*by))
    ranged = prefix.by_ranges(rows, hashed, [F.col(c) for c in order])
    found = prefix.last_before(ranged, hashed, order, {"event": F.col("event_")})
    return found.filter("r_ is not null and event is not null").select(*by, *order, "event", *[F.col(f"r_.{c}").alias(c) for c in payload])


def changes(log: DataFrame, reports: DataFrame) -> DataFrame:
    """Change rows (CHANGE) of reports (id, scope, query_hash, at, adopted, corrected, denied): each sets the outcomes of its event as a whole."""
    return matched(log, reports).select(F.col("id").alias("report"), "at", "event", "scope", "query_hash", *[fact_set(F.col(o)).alias(o) for o in OUTCOMES])


def outcomes(log: DataFrame, changed: DataFrame) -> DataFrame:
    """The log with the outcomes of each event's last report, by (at, report); none where there is no report. Repeated change rows alter nothing."""
    last = changed.groupBy(F.col("event").alias("id")).agg(F.max_by(F.struct("report", *OUTCOMES), F.struct("at", "report")).alias("c_"))
    none = F.array().cast("array<string>")
    return log.join(last, "id", "left").select(*log.columns, F.col("c_.report").alias("report"), *[F.coalesce(f"c_.{o}", none).alias(o) for o in OUTCOMES])


def deliver(spark: SparkSession, folder: str, number: int, events: DataFrame, reports: DataFrame, slices: int = 256) -> None:
    """Adds batch ``number`` of events (EVENT) and reports to the store in ``folder``; a batch that comes again replaces itself.

    An event or a report that an earlier batch brought is not written again. Both tables lie in slices of (scope, query); a
    batch reads the slices that it touches. As in a stream, batches come in order, and a report's event with it or before it.
    """
    hash_ = F.xxhash64("scope", "query_hash")
    slice_ = F.pmod(hash_, F.lit(slices)).cast("int").alias("slice_")
    logged = events.select(*[c.split()[0] for c in EVENT.split(", ")], slice_)
    told = settled(reports.select("id", "scope", "query_hash", "at", *OUTCOMES, slice_).dropDuplicates(["id"]))
    touched = [r.slice_ for r in logged.select("slice_").unionByName(told.select("slice_")).distinct().collect()]  # at most ``slices`` numbers

    def stored_rows(name: str, schema: str) -> DataFrame:
        return _read(spark, f"{folder}/{name}", schema).filter(F.col("slice_").isin(touched))

    def new(rows: DataFrame, name: str, schema: str, key: str) -> DataFrame:
        if not number:
            return rows
        return rows.join(stored_rows(name, schema).filter(F.col("batch") < number).select(F.col(key).alias("id")), "id", "left_anti")

    def write(rows: DataFrame, name: str) -> None:
        rows.hint("rebalance", "slice_").write.mode("overwrite").partitionBy("slice_").parquet(f"{folder}/{name}/batch={number}")

    write(new(logged.dropDuplicates(["id"]), "log", EVENT, "id"), "log")
    told = new(told, "changes", CHANGE, "report").drop("slice_")
    # The entries that a report may be on, and few others with their hash; the match itself is by scope and query.
    held = stored_rows("log", EVENT).filter(F.col("batch") <= number).withColumn("hash_", hash_).join(told.select(hash_.alias("hash_")).distinct(), "hash_", "left_semi")
    write(changes(held, told).withColumn("slice_", slice_), "changes")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The log of the store with outcomes."""
    log, changed = (_read(spark, f"{folder}/{name}", schema).drop("batch", "slice_") for name, schema in (("log", EVENT), ("changes", CHANGE)))
    return outcomes(log, changed)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch int, slice_ int").parquet(path)
