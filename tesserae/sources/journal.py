"""Journals and snapshots at rest: change logs with a hash chain, and AES-GCM payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import integrity, state

#: Entries or bytes from which a journal is folded into a new snapshot.
COMPACT_ENTRIES, COMPACT_BYTES = 500, 16 << 20


def sealed(df: DataFrame, key: bytes, columns: list[str] | None = None) -> DataFrame:
    """seq, payload: each row's columns as JSON under AES-256-GCM with a random IV."""
    columns = columns or [c for c in df.columns if c != "seq"]
    return df.select("seq", F.aes_encrypt(F.to_json(F.struct(*columns)), F.lit(key), F.lit("GCM")).alias("payload"))


def opened(sealed_rows: DataFrame, key: bytes, schema: str) -> DataFrame:
    """The rows again; a payload that was changed or belongs to another key fails the query."""
    plain = F.aes_decrypt("payload", F.lit(key), F.lit("GCM")).cast("string")
    return sealed_rows.select("seq", F.from_json(plain, schema).alias("r")).select("seq", "r.*")


def append(spark: SparkSession, path: str, entries: DataFrame, journal: str = "main") -> None:
    """Append entries (seq, payload string) to the journal at ``path``, chained to its last entry.

    Entries become new files that are visible as a whole or not at all.
    """
    chained = integrity.chained(entries.withColumn("journal", F.lit(journal)), F.col("journal"), "seq", F.col("payload"))
    try:
        last = spark.read.parquet(path).filter(F.col("journal") == journal).agg(F.max(F.struct("seq", "hash")).alias("m")).select("m.*").first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    if last is not None and last.seq is not None:
        chained = chained.withColumn("previous_hash", F.when(F.col("previous_hash") == "", last.hash).otherwise(F.col("previous_hash")))
    chained.select("journal", "seq", "payload", "hash", "previous_hash").write.mode("append").parquet(path)


def verified(spark: SparkSession, path: str, journal: str = "main") -> DataFrame:
    """The journal in order, if its chain holds; else an error that names the first entry that breaks it."""
    rows = spark.read.parquet(path).filter(F.col("journal") == journal)
    broken = integrity.broken_links(rows, "journal", "seq", F.col("payload")).orderBy("seq").first()
    if broken is not None:
        raise ValueError(f"journal {journal}: the chain breaks at entry {broken.seq}")
    return rows


def replay(snapshot: DataFrame | None, changes: DataFrame, key: str) -> DataFrame:
    """State from a snapshot and changes (seq, op 'U' or 'D', key, other columns): later changes win, deletes win within one."""
    log = changes if snapshot is None else changes.unionByName(snapshot.withColumns({"seq": F.lit(-1).cast("long"), "op": F.lit("U")}), allowMissingColumns=True)
    log = log.withColumn("last_", F.when(F.col("op") == "D", 1).otherwise(0))
    return state.latest(log, key, ["seq", "last_"], F.col("op") == "D").drop("seq", "op", "last_")


def needs_compaction(changes: DataFrame, size: int) -> bool:
    return size >= COMPACT_BYTES or changes.limit(COMPACT_ENTRIES).count() >= COMPACT_ENTRIES


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON snapshot of rows; a malformed row fails the read instead of being dropped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def recovered(lines: DataFrame, seq: str = "seq", line: str = "line", schema: str = "seq long, op string, id string, v long") -> DataFrame:
    """The entries of a journal of JSON lines: a last line that was cut off is dropped; any other bad line, or a gap, is an error.

    Nothing is written, so this is also the read-only view.
    """
    rows = lines.withColumn("entry_", F.from_json(line, schema, {"mode": "PERMISSIVE"}))
    good = F.col("entry_").isNotNull() & F.col(f"entry_.{seq}").eqNullSafe(F.col(seq))
    marked = rows.select(seq, "entry_", good.alias("good_"))
    first_bad, last = marked.agg(F.min(F.when(~F.col("good_"), F.col(seq))), F.max(seq)).first()
    n = marked.count()
    if first_bad is not None and first_bad != last:
        raise ValueError(f"the journal breaks at entry {first_bad}")
    if n and last != n:
        raise ValueError(f"the journal has {n} entries and ends with number {last}")
    return marked.filter("good_").select("entry_.*")


def publish(spark: SparkSession, path: str, rows: DataFrame, violations: DataFrame) -> int | None:
    """Writes a version of a table and, if no violation (n > 0) is found, makes it the one that ``published`` reads; its number, or None.

    The version is written whole before one small row points to it, so readers see the old one or the new one.
    """
    if violations.filter("n > 0").limit(1).count():
        return None
    known = _pointers(spark, path)
    number = 1 if known is None else known.agg(F.max("version")).first()[0] + 1
    rows.write.mode("overwrite").parquet(f"{path}/version={number}")
    spark.range(1).select(F.lit(number).alias("version")).coalesce(1).write.mode("append").parquet(f"{path}/_pointers.parquet")
    return number


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/_pointers.parquet")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the latest version that was made public."""
    known = _pointers(spark, path)
    if known is None:
        raise ValueError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/version={known.agg(F.max('version')).first()[0]}")


def backup(spark: SparkSession, source: str, target: str, purged: DataFrame | None = None, key: str = "id") -> None:
    """A copy of a table, without purged rows where some are named: what is purged must not live on in backups."""
    rows = spark.read.parquet(source)
    (rows if purged is None else rows.join(purged.select(key).distinct(), key, "left_anti")).write.mode("overwrite").parquet(target)
