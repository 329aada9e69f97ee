"""Change logs, versions and lifecycle: state as append-only rows and windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.filters import valid_at


def latest(log: DataFrame, key: str | list[str], seq: str | list[str], deleted: Column | None = None) -> DataFrame:
    """The last row of each key by seq; keys whose last row is a deletion are gone."""
    keys, seqs = ([key] if isinstance(key, str) else key), ([seq] if isinstance(seq, str) else seq)
    order = Window.partitionBy(*keys).orderBy(*[F.col(s).desc() for s in seqs])
    kept = log.withColumn("nth_", F.row_number().over(order)).filter("nth_ = 1").drop("nth_")
    return kept if deleted is None else kept.filter(~deleted)


def compact(log: DataFrame, key: str, seq: str, deleted: Column) -> DataFrame:
    """A snapshot that replays to the same state as the whole log; a key deleted and written again is there once."""
    return latest(log, key, seq, deleted)


def close_versions(rows: DataFrame, key: list[str], start: str, ties: list[str], stop: str = "valid_to", fallback: Column | None = None) -> DataFrame:
    """Adds valid_from and valid_to: a version ends where the next of its key starts, at least one unit after its own start.

    ``stop``, where the input has it and it isn't null, is kept; the last version ends at ``fallback`` or stays open.
    """
    order = Window.partitionBy(*key).orderBy(start, *ties)
    following = F.lead(start).over(order)
    end = F.when(following.isNotNull(), F.greatest(following, F.col(start) + F.lit(1)))
    if fallback is not None:
        end = F.coalesce(end, fallback)
    own = F.col(stop) if stop in rows.columns else F.lit(None).cast("long")
    return rows.withColumns({"valid_from": F.col(start), "valid_to": F.coalesce(own, end)})


def number_versions(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds version (1, 2, ...), closed_at (the next version's record time) and is_latest."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumns({"version": F.row_number().over(w), "closed_at": F.lead(order[0]).over(w), "is_latest": F.lead(F.lit(1)).over(w).isNull()})


def as_of(versions: DataFrame, probes: DataFrame, key: str, moment: str) -> DataFrame:
    """Each probe with the version of its key that is valid at its moment (left join on the key; versions don't overlap).

    Both sides are merged and ordered once per key: the last version that began before a probe is carried on.
    """
    payload = [c for c in versions.columns if c not in (key, "valid_from", "valid_to")]
    v = versions.select(F.col(key), F.col("valid_from").alias("t_"), F.lit(0).alias("probe_"), F.struct("valid_from", "valid_to", *payload).alias("v_"), F.lit(None).cast(probes.drop(key).schema).alias("p_"))
    p = probes.select(F.col(key), F.col(moment).alias("t_"), F.lit(1).alias("probe_"), F.lit(None).cast(v.schema["v_"].dataType).alias("v_"), F.struct(*[c for c in probes.columns if c != key]).alias("p_"))
    order = Window.partitionBy(key).orderBy("t_", "probe_").rowsBetween(Window.unboundedPreceding, 0)
    merged = v.unionByName(p).withColumn("v_", F.last("v_", ignorenulls=True).over(order)).filter("probe_ = 1")
    held = F.when(valid_at(F.col("t_"), F.col("v_.valid_from"), F.col("v_.valid_to")), F.col("v_"))
    return merged.select(key, "p_.*", held.alias("v_")).select(key, *[c for c in probes.columns if c != key], "v_.*")


def last_match(events: DataFrame, logged: DataFrame, key: list[str], seq: str, log_seq: str, payload: str) -> DataFrame:
    """Each event with the payload of the latest logged row of its key before it (null without one)."""
    a = logged.select(*key, F.col(log_seq).alias("t_"), F.lit(0).alias("probe_"), F.col(payload).alias("found_"), F.lit(None).cast(events.select(F.struct("*")).schema[0].dataType).alias("e_"))
    b = events.select(*key, F.col(seq).alias("t_"), F.lit(1).alias("probe_"), F.lit(None).cast(logged.schema[payload].dataType).alias("found_"), F.struct("*").alias("e_"))
    order = Window.partitionBy(*key).orderBy("t_", "probe_").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("found_", F.last("found_", ignorenulls=True).over(order)).filter("probe_ = 1").select("e_.*", F.col("found_").alias(f"matched_{payload}"))


def prune(rows: DataFrame, scope: list[str], limit: int, order: list[Column]) -> DataFrame:
    """Adds keep: the first ``limit`` rows of each scope, active ones before others, then by ``order``."""
    w = Window.partitionBy(*scope).orderBy((F.col("status") == "active").desc(), *order)
    return rows.withColumn("keep", F.row_number().over(w) <= limit)


def last_n(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(order).desc())
    return rows.withColumn("nth_", F.row_number().over(w)).filter(F.col("nth_") <= n).drop("nth_")


def recent_context(messages: DataFrame, group: str, order: str, text: str, n: int = 6, per_message: int = 600, total: int = 2400) -> DataFrame:
    """The last n messages of each group, each cut, from the newest back while the budget lasts; the oldest that still fits in part is cut to it."""
    w = Window.partitionBy(group).orderBy(F.col(order).desc())
    cut = messages.withColumn("nth_", F.row_number().over(w)).filter(F.col("nth_") <= n).withColumn("cut_", F.substring(text, 1, per_message))
    before = F.coalesce(F.sum(F.length("cut_")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(total) - before
    return cut.withColumn("room_", room).filter("room_ > 0").withColumn("context", F.expr("substring(cut_, 1, cast(room_ as int))")).drop("nth_", "cut_", "room_")


def page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next page by key: rows beyond the cursor, at most 500."""
    ahead = rows if after is None else rows.filter(F.col(key) > F.lit(after))
    return ahead.orderBy(key).limit(max(1, min(500, size)))


def supersede(existing: DataFrame, incoming: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """All rows after writing ``incoming`` (one row a key: key, id, value, start, confidence, action) over ``existing`` active ones.

    An incoming value that is sure enough, or told to, ends the active one of its key; otherwise it is
    itself put aside as conflicted. Equal values change nothing.
    """
    new = incoming.select("key", F.struct("id", "value", "start", "confidence", "action").alias("n"))
    both = existing.join(new, "key", "left")
    differs = F.col("n").isNotNull() & (F.col("n.value") != F.col("value")) & (F.col("status") == "active")
    allowed = F.coalesce(F.col("n.action") == "SUPERSEDE", F.col("n.confidence") >= min_confidence)
    closed = both.select(
        "key", "id", "value", "start",
        F.when(differs & allowed, F.greatest(F.col("n.start"), F.col("start") + F.lit(1))).otherwise(F.col("stop")).alias("stop"),
        F.when(differs & allowed, "superseded").otherwise(F.col("status")).alias("status"),
        F.lit(None).cast("string").alias("supersedes"),
    )
    active = existing.filter("status = 'active'").select("key", F.col("id").alias("old"), F.col("value").alias("old_value"))
    fresh = incoming.join(active, "key", "left").filter("old is null or old_value <> value")
    ok = F.coalesce(F.col("action") == "SUPERSEDE", F.col("confidence") >= min_confidence)
    written = fresh.select(
        "key", "id", "value", "start", F.lit(None).cast("long").alias("stop"),
        F.when(F.col("old").isNull() | ok, "active").otherwise("conflicted").alias("status"),
        F.when(F.col("old").isNotNull() & ok, F.col("old").cast("string")).alias("supersedes"),
    )
    return closed.unionByName(written)


def unlink_sources(rows: DataFrame, removed: Column) -> DataFrame:
    """Takes source ids away; automatic active rows that lose their last one become orphaned."""
    left = F.array_except("source_ids", removed)
    lost = (F.size("source_ids") > 0) & (F.size(left) == 0) & (F.col("status") == "active") & (F.col("origin") != "manual")
    return rows.withColumns({"status": F.when(lost, "orphaned").otherwise(F.col("status")), "source_ids": left})


def close_superseded(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Fills valid_to of superseded rows of single-valued keys (key, cardinality, status, start, created_at, updated_at): where the
    next row of the key starts, at least one unit after its own start; the last one ends when it was updated."""
    chained = F.col("key").isNotNull() & (F.col("cardinality") == "single")
    following = F.lead("start").over(Window.partitionBy(*scope, "key", chained).orderBy("start", "created_at", "id"))
    end = F.greatest(F.coalesce(following, F.col("updated_at")), F.col("start") + F.lit(1))
    return rows.withColumn("valid_to", F.coalesce(F.col("valid_to"), F.when(chained & (F.col("status") == "superseded"), end)))


def removed(rows: DataFrame, ids: DataFrame | None = None, scope: Column | None = None) -> DataFrame:
    """Rows without those that are forgotten or purged (ids) or whose scope is cleared; nothing of them is left."""
    left = rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_anti")
    return left if scope is None else left.filter(~scope)


def newest(rows: DataFrame, order: str, limit: int, ties: str = "id") -> DataFrame:
    """The newest rows, 1 to 1000 of them."""
    return rows.orderBy(F.col(order).desc(), ties).limit(max(1, min(1000, limit)))


def conflicting(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(incoming, stored) ids of active rows of the same scope (owner, agent, session) and key whose content differs."""
    n = incoming.select(F.col("id").alias("incoming"), "owner", "agent", F.col("session").alias("s_"), "key", F.lower("content").alias("c_"))
    old = stored.filter("status = 'active'").select(F.col("id").alias("stored"), "owner", "agent", F.col("session").alias("t_"), "key", F.lower("content").alias("d_"))
    return n.join(old, ["owner", "agent", "key"]).filter(F.col("s_").eqNullSafe(F.col("t_")) & (F.col("c_") != F.col("d_"))).select("incoming", "stored")
